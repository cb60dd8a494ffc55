"""RSS and Atom feeds read as XML, both dialects in one schema, broken entries kept apart (SRC-12)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BROKEN = "_broken"
_ITEM = f"title string, description string, link string, guid string, identifier string, doi string, pubDate string, date string, {BROKEN} string"
_ENTRY = f"title string, summary string, content string, link array<struct<_href: string, _rel: string>>, id string, identifier string, doi string, published string, updated string, {BROKEN} string"


def _elements(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    """The elements of one name in all files of a folder, wherever they stand; prefixes of names are dropped.

    Sets the session to read XML element by element: Spark's other reader gives up a file at its first broken element.
    """
    spark.conf.set("spark.sql.legacy.useLegacyXMLParser", True)
    reader = spark.read.format("xml").schema(schema).option("rowTag", tag).option("ignoreNamespace", True)
    return reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BROKEN).load(path)


def _time(*texts: str) -> Column:
    """The first time that can be read, of RFC 822 or ISO 8601."""
    short = lambda c: F.regexp_replace(F.regexp_replace(F.trim(c), r"^[A-Za-z]{3},\s*", ""), r"\s+(GMT|UT|Z)$", " +0000")
    return F.coalesce(*[x for c in texts for x in (F.try_to_timestamp(short(c), F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(F.col(c)))])


def read_feeds(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(entries, broken) of the feeds in a folder: dialect, title, description, link, identifier and published; and dialect and text of entries that are no well-formed XML, with what could be read of the title.

    An Atom entry's link is that to the page itself (no `rel`, or `alternate`), its description the summary, else the content. The identifier is a
    DOI field, else the Dublin Core one, else a `guid` or `id`. Texts are as they stand: `bibliography.feed_items` strips them.
    """
    items = _elements(spark, path, "item", _ITEM)
    rss = items.select(F.lit("rss").alias("dialect"), "title", "description", F.trim("link").alias("link"), F.coalesce("doi", "identifier", "guid").alias("identifier"), _time("pubDate", "date").alias("published"), BROKEN)
    entries = _elements(spark, path, "entry", _ENTRY)
    own = F.filter("link", lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate")
    atom = entries.select(F.lit("atom").alias("dialect"), "title", F.coalesce("summary", "content").alias("description"), F.get(own, F.lit(0))["_href"].alias("link"), F.coalesce("doi", "identifier", "id").alias("identifier"), _time("published", "updated").alias("published"), BROKEN)
    both = rss.unionByName(atom)
    # both results keep another column of the source, as Spark refuses to read the text of broken elements alone
    return both.filter(F.col(BROKEN).isNull()).drop(BROKEN), both.filter(F.col(BROKEN).isNotNull()).select("dialect", F.col(BROKEN).alias("text"), "title")
