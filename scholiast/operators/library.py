"""Library, planner and link tables: listing with folders, moves with side effects, links, index tables (FLT-08, DML, SRC)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholiast.functions import text as T

# fixed values: kinds of link between a manuscript and a paper
LINK_TYPES = ["cites", "contrasts", "supports", "background", "extends", "related"]
#: Columns of a paper in which the library looks.
SEARCHED = ("title", "authors", "year", "doi", "journal")


def _found(papers: DataFrame, asked: str) -> DataFrame:
    said = F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in SEARCHED if c in papers.columns]))
    return papers.filter(F.contains(said, F.lit(asked.lower().strip())))


def listing(papers: DataFrame, membership: DataFrame, asked: str = "", folder: str | None = None) -> DataFrame:
    """Papers (paper_id, title, authors, year, ...) whose searched columns hold `asked` without regard to case, in a folder, in none ('unfiled') or in any (None), by title without case, then id (FLT-08, SRT-02)."""
    met = _found(papers, asked).join(membership.select("paper_id", "folder_id"), "paper_id", "left")
    if folder == "unfiled":
        met = met.filter("folder_id is null")
    elif folder is not None:
        met = met.filter(F.col("folder_id") == folder)
    return met.orderBy(F.lower("title"), "paper_id")


def totals(papers: DataFrame, membership: DataFrame, folders: DataFrame, asked: str = "", folder: str | None = None) -> DataFrame:
    """(name, n): the papers found, all, those in no folder, and those in each folder, where papers that are gone don't count (FLT-08, AGG-16)."""
    n = F.count(F.lit(1)).alias("n")
    one = lambda rows, name: rows.agg(n).select(F.lit(name).alias("name"), "n")
    live = membership.join(papers.select("paper_id"), "paper_id", "left_semi").groupBy("folder_id").agg(n)
    held = folders.select("folder_id").join(live, "folder_id", "left").select(F.col("folder_id").alias("name"), F.coalesce("n", F.lit(0)).alias("n"))
    return one(listing(papers, membership, asked, folder), "total").unionByName(one(papers, "total_all")).unionByName(one(papers.join(membership, "paper_id", "left_anti"), "unfiled")).unionByName(held)


def _like(columns: tuple[str, ...], asked: str) -> Column:
    """Whether one of the columns holds what is asked, without its wildcards and without regard to case."""
    bare = asked.replace("%", "").replace("_", "").lower()
    parts = [F.contains(F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(bare)) for c in columns]
    out = parts[0]
    for p in parts[1:]:
        out = out | p
    return out


def catalog_search(catalog: DataFrame, asked: str, limit: int = 12) -> DataFrame:
    """Entries whose key, title, authors, DOI, paper id or alias holds what is asked: by year, newest first and unknown last, then title (FLT-05). An empty question finds nothing; 1 to 50 entries come back."""
    columns = tuple(c for c in ("citation_key", "title", "authors", "doi", "paper_id", "aliases") if c in catalog.columns)
    found = catalog.filter(_like(columns, asked.strip())) if asked.strip() else catalog.limit(0)
    return found.orderBy(F.col("year").isNull(), F.desc("year"), "title", "paper_id").limit(max(1, min(limit, 50)))


def picker_search(catalog: DataFrame, papers: DataFrame, asked: str, limit: int = 12) -> DataFrame:
    """(paper_id, citation_key): of a question of two characters or more the catalog's entries, or where it has none the papers' (FLT-06)."""
    if len(asked.strip()) < 2:
        return catalog.select("paper_id", "citation_key").limit(0)
    known = catalog_search(catalog, asked, limit).select("paper_id", "citation_key")
    any_known = known.limit(1).agg(F.count(F.lit(1)).alias("known"))
    other = papers.filter(_like(("title", "authors", "doi", "paper_id"), asked.strip())).orderBy(F.col("year").isNull(), F.desc("year"), "title", "paper_id").limit(limit)
    return known.unionByName(other.crossJoin(F.broadcast(any_known)).filter("known = 0").select("paper_id", F.lit(None).cast("string").alias("citation_key")))


def resolved_keys(asked: DataFrame, catalog: DataFrame) -> DataFrame:
    """(asked, paper_id) for tokens (asked, token): the entry whose citation key or paper id a token is, else one with it among its aliases (DED-12). @ in front doesn't count."""
    q = asked.select("asked", F.regexp_replace(F.trim("token"), "^@+", "").alias("token"))
    exact = catalog.select(F.col("citation_key").alias("token"), "paper_id").unionByName(catalog.select(F.col("paper_id").alias("token"), "paper_id")).groupBy("token").agg(F.min("paper_id").alias("x"))
    alias = catalog.select(F.explode("aliases").alias("token"), "paper_id").groupBy("token").agg(F.min("paper_id").alias("y"))
    return q.join(exact, "token", "left").join(alias, "token", "left").select("asked", F.coalesce("x", "y").alias("paper_id"))


def _numbered(rows: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """The first `limit` rows in order with their place from 1; the window sees these only."""
    return rows.orderBy(*order).limit(limit).withColumn("place", F.row_number().over(Window.orderBy(*order)))


def venue_search(venues: DataFrame, articles: DataFrame, asked: str, limit: int = 10) -> DataFrame:
    """(kind, name, n): journals by name, publisher or scope, highest impact first, and articles by title or abstract, newest first (FLT-07)."""
    j = _numbered(venues.filter(_like(("name", "publisher", "scope_statement"), asked)), [F.desc_nulls_last("impact_factor"), F.asc("name")], limit)
    a = _numbered(articles.filter(_like(("title", "abstract"), asked)), [F.desc_nulls_last("published_date"), F.asc("name")], limit)
    return j.select(F.lit("journal").alias("kind"), "name", F.col("place").alias("n")).unionByName(a.select(F.lit("article").alias("kind"), "name", F.col("place").alias("n")))


def mention_search(kinds: list[tuple[str, DataFrame]], asked: str, limit: int = 6, most: int = 40, label: int = 80) -> DataFrame:
    """(type, id, title, place): of every kind (name, rows of id, title, at) the newest that hold what is asked, kinds in the given order, `most` in all; titles of memories are cut at `label` characters (FLT-09)."""
    out = None
    for i, (name, rows) in enumerate(kinds):
        title = T.preview("title", label) if name == "memory" else F.col("title")
        part = _numbered(rows.filter(F.contains(F.lower("title"), F.lit(asked.lower()))), [F.desc("at")], limit).select(F.lit(i).alias("t"), F.lit(name).alias("type"), "id", title.alias("title"), "place")
        out = part if out is None else out.unionByName(part)
    return _numbered(out.withColumnRenamed("place", "n"), [F.asc("t"), F.asc("n")], most).select("type", "id", "title", "place")


def filtered(rows: DataFrame, filters: dict[str, object], order: list[Column], limit: int) -> DataFrame:
    """Rows that equal every filter that is not None, in order, with their place (FLT-10)."""
    for column, value in filters.items():
        rows = rows if value is None else rows.filter(F.col(column) == value)
    return _numbered(rows, order, limit)


def upcoming(experiments: DataFrame, day: Column) -> DataFrame:
    """Planned experiments scheduled on `day` or later, soonest first (FLT-11)."""
    return experiments.filter((F.col("status") == "planned") & (F.col("scheduled_for") >= day)).orderBy("scheduled_for", "id")


def page(rows: DataFrame, number: int, size: int = 30) -> DataFrame:
    """Page `number` from 1 of an ordered table (SRT-04)."""
    return rows.offset((number - 1) * size).limit(size)


def upsert_links(links: DataFrame, new: DataFrame, manuscripts: DataFrame, papers: DataFrame) -> DataFrame:
    """Links (manuscript_id, paper_id, link_type, note, created_at) after `new` ones in order of created_at (DML-12).

    A link is one of a manuscript, a paper and a type; where it is there only its note changes, to the last one given. New links of unknown types,
    manuscripts or papers are refused.
    """
    key = ["manuscript_id", "paper_id", "link_type"]
    good = new.filter(F.col("link_type").isin(LINK_TYPES)).join(manuscripts.select("manuscript_id"), "manuscript_id", "left_semi").join(papers.select("paper_id"), "paper_id", "left_semi")
    both = links.withColumn("_new", F.lit(0)).unionByName(good.withColumn("_new", F.lit(1)))
    return both.groupBy(*key).agg(F.max_by("note", F.struct("_new", "created_at", "note")).alias("note"), F.min_by("created_at", F.struct("_new", "created_at")).alias("created_at"))


def linked_papers(links: DataFrame, papers: DataFrame) -> DataFrame:
    """Links with title, authors and year of their papers; a paper that is gone has its id as title (DML-12)."""
    met = links.join(papers.select("paper_id", "title", "authors", "year"), "paper_id", "left")
    return met.select(*links.columns, F.coalesce("title", F.col("paper_id").cast("string")).alias("title"), F.coalesce("authors", F.lit("")).alias("authors"), "year")


def note_folders(folders: DataFrame, notes: DataFrame) -> DataFrame:
    """(folder, n): live counts of notes by their folder field, empty folders too (DML-15)."""
    return folders.join(notes.groupBy("folder").agg(F.count(F.lit(1)).alias("n")), "folder", "left").select("folder", F.coalesce("n", F.lit(0)).alias("n"))


def index_tables(chunks: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New chunks, those whose id is not known, and their postings (token, chunk_id, tf) (SRC-20, FLT-16)."""
    new = chunks.join(known.select("chunk_id"), "chunk_id", "left_anti")
    words = new.select("chunk_id", F.explode(T.tokens("text")).alias("token"))
    return new, words.groupBy("token", "chunk_id").agg(F.count(F.lit(1)).alias("tf"))


def with_unique_keys(records: DataFrame, order: str) -> DataFrame:
    """Adds citation_key from authors, year and title; the second and later records of one key get 2, 3, ... (STR-12)."""
    base = records.withColumn("_key", T.citation_key("authors", "year", "title"))
    n = F.row_number().over(Window.partitionBy("_key").orderBy(order))
    return base.withColumn("citation_key", F.when(n == 1, F.col("_key")).otherwise(F.concat("_key", n.cast("string")))).drop("_key")


def filtered_works(works: DataFrame) -> DataFrame:
    """External works (doi, type, title, authors array<struct<family, given>>, print_year, online_year, issued_year) without components, reviews and supplements, authors as 'Family, Given', the first year present (STR-31)."""
    kept = works.filter(~F.coalesce(F.col("type").isin("component", "peer-review"), F.lit(False)) & ~F.coalesce(F.lower("doi").rlike(r"\.s\d{3}$"), F.lit(False)))
    names = F.array_join(F.transform("authors", lambda a: F.concat_ws(", ", a["family"], a["given"])), "; ")
    return kept.select(T.doi_key("doi").alias("doi"), T.strip_tags("title").alias("title"), names.alias("authors"), F.coalesce("print_year", "online_year", "issued_year").alias("year"))


def last_per_stem(entries: DataFrame, order: str) -> DataFrame:
    """Legacy library entries (filename or source or file, ...) keyed by file stem, the last one of a stem (SRC-23)."""
    names = [F.nullif(F.col(c), F.lit("")) for c in ("filename", "source", "file") if c in entries.columns]
    keyed = entries.withColumn("stem", F.regexp_replace(F.coalesce(*names), r"^.*/|\.[^./]*$", ""))
    return keyed.withColumn("_n", F.row_number().over(Window.partitionBy("stem").orderBy(F.desc(order)))).filter("_n = 1").drop("_n")


def issn_of(work: Column) -> Column:
    """Print or electronic ISSN by type, else the first one (SRC-25): work has issn_type array<struct<type, value>> and issn array<string>."""
    of = lambda t: F.get(F.filter(work["issn_type"], lambda x: x["type"] == t), F.lit(0))["value"]
    return F.coalesce(of("print"), of("electronic"), F.get(work["issn"], F.lit(0)))


def attachment_text(files: DataFrame, most_bytes: int = 50 << 20, most_chars: int = 12000) -> DataFrame:
    """(name, kind, value): images as base64, other files as their first characters; larger files go (SRC-26)."""
    image = F.lower("name").rlike(r"\.(png|jpe?g|gif|webp)$")
    kept = files.filter(F.octet_length("content") <= most_bytes)
    return kept.select("name", F.when(image, "image").otherwise("text").alias("kind"), F.when(image, F.regexp_replace(F.base64("content"), r"\s", "")).otherwise(F.left(F.decode("content", "UTF-8"), F.lit(most_chars))).alias("value"))


def refreshed_factors(journals: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Journals (key, impact_factor) with the mean citedness found (key, citedness) to one decimal; zero or absent changes nothing (SRC-24)."""
    new = F.when(F.col("citedness") > 0, F.round("citedness", 1))
    return journals.join(found, key, "left").select(key, F.coalesce(new, "impact_factor").alias("impact_factor"))


def written_index(spark, folder: str, chunks: DataFrame, embed, counts: bool = False):  # noqa: ANN001, ANN201
    """Adds chunks (chunk_id, text) of unknown ids and their vectors to the index in `folder`, and builds its postings anew (SRC-20); gives the folder of the new index, or with `counts` its sizes.

    A version of the index is a folder of its own, so readers of the old one are not disturbed.
    """
    import uuid

    from scholiast.functions.models import embedded

    there = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/chunks")
    known = spark.read.parquet(f"{folder}/chunks") if there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there) else chunks.limit(0)
    new = chunks.join(known.select("chunk_id"), "chunk_id", "left_anti")
    out = f"{folder}/../index-{uuid.uuid4().hex}"
    known.unionByName(new).write.parquet(f"{out}/chunks")
    vectors = embedded(new, "text", embed).drop("text")
    (spark.read.parquet(f"{folder}/vectors").unionByName(vectors) if not known.isEmpty() else vectors).write.parquet(f"{out}/vectors")
    everything = spark.read.parquet(f"{out}/chunks")
    everything.select("chunk_id", F.explode(T.tokens("text")).alias("token")).groupBy("token", "chunk_id").agg(F.count(F.lit(1)).alias("tf")).write.parquet(f"{out}/postings")
    if not counts:
        return out
    size = lambda name: spark.read.parquet(f"{out}/{name}").agg(F.count(F.lit(1)).alias(name))
    return size("chunks").crossJoin(size("vectors")).crossJoin(size("postings"))
