"""Readers and writers of bibliographic formats: BibTeX, RIS, CSL-JSON, notes, feeds (SRC)."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scholiast.functions import text as T

FIELDS = "external_key title authors year doi journal volume issue pages publisher url".split()
_RECORD = "external_key string, title string, authors string, year int, doi string, journal string, volume string, issue string, pages string, publisher string, url string"
_ENTRY = re.compile(r"@(\w+)\s*\{\s*([^,\s]+)\s*,")
_BLANKS = re.compile(r"[ \t\n\f\r]+")


def bibtex_entries(text: str) -> list[dict[str, str]]:
    """Fields of every entry of a BibTeX text by lower-case name, with the key; braces may nest, values may be quoted or bare."""
    out = []
    for m in _ENTRY.finditer(text):
        if m[1].lower() in ("comment", "string", "preamble"):
            continue
        fields, at = {"external_key": m[2]}, m.end()
        while found := re.compile(r"\s*,?\s*([\w-]+)\s*=\s*").match(text, at):
            at, start = found.end(), found.end()
            if at < len(text) and text[at] == "{":
                depth = 0
                while at < len(text):
                    depth += {"{": 1, "}": -1}.get(text[at], 0)
                    at += 1
                    if not depth:
                        break
                value = text[start + 1 : at - 1]
            elif at < len(text) and text[at] == '"':
                end = text.find('"', at + 1)
                at = len(text) if end < 0 else end + 1
                value = text[start + 1 : at - 1]
            else:
                bare = re.compile(r"[^,}\s]*").match(text, at)
                at, value = bare.end(), bare[0]
            fields[found[1].lower()] = _BLANKS.sub(" ", re.sub(r"[{}]", "", value)).strip(" ")
        out.append(fields)
    return out


def read_bibtex(spark: SparkSession, path: str) -> DataFrame:
    """Records of BibTeX files (SRC-04): journal falls back to journaltitle, issue to number. An empty title is one, other empty fields are null."""

    def parse(batches):  # noqa: ANN001, ANN202
        for pdf in batches:
            rows = [e for text in pdf["value"] for e in bibtex_entries(text)]
            pick = lambda e, *names: next((e[n] for n in names if e.get(n)), None)
            yield pd.DataFrame(
                [(e["external_key"], e.get("title"), (pick(e, "author") or "").replace(" and ", "; ") or None, pick(e, "year", "date"), pick(e, "doi"), pick(e, "journal", "journaltitle"), pick(e, "volume"), pick(e, "issue", "number"), pick(e, "pages"), pick(e, "publisher"), pick(e, "url")) for e in rows],
                columns=FIELDS,
            ).astype(object)

    raw = spark.read.text(path, wholetext=True).mapInPandas(parse, _RECORD.replace("year int", "year string"))
    return raw.withColumn("year", T.first_year("year"))


def read_ris(spark: SparkSession, path: str, trimmed: bool = True) -> DataFrame:
    """Records of RIS files (SRC-05): tagged lines up to ER; AU accumulates; TI or T1, PY or Y1, JO or JF; pages from SP and EP. Values are `trimmed`, or as they stand behind the mark."""
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", r"\r?\n")).alias("pos", "line"))
    value = F.regexp_replace("line", r"^[A-Z][A-Z0-9]  - ?", "")
    tagged = lines.select("file", "pos", F.regexp_extract("line", r"^([A-Z][A-Z0-9])  - ?", 1).alias("tag"), (F.trim(value) if trimmed else value).alias("value")).filter("tag <> ''")
    order = Window.partitionBy("file").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    numbered = tagged.withColumn("record", F.coalesce(F.sum((F.col("tag") == "ER").cast("int")).over(order), F.lit(0))).filter("tag <> 'ER'")
    first = lambda *tags: F.coalesce(*[F.min_by(F.when(F.col("tag") == t, F.col("value")), F.when(F.col("tag") == t, F.col("pos"))) for t in tags])
    authors = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("tag") == "AU", F.struct("pos", "value")))), lambda x: x["value"]), "; ")
    grouped = numbered.groupBy("file", "record").agg(first("ID").alias("external_key"), first("TI", "T1").alias("title"), F.nullif(authors, F.lit("")).alias("authors"), first("PY", "Y1").alias("y"), first("DO").alias("doi"), first("JO", "JF").alias("journal"), first("VL").alias("volume"), first("IS").alias("issue"), F.nullif(F.concat_ws("-", first("SP"), first("EP")), F.lit("")).alias("pages"), first("PB").alias("publisher"), first("UR").alias("url"))
    return grouped.withColumn("year", T.first_year("y")).select(*FIELDS)


_CSL = "struct<id:string,title:string,author:array<struct<family:string,given:string>>,issued:struct<`date-parts`:array<array<string>>>,DOI:string,`container-title`:string,volume:string,issue:string,page:string,publisher:string,URL:string>"


def read_csl(spark: SparkSession, path: str) -> DataFrame:
    """Records of CSL-JSON files (SRC-06): an array, or an object with items."""
    raw = spark.read.text(path, wholetext=True)
    listed = F.when(F.trim("value").startswith("["), F.from_json("value", f"array<{_CSL}>")).otherwise(F.from_json("value", f"struct<items:array<{_CSL}>>")["items"])
    item = raw.select(F.explode(listed).alias("x"))
    names = F.nullif(F.array_join(F.transform("x.author", lambda a: F.concat_ws(" ", a["given"], a["family"])), "; "), F.lit(""))
    year = F.get(F.get(F.col("x.issued.date-parts"), F.lit(0)), F.lit(0)).try_cast("int")
    return item.select(F.col("x.id").alias("external_key"), "x.title", names.alias("authors"), year.alias("year"), F.col("x.DOI").alias("doi"), F.col("x.container-title").alias("journal"), "x.volume", "x.issue", F.col("x.page").alias("pages"), "x.publisher", F.col("x.URL").alias("url"))


def read_references(spark: SparkSession, path: str, head: str = "", trimmed: bool = True) -> DataFrame:
    """Reader by suffix, else by what the text begins with (SRC-07); `trimmed` is for RIS."""
    suffix = path.rsplit(".", 1)[-1].lower()
    if suffix in ("json", "csl") or head.lstrip().startswith("["):
        return read_csl(spark, path)
    if suffix == "ris" or re.search(r"^TY  -", head, re.M):
        return read_ris(spark, path, trimmed)
    return read_bibtex(spark, path)


def cleaned(records: DataFrame, synonyms: dict[str, list[str]] | None = None) -> DataFrame:
    """The eleven fields, trimmed, from columns of the same or a synonymous name; '' becomes null (SRC-08, SRC-22)."""
    known = {"issue": ["number"], "pages": ["page"], "external_key": ["id", "key"], "authors": ["author"], "journal": ["journaltitle", "container-title"], **(synonyms or {})}

    def field(name: str) -> Column:
        there = [c for c in (name, *known.get(name, [])) if c in records.columns]
        values = [F.nullif(F.trim(F.col(f"`{c}`").cast("string")), F.lit("")) for c in there]
        found = F.coalesce(*values) if values else F.lit(None).cast("string")
        return (found.try_cast("int") if name == "year" else found).alias(name)

    return records.select(*[field(n) for n in FIELDS])


def merged_sources(sources: list[DataFrame]) -> DataFrame:
    """Union of record sources; of records with one normalised title and DOI the earliest source's stays; records with neither go (SRC-09)."""
    out = None
    for i, s in enumerate(sources):
        part = s.withColumn("_source", F.lit(i))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    keyed = out.withColumn("_t", F.coalesce(T.title_key("title"), F.lit(""))).withColumn("_d", F.coalesce(T.doi_key("doi"), F.lit(""))).filter("_t <> '' or _d <> ''")
    order = Window.partitionBy("_t", "_d").orderBy("_source", "external_key")
    return keyed.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_source", "_t", "_d", "_n")


def to_bibtex(records: DataFrame, empty: tuple[str, ...] = ()) -> DataFrame:
    """One text entry per record with its non-empty fields, and those of `empty` that are '', braces escaped (SRC-16)."""
    names = {"title": "title", "authors": "author", "year": "year", "journal": "journal", "volume": "volume", "issue": "number", "pages": "pages", "publisher": "publisher", "doi": "doi", "url": "url"}
    filled = lambda c: F.col(c).isNotNull() if c in empty else F.coalesce(F.col(c).cast("string"), F.lit("")) != ""
    lines = [F.when(filled(c), F.concat(F.lit(f"  {n} = {{"), F.regexp_replace(F.col(c).cast("string"), r"([{}])", r"\\$1"), F.lit("}"))) for c, n in names.items()]
    return records.select(F.concat(F.lit("@article{"), "external_key", F.lit(",\n"), F.concat_ws(",\n", *lines), F.lit("\n}\n")).alias("value"))


def read_notes(spark: SparkSession, path: str) -> DataFrame:
    """Notes of a folder, one a file (SRC-14)."""
    return parsed_notes(spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_modification_time").alias("modified")))


def parsed_notes(raw: DataFrame) -> DataFrame:
    """file, modified, meta, title, body and preview of notes (value, file, modified) with a front block of key: value lines (SRC-14): the title is that of the block, else the first heading, else the file's stem."""
    front = F.regexp_extract("value", r"(?s)^---\r?\n(.*?)\r?\n---\r?\n?", 1)
    body = F.regexp_replace("value", r"(?s)^---\r?\n.*?\r?\n---\r?\n?", "")
    pairs = F.filter(F.transform(F.split(front, r"\r?\n"), lambda x: F.struct(F.trim(F.split_part(x, F.lit(":"), F.lit(1))).alias("k"), F.trim(F.regexp_replace(x, r"^[^:]*:", "")).alias("v"))), lambda x: x["k"] != "")
    parsed = raw.select("file", "modified", F.map_from_entries(F.array_distinct(pairs)).alias("meta"), body.alias("body"))
    title = F.coalesce(F.try_element_at("meta", F.lit("title")), F.nullif(F.regexp_extract("body", r"(?m)^# (.+)$", 1), F.lit("")), F.regexp_replace("file", r"\.[^.]*$", ""))
    return parsed.select("file", "modified", "meta", title.alias("title"), "body", T.preview("body", 200).alias("preview"))


def read_parsed(spark: SparkSession, folder: str, lines: bool = False) -> DataFrame:
    """Parsed papers, one JSON object a file, or a line, with the file's name for the order of arrival (SRC-01)."""
    schema = "paper_id string, title string, authors array<string>, year int, doi string, journal string, volume string, issue string, pages string, publisher string, url string, source_pdf string, sections array<struct<name:string,text:string,page_start:int,page_end:int>>, references_raw string"
    return spark.read.schema(schema).option("multiLine", not lines).json(folder).withColumn("file", F.input_file_name())


def new_files(spark: SparkSession, folder: str, parsed: DataFrame, suffix: str = "pdf") -> DataFrame:
    """Files of a folder whose stem is no known paper_id, without side files (SRC-02, SET-02)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*." + "".join(f"[{c.lower()}{c.upper()}]" for c in suffix)).load(folder).select("path", "length", F.regexp_extract("path", r"([^/]+)\.[^.]+$", 1).alias("paper_id"))
    return files.filter(~F.col("paper_id").startswith("._")).join(parsed.select("paper_id"), "paper_id", "left_anti").orderBy("path")


def unknown_files(files: DataFrame, parsed: DataFrame, suffix: str = "pdf") -> DataFrame:
    """(path, paper_id) of files (path) with the suffix in any case whose stem is no known paper_id, without side files (SRC-02, SET-02)."""
    stem = files.withColumn("paper_id", F.regexp_extract("path", rf"(?i)([^/]+)\.{suffix}$", 1)).filter("paper_id <> ''")
    return stem.filter(~F.startswith(F.col("paper_id"), F.lit("._"))).join(parsed.select("paper_id"), "paper_id", "left_anti").select("path", "paper_id")


def valid_upload(content: Column, name: Column, most: int = 200 << 20) -> Column:
    """Non-empty PDF of at most `most` bytes with a safe name (SRC-21)."""
    return (F.octet_length(content) > 0) & (F.octet_length(content) <= most) & F.startswith(content, F.lit(b"%PDF-")) & F.regexp_replace(name, r"[^\w.() -]", "_").rlike(r"^.{1,200}$")


def feed_items(items: DataFrame) -> DataFrame:
    """doi, title and abstract of feed items (title, description, link, identifier) with tags stripped; items with neither title nor abstract go (SRC-12)."""
    doi = F.coalesce(T.doi_key("identifier"), F.nullif(F.regexp_extract("link", r"doi\.org/(10\.\d{4,9}/\S+)", 1), F.lit("")))
    out = items.select(doi.alias("doi"), T.strip_tags(F.coalesce("title", F.lit(""))).alias("title"), T.strip_tags(F.coalesce("description", F.lit(""))).alias("abstract"))
    return out.filter("title <> '' or abstract <> ''")


def text_of_inverted_index(index: Column) -> Column:
    """Words of map<word, positions> in order of position; the later word of the map wins a place (ARR-01, SRC-11)."""
    placed = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    last = lambda by_place: F.filter(by_place, lambda x, i: F.coalesce(F.get(by_place, i + 1)["p"] != x["p"], F.lit(True)))
    return T.once(F.sort_array(placed), lambda by_place: F.array_join(F.transform(last(by_place), lambda x: x["w"]), " "))


def fetched_works(works: DataFrame, since: Column) -> DataFrame:
    """Works (doc_id, published, inverted map<word, positions>, concepts) from a day on with their abstract and first five topics; works without an abstract go (SRC-10, SRC-11)."""
    kept = works.filter((F.col("published") >= since) & F.col("inverted").isNotNull())
    return kept.select("doc_id", "published", text_of_inverted_index(F.col("inverted")).alias("abstract"), F.slice("concepts", 1, 5).alias("topics")).filter("abstract <> ''")


# fixed values: names of columns that hold a title, and of others that make a table bibliographic
TITLE_NAMES = ["title", "name", "paper_title"]
OTHER_NAMES = ["doi", "authors", "author", "year", "journal", "path", "file"]


def discovered(tables: dict[str, DataFrame], most: int = 100_000) -> tuple[str, str, DataFrame]:
    """(name, title column, records) of the first table by name that has a title-like column, another bibliographic one and rows; at most `most` rows of it are read (SRC-08)."""
    for name, rows in sorted(tables.items()):
        title = next((c for c in TITLE_NAMES if c in rows.columns), None)
        if title and any(c in rows.columns for c in OTHER_NAMES) and not rows.isEmpty():
            return name, title, cleaned(rows.limit(most), {"title": [title]})
    raise ValueError("no table has bibliographic columns")


def read_journal_seeds(spark: SparkSession, path: str) -> DataFrame:
    """(id, name, impact_factor) of a seed file in YAML's plain form, a list of flat mappings (SRC-13)."""
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.split(F.concat(F.lit("\n"), "value"), r"\n- ")).alias("entry")).filter(F.contains("entry", F.lit(":")))
    field = lambda name: F.nullif(F.trim(F.regexp_extract("entry", rf"(?m)^\s*{name}:\s*(.*)$", 1)), F.lit(""))
    return raw.select(field("id").alias("id"), field("name").alias("name"), field("impact_factor").try_cast("double").alias("impact_factor")).filter("id is not null")


def read_policy(spark: SparkSession, path: str, defaults: dict[str, str]) -> dict[str, str]:
    """Settings by section.name of a policy file with [section] and name = value lines, over their defaults (SRC-13). The file is small and read by the driver."""
    found, section = dict(defaults), ""
    for row in spark.read.text(path).toLocalIterator():
        line = row["value"].split("#")[0].strip()
        if line.startswith("[") and line.endswith("]"):
            section = line[1:-1].strip()
        elif "=" in line:
            name, value = (x.strip() for x in line.split("=", 1))
            found[f"{section}.{name}"] = value
    return found


def write_manifest(rows: DataFrame, path: str) -> None:
    """Rows as JSON lines, nulls written out (SRC-19)."""
    rows.write.option("ignoreNullFields", False).mode("overwrite").json(path)
