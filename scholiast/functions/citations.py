"""Citations, links and sections inside texts (STR-19 to STR-32, SRC-17, SRC-18, JOI-13)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholiast.functions import text as T


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


# fixed values: bracketed words that are no source numbers
PLACEHOLDERS = r"(?i)^(ref|refs|citation|citations|x|n|todo|author|authors|year|source|paper|id|web:.*)$"


def invalid_citations(text: Column | str, most: Column) -> Column:
    """Numeric citation groups that name a number outside 1..most, sorted as text (STR-19). Placeholders, and groups with anything but numbers before the first bad one, are not citations."""
    groups = F.transform(F.regexp_extract_all(_c(text), F.lit(r"\[([^\[\]\n]+)\]"), F.lit(1)), lambda g: F.trim(g))

    def kind(part: Column) -> Column:
        """0 a good number or range, 1 a bad one, 2 anything else."""
        ends = F.transform(F.regexp_extract_all(part, F.lit(r"\d+"), F.lit(0)), lambda n: F.coalesce(n.try_cast("int"), F.lit(0)))
        return F.when(~part.rlike(r"^\d+([–-]\d+)?$"), 2).when(F.forall(ends, lambda n: n.between(F.lit(1), most)), 0).otherwise(1)

    kinds = lambda g: F.transform(F.filter(F.split(g, r"[,\s]+"), lambda x: x != ""), kind)
    first = lambda g: F.get(F.filter(kinds(g), lambda k: k > 0), F.lit(0))
    bad = F.filter(groups, lambda g: ~g.rlike(PLACEHOLDERS) & F.coalesce(first(g) == 1, F.lit(False)))
    return F.array_sort(F.array_distinct(bad))


# fixed values: the grammar of citation tokens and links
CITE = r"(?<![\w.\-])@([A-Za-z0-9_\-]+)"
WIKI = r"\[\[\s*([A-Za-z0-9_\-]+)(?:\s*\|\s*([^\[\]]+?))?\s*\]\]"
FILE = r"\[[^\]]+\]\(([\w\-]+)\.md\)"


def tokens_cited(text: Column | str) -> Column:
    """Distinct @keys in order of first appearance, not behind a word character, a dot or a hyphen (STR-21, AGG-19)."""
    return F.array_distinct(F.regexp_extract_all(_c(text), F.lit(CITE), F.lit(1)))


def slugs_linked(text: Column | str) -> Column:
    """Distinct slugs of [[slug]] and [[slug|label]], then of [text](slug.md) links, each in order (STR-21, JOI-13)."""
    return F.array_distinct(F.concat(F.regexp_extract_all(_c(text), F.lit(WIKI), F.lit(1)), F.regexp_extract_all(_c(text), F.lit(FILE), F.lit(1))))


def cited_papers(files: DataFrame, key: str, text: str, keys: DataFrame) -> DataFrame:
    """(key, place, paper_id): the papers that a text's tokens name, in order; `keys` (key, paper_id) resolves ids, citation keys and aliases, and a token that it doesn't know is no citation (STR-21, DED-12)."""
    said = files.select(F.col(key).alias("_file"), F.posexplode(tokens_cited(text)).alias("place", "key"))
    found = said.join(keys, "key").groupBy("_file", "paper_id").agg(F.min("place").alias("place"))
    return found.select(F.col("_file").alias(key), "place", "paper_id")


def backlinks(files: DataFrame, project: str, slug: str, text: str) -> DataFrame:
    """(project, slug, linked_from): which files of a project refer to each file; a file's links to itself don't count (JOI-13)."""
    links = files.select(project, F.col(slug).alias("linked_from"), F.explode(slugs_linked(text)).alias(slug))
    return links.join(files.select(project, slug), [project, slug], "left_semi").filter(F.col(slug) != F.col("linked_from")).select(project, slug, "linked_from").distinct()


def mentions(text: Column | str) -> Column:
    """Distinct (type, id) of @[Title](mention:type:id) with the first title (STR-23)."""
    part = lambda i: F.regexp_extract_all(_c(text), F.lit(r"@\[([^\]]*)\]\(mention:(\w+):([^)\s]+)\)"), F.lit(i))
    listed = F.arrays_zip(part(2).alias("type"), part(3).alias("id"), part(1).alias("title"))
    return F.filter(listed, lambda x, i: ~F.exists(F.slice(listed, F.lit(1), i), lambda y: (y["type"] == x["type"]) & (y["id"] == x["id"])))


def renumbered(text: Column | str, numbers: Column) -> Column:
    """@key becomes [n] where the map `numbers` knows the key (STR-22)."""

    def changed(piece: Column) -> Column:
        key = F.regexp_extract(piece, r"^@([A-Za-z0-9_\-]+)", 1)
        n = F.try_element_at(numbers, key)
        return F.when(n.isNotNull(), F.concat(F.lit("["), n.cast("string"), F.lit("]"), F.substr(piece, F.char_length(key) + 2))).otherwise(piece)

    return F.array_join(F.transform(F.split(_c(text), r"(?<![\w.\-])(?=@[A-Za-z0-9_\-])"), changed), "")


def flattened(text: Column | str, titles: Column) -> Column:
    """[[slug|label]] becomes the label, [[slug]] the title that the map `titles` has for it or the slug, [text](slug.md) the slug (STR-22)."""

    def changed(piece: Column) -> Column:
        whole, slug, label = (F.regexp_extract(piece, f"^{WIKI}", i) for i in range(3))
        shown = F.coalesce(F.nullif(label, F.lit("")), F.try_element_at(titles, slug), slug)
        return F.when(whole != "", F.concat(shown, F.substr(piece, F.char_length(whole) + 1))).otherwise(piece)

    return F.regexp_replace(F.array_join(F.transform(F.split(_c(text), r"(?=\[\[)"), changed), ""), FILE, "$1")


def project_numbers(files: DataFrame, project: str, order: str, text: str, keys: DataFrame | None = None) -> DataFrame:
    """(project, key, number): keys, or the papers that they resolve to, numbered by first appearance over a project's files in order (WIN-04)."""
    cited = files.select(project, order, F.posexplode(tokens_cited(text)).alias("place", "key"))
    if keys is not None:
        cited = cited.join(keys, "key").select(project, order, "place", F.col("paper_id").alias("key"))
    first = cited.groupBy(project, "key").agg(F.min(F.struct(order, "place")).alias("first"))
    return first.select(project, "key", F.row_number().over(Window.partitionBy(project).orderBy("first")).alias("number"))


# fixed values: what a slug or title holds and the section that it then is, in this order
SECTION_HINTS = [("results and discussion", "results"), ("introduction", "intro"), ("background", "intro"), ("method", "methods"), ("experimental", "methods"), ("materials", "methods"), ("result", "results"), ("discussion", "discussion"), ("conclusion", "conclusion"), ("abstract", "abstract"), ("summary", "abstract"), ("reviewer", "reviewer"), ("response", "reviewer"), ("rebuttal", "reviewer"), ("intro", "intro")]


def section_of(slug: Column | str, title: Column | str) -> Column:
    """The section of the first hint that slug or title holds, null if none (STR-28). Hyphens and underscores count as spaces."""
    said = F.translate(F.lower(F.concat_ws(" ", F.coalesce(_c(slug), F.lit("")), F.coalesce(_c(title), F.lit("")))), "-_", "  ")
    return F.coalesce(*[F.when(F.contains(said, F.lit(hint)), section) for hint, section in SECTION_HINTS])


def markdown_blocks(text: Column | str, level: int = 2) -> Column:
    """array<struct<heading, body>> of the headings of one level in order; text before the first is left out (STR-32)."""
    mark = "#" * level
    pieces = F.slice(F.split(F.concat(F.lit("\n"), _c(text)), rf"\n(?={mark} [^#\n])"), 2, 1 << 30)
    head = lambda x: F.trim(F.regexp_extract(x, rf"^{mark} ([^\n]+)", 1))
    return F.transform(pieces, lambda x: F.struct(head(x).alias("heading"), F.trim(F.regexp_replace(F.regexp_replace(x, r"^[^\n]*", ""), r"^\s+|\s+$", "")).alias("body")))


def trimmed_block(text: Column | str, limit: int) -> Column:
    """Without a rule at its end and, if longer than `limit`, cut at the last line end past 60 % of it, with an ellipsis below (STR-32)."""
    ends = lambda x: F.regexp_replace(x, r"\s+$", "")
    whole = ends(F.regexp_replace(_c(text), r"\n-{3,}\s*$", ""))
    head = F.left(whole, F.lit(limit))
    line = F.char_length(head) - F.instr(F.reverse(head), "\n")  # characters before the last line end
    kept = F.when((F.instr(head, "\n") > 0) & (line > 0.6 * limit), F.substr(head, F.lit(1), line)).otherwise(head)
    return F.when(F.char_length(whole) <= limit, whole).otherwise(F.concat(ends(kept), F.lit("\n…")))


def without_exemplars(text: Column | str) -> Column:
    """Without quoted example lines and the gaps they leave (STR-32)."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(_c(text), r'(?m)^>\s*".*$', ""), r"\n{3,}", "\n\n"), r"^\s+|\s+$", ""))


def bullets(text: Column | str, least: int = 20) -> Column:
    """Bullet lines of more than `least` characters, marks removed (STM-06)."""
    lines = F.transform(F.split(_c(text), r"\r?\n"), lambda x: F.trim(F.regexp_replace(x, r"^\s*(?:[-*•]|\d+[.)])\s*", "")))
    return F.filter(lines, lambda x: F.char_length(x) > least)


def references_block(cited: DataFrame, papers: DataFrame, key: str) -> DataFrame:
    """(key, block): a heading and one line per cited paper in order of number (STR-30): cited has key, number, paper_id."""
    line = T.reference_line(F.col("number"), F.col("authors"), F.col("title"), F.col("year"), F.col("doi"), F.col("paper_id"))
    met = cited.join(papers, "paper_id").select(key, "number", line.alias("line"))
    lines = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("number", "line"))), lambda x: x["line"]), "\n\n")
    return met.groupBy(key).agg(F.concat(F.lit("\n\n## References\n\n"), lines).alias("block"))


def valid_rects(rects: Column) -> Column:
    """Rectangles of positive size, or null if a number of any is missing or outside 0..1 (MTH-07, DML-17)."""
    inside = F.forall(rects, lambda r: F.forall(F.array(r["x"], r["y"], r["width"], r["height"]), lambda v: v.between(0, 1) & v.isNotNull()))
    return F.when(F.coalesce(inside, F.lit(False)), F.filter(rects, lambda r: (r["width"] > 0) & (r["height"] > 0)))


def review_text(papers: DataFrame, notes: DataFrame, marks: DataFrame) -> DataFrame:
    """(paper_id, value): the review of each of `papers` (paper_id, title) as text: notes (paper_id, at, page, text) and then marks (paper_id, at, type, page, color, note, rects), oldest first, rectangles to three places (SRC-18)."""
    spot = F.array_join(F.transform("rects", lambda r: F.format_string("(%.3f,%.3f,%.3fx%.3f)", r["x"], r["y"], r["width"], r["height"])), ", ")
    remark = F.when(F.coalesce("note", F.lit("")) != "", F.concat(F.lit("\n   ↳ "), "note", F.lit("\n"))).otherwise("")
    said = F.concat(F.lit("[p"), F.col("page").cast("string"), F.lit("] "), "text", F.lit("\n"))
    marked = F.concat(F.lit("["), "type", F.lit("] p"), F.col("page").cast("string"), F.lit(" color "), "color", F.lit("  "), spot, F.lit("\n"), remark)

    def listed(rows: DataFrame, line: Column, name: str, none: str) -> tuple[DataFrame, Column]:
        own = rows.select("paper_id", "at", line.alias("line")).groupBy("paper_id").agg(F.sort_array(F.collect_list(F.struct("at", "line"))).alias(name))
        shown = F.concat(F.format_string(f"── {name} (%d) ──\n", F.size(name)), F.array_join(F.transform(name, lambda x: x["line"]), "\n"))
        return own, F.coalesce(F.when(F.size(name) > 0, shown), F.lit(none))

    own_notes, notes_text = listed(notes, said, "Notes", "── No notes ──\n")
    own_marks, marks_text = listed(marks, marked, "Marks", "── No marks ──")
    head = F.concat(F.lit("# Review: "), "title", F.lit("\nPaper ID: "), "paper_id", F.lit("\n"))
    met = papers.join(own_notes, "paper_id", "left").join(own_marks, "paper_id", "left")
    return met.select("paper_id", F.concat_ws("\n", head, notes_text, marks_text).alias("value"))


def manuscript(files: DataFrame, papers: DataFrame, keys: DataFrame, project: str = "project") -> DataFrame:
    """(project, value): the manuscript of each project as Markdown (SRC-17, STR-22, WIN-04).

    files: project, title (of the project), slug, name, sort_order, body. Non-empty bodies in order, under their name unless they
    begin with a heading; @keys become numbers by first appearance, links become plain text; then the numbered references.
    papers: paper_id, title, authors, year, doi; keys: key, paper_id. A project's files are one text in the end, so they meet in one row.
    """
    numbers = project_numbers(files, project, "sort_order", "body", keys).withColumnRenamed("key", "paper_id")
    aliases = numbers.join(keys, "paper_id").groupBy(project).agg(F.map_from_entries(F.collect_list(F.struct("key", "number"))).alias("numbers"))
    titles = files.groupBy(project).agg(F.map_from_entries(F.collect_list(F.struct("slug", "name"))).alias("titles"))
    empty = F.create_map().cast("map<string,int>")
    met = files.withColumn("body", F.regexp_replace("body", r"^\s+|\s+$", "")).filter("body <> ''").join(titles, project).join(aliases, project, "left")
    body = flattened(renumbered("body", F.coalesce("numbers", empty)), F.col("titles"))
    head = F.when(F.startswith(F.col("body"), F.lit("#")), F.lit("")).otherwise(F.concat(F.lit("## "), "name", F.lit("\n\n")))
    parts = met.select(project, "title", "sort_order", "slug", F.concat(head, body, F.lit("\n")).alias("part"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("sort_order", "slug", "part"))), lambda x: x["part"]), "\n")
    texts = parts.groupBy(project).agg(F.min("title").alias("title"), joined.alias("text"))
    filled = lambda c: F.nullif(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(""))
    line = F.concat(F.lit("["), F.col("number").cast("string"), F.lit("] "), F.coalesce(F.concat(filled("authors"), F.lit(". ")), F.lit("")), F.coalesce(filled("title"), F.col("paper_id")), F.lit("."), F.coalesce(F.concat(F.lit(" "), filled("year"), F.lit(".")), F.lit("")), F.coalesce(F.concat(F.lit(" DOI: "), filled("doi"), F.lit(".")), F.lit("")))
    lines = numbers.join(papers, "paper_id", "left").select(project, "number", line.alias("line"))
    cited = lines.groupBy(project).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("number", "line"))), lambda x: x["line"]), "\n").alias("cited"))
    whole = F.concat(F.lit("# "), "title", F.lit("\n\n"), "text", F.coalesce(F.concat(F.lit("\n## References\n\n"), "cited"), F.lit("")))
    return texts.join(cited, project, "left").select(project, F.concat(F.regexp_replace(whole, r"\s+$", ""), F.lit("\n")).alias("value"))


def as_page(title: Column, markdown: Column) -> Column:
    """A page of its own that carries Markdown text as JSON for a renderer (SRC-17): nothing in the text can end the element that holds it."""
    json = F.replace(F.to_json(F.array(F.coalesce(markdown, F.lit("")))), F.lit("</"), F.lit("<\\/"))
    name = F.coalesce(title, F.lit("Manuscript"))
    for sign, spelt in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        name = F.replace(name, F.lit(sign), F.lit(spelt))
    return F.concat(F.lit('<!doctype html>\n<html><head><meta charset="utf-8"><title>'), name, F.lit('</title></head>\n<body><main id="paper"></main>\n<script type="application/json" id="source">'), json, F.lit("</script></body></html>\n"))


def manuscript_files(files: DataFrame, papers: DataFrame, keys: DataFrame, project: str = "project") -> DataFrame:
    """(name, text): of each project its manuscript as Markdown and as a page, and the BibTeX entries of the papers that it cites, by number (SRC-16, SRC-17); a project that cites none has an empty one."""
    from scholiast.sources.bibliography import to_bibtex

    texts = manuscript(files, papers, keys, project).join(files.groupBy(project).agg(F.min("title").alias("title")), project)
    numbers = project_numbers(files, project, "sort_order", "body", keys).withColumnRenamed("key", "paper_id")
    fields = ["title", "authors", "year", "doi", "journal", "volume", "issue", "pages", "publisher", "url"]
    known = papers.select("paper_id", *[F.col(c) if c in papers.columns else F.lit(None).cast("string").alias(c) for c in fields])
    entries = to_bibtex(known.withColumn("external_key", F.col("paper_id"))).withColumn("paper_id", F.regexp_extract("value", r"\{([^,]+),", 1))
    cited = numbers.join(entries, "paper_id").groupBy(project).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("number", "value"))), lambda x: x["value"]), "\n").alias("entries"))
    met = texts.join(cited, project, "left")
    named = lambda ending, text: F.struct(F.concat(F.col(project).cast("string"), F.lit(ending)).alias("name"), text.alias("text"))
    made = F.array(named(".md", F.col("value")), named(".html", as_page(F.col("title"), F.col("value"))), named("-references.bib", F.coalesce("entries", F.lit(""))))
    return met.select(F.explode(made).alias("f")).select("f.name", "f.text")
