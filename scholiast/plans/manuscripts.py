"""Queries over writing projects: a conversation is a project, its turns are the files; and over what models answer."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholiast.functions import citations as C
from scholiast.functions import text as T
from scholiast.plans.papers import PAPERS, catalog, line_sql, ordered_distinct, papers
from scholiast.plans.registry import query, table

# every file cites two papers, one alias of a paper and a key that nobody knows, and links to two files
_A, _B = "((conv_id * 7 + turn) % 60)", "((conv_id + turn * 5) % 40)"
FILES = f"""files AS (SELECT conv_id AS project, turn AS sort_order, 's' || turn AS slug, role || ' ' || turn AS name, 'Project ' || conv_id AS title, replace(replace(text, '@', ' '), '[', '(') AS said, {_A} AS a, {_B} AS b FROM conversations),
bodies AS (SELECT *, said || ' as @p' || a || ', @key' || b || ' and @nobody or x@p1 say [[s0|first part]] [[s1]] [x](s2.md)' AS body FROM files),
keys AS (SELECT paper_id AS key, paper_id FROM papers UNION ALL SELECT 'key' || doc_id, paper_id FROM papers)"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """project, title, slug, name, sort_order, body."""
    c = table(spark, sf_dir, "conversations")
    said = F.replace(F.replace("text", F.lit("@"), F.lit(" ")), F.lit("["), F.lit("("))
    body = F.concat(said, F.lit(" as @p"), F.expr(_A), F.lit(", @key"), F.expr(_B), F.lit(" and @nobody or x@p1 say [[s0|first part]] [[s1]] [x](s2.md)"))
    return c.select(F.col("conv_id").alias("project"), F.concat(F.lit("Project "), "conv_id").alias("title"), F.concat(F.lit("s"), "turn").alias("slug"), F.concat_ws(" ", "role", "turn").alias("name"), F.col("turn").alias("sort_order"), body.alias("body"))


def keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = papers(spark, sf_dir)
    return p.select(F.col("paper_id").alias("key"), "paper_id").unionByName(p.select(F.concat(F.lit("key"), "doc_id").alias("key"), "paper_id"))


NUMBERED = """said AS (SELECT project, sort_order, 0 AS place, 'p' || a AS key FROM files UNION ALL SELECT project, sort_order, 1, 'key' || b FROM files),
named AS (SELECT project, paper_id, min(sort_order * 10 + place) AS first FROM said JOIN keys USING (key) GROUP BY ALL),
numbers AS (SELECT project, paper_id, row_number() OVER (PARTITION BY project ORDER BY first)::INT AS number FROM named)"""


@query(f"WITH {PAPERS}, {FILES}, {NUMBERED} SELECT project, paper_id, number FROM numbers")
def manuscript_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-04: papers of a project by first appearance over its files in order, an alias and an id being one paper"""
    return C.project_numbers(files(spark, sf_dir), "project", "sort_order", "body", keys(spark, sf_dir)).withColumnRenamed("key", "paper_id")


_EXPORTED = f"""WITH {PAPERS}, {FILES}, {NUMBERED}, ref AS (SELECT k.key, n.project, n.number FROM numbers n JOIN keys k USING (paper_id)),
part AS (SELECT f.project, f.sort_order, CASE WHEN starts_with(trim(f.said), '#') THEN '' ELSE '## ' || f.name || chr(10) || chr(10) END || regexp_replace(f.said, '^\\s+', '') || ' as ' || coalesce('[' || x.number || ']', '@p' || f.a) || ', ' || coalesce('[' || y.number || ']', '@key' || f.b) || ' and @nobody or x@p1 say first part ' || coalesce(g.name, 's1') || ' s2' || chr(10) AS part, f.title
 FROM files f LEFT JOIN ref x ON x.project = f.project AND x.key = 'p' || f.a LEFT JOIN ref y ON y.project = f.project AND y.key = 'key' || f.b LEFT JOIN files g ON g.project = f.project AND g.slug = 's1'),
line AS (SELECT project, number, '[' || number || '] ' || coalesce(nullif(authors, '') || '. ', '') || coalesce(nullif(p.title, ''), paper_id) || '.' || coalesce(' ' || year || '.', '') || coalesce(' DOI: ' || nullif(doi, '') || '.', '') AS line FROM numbers JOIN papers p USING (paper_id)),
cited AS (SELECT project, string_agg(line, chr(10) ORDER BY number) AS cited FROM line GROUP BY project),
texts AS (SELECT project, min(title) AS title, '# ' || min(title) || chr(10) || chr(10) || string_agg(part, chr(10) ORDER BY sort_order) || coalesce(chr(10) || '## References' || chr(10) || chr(10) || min(cited), '') || CASE WHEN min(cited) IS NULL THEN '' ELSE chr(10) END AS value FROM part LEFT JOIN cited USING (project) GROUP BY project)"""


@query(f"{_EXPORTED} SELECT project, value FROM texts")
def manuscript_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-17, STR-22, DML-16: whole manuscripts with numbered citations, flattened links and the references"""
    return C.manuscript(files(spark, sf_dir), papers(spark, sf_dir), keys(spark, sf_dir))


_ENTRY = "'@article{{' || paper_id || ',' || chr(10) || concat_ws(',' || chr(10), '  title = {{' || nullif(replace(replace(p.title, '{{', '\\{{'), '}}', '\\}}'), '') || '}}', '  author = {{' || authors || '}}', '  year = {{' || year || '}}', '  doi = {{' || nullif(doi, '') || '}}') || chr(10) || '}}' || chr(10)".replace("{{", "{").replace("}}", "}")


@query(f"""{_EXPORTED}, bib AS (SELECT project, string_agg({_ENTRY}, chr(10) ORDER BY number) AS entries FROM numbers JOIN papers p USING (paper_id) GROUP BY project),
made AS (SELECT project || '.md' AS name, value AS text FROM texts UNION ALL SELECT project || '-references.bib', coalesce(entries, '') FROM texts LEFT JOIN bib USING (project)
UNION ALL SELECT project || '.html', '<!doctype html>' || chr(10) || '<html><head><meta charset="utf-8"><title>' || title || '</title></head>' || chr(10) || '<body><main id="paper"></main>' || chr(10) || '<script type="application/json" id="source">' || replace(to_json([value])::VARCHAR, '</', '<\\/') || '</script></body></html>' || chr(10) FROM texts)
SELECT name, length(text) AS size, md5(text) AS content FROM made""")
def manuscript_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-16, SRC-17: every project as Markdown, HTML and BibTeX files, written whole or not at all, and read back"""
    from scholiast.operators.graph import shared_folder
    from scholiast.sources.files import write_files

    folder = f"{shared_folder(spark)}/export-{uuid.uuid4().hex}"
    write_files(C.manuscript_files(files(spark, sf_dir), papers(spark, sf_dir), keys(spark, sf_dir)), folder)
    back = spark.read.text(folder, wholetext=True).select(F.col("_metadata.file_name").alias("name"), "value")
    empty = spark.read.format("binaryFile").load(folder).filter("length = 0").select(F.regexp_extract("path", "[^/]+$", 0).alias("name"), F.lit("").alias("value"))
    whole = back.filter("value <> ''").unionByName(empty)
    return whole.select("name", F.char_length("value").cast("long").alias("size"), F.md5("value").alias("content"))


@query(f"WITH {PAPERS}, {FILES} SELECT project, slug, 'p' || a || ' key' || b || ' nobody' AS tokens, 's0 s1 s2' AS links FROM files WHERE 'p' || a <> 'key' || b")
def file_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-21: citation tokens, without addresses, and links"""
    return files(spark, sf_dir).select("project", "slug", F.array_join(C.tokens_cited("body"), " ").alias("tokens"), F.array_join(C.slugs_linked("body"), " ").alias("links"))


@query(f"WITH {PAPERS}, {FILES} SELECT f.project, t.slug, f.slug AS linked_from FROM files f JOIN files t ON t.project = f.project AND t.slug IN ('s0', 's1', 's2') WHERE f.slug <> t.slug")
def backlinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOI-13"""
    return C.backlinks(files(spark, sf_dir), "project", "slug", "body")


_CITED = "text || ' See [1,3] and [2–4], [' || (turn + 4) || '-' || (turn + 6) || '] [ref] [x, 2] [0, 7] [web:3]'"


def _cited() -> F.Column:
    return F.concat("text", F.lit(" See [1,3] and [2–4], ["), F.col("turn") + 4, F.lit("-"), F.col("turn") + 6, F.lit("] [ref] [x, 2] [0, 7] [web:3]"))


_GROUPS = rf"list_transform(regexp_extract_all(t, '\[([^\[\]\n]+)\]', 1), lambda g: trim(g))"
_KIND = r"CASE WHEN NOT regexp_full_match(x, '\d+([–-]\d+)?') THEN 2 WHEN len(list_filter(regexp_extract_all(x, '\d+'), lambda n: coalesce(TRY_CAST(n AS INT), 0) NOT BETWEEN 1 AND 9)) = 0 THEN 0 ELSE 1 END"


@query(rf"""WITH c AS (SELECT conv_id, turn, {_CITED} AS t FROM conversations),
p AS (SELECT conv_id, turn, list_filter(flatten(list_transform(regexp_extract_all(t, '\[([0-9,\s–-]+)\]', 1), lambda g: string_split_regex(trim(g), '[,\s]+'))), lambda x: regexp_full_match(x, '\d+([–-]\d+)?')) AS p, {_GROUPS} AS g FROM c)
SELECT conv_id, turn, array_to_string(list_sort(list_distinct(flatten(list_transform(p, lambda x: range(greatest(1, regexp_extract(x, '^(\d+)', 1)::INT), least(9, regexp_extract(x, '(\d+)$', 1)::INT) + 1))))), ' ') AS cited,
 array_to_string(list_sort(list_distinct(list_filter(g, lambda g: NOT regexp_matches(g, '{C.PLACEHOLDERS}') AND coalesce(list_filter(list_transform(list_filter(string_split_regex(g, '[,\s]+'), lambda x: x <> ''), lambda x: {_KIND}), lambda k: k > 0)[1] = 1, false)))), ' | ') AS invalid FROM p""")
def cited_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-18, STR-19: numbers cited within 1..9, and the groups that leave the range"""
    c = table(spark, sf_dir, "conversations").withColumn("t", _cited())
    return c.select("conv_id", "turn", F.array_join(C.T.cited_numbers("t", F.lit(9)), " ").alias("cited"), F.array_join(C.invalid_citations("t", F.lit(9)), " | ").alias("invalid"))


_ANSWER = "CASE turn % 4 WHEN 0 THEN '<think>no' || chr(10) || 'yes</think>' || text WHEN 1 THEN text || chr(10) || '---' || chr(10) || '## **References**' || chr(10) || '[1] A' WHEN 2 THEN 'a' || chr(10) || 'References:' || chr(10) || text || text ELSE text || chr(10) || 'Sources' || chr(10) || 'x' END"
_HEADING = r"\n[ \t]*(?:[-*_]{3,}[ \t]*\n[ \t]*)?(?:#{1,6}[ \t]*)?\**[ \t]*(?:references|reference list|cited papers|cited works|works cited|bibliography)\b[ \t:]*\**[ \t]*\n"


@query(rf"""WITH a AS (SELECT conv_id, turn, {_ANSWER} AS t FROM conversations), h AS (SELECT conv_id, turn, t, regexp_extract(t, '(?is)^(.*){_HEADING}', 1) AS head FROM a)
SELECT conv_id, turn, CASE WHEN regexp_matches(t, '(?i){_HEADING}') AND length(head) >= length(t) * 0.4 THEN regexp_replace(regexp_replace(regexp_replace(head, '\s+$', ''), '[-—_*]+$', ''), '\s+$', '') ELSE t END AS answer, trim(regexp_replace(t, '(?is)<think>.*?</think>', '', 'g')) AS said FROM h""")
def answers_stripped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-20: without a reference list at the end, and without thoughts"""
    t = table(spark, sf_dir, "conversations").withColumn("t", F.expr(_ANSWER.replace("chr(10)", "'\\n'")))
    return t.select("conv_id", "turn", T.strip_model_references("t").alias("answer"), T.without_thoughts("t").alias("said"))


@query(f"""WITH {PAPERS}, {FILES}, {NUMBERED}, line AS (SELECT project, number, {line_sql('number')} AS line FROM numbers JOIN papers USING (paper_id)) SELECT project, chr(10) || chr(10) || '## References' || chr(10) || chr(10) || string_agg(line, chr(10) || chr(10) ORDER BY number) AS block FROM line GROUP BY project""")
def references_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-30: the cited papers of a project, one formatted line each"""
    numbers = C.project_numbers(files(spark, sf_dir), "project", "sort_order", "body", keys(spark, sf_dir)).withColumnRenamed("key", "paper_id")
    return C.references_block(numbers, papers(spark, sf_dir), "project")


_MENTIONED = "text || ' @[Ann](mention:task:t' || (turn % 3) || ') and @[Bob B](mention:paper:p1) @[Again](mention:task:t' || (conv_id % 3) || ')'"


@query(rf"""WITH m AS (SELECT conv_id, turn, regexp_extract_all({_MENTIONED}, '@\[([^\]]*)\]\(mention:(\w+):([^)\s]+)\)', 1) AS a, regexp_extract_all({_MENTIONED}, '@\[([^\]]*)\]\(mention:(\w+):([^)\s]+)\)', 2) AS b, regexp_extract_all({_MENTIONED}, '@\[([^\]]*)\]\(mention:(\w+):([^)\s]+)\)', 3) AS c FROM conversations),
u AS (SELECT conv_id, turn, unnest(a) AS title, unnest(b) AS type, unnest(c) AS id, generate_subscripts(a, 1) AS i FROM m) SELECT conv_id, turn, type, id, arg_min(title, i) AS title FROM u GROUP BY conv_id, turn, type, id""")
def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-23: distinct mentions with their first title"""
    said = F.concat("text", F.lit(" @[Ann](mention:task:t"), F.col("turn") % 3, F.lit(") and @[Bob B](mention:paper:p1) @[Again](mention:task:t"), F.col("conv_id") % 3, F.lit(")"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(C.mentions(said)).alias("m")).select("conv_id", "turn", "m.type", "m.id", "m.title")


_SLUG = "CASE turn % 9 WHEN 0 THEN '02-results_and-discussion' WHEN 1 THEN 'Introduction' WHEN 2 THEN 'materials' WHEN 3 THEN 'part-3' WHEN 4 THEN 'Discussion' WHEN 5 THEN 'reviewer-2' WHEN 6 THEN 'summary' WHEN 7 THEN 'intro' ELSE 'x' END"
_HINTS = " ".join(f"WHEN contains(s, '{h}') THEN '{section}'" for h, section in C.SECTION_HINTS)


@query(f"WITH t AS (SELECT conv_id, turn, translate(lower({_SLUG} || ' ' || text), '-_', '  ') AS s FROM conversations) SELECT conv_id, turn, CASE {_HINTS} END AS section FROM t")
def sections_guessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-28: slug and whole text against the ordered hints, null where none occurs"""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", C.section_of(F.expr(_SLUG), "text").alias("section"))


_MD = "'intro' || chr(10) || '# Title' || chr(10) || '## Moves  ' || chr(10) || '> \"A quoted line\"' || chr(10) || chr(10) || chr(10) || text || chr(10) || '### Deeper' || chr(10) || 'x' || chr(10) || '## Phrases' || chr(10) || '> \"Another\"' || chr(10) || lang || chr(10) || '---' || chr(10)"
_STRIPPED = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(md, '(?m)^>\s*\".*$', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g'), '^$', '')"


@query(rf"""WITH d AS (SELECT doc_id, text, lang, {_MD} AS md FROM documents), e AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(md, '\s+$', ''), '\n-{{3,}}\s*$', ''), '\s+$', '') AS whole FROM d)
SELECT doc_id, 'Moves|Phrases' AS headings, trim(regexp_extract(md, '(?s)## Moves[^\n]*\n(.*)\n## Phrases', 1), ' ' || chr(10) || chr(9) || chr(13)) AS moves, {_STRIPPED} AS plain, CASE WHEN length(whole) <= 300 THEN whole ELSE
 regexp_replace(CASE WHEN 300 - strpos(reverse(left(whole, 300)), chr(10)) > 180 AND strpos(left(whole, 300), chr(10)) > 0 THEN left(whole, 300 - strpos(reverse(left(whole, 300)), chr(10))) ELSE left(whole, 300) END, '\s+$', '') || chr(10) || '…' END AS cut FROM e""")
def markdown_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-32: blocks of one heading level, text without exemplars, text cut at a line end"""
    d = table(spark, sf_dir, "documents").select("doc_id", F.expr(_MD.replace("chr(10)", "'\\n'")).alias("md"))
    blocks = d.withColumn("b", C.markdown_blocks("md"))
    return blocks.select("doc_id", F.array_join(F.transform("b", lambda x: x["heading"]), "|").alias("headings"), F.get("b", F.lit(0))["body"].alias("moves"), C.without_exemplars("md").alias("plain"), C.trimmed_block("md", 300).alias("cut"))


@query("""WITH n AS (SELECT o_custkey AS c, string_agg('[p' || (o_orderkey % 20) || '] ' || o_orderpriority || chr(10), chr(10) ORDER BY o_orderdate, o_orderkey) AS t, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1),
m AS (SELECT o_custkey AS c, string_agg('[highlight] p' || (o_orderkey % 20) || ' color #ffcc00  ' || printf('(%.3f,%.3f,%.3fx%.3f), (%.3f,%.3f,%.3fx%.3f)', 0.25, o_orderkey % 8 / 8.0, 0.5, 0.125, 0.0, 0.5, 1.0, 0.25) || chr(10) || CASE WHEN o_orderkey % 2 = 0 THEN chr(10) || '   ↳ ' || o_orderpriority || chr(10) ELSE '' END, chr(10) ORDER BY o_orderdate, o_orderkey) AS t, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)
SELECT c_custkey::VARCHAR AS paper_id, concat_ws(chr(10), '# Review: ' || c_name || chr(10) || 'Paper ID: ' || c_custkey || chr(10), coalesce('── Notes (' || n.n || ') ──' || chr(10) || n.t, '── No notes ──' || chr(10)), coalesce('── Marks (' || m.n || ') ──' || chr(10) || m.t, '── No marks ──')) AS value FROM customer LEFT JOIN n ON n.c = c_custkey LEFT JOIN m ON m.c = c_custkey""")
def review_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-18: notes and marks of each paper as text"""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    at = F.struct("o_orderdate", "o_orderkey").alias("at")
    own = o.select(F.col("o_custkey").cast("string").alias("paper_id"), at, (F.col("o_orderkey") % 20).alias("page"), "o_orderstatus", "o_orderpriority", "o_orderkey")
    notes = own.filter("o_orderstatus = 'F'").select("paper_id", "at", "page", F.col("o_orderpriority").alias("text"))
    rect = lambda x, y, w, h: F.struct(x.alias("x"), y.alias("y"), w.alias("width"), h.alias("height"))
    rects = F.array(rect(F.lit(0.25), F.col("o_orderkey") % 8 / 8, F.lit(0.5), F.lit(0.125)), rect(F.lit(0.0), F.lit(0.5), F.lit(1.0), F.lit(0.25)))
    marks = own.filter("o_orderstatus = 'O'").select("paper_id", "at", F.lit("highlight").alias("type"), "page", F.lit("#ffcc00").alias("color"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).alias("note"), rects.alias("rects"))
    return C.review_text(c.select(F.col("c_custkey").cast("string").alias("paper_id"), F.col("c_name").alias("title")), notes, marks)


@query("""WITH r AS (SELECT l_orderkey, list({'x': l_discount, 'y': l_tax, 'w': l_quantity / 48, 'h': CASE WHEN l_linenumber = 3 THEN 0.0 ELSE l_tax END} ORDER BY l_linenumber) AS r FROM lineitem GROUP BY 1)
SELECT l_orderkey, CASE WHEN len(list_filter(r, lambda x: x.x NOT BETWEEN 0 AND 1 OR x.y NOT BETWEEN 0 AND 1 OR x.w NOT BETWEEN 0 AND 1 OR x.h NOT BETWEEN 0 AND 1)) = 0 THEN len(list_filter(r, lambda x: x.w > 0 AND x.h > 0)) END AS kept FROM r""")
def rects_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MTH-07: null where a number leaves 0..1, else how many rectangles have a size"""
    rect = F.struct("l_linenumber", F.col("l_discount").alias("x"), F.col("l_tax").alias("y"), (F.col("l_quantity") / 48).alias("width"), F.when(F.col("l_linenumber") == 3, 0.0).otherwise(F.col("l_tax")).alias("height"))
    valid = C.valid_rects(F.sort_array(F.collect_list(rect)))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.when(valid.isNotNull(), F.size(valid)).alias("kept"))


_LISTED = "'Facts:' || chr(10) || '- ' || text || chr(10) || '  2) short one' || chr(10) || '* The second fact is about ' || role"


@query(rf"""WITH m AS (SELECT conv_id, turn, list_filter(list_transform(string_split_regex({_LISTED}, '\r?\n'), lambda x: trim(regexp_replace(x, '^\s*(?:[-*•]|\d+[.)])\s*', ''))), lambda x: length(x) > 20) AS facts FROM conversations WHERE role = 'assistant') SELECT conv_id, turn, len(facts) AS n, array_to_string(facts, '|') AS facts FROM m""")
def memory_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM-06: the facts that a model lists after an answer, without those of twenty characters or fewer"""
    c = table(spark, sf_dir, "conversations").filter("role = 'assistant'").withColumn("facts", C.bullets(F.expr(_LISTED.replace("chr(10)", "'\\n'"))))
    return c.select("conv_id", "turn", F.size("facts").cast("long").alias("n"), F.array_join("facts", "|").alias("facts"))
