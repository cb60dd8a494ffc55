"""Text queries over documents, pages, benchmark and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scholiast.functions import text as T
from scholiast.functions.chunking import chunk_texts
from scholiast.plans.registry import query, table

CONTENT = "trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'))"
NEWLINE = "chr(10)"


@query(f"SELECT doc_id, md5({CONTENT}) AS hash FROM documents")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-07"""
    return table(spark, sf_dir, "documents").select("doc_id", T.content_hash("text").alias("hash"))


@query("SELECT doc_id, left(md5(source || '::' || doc_id), 16) AS chunk_id, '[' || source || ' — ' || lang || ']' || chr(10) || text AS embedded FROM documents")
def chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-03, STR-04"""
    return table(spark, sf_dir, "documents").select("doc_id", T.chunk_id("source", "doc_id").alias("chunk_id"), T.embedded_text("source", "lang", "text").alias("embedded"))


OTHER_LETTERS = r"\x{AA}\x{B5}\x{BA}\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{2C1}\x{300}-\x{36F}\x{1E00}-\x{1EFF}\x{370}-\x{3FF}\x{400}-\x{52F}"


@query(rf"""SELECT doc_id, len(regexp_extract_all(text, '[^ \t\n\r\f\v]+')) AS runs, len(regexp_extract_all(text, '[A-Za-z][A-Za-z''\-]*')) AS words, len(regexp_extract_all(regexp_replace(text, '[A-Za-z]*[0-9_{OTHER_LETTERS}][A-Za-z0-9_{OTHER_LETTERS}]*', '0', 'g'), '[A-Za-z][A-Za-z''-]*')) AS bounded_words FROM documents""")
def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-24"""
    return table(spark, sf_dir, "documents").select("doc_id", *T.word_counts("text"))


@query(r"""SELECT page_id, md5(trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&#39;', ''''), '&amp;', '&'), '[ \t\n\r\f\v]+', ' ', 'g'))) AS plain FROM pages""")
def html_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-14"""
    return table(spark, sf_dir, "pages").select("page_id", F.md5(T.strip_tags("html")).alias("plain"))


@query("""SELECT page_id, left(regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 60) AS slug, left(regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 48) AS journal_slug FROM pages""")
def slugify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-13"""
    return table(spark, sf_dir, "pages").select("page_id", T.slug("url", 60, "-").alias("slug"), T.slug("url", 48, "_").alias("journal_slug"))


@query(r"""SELECT doc_id, left(sha1(trim(regexp_replace(lower(text), '[ \t\n\r\f\v]+', ' ', 'g'))), 12) AS print FROM documents""")
def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-29"""
    return table(spark, sf_dir, "documents").select("doc_id", T.fingerprint("text").alias("print"))


@query("SELECT doc_id, CASE WHEN length(text) > 200 THEN left(text, 200) || '…' ELSE text END AS preview, trim(regexp_replace(lower(text), '[^\\p{L}\\p{M}\\p{N}_]+', ' ', 'g')) AS title_key FROM documents")
def previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-06, STR-27"""
    return table(spark, sf_dir, "documents").select("doc_id", T.preview("text", 200).alias("preview"), T.title_key("text").alias("title_key"))


_TAIL = "substr(text, {at} + 1, 3200)"
_BREAK = """CASE WHEN {at} + 3200 >= length(text) THEN length(text)
  WHEN strpos(reverse({w}), chr(10) || chr(10)) BETWEEN 1 AND 3198 THEN {at} + 3200 - strpos(reverse({w}), chr(10) || chr(10))
  WHEN strpos(reverse({w}), ' .') BETWEEN 1 AND 3198 THEN {at} + 3200 - strpos(reverse({w}), ' .')
  WHEN strpos(reverse({w}), chr(10)) BETWEEN 1 AND 3199 THEN {at} + 3200 - strpos(reverse({w}), chr(10)) + 1
  ELSE {at} + 3200 END"""


def _step(at: str) -> str:
    """SQL of the next boundary of a chunk that begins at `at`."""
    return _BREAK.format(at=at, w=_TAIL.format(at=at))


_NEXT = "CASE WHEN stop - 600 > pos THEN stop - 600 ELSE stop END"


@query(f"""WITH RECURSIVE r(doc_id, text, pos, stop) AS (
  SELECT doc_id, text, 0::BIGINT, CASE WHEN e < length(text) AND substr(text, e + 1, 1) = chr(10) THEN e + 1 ELSE e END FROM (SELECT doc_id, text, {_step('0')} AS e FROM documents)
  UNION ALL
  SELECT doc_id, text, pos, CASE WHEN e < length(text) AND substr(text, e + 1, 1) = chr(10) THEN e + 1 ELSE e END FROM (SELECT doc_id, text, pos, {_step('pos')} AS e FROM (SELECT doc_id, text, {_NEXT} AS pos FROM r WHERE stop < length(text)))),
k AS (SELECT doc_id, pos, trim(substr(text, pos + 1, stop - pos), ' ' || chr(9) || chr(10) || chr(13)) AS chunk FROM r)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1)::INT AS position, md5(chunk) AS chunk FROM k WHERE chunk <> ''""")
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-01, STR-02"""
    return chunk_texts(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "position", F.md5("chunk").alias("chunk"))


# a split behind a mark, for an engine without look-behind: the mark is kept and a control character put behind it
_TRIMMED = "list_transform(string_split(p, chr(10)), lambda l: trim(l))"
_LINES = rf"list_filter({_TRIMMED}, lambda l: l <> '' AND NOT starts_with(l, '#') AND NOT regexp_matches(l, '^\[\d+\]|^\d+\.\s+[A-Z][a-z]+,\s'))"
_JOINED = rf"trim(regexp_replace(regexp_replace(array_to_string({_LINES}, ' '), '^\s*[-*•]\s+', ''), '\s+', ' ', 'g'))"
_GUARDED = rf"regexp_replace({_JOINED}, '(?i)(^|[^\p{{L}}\p{{N}}_])({T.ABBREVIATIONS})\.', '\1\2' || chr(8291), 'g')"
_PARTS = rf"""list_transform(string_split(regexp_replace({_GUARDED}, '([.!?])["'')\]]*\s+(["''(\[]?[A-Z0-9])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: trim(replace(x, chr(8291), '.')))"""
_SAID = rf"flatten(list_transform(string_split_regex(text, '\n\s*\n'), lambda p: {_PARTS}))"


def sentence_list(least: int) -> str:
    """SQL of a text's sentences of at least `least` words."""
    return rf"list_filter({_SAID}, lambda x: len(regexp_extract_all(x, '\S+')) >= {least})"


def sentence_sizes(least: int) -> str:
    """SQL of the ascending word counts of a text's sentences."""
    return rf"list_sort(list_transform({sentence_list(least)}, lambda x: len(regexp_extract_all(x, '\S+'))))"


# sentences of an audit end before a capital, a quote or a bracket, behind abbreviations too
AUDIT_SENTENCES = r"""list_filter(list_transform(string_split(regexp_replace(text, '([.!?])["'')\]]?\s+([A-Z("''])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: trim(x)), lambda x: len(regexp_extract_all(x, '\S+')) >= 3)"""
AUDIT_PARAGRAPHS = r"list_filter(list_transform(string_split_regex(text, '\n\s*\n'), lambda p: trim(p)), lambda p: len(regexp_extract_all(p, '\S+')) >= 15)"
# runs of word characters that are not ASCII letters only hold no bounded word
BOUNDED = rf"len(regexp_extract_all(regexp_replace(text, '[A-Za-z]*[0-9_{OTHER_LETTERS}][A-Za-z0-9_{OTHER_LETTERS}]*', '0', 'g'), '[A-Za-z][A-Za-z''-]*'))"


def quantile(cut: int, parts: int) -> str:
    """SQL of a cut by the exclusive method over the ascending list `s`."""
    h = f"({cut} * (len(s) + 1) / {parts}.0)"
    j = f"greatest(1, least(floor({h})::BIGINT, len(s) - 1))"
    return f"CASE WHEN len(s) = 1 THEN s[1]::DOUBLE ELSE round(s[{j}] + ({h} - {j}) * (s[{j} + 1] - s[{j}]), 6) END"


@query(f"WITH t AS (SELECT doc_id, {sentence_sizes(4)} AS s FROM documents) SELECT doc_id, len(s) AS n_sentences, {quantile(1, 4)} AS q1, {quantile(2, 4)} AS q2, {quantile(3, 4)} AS q3 FROM t WHERE len(s) > 0")
def sentence_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-25, AGG-20: number, median and quartiles (exclusive method) of sentence lengths"""
    from scholiast.operators.style import exclusive_quantile

    sizes = table(spark, sf_dir, "documents").select("doc_id", F.array_sort(F.transform(T.sentences("text"), lambda s: F.regexp_count(s, F.lit(r"\S+")))).alias("sizes"))
    cuts = [exclusive_quantile(F.col("sizes"), i, 4).alias(f"q{i}") for i in (1, 2, 3)]
    return sizes.filter(F.size("sizes") > 0).select("doc_id", F.size("sizes").alias("n_sentences"), *cuts)


# fixed values: hosts that are never shown, and hosts that come first
BLOCKED = "linkedin.com facebook.com twitter.com x.com instagram.com reddit.com quora.com pinterest.com youtube.com tiktok.com amazon.com ebay.com".split()
ACADEMIC = "arxiv.org pubmed.ncbi.nlm.nih.gov ncbi.nlm.nih.gov scholar.google.com semanticscholar.org sciencedirect.com springer.com wiley.com nature.com science.org acs.org rsc.org mdpi.com frontiersin.org tandfonline.com pubs.acs.org iopscience.iop.org researchgate.net academia.edu ssrn.com".split()
_LIST = lambda names: ", ".join(f"'{n}'" for n in names)
_HOSTS = ["reddit.com", "arxiv.org", "link.springer.com", "pubs.acs.org", "www.nature.com"]
_HOST = "CASE page_id % 7 " + " ".join(f"WHEN {i} THEN '{h}'" for i, h in enumerate(_HOSTS)) + " ELSE regexp_extract(url, '^https?://([^/]+)', 1) END"


@query(f"""WITH h AS (SELECT page_id, page_id % 5 AS query_id, {_HOST} AS host FROM pages), s AS (SELECT *, CASE WHEN host IN ({_LIST(ACADEMIC)}) THEN 2 WHEN regexp_matches(host, '({"|".join(h.replace(".", "[.]") for h in ACADEMIC)})$') THEN 1 ELSE 0 END AS score FROM h WHERE host NOT IN ({_LIST(BLOCKED)}))
SELECT query_id, page_id, host, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, page_id) AS place FROM s QUALIFY place <= 6""")
def web_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-17: blocked hosts go, academic hosts come first, then those that end like one, then the order of arrival; six for each question, numbered anew"""
    host = F.expr(_HOST.replace("regexp_extract(url, '^https?://([^/]+)', 1)", "regexp_extract(url, '^https?://([^/]+)', 1)"))
    p = table(spark, sf_dir, "pages").select("page_id", (F.col("page_id") % 5).alias("query_id"), host.alias("host")).filter(~F.col("host").isin(BLOCKED))
    ends = F.exists(F.array(*[F.lit(h) for h in ACADEMIC]), lambda h: F.endswith(F.col("host"), h))
    scored = p.withColumn("score", F.when(F.col("host").isin(ACADEMIC), 2).when(ends, 1).otherwise(0))
    return scored.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "page_id"))).filter("place <= 6")


@query(r"""SELECT doc_id, left(regexp_replace(regexp_replace(regexp_replace(left(text, 300), '[^\p{L}\p{N}_\-]', '_', 'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g'), 120) AS paper, coalesce(nullif(left(lower(regexp_replace(regexp_replace(trim(text), '[^\p{L}\p{N}_\-]+', '-', 'g'), '^-+|-+$', '', 'g')), 60), ''), 'untitled') AS project, left(regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 48) AS journal, left(regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 40) AS note FROM documents""")
def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-13: the four variants"""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", T.paper_slug(F.left("text", F.lit(300))).alias("paper"), T.project_slug("text").alias("project"), T.slug("text", 48, "_").alias("journal"), T.slug("text", 40, "-").alias("note"))
