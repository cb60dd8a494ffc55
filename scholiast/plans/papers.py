"""Queries over bibliographic records: documents stand for papers, with titles, authors, years, DOIs and files made from their columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholiast.functions import text as T
from scholiast.operators import library as L
from scholiast.operators import matching as M
from scholiast.plans.registry import query, table

PAPERS = r"""papers AS (SELECT doc_id, 'p' || doc_id AS paper_id, array_to_string(string_split_regex(trim(text), '\s+')[1:8], ' ') AS title,
CASE doc_id % 4 WHEN 0 THEN 'Müller-' || source || ', A.; Other, B.' WHEN 1 THEN 'Ann ' || source || ' and Bob Other' WHEN 2 THEN '["Ann Lee1,2*", "' || source || '†"]' ELSE 'unknown' END AS authors,
CASE WHEN doc_id % 6 = 0 THEN NULL ELSE (1980 + doc_id % 45)::INT END AS year,
CASE doc_id % 3 WHEN 0 THEN 'https://doi.org/10.1234/ABC.' || doc_id || '.' WHEN 1 THEN '' ELSE '10.5555/x' || doc_id || ',);' END AS doi,
'/papers/' || doc_id || '.pdf' AS source_pdf, source, lang, text FROM documents)"""


#: What \s is in the oracles; in Java it is a vertical tab, too.
SPACES = r"[ \t\n\f\r]+"


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, paper_id, title, authors, year, doi, source_pdf, source, lang, text."""
    key = F.col("doc_id").cast("string")
    of = lambda n, *values: F.coalesce(*[F.when(F.col("doc_id") % n == i, v) for i, v in enumerate(values[:-1])], values[-1])
    authors = of(4, F.concat(F.lit("Müller-"), "source", F.lit(", A.; Other, B.")), F.concat(F.lit("Ann "), "source", F.lit(" and Bob Other")), F.concat(F.lit('["Ann Lee1,2*", "'), "source", F.lit('†"]')), F.lit("unknown"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.concat(F.lit("p"), key).alias("paper_id"), F.array_join(F.slice(F.split(F.trim("text"), SPACES), 1, 8), " ").alias("title"), authors.alias("authors"),
        F.when(F.col("doc_id") % 6 != 0, (1980 + F.col("doc_id") % 45).cast("int")).alias("year"),
        of(3, F.concat(F.lit("https://doi.org/10.1234/ABC."), key, F.lit(".")), F.lit(""), F.concat(F.lit("10.5555/x"), key, F.lit(",);"))).alias("doi"),
        F.concat(F.lit("/papers/"), key, F.lit(".pdf")).alias("source_pdf"), "source", "lang", "text",
    )


def folded(x: str) -> str:
    """SQL of the ASCII form of an expression."""
    return rf"trim(regexp_replace(lower(regexp_replace(strip_accents({x}), '[^\x00-\x7F]+', '', 'g')), '[^a-z0-9]+', ' ', 'g'))"


def doi_sql(x: str, tail: str = " .;)") -> str:
    return rf"nullif(regexp_replace(regexp_replace(lower(trim({x})), '^(https?://)?(dx\.)?doi\.org/', ''), '[{tail}]+$', ''), '')"


def ordered_distinct(x: str) -> str:
    """SQL of a list without later repeats."""
    return f"list_filter({x}, lambda x, i: list_position({x}, x) = i)"


@query(f"SELECT doc_id, md5({folded('text')}) AS folded FROM documents")
def ascii_folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-05"""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.ascii_fold("text")).alias("folded"))


@query(f"WITH {PAPERS} SELECT paper_id, {doi_sql('doi')} AS citation, {doi_sql('doi', ' .;,)')} AS metadata, replace(doi, 'https://doi.org/', '') AS corpus FROM papers")
def doi_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-08: the three variants"""
    return papers(spark, sf_dir).select("paper_id", T.doi_key("doi").alias("citation"), T.doi_key("doi", " .;,)").alias("metadata"), T.doi_of_corpus("doi").alias("corpus"))


_SAID = "text || ' see https://doi.org/10.1234/abc' || doc_id || '). Also 10.5555/x.' || (doc_id % 7) || ', 10.1234/abc' || doc_id || ';'"
_FOUND = rf"list_transform(regexp_extract_all({_SAID}, '10\.\d{{4,9}}/[-._;()/:A-Za-z0-9]+'), lambda x: regexp_replace(x, '[.,;:)]+$', ''))"


@query(f"WITH f AS (SELECT doc_id, {_FOUND} AS d FROM documents) SELECT doc_id, array_to_string({ordered_distinct('d')}, ' ') AS dois FROM f")
def doi_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-09"""
    said = F.concat("text", F.lit(" see https://doi.org/10.1234/abc"), "doc_id", F.lit("). Also 10.5555/x."), F.col("doc_id") % 7, F.lit(", 10.1234/abc"), "doc_id", F.lit(";"))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(T.dois(said), " ").alias("dois"))


_DATED = "text || ' (' || (1890 + doc_id % 170) || ') x' || (1900 + doc_id % 90) || ' ' || (1930 + doc_id % 120)"


@query(rf"""SELECT doc_id, TRY_CAST(nullif(regexp_extract({_DATED}, '\b((?:19|20)\d{{2}})\b', 1), '') AS INT) AS year, TRY_CAST(nullif(regexp_extract({_DATED}, '\b(19[5-9]\d|20[0-3]\d)\b', 1), '') AS INT) AS hint FROM documents""")
def year_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-10: both variants over whole texts"""
    said = F.concat("text", F.lit(" ("), 1890 + F.col("doc_id") % 170, F.lit(") x"), 1900 + F.col("doc_id") % 90, F.lit(" "), 1930 + F.col("doc_id") % 120)
    return table(spark, sf_dir, "documents").select("doc_id", T.first_year(said).alias("year"), T.first_year(said, T.HINT_YEAR).alias("hint"))


_FIRST = r"trim(string_split_regex(authors, '(?i)\s*(?:;|\band\b|\|)\s*')[1])"
FAMILY = f"replace({folded(f'CASE WHEN contains({_FIRST}, chr(44)) THEN split_part({_FIRST}, chr(44), 1) ELSE string_split_regex({_FIRST}, chr(32))[-1] END')}, ' ', '')"
CLEAN = r"""CASE WHEN lower(trim(authors)) IN ('see paper', 'unknown', 'n/a', 'na', 'none', '') THEN '' ELSE regexp_replace(regexp_replace(regexp_replace(regexp_replace(
CASE WHEN authors LIKE '[%' THEN array_to_string(list_filter(list_transform(from_json(authors, '["VARCHAR"]'), lambda x: trim(x)), lambda x: x <> ''), '; ') ELSE trim(authors) END, '[\d*†‡§]+', '', 'g'), '(\s*,\s*){2,}', ', ', 'g'), '\s{2,}', ' ', 'g'), '^[ ;,]+|[ ;,]+$', '', 'g') END"""


@query(f"WITH {PAPERS} SELECT paper_id, {FAMILY} AS family, {CLEAN} AS authors FROM papers")
def author_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-11, STR-16"""
    return papers(spark, sf_dir).select("paper_id", T.family_name("authors").alias("family"), T.clean_authors("authors").alias("authors"))


KEYED = f"""based AS (SELECT *, left({FAMILY} || coalesce(year::VARCHAR, '') || coalesce(nullif(left(array_to_string(list_filter(string_split({folded('title')}, ' '), lambda w: w NOT IN ('the', 'a', 'an', 'of', 'and', 'in', 'for', 'on', ''))[1:3], ''), 34), ''), 'reference'), 48) AS base FROM papers),
keyed AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY base ORDER BY doc_id) = 1 THEN base ELSE base || row_number() OVER (PARTITION BY base ORDER BY doc_id) END AS citation_key FROM based)"""


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The papers with their citation keys."""
    return L.with_unique_keys(papers(spark, sf_dir), "doc_id")


@query(f"WITH {PAPERS}, {KEYED} SELECT paper_id, citation_key FROM keyed")
def citation_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-12: later papers of one key get 2, 3, ..."""
    return catalog(spark, sf_dir).select("paper_id", "citation_key")


_TITLED = "CASE doc_id % 8 WHEN 0 THEN 'Downloaded from ' || title WHEN 1 THEN left(title, 4) WHEN 2 THEN paper_id WHEN 3 THEN doc_id || '.pdf' WHEN 4 THEN 'Paper ' || doc_id WHEN 5 THEN replace(title, 'e', '❈❈❈') WHEN 6 THEN '' ELSE title END"
GLYPH = r"/(?:uni[0-9A-Fa-f]{4}|[A-Za-z]{1,4}\d{1,4})"
_SYMBOLS = T.SYMBOLS


def _n(pattern: str, x: str) -> str:
    return f"len(regexp_extract_all({x}, '{pattern}'))"


def garble_sql(x: str) -> str:
    """SQL of the garble ratio; no letter or digit of the test data lies in a block of symbols."""
    rest = f"regexp_replace({x}, '{GLYPH}', ' ', 'g')"
    bad = f"({_n(GLYPH, x)} + {_n(f'[{_SYMBOLS}]', rest)})"
    good = _n(r"[\p{L}\p{N}]", rest)
    return f"CASE WHEN {bad} + {good} > 0 THEN {bad} / ({bad} + {good}) ELSE 0.0 END"


def title_sql(x: str) -> str:
    return rf"trim(regexp_replace(lower({x}), '[^\p{{L}}\p{{M}}\p{{N}}_]+', ' ', 'g'))"


PLACEHOLDER = rf"(trim(t) = '' OR {title_sql('trim(t)')} IN ({title_sql('paper_id')}, {title_sql('doc_id::VARCHAR')}, {title_sql(chr(100) + 'oc_id || ' + chr(39) + '.pdf' + chr(39))}) OR regexp_matches(trim(t), '(?i)^(?:paper[\s_-]*)?\d+(?:\.pdf)?$') OR lower(trim(t)) LIKE '%.pdf')"


@query(rf"""WITH {PAPERS}, t AS (SELECT doc_id, paper_id, {_TITLED} AS t FROM papers)
SELECT paper_id, length(trim(t)) < 6 OR regexp_matches(trim(t), '{T.FURNITURE}') OR {garble_sql('trim(t)')} >= 0.25 AS junk, {PLACEHOLDER} AS placeholder, length(trim(t)) >= 6 AND NOT {PLACEHOLDER} AS usable FROM t""")
def title_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-14, FLT-15: junk, placeholder and usable titles"""
    t = papers(spark, sf_dir).withColumn("t", F.expr(_TITLED))
    return t.select("paper_id", T.is_junk_title("t").alias("junk"), T.is_placeholder_title("t", "paper_id", "source_pdf").alias("placeholder"), T.is_usable_title("t", "paper_id", "source_pdf").alias("usable"))


_BROKEN = "CASE doc_id % 5 WHEN 0 THEN replace(replace(text, 'e', '❈'), 'a', '▲') WHEN 1 THEN replace(text, ' ', ' /a114 ') ELSE text END"


@query(f"WITH t AS (SELECT doc_id, left({_BROKEN}, 40000) AS t FROM documents) SELECT doc_id, round({garble_sql('t')}, 6) AS ratio, length(t) >= 80 AND {garble_sql('t')} >= 0.25 AS garbled FROM t")
def garbled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-13: the sample is the first 40,000 characters, which is part of the rule"""
    t = table(spark, sf_dir, "documents").select("doc_id", F.expr(_BROKEN).alias("t"))
    return t.select("doc_id", F.round(T.garble_ratio(F.left("t", F.lit(40000))), 6).alias("ratio"), T.is_garbled("t").alias("garbled"))


def line_sql(n: str) -> str:
    """SQL of a formatted reference of `papers`."""
    return rf"'[' || {n} || '] ' || concat_ws('. ', nullif({CLEAN}, ''), nullif(regexp_replace(trim(coalesce(nullif(title, ''), paper_id)), '\.+$', ''), ''), year::VARCHAR) || '.' || coalesce(' https://doi.org/' || nullif(trim(doi), ''), '')"


@query(f"WITH {PAPERS} SELECT paper_id, {line_sql('(doc_id + 1)')} AS line FROM papers")
def reference_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-17"""
    return papers(spark, sf_dir).select("paper_id", T.reference_line(F.col("doc_id") + 1, F.col("authors"), F.col("title"), F.col("year"), F.col("doi"), F.col("paper_id")).alias("line"))


_QUERY = "CASE doc_id % 5 WHEN 0 THEN 'Cite this: J. Chem. 2020, 12, 34–56 ' || title WHEN 1 THEN replace(title, ' ', '-') WHEN 2 THEN 'Nanoscale Article ' || title WHEN 3 THEN title || '  pubs.acs.org/abc | ' ELSE 'Advances in Colloid and Interface Science 12 (1999) 3-44 ' || title END"
_FURNITURE = [r"(?i)cite this:.*?\d{4},?\s*\d+,?\s*[\d–-]+", r"(?i)pubs\.acs\.org\S*", r"(?i)^(nano\w+|materials|molecules|polymers|membranes)\s+(article|review)\b", r"(?i)advances in colloid and interface science\s*\d+\s*\(\d{4}\)\s*[\d–-]+"]
_BARE = _QUERY
for _f in _FURNITURE:
    _BARE = f"regexp_replace({_BARE}, '{_f}', '', 'g')"


@query(rf"""WITH {PAPERS}, t AS (SELECT paper_id, {_BARE} AS t FROM papers), u AS (SELECT paper_id, CASE WHEN len(regexp_extract_all(t, '-')) >= 3 AND NOT contains(trim(t), ' ') THEN replace(t, '-', ' ') ELSE t END AS t FROM t)
SELECT paper_id, regexp_replace(regexp_replace(t, '\s{{2,}}', ' ', 'g'), '^[ |·-]+|[ |·-]+$', '', 'g') AS asked FROM u""")
def titles_asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-15"""
    return papers(spark, sf_dir).select("paper_id", T.title_for_query(F.expr(_QUERY)).alias("asked"))


STOP = ", ".join(f"'{w}'" for w in T.TITLE_STOP)


def tokens_sql(x: str) -> str:
    return rf"list_distinct(list_filter(string_split(trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: length(w) > 1 AND w NOT IN ({STOP})))"


@query(f"""WITH q AS (SELECT item_id, {tokens_sql('text')} AS a FROM benchmark), d AS (SELECT doc_id, {tokens_sql('text')} AS b FROM documents),
r AS (SELECT item_id, doc_id, len(list_intersect(a, b)) AS shared, round(len(list_intersect(a, b)) / greatest(1, least(len(a), len(b))), 6) AS score FROM q, d)
SELECT item_id, doc_id, shared, score, CASE WHEN score >= 0.85 AND shared >= 5 THEN 'AUTO' ELSE 'REVIEW' END AS tier FROM r WHERE score >= 0.6 AND shared >= 3""")
def overlap_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MTH-04: items meet the documents that share one of their words, whole texts"""
    q = table(spark, sf_dir, "benchmark").select("item_id", T.title_tokens("text").alias("a"))
    d = table(spark, sf_dir, "documents").select("doc_id", T.title_tokens("text").alias("b"))
    return M.overlaps(q, "item_id", "a", d, "doc_id", "b").filter("tier <> 'SKIP'")


_OFFERS = """offers AS (SELECT doc_id, paper_id, 1 AS n, array_to_string(string_split(title, ' ')[1:5], ' ') AS new_title, year FROM papers UNION ALL
SELECT doc_id, paper_id, 2, title || ' and the <i>Effect</i> &amp; more words beside it all', year + 1 FROM papers WHERE doc_id % 3 = 0 UNION ALL
SELECT p.doc_id, p.paper_id, 3, o.title, o.year FROM papers p JOIN papers o ON o.doc_id = p.doc_id + 1)"""


@query(f"""WITH {PAPERS}, {_OFFERS}, s AS (SELECT o.paper_id, n, regexp_replace(new_title, '<[^>]+>', '', 'g') AS raw, o.year, p.title FROM offers o JOIN papers p USING (paper_id)),
c AS (SELECT *, replace(raw, '&amp;', '&') AS new_title FROM s),
m AS (SELECT *, len(list_intersect({tokens_sql('title')}, {tokens_sql('new_title')})) AS shared, CASE WHEN least(len({tokens_sql('title')}), len({tokens_sql('new_title')})) = 0 THEN 0.0 ELSE round(len(list_intersect({tokens_sql('title')}, {tokens_sql('new_title')})) / least(len({tokens_sql('title')}), len({tokens_sql('new_title')})), 6) END AS score FROM c),
b AS (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY score DESC, n) AS k FROM m)
SELECT paper_id, new_title, year, shared, score, CASE WHEN score >= 0.85 AND shared >= 5 THEN 'AUTO' WHEN score >= 0.6 AND shared >= 3 THEN 'REVIEW' ELSE 'SKIP' END AS tier FROM b WHERE k = 1""")
def proposal_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DED-10, STR-14: of the titles that a search service offers for a paper the one with the largest overlap, the first of equal ones, and its tier"""
    p = papers(spark, sf_dir)
    one = p.select("paper_id", F.lit(1).alias("n"), F.array_join(F.slice(F.split("title", " "), 1, 5), " ").alias("new_title"), "year")
    two = p.filter("doc_id % 3 = 0").select("paper_id", F.lit(2).alias("n"), F.concat("title", F.lit(" and the <i>Effect</i> &amp; more words beside it all")).alias("new_title"), (F.col("year") + 1).alias("year"))
    three = p.select((F.col("doc_id") - 1).alias("doc_id"), F.lit(3).alias("n"), F.col("title").alias("new_title"), "year").join(p.select("doc_id", "paper_id"), "doc_id").select("paper_id", "n", "new_title", "year")
    return M.proposals(p.select("paper_id", "title"), one.unionByName(two).unionByName(three)).select("paper_id", "new_title", "year", "shared", "score", "tier")


RECONCILED = f"""old AS (SELECT doc_id, paper_id, CASE doc_id % 4 WHEN 0 THEN doc_id::VARCHAR WHEN 1 THEN 'paper_' || doc_id WHEN 2 THEN '' ELSE title END AS t, CASE WHEN doc_id % 5 = 0 THEN 'kept' END AS title_original, doi, source_pdf FROM papers),
sources AS (SELECT paper_id, NULL AS doi, NULL AS file, title || ' by id' AS title FROM papers WHERE doc_id % 3 = 0 UNION ALL SELECT NULL, doi, NULL, title || ' by doi' FROM papers WHERE doc_id % 7 = 0 UNION ALL
SELECT NULL, NULL, '/elsewhere/' || doc_id || '.pdf', CASE WHEN doc_id % 9 = 0 THEN 'paper_1' ELSE title || ' BY--ID' END FROM papers WHERE doc_id % 2 = 0),
met AS (SELECT o.*, s.title, 1 AS way FROM old o JOIN sources s ON s.paper_id = o.paper_id UNION ALL SELECT o.*, s.title, 2 FROM old o JOIN sources s ON {title_sql('s.doi')} = {title_sql('o.doi')} AND o.doi <> '' UNION ALL
SELECT o.*, s.title, 3 FROM old o JOIN sources s ON regexp_replace(s.file, '^.*/', '') = regexp_replace(o.source_pdf, '^.*/', '')),
fit AS (SELECT * FROM met WHERE {PLACEHOLDER} AND length(trim(title)) >= 6 AND NOT {PLACEHOLDER.replace('trim(t)', 'trim(title)')}),
found AS (SELECT paper_id, arg_min(trim(title), way) AS new_title FROM fit GROUP BY paper_id HAVING count(DISTINCT {title_sql('title')}) = 1)"""


@query(f"WITH {PAPERS}, {RECONCILED} SELECT paper_id, coalesce(new_title, t) AS title, CASE WHEN new_title IS NOT NULL THEN coalesce(nullif(title_original, ''), t) ELSE title_original END AS title_original, new_title IS NOT NULL AS changed FROM old LEFT JOIN found USING (paper_id)")
def title_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOI-10, DED-09: placeholder titles take the one title that records of the same id, DOI or file name agree on; conflicts and curated titles stay"""
    p = papers(spark, sf_dir)
    t = F.expr("CASE doc_id % 4 WHEN 0 THEN cast(doc_id AS string) WHEN 1 THEN concat('paper_', doc_id) WHEN 2 THEN '' ELSE title END")
    old = p.select("paper_id", t.alias("title"), F.when(F.col("doc_id") % 5 == 0, "kept").alias("title_original"), "doi", "source_pdf")
    none = F.lit(None).cast("string")
    by_id = p.filter("doc_id % 3 = 0").select("paper_id", none.alias("doi"), none.alias("file"), F.concat("title", F.lit(" by id")).alias("title"))
    by_doi = p.filter("doc_id % 7 = 0").select(none.alias("paper_id"), "doi", none.alias("file"), F.concat("title", F.lit(" by doi")).alias("title"))
    by_file = p.filter("doc_id % 2 = 0").select(none.alias("paper_id"), none.alias("doi"), F.concat(F.lit("/elsewhere/"), "doc_id", F.lit(".pdf")).alias("file"), F.when(F.col("doc_id") % 9 == 0, "paper_1").otherwise(F.concat("title", F.lit(" BY--ID"))).alias("title"))
    return M.reconciled_titles(old, by_id.unionByName(by_doi).unionByName(by_file)).select("paper_id", "title", "title_original", "changed")


@query(f"WITH {PAPERS}, k AS (SELECT doc_id, lower(source) || '/' || (doc_id % 50) AS d, length(text) AS chunks FROM papers WHERE doc_id % 3 <> 1) SELECT d AS doi, arg_max(doc_id, chunks * 10000000 - doc_id) AS doc_id FROM k GROUP BY d")
def doi_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DED-03: of papers with one DOI the one with most chunks, then the smaller id; papers without a DOI form no group"""
    d = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 3 != 1, F.concat(F.lower("source"), F.lit("/"), F.col("doc_id") % 50)).alias("doi"), F.char_length("text").alias("chunks"))
    return M.best_per_doi(d, "doi", "chunks", "doc_id")


@query(f"""WITH {PAPERS}, n AS (SELECT doc_id, CASE WHEN doc_id % 3 = 1 THEN NULL ELSE '10.1/' || (doc_id % 40) END AS doi, source AS journal, lower(split_part(title, ' ', 1)) AS title FROM papers),
k AS (SELECT *, row_number() OVER (PARTITION BY doi ORDER BY doc_id) AS a, row_number() OVER (PARTITION BY doi IS NULL, journal, title ORDER BY doc_id) AS b FROM n)
SELECT doc_id, doi, journal, title FROM k WHERE (doi IS NOT NULL AND a = 1) OR (doi IS NULL AND b = 1)""")
def corpus_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DED-04: a DOI is in the corpus once; articles without one once per journal and title"""
    p = papers(spark, sf_dir)
    new = p.select("doc_id", F.when(F.col("doc_id") % 3 != 1, F.concat(F.lit("10.1/"), F.col("doc_id") % 40)).alias("doi"), F.col("source").alias("journal"), F.lower(F.split_part("title", F.lit(" "), F.lit(1))).alias("title"))
    return M.inserted_once(new, "doc_id")
