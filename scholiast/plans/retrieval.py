"""Retrieval queries: documents stand for chunks, `source` for the paper, embeddings for chunk vectors."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scholiast.operators import retrieval as R
from scholiast.operators.graph import shared_folder
from scholiast.operators.lexical import LexicalIndex
from scholiast.plans.registry import query, table

ASKED = [(1, "the and attion"), (2, "erthe onble edst"), (3, "de la que en"), (4, "einen und die")]
VALUES = ", ".join(f"({i}, '{q}')" for i, q in ASKED)
TOKENS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+')"


def asked(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ASKED, "query_id int, query string")


def asked_vectors(vectors: DataFrame) -> DataFrame:
    """The vectors 0 to 3 ask queries 1 to 4."""
    return F.broadcast(vectors.filter("vec_id between 0 and 3").select((F.col("vec_id") + 1).cast("int").alias("query_id"), F.col("embedding").alias("query_vector")))


BM25 = f"""asked AS (SELECT * FROM (VALUES {VALUES}) q(query_id, query)),
terms AS (SELECT DISTINCT query_id, unnest({TOKENS.format('query')}) AS token FROM asked),
words AS (SELECT doc_id, {TOKENS.format('text')} AS w FROM documents),
stats AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM words),
post AS (SELECT doc_id, l, token, count(*) AS tf FROM (SELECT doc_id, len(w) AS l, unnest(w) AS token FROM words) GROUP BY ALL),
df AS (SELECT token, count(*) AS df FROM post GROUP BY token),
bm AS (SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / mean))), 6) AS score
  FROM terms JOIN post USING (token) JOIN df USING (token) CROSS JOIN stats GROUP BY ALL),
bmr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM bm QUALIFY rank <= 50)"""
DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda x: x[1]::DOUBLE * x[2]::DOUBLE))"
COS = f"{DOT.format(a='v.embedding', b='q.embedding')} / (sqrt({DOT.format(a='v.embedding', b='v.embedding')}) * sqrt({DOT.format(a='q.embedding', b='q.embedding')}))"
KNN = f"""knn AS (SELECT (q.vec_id + 1)::INT AS query_id, v.vec_id AS doc_id, round({COS}, 6) AS score FROM embeddings v, embeddings q WHERE q.vec_id BETWEEN 0 AND 3),
knnr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM knn QUALIFY rank <= 50)"""
FUSED = """fused AS (SELECT query_id, doc_id, round(sum(1.0 / (60 + rank)), 9) AS score, min((arm, rank)) AS first FROM
  (SELECT query_id, doc_id, rank, 0 AS arm FROM bmr UNION ALL SELECT query_id, doc_id, rank, 1 FROM knnr) GROUP BY ALL),
fr AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first[1], first[2], doc_id) AS rank FROM fused QUALIFY rank <= 40)"""
FUSED = FUSED.replace("min((arm, rank)) AS first", "min(arm * 1000 + rank) AS first").replace("first[1], first[2]", "first")
DIVERSE = """g AS (SELECT fr.*, source, row_number() OVER (PARTITION BY query_id, source ORDER BY rank, doc_id) AS n FROM fr JOIN documents USING (doc_id)),
p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n > 2, rank, doc_id) AS place FROM g)"""


_indexes: dict[tuple[str, str], LexicalIndex] = {}


def index(spark: SparkSession, sf_dir: str) -> LexicalIndex:
    """The stored index of the documents, written in two insertions at its first use in an application; searches read it and no text."""
    known = (spark.sparkContext.applicationId, sf_dir)
    if known not in _indexes:
        docs = table(spark, sf_dir, "documents").select("doc_id", "text")
        empty = LexicalIndex(spark, f"{shared_folder(spark)}/lexical-{uuid.uuid4().hex}", "doc_id")
        _indexes[known] = empty.insert(docs.filter("doc_id % 8 <> 0"), "text").insert(docs, "text")
    return _indexes[known]


def _bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index(spark, sf_dir).search(asked(spark), 50)


def _knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", "vec_id")
    return R.top(R.knn(v, "doc_id", "embedding", asked_vectors(v)), "doc_id", 50)


def _fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.fuse([_bm25(spark, sf_dir), _knn(spark, sf_dir)], "doc_id")


@query(f"SELECT token, count(DISTINCT doc_id) AS documents, count(*) AS uses FROM (SELECT doc_id, unnest({TOKENS.format('text')}) AS token FROM documents) GROUP BY token")
def lexical_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-20: the stored index that the other queries search, written at its first use: documents and uses of each token"""
    uses = F.aggregate("tfs", F.lit(0).cast("long"), lambda s, x: s + x)
    return index(spark, sf_dir).postings().groupBy("token").agg(F.sum("n").alias("documents"), F.sum(uses).alias("uses"))


@query(f"WITH {BM25} SELECT * FROM bmr")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RET-01, FLT-01, SRT-03"""
    return _bm25(spark, sf_dir)


@query(f"WITH {KNN} SELECT * FROM knnr")
def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RET-02, MTH-01, JOI-11"""
    return _knn(spark, sf_dir)


@query(f"WITH {BM25}, {KNN}, {FUSED} SELECT * FROM fr")
def rrf_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RET-03, SET-01, WIN-01"""
    return _fused(spark, sf_dir)


@query(f"WITH {BM25}, {KNN}, {FUSED} SELECT query_id, rank, doc_id, source, lang, left(text, 80) AS head FROM fr JOIN documents USING (doc_id)")
def hydrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RET-04: joins the few ranked ids to their rows, in ranked order by the rank column."""
    docs = table(spark, sf_dir, "documents")
    return docs.join(_fused(spark, sf_dir), "doc_id").select("query_id", "rank", "doc_id", "source", "lang", F.substring("text", 1, 80).alias("head"))


@query(f"""WITH {BM25}, r AS (SELECT query_id, doc_id, rank, round(len(list_intersect(list_distinct({TOKENS.format('query')}), {TOKENS.format('text')})) / len(list_distinct({TOKENS.format('query')})), 6) AS overlap
  FROM bmr JOIN documents USING (doc_id) JOIN asked USING (query_id))
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, rank) AS place FROM r QUALIFY place <= 16""")
def rerank_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RET-05, UDF-03 by the deterministic stand-in"""
    ranked = _bm25(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").join(F.broadcast(asked(spark)), "query_id")
    scored = R.rerank(ranked, "query", "text").select("query_id", "doc_id", "rank", "overlap")
    return scored.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("overlap"), "rank"))).filter("place <= 16")


@query(f"""WITH allowed AS (SELECT doc_id AS vec_id FROM documents WHERE lang = 'fr'), knn AS (SELECT (q.vec_id + 1)::INT AS query_id, v.vec_id AS doc_id, round({COS}, 6) AS score
 FROM embeddings v SEMI JOIN allowed USING (vec_id), embeddings q WHERE q.vec_id BETWEEN 0 AND 3)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM knn QUALIFY rank <= 10""")
def restricted_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-04, JOI-03: the restriction comes before the top k"""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", "vec_id")
    allowed = table(spark, sf_dir, "documents").filter("lang = 'fr'").select("doc_id")
    return R.top(R.knn(v.join(allowed, "doc_id", "left_semi"), "doc_id", "embedding", asked_vectors(v)), "doc_id", 10)


@query(f"""SELECT doc_id, source, n_chars FROM documents WHERE contains(' ' || array_to_string({TOKENS.format('text')}, ' ') || ' ', ' of the ') ORDER BY n_chars DESC, doc_id LIMIT 50""")
def phrase_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-02: the whole query as one phrase of tokens, found by the places in the stored index"""
    found = index(spark, sf_dir).phrases(spark.createDataFrame([(1, "of the")], "query_id int, query string"))
    return table(spark, sf_dir, "documents").join(found.select("doc_id"), "doc_id", "left_semi").select("doc_id", "source", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(50)


@query("""WITH t AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9_-]{2,}')) AS d, regexp_extract_all(lower(text), '[a-z0-9][a-z0-9_-]{2,}') AS w FROM benchmark),
u AS (SELECT item_id, term, min(i) AS i FROM (SELECT item_id, unnest(w) AS term, generate_subscripts(w, 1) AS i FROM t) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY i) AS n FROM u)
SELECT item_id, string_agg(term, ' OR ' ORDER BY n) AS fts FROM r WHERE n <= 8 GROUP BY item_id""")
def manuscript_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-03, SET-04, AGG-19: the first eight distinct terms of a text as an OR query"""
    terms = F.slice(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9][a-z0-9_-]{2,}"), F.lit(0))), 1, 8)
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(terms, " OR ").alias("fts")).filter("fts <> ''")


@query(f"""WITH {BM25}, t AS (SELECT query_id, source, doc_id, rank, row_number() OVER (PARTITION BY query_id, source ORDER BY rank) AS n FROM bmr JOIN documents USING (doc_id) WHERE rank <= 20),
f AS (SELECT query_id, source, doc_id, rank, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place FROM t WHERE n = 1) SELECT * FROM f WHERE place <= 10""")
def topical_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RET-11: the first hit of each paper among the best twenty"""
    ranked = _bm25(spark, sf_dir).filter("rank <= 20").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    first = ranked.withColumn("n", F.row_number().over(Window.partitionBy("query_id", "source").orderBy("rank"))).filter("n = 1")
    return first.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).filter("place <= 10").select("query_id", "source", "doc_id", "rank", "place")


_OVERLAP = f"round(len(list_intersect(list_distinct({TOKENS.format('query')}), {TOKENS.format('text')})) / greatest(1, len(list_distinct({TOKENS.format('query')}))), 6)"
HYBRID = f"""re AS (SELECT * FROM (SELECT query_id, doc_id, source, score, row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, fused_rank) AS rank FROM (SELECT query_id, doc_id, score, fr.rank AS fused_rank, source, {_OVERLAP} AS overlap FROM fr JOIN documents USING (doc_id) JOIN asked USING (query_id))) WHERE rank <= 16),
g AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY rank, doc_id) AS n FROM re), p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n > 2, rank, doc_id) AS place FROM g),
hy AS (SELECT query_id, doc_id, source, score, rank, place FROM p WHERE (n <= 2 OR place <= 6) AND place <= 8)"""


def hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return R.hybrid(_bm25(spark, sf_dir), _knn(spark, sf_dir), docs, asked(spark), "doc_id", "source", "text").select("query_id", "doc_id", "source", "score", "rank", "place")


@query(f"WITH {BM25}, {KNN}, {FUSED}, {HYBRID} SELECT * FROM hy")
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RET-06, RET-07, WIN-02: both arms, fusion to 40, hydration, rerank to 16, at most two of a source, 8 in all"""
    return hybrid(spark, sf_dir)


@query(f"""WITH {BM25}, m AS (SELECT query_id, source, min(rank) AS first FROM bmr JOIN documents USING (doc_id) WHERE rank <= 20 GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY first) AS number FROM m)
SELECT query_id, string_agg('---' || chr(10) || '[' || number || '] ' || source || chr(10) || 'Section: ' || lang || ' (pages ' || (doc_id % 9) || '-' || (doc_id % 9 + 1) || ')' || chr(10) || text || chr(10) || '---', chr(10) || chr(10) ORDER BY rank) AS prompt FROM bmr JOIN documents USING (doc_id) JOIN n USING (query_id, source) WHERE rank <= 20 GROUP BY query_id""")
def excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RET-14, WIN-03, AGG-18: the excerpts of a prompt, whole texts, one number per paper in order of first appearance"""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.col("source").alias("title"), F.col("lang").alias("section"), (F.col("doc_id") % 9).alias("page_start"), (F.col("doc_id") % 9 + 1).alias("page_end"), "text")
    return R.excerpts(_bm25(spark, sf_dir).filter("rank <= 20").join(d, "doc_id"), "source")


_SECTION = "CASE doc_id % 6 WHEN 0 THEN 'Results and more' WHEN 1 THEN ' Abstract' WHEN 2 THEN 'Methods' WHEN 3 THEN 'Conclusions' WHEN 4 THEN 'Introduction' ELSE 'Annex' END"


@query(f"""WITH d AS (SELECT source, doc_id, CASE doc_id % 6 WHEN 1 THEN 0 WHEN 4 THEN 2 WHEN 3 THEN 3 WHEN 0 THEN 6 ELSE 7 END AS p, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t FROM documents), k AS (SELECT * FROM d WHERE t <> ''),
b AS (SELECT *, coalesce(sum(length(t)) OVER (PARTITION BY source ORDER BY p, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM k)
SELECT source, string_agg(left(t, (8000 - before)::BIGINT), chr(10) || chr(10) ORDER BY p, doc_id) AS text FROM b WHERE before < 8000 GROUP BY source""")
def context_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RET-13, WIN-06: a paper's preferred sections first, whole blocks until 8,000 characters are used, the last one cut"""
    d = table(spark, sf_dir, "documents").withColumn("section", F.expr(_SECTION))
    return R.gathered(d, "source", "section", "doc_id", "text")


@query("""WITH RECURSIVE s AS (SELECT item_id, text, row_number() OVER (ORDER BY item_id DESC) AS n, length(text) AS size FROM benchmark), b AS (SELECT *, coalesce(sum(size + 2) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s)
SELECT item_id, left(text, (12000 - before)::BIGINT) AS text FROM b WHERE before < 12000""".replace("WITH RECURSIVE", "WITH"))
def style_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-15: samples, newest first, until 12,000 characters are used"""
    from scholiast.operators import style as S

    return S.samples(table(spark, sf_dir, "benchmark").select("item_id", "text"), "item_id", "text", 12000)
