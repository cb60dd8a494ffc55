"""Recommendation, tracking, planning and style queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scholiast.functions import text as T
from scholiast.operators import recommend as R
from scholiast.operators import style as S
from scholiast.operators import tracker as K
from scholiast.plans.registry import query, table
from scholiast.plans.retrieval import DOT

ASKED = ["the", "and", "of", "ererti", "la", "topic3"]
ARTICLES = r"""art AS (SELECT source, doc_id, list_filter(string_split_regex(lower('T' || doc_id || ' ' || text || ' kw' || (doc_id % 5) || ' ' || lang || ' topic' || (doc_id % 7)), '\s+'), lambda w: w <> '') AS w FROM documents WHERE text <> '' QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) <= 500)"""
COS0 = f"{DOT.format(a='v.embedding', b='q.embedding')} / (sqrt({DOT.format(a='v.embedding', b='v.embedding')}) * sqrt({DOT.format(a='q.embedding', b='q.embedding')}))"
DENSE = f"""dense AS (SELECT v.label, v.vec_id, round({COS0}, 6) AS score FROM embeddings v, embeddings q WHERE q.vec_id = 0),
dtop AS (SELECT label, avg(score) AS mean, CASE WHEN count(*) > 1 THEN stddev_pop(score) ELSE 0 END AS deviation, max(score) AS best FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS n FROM dense) WHERE n <= 25 GROUP BY label)"""
OKAPI = f"""{ARTICLES}, st AS (SELECT source, count(*) AS n, avg(len(w)) AS mean FROM art GROUP BY source),
df AS (SELECT source, t, count(*) AS df FROM (SELECT source, unnest(list_distinct(w)) AS t FROM art) GROUP BY ALL),
idf AS (SELECT source, t, ln((n - df + 0.5) / (df + 0.5)) AS raw FROM df JOIN st USING (source)), fl AS (SELECT source, avg(raw) * 0.25 AS floor FROM idf GROUP BY source),
tf AS (SELECT source, doc_id, l, t, count(*) AS tf FROM (SELECT source, doc_id, len(w) AS l, unnest(w) AS t FROM art) WHERE t IN ('the', 'and', 'of', 'ererti', 'la', 'topic3') GROUP BY ALL),
ok AS (SELECT source, doc_id, sum(CASE WHEN raw < 0 THEN floor ELSE raw END * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * l / mean))) AS s FROM tf JOIN idf USING (source, t) JOIN fl USING (source) JOIN st USING (source) GROUP BY ALL),
lex AS (SELECT source, doc_id, round(coalesce(s, 0), 6) AS score FROM art LEFT JOIN ok USING (source, doc_id))"""


def _dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return R.dense_scores(e, "label", "vec_id", "embedding", e.filter("vec_id = 0").select(F.col("embedding").alias("query_vector")))


def _okapi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 500 articles of a source, n_chars standing for the date."""
    key = F.col("doc_id")
    articles = table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars", F.concat(F.lit("T"), key).alias("title"), F.col("text").alias("abstract"), F.array(F.concat(F.lit("kw"), key % 5), F.col("lang")).alias("keywords"), F.array(F.concat(F.lit("topic"), key % 7)).alias("topics"))
    newest = R.recent(articles, "source", "n_chars", "doc_id")
    return R.okapi(newest.select("source", "doc_id", R.article_words().alias("w")), "source", "doc_id", "w", ASKED)


@query(f"WITH {DENSE} SELECT label, round(mean, 6) AS mean, round(deviation, 6) AS deviation, best FROM dtop")
def journal_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """REC-02"""
    return R.top_mean(_dense(spark, sf_dir), "label", "vec_id").select("label", F.round("mean", 6).alias("mean"), F.round("deviation", 6).alias("deviation"), "best")


@query(f"WITH {DENSE} SELECT label, vec_id, round(score, 4) AS similarity, n FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS n FROM dense) WHERE n <= 5")
def nearest_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """REC-02: the five nearest of each venue"""
    order = Window.partitionBy("label").orderBy(F.desc("score"), "vec_id")
    return _dense(spark, sf_dir).withColumn("n", F.row_number().over(order)).filter("n <= 5").select("label", "vec_id", F.round("score", 4).alias("similarity"), "n")


POLICY = R.Policy(excluded=["Supplier#000000003"], need_open=True, floor=0.0, allowed=["Supplier#000000004"], blocked_publishers=["CANADA", "brazil"])


def _venues(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    return s.join(n, s.s_nationkey == n.n_nationkey).select(F.col("s_name").alias("venue"), (F.col("s_suppkey") % 7 != 0).alias("is_open"), F.when(F.col("s_suppkey") % 10 != 0, F.col("s_acctbal")).alias("factor"), F.col("n_name").alias("publisher"))


GATED = """gated AS (SELECT s_name AS venue, CASE WHEN s_suppkey % 7 = 0 THEN 'not open access' WHEN s_name <> 'Supplier#000000004' AND s_suppkey % 10 <> 0 AND s_acctbal < 0 THEN 'impact factor below floor' WHEN lower(n_name) IN ('canada', 'brazil') THEN 'publisher blocked' END AS reason
 FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_name <> 'Supplier#000000003')"""


@query(f"WITH {GATED} SELECT * FROM gated")
def policy_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-12, SRC-13"""
    v = _venues(spark, sf_dir).filter(~POLICY.excludes(F.col("venue")))
    return v.select("venue", POLICY.reason(F.col("venue"), F.col("is_open"), F.col("factor"), F.col("publisher")).alias("reason"))




LEGAL = {"new": ["view", "search"], "view": ["click", "cart", "view"], "search": ["view", "click"], "click": ["cart", "purchase", "view"], "cart": ["purchase", "view"], "purchase": ["view", "search"]}


_MOVES = ", ".join(f"('{a}', '{b}')" for a, to in LEGAL.items() for b in to)


@query(f"""WITH RECURSIVE legal AS (SELECT * FROM (VALUES {_MOVES}) m(a, b)), o AS (SELECT user_id, event_id, ts, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT user_id, 0::BIGINT AS n, NULL::BIGINT AS event_id, NULL::TIMESTAMP AS ts, NULL::VARCHAR AS from_state, NULL::VARCHAR AS to_state, NULL::BOOLEAN AS accepted, 'new' AS now FROM (SELECT DISTINCT user_id FROM events)
 UNION ALL SELECT o.user_id, o.n, o.event_id, o.ts, r.now, o.event_type, l.a IS NOT NULL, CASE WHEN l.a IS NOT NULL THEN o.event_type ELSE r.now END FROM r JOIN o ON o.user_id = r.user_id AND o.n = r.n + 1 LEFT JOIN legal l ON l.a = r.now AND l.b = o.event_type)
SELECT user_id, ts, event_id, from_state, to_state, accepted FROM r WHERE n > 0""")
def validated_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DML-01, DML-13: events as attempted moves"""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id")
    return K.accepted_moves(e, "user_id", "event_type", ["ts", "event_id"], "new", LEGAL)


@query("SELECT o_orderkey, o_orderstatus, floor((epoch_us(TIMESTAMP '1998-08-02 12:00:00') - epoch_us(o_orderdate)) / 86400000000.0)::INT AS days FROM orders WHERE floor((epoch_us(TIMESTAMP '1998-08-02 12:00:00') - epoch_us(o_orderdate)) / 86400000000.0)::INT >= CASE o_orderstatus WHEN 'O' THEN 1200 WHEN 'P' THEN 600 ELSE 2000 END")
def stalled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-18"""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate")
    return K.stalled(o, F.lit("1998-08-02 12:00:00").cast("timestamp"), ["o_orderdate"], "o_orderstatus", {"O": 1200, "P": 600}, 2000).select("o_orderkey", "o_orderstatus", "days")


@query("SELECT p_partkey, CASE WHEN n = 1 THEN base ELSE base || '_' || n END AS id FROM (SELECT p_partkey, regexp_replace(lower(p_brand), '[^a-z0-9]+', '_', 'g') AS base, row_number() OVER (PARTITION BY regexp_replace(lower(p_brand), '[^a-z0-9]+', '_', 'g') ORDER BY p_partkey) AS n FROM part)")
def probed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DML-18, STR-12"""
    p = table(spark, sf_dir, "part").select("p_partkey", T.slug("p_brand", 48, "_").alias("base"))
    return K.numbered_ids(p, "base", "p_partkey").select("p_partkey", "id")


@query("""WITH RECURSIVE o AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents), r AS (
 SELECT source, n, CASE WHEN n_chars <= 14000 THEN n_chars ELSE 0 END AS used, CASE WHEN n_chars <= 14000 THEN doc_id END AS taken FROM o WHERE n = 1 UNION ALL
 SELECT o.source, o.n, CASE WHEN r.used + o.n_chars <= 14000 THEN r.used + o.n_chars ELSE r.used END, CASE WHEN r.used + o.n_chars <= 14000 THEN o.doc_id END FROM r JOIN o ON o.source = r.source AND o.n = r.n + 1)
SELECT source, taken AS doc_id FROM r WHERE taken IS NOT NULL""")
def brief_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STY-07, STY-09, WIN-06: skip and go on within a budget"""
    return S.first_fitting(table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars"), "source", "doc_id", "n_chars", 14000)


@query(f"WITH {OKAPI} SELECT source, doc_id, score FROM lex")
def journal_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """REC-01: the last 500 articles of a venue, with keywords and topics"""
    return _okapi(spark, sf_dir)


CLAIM = """cl AS (SELECT v.label, v.vec_id, round({c}, 6) AS score FROM embeddings v, embeddings q WHERE q.vec_id = 1), ctop AS (SELECT label, avg(score) AS mean FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS n FROM cl) WHERE n <= 25 GROUP BY label)""".replace("{c}", COS0)
RECOMMENDED = """x AS (SELECT source, avg(score) AS mean, max(score) AS best FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS n FROM lex) WHERE n <= 25 GROUP BY source),
h AS (SELECT 'src' || (o_custkey % 30) AS venue, count(*) FILTER (o_orderstatus = 'F' AND o_orderkey % 97 = 0) AS accepted, count(*) FILTER (o_orderstatus = 'P') AS rejected FROM orders WHERE o_orderkey % 50 <> 7 GROUP BY 1),
v AS (SELECT source AS venue, min(doc_id) AS arrival, CASE WHEN source IN ('src1', 'src5') THEN 'not open access' END AS reason, (replace(source, 'src', '')::INT % 10) AS label FROM documents WHERE source <> 'src3' GROUP BY source),
s AS (SELECT venue, arrival, reason, coalesce(d.mean, 0) AS d, coalesce(c.mean, 0) AS c, coalesce(x.mean / nullif(x.best, 0), 0) AS l, -0.5 * coalesce(d.deviation, 0) AS p, coalesce(accepted, 0) AS accepted, coalesce(rejected, 0) AS rejected FROM v LEFT JOIN dtop d USING (label) LEFT JOIN ctop c USING (label) LEFT JOIN x ON x.source = venue LEFT JOIN h USING (venue)),
t AS (SELECT *, round(0.5 * d + 0.25 * l + 0.25 * c + p, 4) AS score, concat_ws('; ', CASE WHEN round(d, 4) >= 0.7 THEN printf('strong abstract match (score %.2f)', round(d, 4)) END, CASE WHEN round(l, 4) >= 0.5 THEN 'technique terminology overlap' END, CASE WHEN accepted > 0 THEN 'prior acceptance at this venue' END, CASE WHEN rejected > 0 THEN 'prior rejection — review rejection notes' END) AS why FROM s),
u AS (SELECT *, coalesce(nullif(why, ''), 'moderate topical overlap across recent articles') AS said, row_number() OVER (PARTITION BY reason IS NULL ORDER BY CASE WHEN reason IS NULL THEN -score END, arrival) AS n FROM t),
rec AS (SELECT venue, CASE WHEN reason IS NULL THEN n ELSE n + least(12, (SELECT count(*) FROM u WHERE reason IS NULL)) END::INT AS rank, CASE WHEN reason IS NULL THEN score ELSE 0.0 END AS score, CASE WHEN reason IS NULL THEN round(d, 4) ELSE 0.0 END AS dense, CASE WHEN reason IS NULL THEN round(l, 4) ELSE 0.0 END AS lexical, CASE WHEN reason IS NULL THEN round(c, 4) ELSE 0.0 END AS claim, CASE WHEN reason IS NULL THEN round(p, 4) ELSE 0.0 END AS dispersion, reason, CASE WHEN reason IS NULL THEN upper(left(said, 1)) || lower(substr(said, 2)) || '.' ELSE '' END AS rationale FROM u WHERE reason IS NOT NULL OR n <= 12)"""


def _recommended(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, e, o = (table(spark, sf_dir, x) for x in ("documents", "embeddings", "orders"))
    named = d.groupBy(F.col("source").alias("venue")).agg(F.min("doc_id").alias("arrival"))
    label = (F.replace("venue", F.lit("src"), F.lit("")).cast("int") % 10).alias("label")
    of = lambda scored: named.select("venue", label).join(R.top_mean(scored, "label", "vec_id"), "label")
    claim = R.dense_scores(e, "label", "vec_id", "embedding", e.filter("vec_id = 1").select(F.col("embedding").alias("query_vector")))
    lexical = R.top_mean_over_best(_okapi(spark, sf_dir), "source", "doc_id").withColumnRenamed("source", "venue")
    state = F.when((F.col("o_orderstatus") == "F") & (F.col("o_orderkey") % 97 == 0), "accepted").when(F.col("o_orderstatus") == "P", "rejected_desk").otherwise("submitted")
    past = R.history(o.select(F.concat(F.lit("src"), F.col("o_custkey") % 30).alias("venue"), (F.col("o_orderkey") % 50).cast("string").alias("manuscript_id"), state.alias("state")), "venue", "7")
    venues = named.select("venue", "arrival", (~F.col("venue").isin("src1", "src5")).alias("is_open"), F.lit(None).cast("double").alias("factor"), F.lit("").alias("publisher"))
    return R.recommend(of(_dense(spark, sf_dir)), of(claim), lexical, past, venues, R.Policy(excluded=["src3"], need_open=True), "venue", 12)


@query(f"WITH {DENSE}, {OKAPI}, {CLAIM}, {RECOMMENDED} SELECT * FROM rec")
def recommend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """REC-02, REC-03, REC-04, MTH-02: abstract, claim and words of every venue, the policy's failures behind; a source's vectors are those of the label that its number gives"""
    return _recommended(spark, sf_dir)


@query(f"""WITH {DENSE}, {OKAPI}, {CLAIM}, {RECOMMENDED}, m AS (SELECT item_id, text, row_number() OVER (ORDER BY item_id DESC) AS place FROM benchmark), e AS (SELECT p_name, row_number() OVER (ORDER BY p_partkey) AS place FROM part WHERE contains(lower(p_name), 'a'))
SELECT 'recommendation' AS part, rank AS place, venue AS name, score AS value, '' AS said FROM rec UNION ALL SELECT 'graph', 0, 'nodes', count(*), '' FROM part UNION ALL SELECT 'graph', 0, 'edges', count(*), '' FROM lineitem UNION ALL SELECT 'entity', place, p_name, 0, '' FROM e WHERE place <= 10 UNION ALL SELECT 'memory', place, item_id::VARCHAR, 0, text FROM m WHERE place <= 10
UNION ALL SELECT 'total', 0, 'papers', count(DISTINCT source), '' FROM documents UNION ALL SELECT 'total', 0, 'chunks', count(*), '' FROM documents UNION ALL SELECT 'total', 0, 'memories', count(*), '' FROM m WHERE place <= 10 UNION ALL SELECT 'total', 0, 'entities', count(*), '' FROM e WHERE place <= 20""")
def recommendations_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """REC-05: recommendations with graph counts, entities, memories and totals"""
    d, p, x = (table(spark, sf_dir, n) for n in ("documents", "part", "lineitem"))
    number = lambda rows, order: rows.limit(30).withColumn("place", F.row_number().over(Window.orderBy(*order)))
    entities = number(p.filter(F.contains(F.lower("p_name"), F.lit("a"))).orderBy("p_partkey"), [F.asc("p_partkey")]).select(F.col("p_name").alias("name"), "place")
    memories = number(table(spark, sf_dir, "benchmark").orderBy(F.desc("item_id")), [F.desc("item_id")]).select(F.col("item_id").alias("memory_id"), F.col("text").alias("content"), "place")
    out = R.enriched(_recommended(spark, sf_dir), p, x, entities, memories, d.select("source").distinct(), d)
    told = F.col("part") == "memory"
    return out.select("part", "place", "name", F.when(told, 0.0).otherwise(F.coalesce(F.nullif("value", F.lit("")).try_cast("double"), F.lit(0.0))).alias("value"), F.when(told, F.col("value")).otherwise("").alias("said"))


@query("""WITH f AS (SELECT conv_id, turn, CASE WHEN turn = 2 AND conv_id % 3 = 0 THEN 'abstract' ELSE 's' || turn END AS slug, CASE WHEN conv_id % 5 = 0 AND turn = 0 THEN '  ' ELSE text END AS body FROM conversations), r AS (SELECT *, trim(body) AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn, slug) AS n FROM f),
a AS (SELECT conv_id, arg_min(t, CASE WHEN slug = 'abstract' THEN 0 ELSE 1 END) AS abstract FROM r WHERE (slug = 'abstract' OR n = 1) AND t <> '' GROUP BY 1), b AS (SELECT conv_id, abstract, regexp_replace(split_part(abstract, '. ', 1), '\\.+$', '') AS first FROM a),
new AS (SELECT CASE WHEN conv_id % 4 = 0 THEN 'm' || conv_id ELSE 'wp.project-' || conv_id END AS id, 'Project ' || conv_id AS title, abstract, CASE WHEN conv_id % 2 = 0 THEN 'A claim' WHEN length(first) > 8 THEN first || '.' ELSE left(abstract, 200) END AS principal_claim, 'xrd|nmr' AS techniques FROM b)
SELECT * FROM new UNION ALL SELECT DISTINCT 'm' || conv_id, 'old', 'old', 'old', '' FROM conversations WHERE (conv_id % 4 = 0 OR conv_id % 7 = 1) AND 'm' || conv_id NOT IN (SELECT id FROM new)""")
def manuscript_push(spark: SparkSession, sf_dir: str) -> DataFrame:
    """REC-06: projects become manuscripts or update theirs"""
    c = table(spark, sf_dir, "conversations")
    key = F.col("conv_id")
    body = F.when((key % 5 == 0) & (F.col("turn") == 0), "  ").otherwise(F.col("text"))
    files = c.select(key.alias("project_id"), F.col("turn").alias("sort_order"), F.when((F.col("turn") == 2) & (key % 3 == 0), "abstract").otherwise(F.concat(F.lit("s"), "turn")).alias("slug"), body.alias("body"))
    ids = c.select("conv_id").distinct()
    projects = ids.select(key.alias("project_id"), F.concat(F.lit("project-"), key).alias("slug"), F.concat(F.lit("Project "), key).alias("title"), F.when(key % 2 == 0, "A claim").alias("principal_claim"), F.lit("xrd, nmr,").alias("techniques"), F.when(key % 4 == 0, F.concat(F.lit("m"), key)).when(key % 4 == 1, F.concat(F.lit("gone"), key)).alias("manuscript_id"))
    old = ids.filter("conv_id % 4 = 0 or conv_id % 7 = 1").select(F.concat(F.lit("m"), key).alias("id"), *[F.lit("old").alias(x) for x in ("title", "abstract", "principal_claim")], F.array().cast("array<string>").alias("techniques"))
    return R.pushed(projects, files, old).withColumn("techniques", F.array_join("techniques", "|"))


@query("""WITH k AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN NULL WHEN doc_id % 4 = 1 THEN 'other' WHEN doc_id % 4 = 2 THEN 'm' END AS model, vec_id IS NOT NULL AS has FROM documents LEFT JOIN embeddings ON vec_id = doc_id)
SELECT 'new chunk' AS kind, doc_id FROM k WHERE NOT has UNION ALL SELECT 'stale vector', doc_id FROM k WHERE NOT has OR model = 'other' UNION ALL SELECT 'not in graph', doc_id FROM documents WHERE doc_id NOT IN (SELECT l_orderkey FROM lineitem) UNION ALL SELECT 'new paper', min(doc_id) FROM documents WHERE source NOT IN (SELECT source FROM documents WHERE doc_id < 40) GROUP BY source""")
def new_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-16: unknown chunks and papers, rows without a vector or with another model's, chunks that are not in the graph"""
    from scholiast.functions import models as Mo

    d, e, x = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings"), table(spark, sf_dir, "lineitem")
    key = F.col("doc_id")
    held = d.select("doc_id").join(e.select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id", "left").withColumn("model", F.when(key % 4 == 1, "other").when(key % 4 == 2, "m"))
    papers = d.groupBy("source").agg(F.min("doc_id").alias("doc_id"))
    kinds = {"new chunk": held.filter("embedding is null"), "stale vector": Mo.stale(held, "embedding", "model", "m"), "not in graph": d.join(x.select(F.col("l_orderkey").alias("doc_id")), "doc_id", "left_anti"), "new paper": papers.join(d.filter("doc_id < 40").select("source"), "source", "left_anti")}
    out = None
    for kind, rows in kinds.items():
        part = rows.select(F.lit(kind).alias("kind"), "doc_id")
        out = part if out is None else out.unionByName(part)
    return out


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'old' WHEN length(text) < 200 THEN '' ELSE trim('S: ' || left(text, 50)) END AS summary, CASE WHEN doc_id % 3 = 0 THEN 'kept' WHEN length(text) < 200 THEN 'skipped' ELSE 'done' END AS state FROM documents")
def summary_backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM-08, UDF-04: papers without a summary get one, those of fewer than 200 characters none, others keep theirs"""
    from scholiast.functions import models as Mo

    key = F.col("doc_id") % 3
    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.when(key == 0, "old").when(key == 1, "").alias("summary"))
    return Mo.summarised(d, "text", "summary", lambda texts: ["<think>hm</think>S: " + t[:50] for t in texts]).select("doc_id", "summary", "state")
