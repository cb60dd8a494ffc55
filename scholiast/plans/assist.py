"""Queries around answers: graph-augmented retrieval, memories, dashboards, links, evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scholiast.functions import models as Mo
from scholiast.functions import text as T
from scholiast.operators import retrieval as R
from scholiast.plans.papers import KEYED, PAPERS
from scholiast.plans.registry import query, table
from scholiast.plans.retrieval import BM25, COS, TOKENS, _bm25, asked_vectors, index


MEMORY = f"""v AS (SELECT (q.vec_id + 1)::INT AS query_id, v.vec_id AS doc_id, round({COS}, 6) AS score FROM embeddings v, embeddings q WHERE q.vec_id BETWEEN 0 AND 3),
vr AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM v QUALIFY rank <= 15),
fr AS (SELECT DISTINCT query_id, doc_id FROM terms JOIN post USING (token)), ft AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS rank FROM fr QUALIFY rank <= 15),
u AS (SELECT query_id, doc_id, round(sum(1.0 / (60 + rank)), 9) AS score, min(arm * 1000 + rank) AS first FROM (SELECT *, 0 AS arm FROM vr UNION ALL SELECT *, 1 FROM ft) GROUP BY ALL)"""


@query(f"WITH {BM25}, {MEMORY} SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first, doc_id) AS rank FROM u QUALIFY rank <= 5")
def memory_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RET-10: the lexical arm keeps the order of insertion"""
    return R.fuse(_memory_arms(spark, sf_dir), "doc_id", most=5)


def _memory_arms(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", "vec_id")
    dense = R.top(R.knn(v, "doc_id", "embedding", asked_vectors(v)), "doc_id", 15)
    from scholiast.plans.retrieval import asked

    hits = index(spark, sf_dir).holding(asked(spark))
    lexical = hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("doc_id"))).filter("rank <= 15")
    return [dense, lexical]


@query("""WITH r AS (SELECT q.vec_id AS query_id, v.vec_id AS id, q.label = v.label AS same, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(%s, 6) DESC, v.vec_id) AS rank FROM embeddings v, embeddings q WHERE q.vec_id %% 100 = 0 AND v.vec_id <> q.vec_id),
t AS (SELECT q.vec_id AS query_id, count(*) AS total FROM embeddings v, embeddings q WHERE q.vec_id %% 100 = 0 AND v.vec_id <> q.vec_id AND v.label = q.label GROUP BY 1)
SELECT query_id, round(count(*) FILTER (same AND rank <= 10) / least(total, 10), 6) AS recall, round(coalesce(1.0 / min(rank) FILTER (same AND rank <= 10), 0), 6) AS reciprocal_rank FROM r JOIN t USING (query_id) GROUP BY query_id, total""" % COS)
def retrieval_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UDF-07 (extension): recall at ten and reciprocal rank, a label's vectors being relevant to each other"""
    e = table(spark, sf_dir, "embeddings")
    asked = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    best = R.nearest(e.select("vec_id", "embedding"), "vec_id", "embedding", asked, 10)
    labels = e.select("vec_id", "label")
    ranked = best.join(labels, "vec_id").join(labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("own")), "query_id").select("query_id", "rank", (F.col("label") == F.col("own")).alias("relevant"))
    others = e.groupBy("label").agg((F.count(F.lit(1)) - 1).alias("total")).filter("total > 0")
    total = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "label").join(others, "label").select("query_id", "total")
    return Mo.retrieval_quality(ranked, total, 10)


@query()
def named_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRF-09, GRF-10 by the deterministic rules: pairs of names in one sentence with a verb, which is their relation, all languages; brute force in the tests"""
    d = table(spark, sf_dir, "documents")
    found = Mo.named_entities(d, "doc_id", "text")
    return Mo.verb_relations(found, d, "doc_id", "text").groupBy("a", "b", "relation").agg(F.count(F.lit(1)).alias("weight"))



@query()
def embedded_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UDF-01, UDF-02, UDF-09 by the deterministic stand-in"""
    return Mo.embedded(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", Mo.hashed_embedder()).select("doc_id", "embedding")


GRAPH = """ent AS (SELECT doc_id AS id, array_to_string(string_split_regex(trim(text), '\\s+')[1:8], ' ') AS name FROM documents WHERE doc_id % 5 = 0), edge AS (SELECT a.id AS source_id, b.id AS target_id FROM ent a JOIN ent b ON b.id = a.id + 10),
link AS (SELECT (doc_id // 5) * 5 AS id, doc_id AS chunk FROM documents UNION ALL SELECT (doc_id * 3 // 10) * 5, doc_id FROM documents)"""
SEEDS = """nw AS (SELECT id, regexp_extract_all(lower(name), '[\\p{L}\\p{N}_]+') AS w FROM ent), ns AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM nw), np AS (SELECT id, l, token, count(*) AS tf FROM (SELECT id, len(w) AS l, unnest(w) AS token FROM nw) GROUP BY ALL), nd AS (SELECT token, count(*) AS df FROM np GROUP BY token),
nb AS (SELECT query_id, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / mean))), 6) AS score FROM terms JOIN np USING (token) JOIN nd USING (token) CROSS JOIN ns GROUP BY ALL),
seeds AS (SELECT query_id, id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS n FROM nb) WHERE n <= 10)"""


@query(f"""WITH {BM25}, {GRAPH}, {SEEDS}, wide AS (SELECT * FROM seeds UNION SELECT query_id, target_id FROM seeds JOIN edge ON source_id = id UNION SELECT query_id, source_id FROM seeds JOIN edge ON target_id = id),
c AS (SELECT query_id, chunk, count(*) AS links FROM link JOIN wide USING (id) GROUP BY ALL), b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY links DESC, chunk) AS n FROM c QUALIFY n <= 20)
SELECT query_id, chunk, links, row_number() OVER (PARTITION BY query_id ORDER BY n) AS n FROM b WHERE NOT EXISTS (SELECT 1 FROM bmr WHERE bmr.query_id = b.query_id AND doc_id = chunk AND rank <= 8) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY n) <= 6""")
def graph_augmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RET-09: entities that the question names, one hop, their best chunks that are not there yet"""
    from scholiast.plans.retrieval import asked

    d = table(spark, sf_dir, "documents")
    entities = d.filter("doc_id % 5 = 0").select(F.col("doc_id").alias("id"), F.array_join(F.slice(F.split(F.trim("text"), r"\s+"), 1, 8), " ").alias("name"))
    seeds = R.top(R.bm25(entities, "id", "name", asked(spark)), "id", 10).select("query_id", "id")
    ids = entities.select("id")
    edges = ids.select(F.col("id").alias("source_id"), (F.col("id") + 10).alias("target_id")).join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    links = d.select(F.expr("doc_id div 5 * 5").alias("id"), F.col("doc_id").alias("chunk")).unionByName(d.select(F.expr("doc_id * 3 div 10 * 5").alias("id"), F.col("doc_id").alias("chunk")))
    return R.graph_additions(seeds, edges, links, _bm25(spark, sf_dir).filter("rank <= 8").select("query_id", F.col("doc_id").alias("chunk")))


@query(f"WITH {BM25}, {MEMORY}, seen AS (SELECT doc_id, count(*) AS n FROM u GROUP BY doc_id) SELECT doc_id AS memory_id, n AS access_count FROM seen")
def memory_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RET-10: every candidate of a memory search, not only what it returns, counts as accessed"""
    return R.fuse(_memory_arms(spark, sf_dir), "doc_id", most=1000).groupBy(F.col("doc_id").alias("memory_id")).agg(F.count(F.lit(1)).alias("access_count"))


@query(f"""WITH {BM25}, j AS (SELECT query_id, count(*) AS journals FROM (SELECT query_id, s_name, row_number() OVER (PARTITION BY query_id ORDER BY s_acctbal DESC, s_name) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN asked ON contains(lower(n_name), left(query, 2))) WHERE n <= 10 GROUP BY 1)
SELECT query_id, count(*) AS total_rag, coalesce(min(journals), 0) AS total_jfr, (SELECT count(*) FROM documents) AS papers_indexed, (SELECT count(*) FROM supplier) AS journals_known FROM bmr LEFT JOIN j USING (query_id) WHERE rank <= 10 GROUP BY query_id""")
def dual_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RET-12: both systems at ten results each, with their totals"""
    from scholiast.plans.retrieval import asked

    n = F.count(F.lit(1))
    papers = _bm25(spark, sf_dir).filter("rank <= 10").groupBy("query_id").agg(n.alias("total_rag"))
    named = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    venues = named.crossJoin(F.broadcast(asked(spark))).filter(F.contains(F.lower("n_name"), F.left("query", F.lit(2)))).groupBy("query_id").agg(F.least(n, F.lit(10)).alias("total_jfr"))
    sizes = table(spark, sf_dir, "documents").agg(n.alias("papers_indexed")).crossJoin(table(spark, sf_dir, "supplier").agg(n.alias("journals_known")))
    return papers.join(venues, "query_id", "left").select("query_id", "total_rag", F.coalesce("total_jfr", F.lit(0)).alias("total_jfr")).crossJoin(F.broadcast(sizes))


@query(f"""WITH {BM25}, {PAPERS}, {KEYED} SELECT query_id, paper_id, rank, CASE WHEN doc_id % 2 = 0 THEN title ELSE 'own' END AS title, CASE WHEN doc_id % 3 = 0 THEN coalesce(year, 0) ELSE 1999 END AS year, citation_key FROM bmr JOIN keyed USING (doc_id) WHERE rank <= 20""")
def search_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RET-08: empty fields of a result come from the catalog, full ones stay; the citation key is added"""
    from scholiast.plans.papers import catalog

    c = catalog(spark, sf_dir)
    found = _bm25(spark, sf_dir).filter("rank <= 20").select("query_id", F.concat(F.lit("p"), "doc_id").alias("paper_id"), "rank", F.when(F.col("doc_id") % 2 == 0, "").otherwise("own").alias("title"), F.when(F.col("doc_id") % 3 == 0, 0).otherwise(1999).alias("year"))
    return R.enriched(found, c, "paper_id", ["title", "year"])


@query("""WITH s AS (SELECT conv_id, count(*) AS turns FROM conversations GROUP BY 1), a AS (SELECT o_orderkey, floor((epoch_us(TIMESTAMP '1998-08-02') - epoch_us(o_orderdate)) / 86400000000.0)::INT AS days FROM orders WHERE o_orderstatus = 'O')
SELECT 'manuscripts' AS kind, NULL AS id, (SELECT count(*) FROM customer) AS n UNION ALL SELECT 'submissions', NULL, (SELECT count(*) FROM orders) UNION ALL SELECT 'journals', NULL, (SELECT count(*) FROM supplier) UNION ALL SELECT 'papers', NULL, (SELECT count(DISTINCT source) FROM documents) UNION ALL SELECT 'chunks', NULL, (SELECT count(*) FROM documents) UNION ALL SELECT 'sessions', NULL, (SELECT count(*) FROM s)
UNION ALL (SELECT 'session', conv_id, turns FROM s ORDER BY conv_id DESC LIMIT 5) UNION ALL (SELECT 'finding', item_id, length(text) FROM benchmark ORDER BY item_id DESC LIMIT 5) UNION ALL (SELECT 'note', page_id, length(url) FROM pages ORDER BY page_id DESC LIMIT 3) UNION ALL SELECT 'active', o_orderkey, days FROM a""")
def dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-23: counts, the newest sessions, findings and notes, and active submissions with the days since"""
    t = lambda n: table(spark, sf_dir, n)
    n = F.count(F.lit(1)).alias("n")
    counts = {"manuscripts": t("customer"), "submissions": t("orders"), "journals": t("supplier"), "papers": t("documents").select("source").distinct(), "chunks": t("documents"), "sessions": t("conversations").select("conv_id").distinct()}
    newest = lambda kind, rows, key, value, k: rows.orderBy(F.desc(key)).limit(k).select(F.lit(kind).alias("kind"), F.col(key).cast("long").alias("id"), value.cast("long").alias("n"))
    days = F.floor((F.unix_micros(F.lit("1998-08-02").cast("timestamp")) - F.unix_micros(F.col("o_orderdate").cast("timestamp"))) / 86400e6)
    parts = [rows.agg(n).select(F.lit(kind).alias("kind"), F.lit(None).cast("long").alias("id"), "n") for kind, rows in counts.items()]
    parts += [newest("session", t("conversations").groupBy("conv_id").agg(n), "conv_id", F.col("n"), 5), newest("finding", t("benchmark"), "item_id", F.char_length("text"), 5), newest("note", t("pages"), "page_id", F.char_length("url"), 3)]
    parts.append(t("orders").filter("o_orderstatus = 'O'").select(F.lit("active").alias("kind"), F.col("o_orderkey").alias("id"), days.cast("long").alias("n")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(f"""WITH {PAPERS}, {KEYED}, q AS (SELECT doc_id AS asked, CASE doc_id % 4 WHEN 0 THEN '@' || citation_key WHEN 1 THEN paper_id WHEN 2 THEN 'ext ' || doc_id ELSE 'none' || doc_id END AS said FROM keyed)
SELECT asked, coalesce(min(a.paper_id), min(b.paper_id)) AS paper_id FROM q LEFT JOIN keyed a ON a.citation_key = ltrim(said, '@') OR a.paper_id = ltrim(said, '@') LEFT JOIN keyed b ON 'ext ' || b.doc_id = said GROUP BY asked""")
def key_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DED-12: a citation key or paper id, else an alias, with or without @"""
    from scholiast.operators import library as L
    from scholiast.plans.papers import catalog

    c = catalog(spark, sf_dir).withColumn("aliases", F.array(F.concat(F.lit("ext "), "doc_id")))
    said = F.expr("CASE doc_id % 4 WHEN 0 THEN concat('@', citation_key) WHEN 1 THEN paper_id WHEN 2 THEN concat('ext ', doc_id) ELSE concat('none', doc_id) END")
    return L.resolved_keys(c.select(F.col("doc_id").alias("asked"), said.alias("token")), c)


@query(f"""WITH {PAPERS}, x AS (SELECT paper_id, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE 'new ' || source END AS new_title, '10.9/' || doc_id AS new_doi, CASE WHEN doc_id % 2 = 0 THEN 2001 END AS new_year, CASE WHEN doc_id % 3 = 0 THEN 'N. Author' ELSE '' END AS new_authors, CASE doc_id % 4 WHEN 0 THEN 'AUTO' WHEN 1 THEN 'REVIEW' ELSE 'SKIP' END AS tier, CASE WHEN doc_id % 5 = 0 THEN 'first' END AS original FROM papers)
SELECT paper_id, CASE WHEN t THEN new_title ELSE title END AS title, CASE WHEN t THEN coalesce(original, title) ELSE original END AS title_original, CASE WHEN t THEN new_doi ELSE doi END AS doi, CASE WHEN t THEN coalesce(new_year, year) ELSE year END::INT AS year, CASE WHEN t AND new_authors <> '' THEN new_authors ELSE authors END AS authors FROM (SELECT p.*, x.* EXCLUDE (paper_id), tier IN ('AUTO', 'REVIEW') AND new_title IS NOT NULL AS t FROM papers p JOIN x USING (paper_id))""")
def apply_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DED-15, DML-03: accepted tiers overwrite title and DOI, year and authors only if given; the first original title stays"""
    from scholiast.operators import matching as M
    from scholiast.plans.papers import papers

    p = papers(spark, sf_dir)
    key = F.col("doc_id")
    x = p.select("paper_id", F.when(key % 7 != 0, F.concat(F.lit("new "), "source")).alias("new_title"), F.concat(F.lit("10.9/"), "doc_id").alias("doi"), F.when(key % 2 == 0, 2001).alias("year"), F.when(key % 3 == 0, "N. Author").otherwise("").alias("authors"), F.when(key % 4 == 0, "AUTO").when(key % 4 == 1, "REVIEW").otherwise("SKIP").alias("tier"))
    old = p.select("paper_id", "title", F.when(key % 5 == 0, "first").alias("title_original"), "doi", "year", "authors")
    return M.applied_proposals(old, x, ["AUTO", "REVIEW"])


@query("""WITH i AS (SELECT DISTINCT lower(p_brand) || ':' || (p_size % 3) AS name FROM part), a AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'brand#' || (c_custkey % 60) || ':1' WHEN 1 THEN 'brand#' || (c_custkey % 60) || ':latest' ELSE 'nothing' END AS pinned FROM customer),
r AS (SELECT c_custkey, name, row_number() OVER (PARTITION BY c_custkey ORDER BY CASE WHEN name = pinned THEN 0 WHEN split_part(name, ':', 1) = split_part(pinned, ':', 1) THEN 1 WHEN contains(name, '#4') THEN 2 WHEN contains(name, '#2') THEN 3 ELSE 4 END, name) AS n FROM a, i) SELECT c_custkey AS asked, name AS model FROM r WHERE n = 1""")
def model_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UDF-06: the pinned model, else its base, else a preferred one, else the first"""
    installed = table(spark, sf_dir, "part").select(F.concat(F.lower("p_brand"), F.lit(":"), F.col("p_size") % 3).alias("name")).distinct()
    key = F.col("c_custkey")
    pinned = F.when(key % 3 == 0, F.concat(F.lit("brand#"), key % 60, F.lit(":1"))).when(key % 3 == 1, F.concat(F.lit("brand#"), key % 60, F.lit(":latest"))).otherwise("nothing")
    return Mo.resolved_models(table(spark, sf_dir, "customer").select(key.alias("asked"), pinned.alias("pinned")), installed, ["#4", "#2"])
