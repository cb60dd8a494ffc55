"""Queries that change several tables in step: catalog, imports, cascades, graph removal, memories, stores; and small data forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scholiast.functions import models as Mo
from scholiast.functions import text as T
from scholiast.operators import graph as G
from scholiast.operators import stores as S
from scholiast.operators import tracker as K
from scholiast.plans.papers import KEYED, PAPERS, catalog, doi_sql, garble_sql, ordered_distinct, papers
from scholiast.plans.registry import query, table


def _n(name: str = "n") -> F.Column:
    return F.count(F.lit(1)).alias(name)


# two parsed versions of every third paper: one without some values, one with new ones
_NEW = "CASE WHEN doc_id % 2 = 0 THEN '' ELSE 'new ' || source END"


@query(f"""WITH {PAPERS}, old AS (SELECT paper_id, title, CASE WHEN doc_id % 4 = 0 THEN 'original' ELSE '' END AS title_original, authors, year, nullif(doi, '') AS doi, source AS journal, source_pdf, doc_id FROM papers WHERE doc_id % 5 > 0),
new AS (SELECT paper_id, 'T ' || doc_id AS title, {_NEW} AS authors, CASE WHEN doc_id % 2 = 1 THEN 2000 END AS year, {_NEW} AS doi, {_NEW} AS journal, '/new/' || doc_id AS source_pdf FROM papers WHERE doc_id % 3 = 0)
SELECT coalesce(old.paper_id, new.paper_id) AS paper_id, CASE WHEN old.paper_id IS NULL OR (new.paper_id IS NOT NULL AND title_original = '') THEN new.title ELSE old.title END AS title,
 CASE WHEN old.paper_id IS NULL THEN new.authors ELSE coalesce(nullif(new.authors, ''), old.authors) END AS authors, coalesce(new.year, old.year)::INT AS year, CASE WHEN old.paper_id IS NULL THEN new.doi ELSE coalesce(nullif(new.doi, ''), old.doi) END AS doi, CASE WHEN old.paper_id IS NULL THEN new.journal ELSE coalesce(nullif(new.journal, ''), old.journal) END AS journal, coalesce(new.source_pdf, old.source_pdf) AS source_pdf FROM old FULL JOIN new ON old.paper_id = new.paper_id""")
def paper_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DED-08: a cleaned title stays, non-empty new values replace, the file always"""
    p = papers(spark, sf_dir)
    old = p.filter("doc_id % 5 > 0").select("paper_id", "title", F.when(F.col("doc_id") % 4 == 0, "original").otherwise("").alias("title_original"), "authors", "year", F.nullif("doi", F.lit("")).alias("doi"), F.col("source").alias("journal"), "source_pdf")
    said = F.when(F.col("doc_id") % 2 == 0, "").otherwise(F.concat(F.lit("new "), "source"))
    new = p.filter("doc_id % 3 = 0").select("paper_id", F.concat(F.lit("T "), "doc_id").alias("title"), said.alias("authors"), F.when(F.col("doc_id") % 2 == 1, F.lit(2000)).alias("year"), said.alias("doi"), said.alias("journal"), F.concat(F.lit("/new/"), "doc_id").alias("source_pdf"))
    return S.paper_upsert(old, new).select("paper_id", "title", "authors", "year", "doi", "journal", "source_pdf")


@query(f"""WITH {PAPERS}, {KEYED}, c AS (SELECT citation_key, paper_id, CASE WHEN doc_id % 4 = 0 THEN 'old' ELSE title END AS title, CASE WHEN doc_id % 6 = 0 THEN '' ELSE authors END AS authors, 1970 AS year, 'x' AS doi FROM keyed WHERE doc_id % 2 = 0),
f AS (SELECT *, base || CASE WHEN k = 1 THEN '' ELSE k::VARCHAR END AS citation_key FROM (SELECT b.*, row_number() OVER (PARTITION BY base ORDER BY paper_id) AS nth, (SELECT list_filter(range(1, 500), lambda i: i NOT IN (SELECT CASE WHEN o.citation_key = b.base THEN 1 ELSE TRY_CAST(substr(o.citation_key, length(b.base) + 1) AS INT) END FROM c o WHERE starts_with(o.citation_key, b.base) AND regexp_full_match(substr(o.citation_key, length(b.base) + 1), '([2-9]|[1-9][0-9]+)?')))[row_number() OVER (PARTITION BY base ORDER BY paper_id)]) AS k FROM based b WHERE doc_id % 2 = 1))
SELECT c.citation_key, c.paper_id, coalesce(nullif(p.title, ''), c.title) AS title, coalesce(nullif(p.authors, ''), c.authors) AS authors, coalesce(p.year, c.year) AS year, coalesce({doi_sql('p.doi')}, c.doi) AS doi FROM c JOIN papers p USING (paper_id)
UNION ALL SELECT citation_key, paper_id, title, authors, year, {doi_sql('doi')} FROM f""".replace("(SELECT list_filter(range(1, 500), lambda i: i NOT IN (SELECT CASE WHEN o.citation_key = b.base THEN 1 ELSE TRY_CAST(substr(o.citation_key, length(b.base) + 1) AS INT) END FROM c o WHERE starts_with(o.citation_key, b.base) AND regexp_full_match(substr(o.citation_key, length(b.base) + 1), '([2-9]|[1-9][0-9]+)?')))[row_number() OVER (PARTITION BY base ORDER BY paper_id)]) AS k FROM based b WHERE doc_id % 2 = 1))", "list_filter(range(1, 500), lambda i: NOT list_contains(coalesce(held, []), i))[row_number() OVER (PARTITION BY base ORDER BY paper_id)] AS k FROM based b LEFT JOIN (SELECT b.base AS hb, list(DISTINCT CASE WHEN o.citation_key = b.base THEN 1 ELSE substr(o.citation_key, length(b.base) + 1)::BIGINT END) AS held FROM (SELECT DISTINCT base FROM based) b JOIN c o ON starts_with(o.citation_key, b.base) AND regexp_full_match(substr(o.citation_key, length(b.base) + 1), '([2-9]|[1-9][0-9]+)?') GROUP BY 1) h ON hb = base WHERE doc_id % 2 = 1))"))
def catalog_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DED-07: non-empty values overwrite, new papers get free keys, a catalog in step stays untouched"""
    c = catalog(spark, sf_dir).filter("doc_id % 2 = 0")
    aliases = F.array("paper_id")
    old = c.select("citation_key", "paper_id", F.when(F.col("doc_id") % 4 == 0, "old").otherwise(F.col("title")).alias("title"), F.when(F.col("doc_id") % 6 == 0, "").otherwise(F.col("authors")).alias("authors"), F.lit(1970).alias("year"), F.lit("x").alias("doi"), aliases.alias("aliases"))
    return S.catalog_sync(old, papers(spark, sf_dir)).drop("aliases")


@query(f"""WITH {PAPERS}, {KEYED}, c AS (SELECT citation_key, paper_id, title, CASE WHEN doc_id % 4 = 1 THEN '' ELSE authors END AS authors, CASE WHEN doc_id % 8 = 1 THEN NULL ELSE year END AS year, '' AS doi, CASE WHEN doc_id % 3 = 0 THEN '' ELSE source END AS journal FROM keyed WHERE doc_id % 2 = 1),
m AS (SELECT doc_id AS row, CASE WHEN doc_id % 4 = 3 THEN 'review' ELSE 'matched' END AS status, 'p' || (doc_id % 40 * 2 + 1) AS paper_id, 'ext' || doc_id AS external_key, authors, year, {doi_sql('doi')} AS doi, 'J' || doc_id AS journal FROM papers WHERE doc_id % 2 = 1),
g AS (SELECT paper_id, arg_min(authors, row) FILTER (authors <> '') AS authors, arg_min(year, row) FILTER (year IS NOT NULL) AS year, arg_min(doi, row) FILTER (doi IS NOT NULL) AS doi, arg_min(journal, row) AS journal, string_agg(external_key, ',' ORDER BY row) AS x FROM m WHERE status = 'matched' GROUP BY 1)
SELECT citation_key, c.paper_id, title, coalesce(nullif(c.authors, ''), g.authors) AS authors, coalesce(c.year, g.year) AS year, coalesce(nullif(c.doi, ''), g.doi) AS doi, coalesce(nullif(c.journal, ''), g.journal) AS journal, concat_ws(',', c.paper_id, x) AS aliases FROM c LEFT JOIN g USING (paper_id)
UNION ALL SELECT 'imported' || doc_id, NULL, title, authors, year, {doi_sql('doi')}, source, 'ext' || doc_id FROM papers WHERE doc_id % 10 = 0""")
def import_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DED-06: matched rows fill what is empty and become aliases, rows without a paper become entries, rows for review wait"""
    c = catalog(spark, sf_dir).filter("doc_id % 2 = 1")
    old = c.select("citation_key", "paper_id", "title", F.when(F.col("doc_id") % 4 == 1, "").otherwise(F.col("authors")).alias("authors"), F.when(F.col("doc_id") % 8 != 1, F.col("year")).alias("year"), F.lit("").alias("doi"), F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("source")).alias("journal"), F.array("paper_id").alias("aliases"))
    p = papers(spark, sf_dir)
    ext = F.concat(F.lit("ext"), "doc_id").alias("external_key")
    met = p.filter("doc_id % 2 = 1").select(F.col("doc_id").alias("row"), F.when(F.col("doc_id") % 4 == 3, "review").otherwise("matched").alias("status"), F.concat(F.lit("p"), F.col("doc_id") % 40 * 2 + 1).alias("paper_id"), F.lit(None).cast("string").alias("proposed_key"), ext, "title", "authors", "year", "doi", F.concat(F.lit("J"), "doc_id").alias("journal"))
    new = p.filter("doc_id % 10 = 0").select(F.col("doc_id").alias("row"), F.lit("matched").alias("status"), F.lit(None).cast("string").alias("paper_id"), F.concat(F.lit("imported"), "doc_id").alias("proposed_key"), ext, "title", "authors", "year", "doi", F.col("source").alias("journal"))
    return S.applied_imports(old, met.unionByName(new)).withColumn("aliases", F.array_join("aliases", ","))


@query(f"""WITH {PAPERS}, files AS (SELECT '/now/' || source || '/' || doc_id || '.pdf' AS path FROM papers WHERE doc_id % 4 > 0 UNION ALL SELECT source_pdf FROM papers WHERE doc_id % 3 = 0), named AS (SELECT regexp_replace(path, '^.*/', '') AS name, min(path) AS path FROM files GROUP BY 1),
r AS (SELECT paper_id, source_pdf, CASE WHEN source_pdf IN (SELECT path FROM files) THEN source_pdf ELSE n.path END AS path FROM papers LEFT JOIN named n ON name = regexp_replace(source_pdf, '^.*/', ''))
SELECT paper_id, coalesce(path, source_pdf) AS source_pdf, CASE WHEN path IS NULL THEN 'missing' WHEN path = source_pdf THEN 'ok' ELSE 'fixed' END AS state FROM r""")
def path_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DED-11: a stored path that is there, else a file of the same name"""
    p = papers(spark, sf_dir)
    found = p.filter("doc_id % 4 > 0").select(F.concat(F.lit("/now/"), "source", F.lit("/"), "doc_id", F.lit(".pdf")).alias("path")).unionByName(p.filter("doc_id % 3 = 0").select(F.col("source_pdf").alias("path")))
    return S.repaired_paths(p.select("paper_id", "source_pdf"), found)


_BROKEN = "CASE doc_id % 5 WHEN 0 THEN replace(replace(text, 'e', '❈'), 'a', '▲') WHEN 1 THEN replace(text, ' ', ' /a114 ') ELSE text END"


@query(f"""WITH {PAPERS}, b AS (SELECT doc_id, paper_id, text, {_BROKEN} AS t FROM papers), g AS (SELECT paper_id FROM b WHERE length(left(t, 40000)) >= 80 AND {garble_sql('left(t, 40000)')} >= 0.25)
SELECT paper_id, 'c' || doc_id || CASE WHEN paper_id IN (SELECT paper_id FROM g) THEN 'r' ELSE '' END AS chunk_id, md5(CASE WHEN paper_id IN (SELECT paper_id FROM g) THEN text ELSE t END) AS text, paper_id IN (SELECT paper_id FROM g) AS repaired FROM b""")
def garbled_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DED-13: garbled papers lose their rows and are indexed again from a second reading"""
    p = papers(spark, sf_dir)
    old = p.select("paper_id", F.concat(F.lit("c"), "doc_id").alias("chunk_id"), F.expr(_BROKEN).alias("text"))
    again = p.select("paper_id", F.concat(F.lit("c"), "doc_id", F.lit("r")).alias("chunk_id"), "text")
    return S.garbled_repaired(old, again).withColumn("text", F.md5("text"))


@query("""WITH g AS (SELECT 'src' || (c_custkey % 40) AS paper_id FROM customer WHERE c_custkey % 7 = 0), k AS (SELECT 'chunks' AS name, source AS paper_id FROM documents UNION ALL SELECT 'vectors', source FROM documents JOIN embeddings ON vec_id = doc_id UNION ALL SELECT 'papers', paper_id FROM (SELECT DISTINCT source AS paper_id FROM documents) UNION ALL SELECT 'clips', 'src' || (conv_id % 25) FROM conversations)
SELECT name, paper_id, count(*) AS n FROM k WHERE paper_id NOT IN (SELECT paper_id FROM g) GROUP BY ALL""")
def paper_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DED-14: a deleted paper's chunks, vectors, card and clips go together"""
    d, e = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("paper_id")), table(spark, sf_dir, "embeddings")
    gone = table(spark, sf_dir, "customer").filter("c_custkey % 7 = 0").select(F.concat(F.lit("src"), F.col("c_custkey") % 40).alias("paper_id")).distinct()
    tables = {"chunks": d, "vectors": d.join(e, d.doc_id == e.vec_id), "papers": d.select("paper_id").distinct(), "clips": table(spark, sf_dir, "conversations").select(F.concat(F.lit("src"), F.col("conv_id") % 25).alias("paper_id"))}
    out = None
    for name, rows in S.without_papers(gone, tables).items():
        part = rows.groupBy("paper_id").agg(_n()).select(F.lit(name).alias("name"), "paper_id", "n")
        out = part if out is None else out.unionByName(part)
    return out


GRAPH = """links AS (SELECT l_partkey AS entity_id, l_orderkey AS chunk_id, l_suppkey AS paper_id FROM lineitem), ent AS (SELECT entity_id, list_sort(list(DISTINCT paper_id)) AS paper_ids, count(*) AS chunk_count FROM links GROUP BY 1),
rel AS (SELECT DISTINCT l_partkey AS source_id, l_partkey % 97 + 1 AS target_id, l_suppkey AS paper_id FROM lineitem), gone AS (SELECT s_suppkey AS paper_id FROM supplier WHERE s_suppkey % 3 = 0)"""


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    x = table(spark, sf_dir, "lineitem")
    links = x.select(F.col("l_partkey").alias("entity_id"), F.col("l_orderkey").alias("chunk_id"), F.col("l_suppkey").alias("paper_id"))
    entities = links.groupBy("entity_id").agg(F.array_sort(F.collect_set("paper_id")).alias("paper_ids"), F.count(F.lit(1)).alias("chunk_count"))
    relations = x.select(F.col("l_partkey").alias("source_id"), (F.col("l_partkey") % 97 + 1).alias("target_id"), F.col("l_suppkey").alias("paper_id")).distinct()
    return entities, relations, links


@query(f"""WITH {GRAPH}, lost AS (SELECT entity_id, count(*) AS lost FROM links WHERE paper_id IN (SELECT paper_id FROM gone) GROUP BY 1), e AS (SELECT entity_id, list_filter(paper_ids, lambda p: p % 3 <> 0) AS p, chunk_count - coalesce(lost, 0) AS chunk_count FROM ent LEFT JOIN lost USING (entity_id)),
r AS (SELECT source_id AS entity_id, count(*) AS n FROM rel WHERE paper_id % 3 <> 0 AND source_id IN (SELECT entity_id FROM e WHERE len(p) > 0) AND target_id IN (SELECT entity_id FROM e WHERE len(p) > 0) GROUP BY 1)
SELECT entity_id, array_to_string(p, ',') AS paper_ids, chunk_count, coalesce(n, 0) AS relations FROM e LEFT JOIN r USING (entity_id) WHERE len(p) > 0""")
def graph_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRF-08, ARR-03: papers leave the graph; entities lose them and their chunks, empty ones go with all that refers to them"""
    gone = table(spark, sf_dir, "supplier").filter("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("paper_id"))
    e, r, _ = S.graph_without_papers(*_graph(spark, sf_dir), gone)
    return e.join(r.groupBy(F.col("source_id").alias("entity_id")).agg(_n("r")), "entity_id", "left").select("entity_id", F.array_join(F.transform("paper_ids", lambda x: x.cast("string")), ",").alias("paper_ids"), "chunk_count", F.coalesce("r", F.lit(0)).alias("relations"))


_REFS = "text || ' [1] 10.1234/abc.' || (doc_id % 9) || '. [2] doi:10.5555/x' || (doc_id % 4) || ' [3] 10.1234/ABC.' || (doc_id % 9)"
_DOIS = rf"list_transform(regexp_extract_all({_REFS}, '10\.\d{{4,9}}/[-._;()/:A-Za-z0-9]+'), lambda x: regexp_replace(x, '[.,;:)]+$', ''))"


@query(f"WITH {PAPERS}, d AS (SELECT doc_id, lower(title) AS source_id, {_DOIS} AS d FROM papers), u AS (SELECT doc_id, source_id, unnest({ordered_distinct('d')}) AS doi FROM d) SELECT source_id, lower(doi) AS target_id, 'Cites' AS relation, count(*) AS weight FROM u GROUP BY ALL")
def citation_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRF-11: every paper cites the DOIs in its references; names of entities have no case"""
    said = F.concat("text", F.lit(" [1] 10.1234/abc."), F.col("doc_id") % 9, F.lit(". [2] doi:10.5555/x"), F.col("doc_id") % 4, F.lit(" [3] 10.1234/ABC."), F.col("doc_id") % 9)
    return G.citation_edges(papers(spark, sf_dir).withColumn("references_raw", said), "doc_id")


@query(f"WITH {GRAPH} SELECT 'entities' AS name, count(*)::VARCHAR AS value FROM ent UNION ALL SELECT 'relations', count(*)::VARCHAR FROM rel UNION ALL SELECT 'links', count(*)::VARCHAR FROM links UNION ALL SELECT 'built_at', max(ts)::DATE::VARCHAR FROM events UNION ALL SELECT 'model', 'rules' FROM region WHERE r_regionkey = 0")
def graph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRF-07: counts and the notes about how the graph was built"""
    e, r, k = _graph(spark, sf_dir)
    meta = table(spark, sf_dir, "events").agg(F.to_date(F.max("ts")).cast("string").alias("value")).select(F.lit("built_at").alias("name"), "value").unionByName(table(spark, sf_dir, "region").filter("r_regionkey = 0").select(F.lit("model").alias("name"), F.lit("rules").alias("value")))
    return G.stats({"entities": e, "relations": r, "links": k}, meta)


@query("""WITH e AS (SELECT l_suppkey AS id, l_partkey + 1000000 AS other, l_returnflag AS relation, l_orderkey AS doc FROM lineitem), both_ways AS (SELECT id, other, relation FROM e UNION ALL SELECT other, id, relation FROM e), n AS (SELECT id, count(DISTINCT other) AS neighbours FROM both_ways WHERE id <> other GROUP BY id),
c AS (SELECT id, doc, count(*) AS links FROM (SELECT id, doc % 200 AS doc FROM e UNION ALL SELECT other, doc % 200 FROM e) GROUP BY ALL), t AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY links DESC, doc) AS place FROM c)
SELECT t.id, neighbours, place, doc, links, left(text, 320) AS snippet FROM t JOIN n USING (id) JOIN documents ON doc_id = doc WHERE place <= 3""")
def entity_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRF-12: of every entity the number of its neighbours and its best chunks with a snippet of 320 characters"""
    x = table(spark, sf_dir, "lineitem")
    e = x.select(F.col("l_suppkey").alias("source_id"), (F.col("l_partkey") + 1000000).alias("target_id"))
    one = x.select(F.col("l_suppkey").alias("id"), (F.col("l_orderkey") % 200).alias("doc"))
    links = one.unionByName(x.select((F.col("l_partkey") + 1000000).alias("id"), (F.col("l_orderkey") % 200).alias("doc")))
    chunks = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text")
    return G.entity_cards(e, links, chunks, "doc", 3, 320)


@query("""WITH a AS (SELECT s_name AS journal_id FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT 'nobody'), u AS (SELECT s_name AS journal_id, count(*) AS used FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_quantity > 49 AND s_suppkey % 4 = 0 GROUP BY 1)
SELECT journal_id, CASE WHEN s_name IS NULL THEN 'not found' WHEN used > 0 THEN 'refused' ELSE 'deleted' END AS status, coalesce(used, 0) AS used, (SELECT count(*) FROM supplier) - (SELECT count(*) FROM a JOIN supplier ON s_name = journal_id LEFT JOIN u USING (journal_id) WHERE used IS NULL) AS journals_left FROM a LEFT JOIN supplier ON s_name = journal_id LEFT JOIN u USING (journal_id)""")
def journal_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DML-05: a journal with submissions is not deleted"""
    s, x = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "lineitem")
    asked = s.filter("s_suppkey % 2 = 0").select(F.col("s_name").alias("journal_id")).unionByName(spark.createDataFrame([("nobody",)], "journal_id string"))
    users = x.filter("l_quantity > 49").join(s.filter("s_suppkey % 4 = 0"), F.col("s_suppkey") == F.col("l_suppkey")).select(F.col("s_name").alias("journal_id"))
    left, answers = S.deleted_unless_used(s.select(F.col("s_name").alias("journal_id")), asked, "journal_id", users)
    return answers.crossJoin(left.agg(_n("journals_left")))




@query("""WITH t AS (SELECT o_custkey AS id, min(o_totalprice) AS v FROM orders WHERE o_custkey % 2 = 0 GROUP BY 1), n AS (SELECT o_custkey AS id, o_totalprice AS v, o_orderkey AS ord FROM orders WHERE o_custkey % 3 = 0), f AS (SELECT id, arg_min(v, ord) AS a, arg_max(v, ord) AS b FROM n GROUP BY id)
SELECT 'ignore' AS way, coalesce(t.id, f.id) AS id, coalesce(t.v, f.a) AS v FROM t FULL JOIN f ON t.id = f.id UNION ALL SELECT 'replace', coalesce(t.id, f.id), coalesce(f.b, t.v) FROM t FULL JOIN f ON t.id = f.id UNION ALL SELECT 'update', coalesce(t.id, f.id), CASE WHEN t.id IS NULL THEN f.b WHEN f.id IS NULL THEN t.v ELSE greatest(t.v, f.b) END FROM t FULL JOIN f ON t.id = f.id""")
def insert_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DML-02: insert or ignore, insert or replace, insert with an update on conflict"""
    o = table(spark, sf_dir, "orders")
    t = o.filter("o_custkey % 2 = 0").groupBy(F.col("o_custkey").alias("id")).agg(F.min("o_totalprice").alias("v"))
    n = o.filter("o_custkey % 3 = 0").select(F.col("o_custkey").alias("id"), F.col("o_totalprice").alias("v"), F.col("o_orderkey").alias("ord"))
    last = n.groupBy("id").agg(F.max_by("v", "ord").alias("v"))
    ways = {"ignore": S.inserted_or_ignored(t, n, ["id"], "ord"), "replace": S.inserted_or_replaced(t, n, ["id"], "ord"), "update": S.upserted(t, last, ["id"], {"v": F.greatest("v", "new_v")})}
    out = None
    for way, rows in ways.items():
        part = rows.select(F.lit(way).alias("way"), "id", "v")
        out = part if out is None else out.unionByName(part)
    return out


@query("""SELECT 'good' AS asked, c_custkey AS paper_id, CASE WHEN c_custkey % 10 = 1 THEN 'new' ELSE 'f' || (c_custkey % 3) END AS folder_id FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 10 = 1 UNION ALL SELECT 'bad', c_custkey, 'f' || (c_custkey % 3) FROM customer WHERE c_custkey % 2 = 0""")
def membership_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DML-06: an unknown id leaves every membership as it was"""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("paper_id"))
    now = c.filter("paper_id % 2 = 0").select("paper_id", F.concat(F.lit("f"), F.col("paper_id") % 3).alias("folder_id"))
    good = c.filter("paper_id % 10 = 1").select("paper_id", F.lit("new").alias("folder_id"))
    bad = good.unionByName(spark.createDataFrame([(-5, "new")], "paper_id long, folder_id string"))
    return K.assign_all_or_nothing(now, good, c, "paper_id").select(F.lit("good").alias("asked"), "*").unionByName(K.assign_all_or_nothing(now, bad, c, "paper_id").select(F.lit("bad").alias("asked"), "*"))


@query("""WITH m AS (SELECT o_orderkey AS id, o_custkey AS manuscript_id, o_orderkey % 50 AS journal_id, o_orderdate AS created_at FROM orders)
SELECT 'submission' AS kind, id, manuscript_id, journal_id, row_number() OVER (PARTITION BY manuscript_id ORDER BY created_at, id) AS place FROM m UNION ALL SELECT 'transition', id, NULL, NULL, 1 FROM m UNION ALL SELECT 'manuscript', c_custkey, NULL, NULL, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) FROM (SELECT * FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20)""")
def tracker_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DML-13: submissions in order of creation, each with an initial transition from nothing; manuscripts newest first"""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    new = o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("manuscript_id"), (F.col("o_orderkey") % 50).alias("journal_id"), F.col("o_orderdate").alias("created_at"))
    submissions, transitions = K.created_submissions(new)
    none = F.lit(None).cast("long")
    place = F.row_number().over(Window.partitionBy("manuscript_id").orderBy("created_at", "id")).alias("place")
    listed = submissions.select(F.lit("submission").alias("kind"), "id", "manuscript_id", "journal_id", place)
    first = transitions.filter("from_state is null and to_state = 'draft'").select(F.lit("transition").alias("kind"), F.col("submission_id").alias("id"), none.alias("manuscript_id"), none.alias("journal_id"), F.lit(1).alias("place"))
    newest = c.orderBy(F.desc("c_acctbal"), "c_custkey").limit(20)
    papers_ = newest.select(F.lit("manuscript").alias("kind"), F.col("c_custkey").alias("id"), none.alias("manuscript_id"), none.alias("journal_id"), F.row_number().over(Window.orderBy(F.desc("c_acctbal"), "c_custkey")).alias("place"))
    return listed.unionByName(first).unionByName(papers_)


@query("""WITH m AS (SELECT conv_id * 1000 + turn AS id, text, (conv_id * 37 + turn) % 1000 AS created_at FROM conversations WHERE role <> 'system'), k AS (SELECT * FROM m WHERE id % 4 <> 0), r AS (SELECT *, row_number() OVER (ORDER BY created_at DESC, id) AS place FROM k)
SELECT 'listed' AS store, id, place FROM r WHERE place <= 200 UNION ALL SELECT 'words', id, len(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) FROM k UNION ALL SELECT 'vectors', id, 64 FROM k""")
def memory_stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DML-14: memories, their words and vectors are saved and deleted together; the newest 200 are listed"""
    c = table(spark, sf_dir, "conversations").filter("role <> 'system'")
    new = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("memory_id"), F.col("text").alias("content"), ((F.col("conv_id") * 37 + F.col("turn")) % 1000).alias("created_at"))
    stores = S.memories_saved(new, Mo.hashed_embedder())
    left = S.memories_deleted(stores, new.filter("memory_id % 4 = 0").select("memory_id"))
    listed = S.memories_listed(left["memories"], 200)
    return listed.select(F.lit("listed").alias("store"), F.col("memory_id").alias("id"), "place").unionByName(left["words"].groupBy("memory_id").agg(F.sum("tf").cast("int").alias("n")).select(F.lit("words").alias("store"), "memory_id", "n").toDF("store", "id", "place")).unionByName(left["vectors"].select(F.lit("vectors").alias("store"), F.col("memory_id").alias("id"), F.size("embedding").alias("place")))


@query("""WITH n AS (SELECT conv_id AS note, CASE WHEN conv_id % 4 < 3 THEN 'folder' || (conv_id % 4) END AS folder FROM conversations GROUP BY conv_id) SELECT 'folder' || f AS folder, count(note) AS n, (SELECT count(*) FROM n WHERE folder IS NULL OR folder = 'folder1') AS unfiled FROM (VALUES (0), (2), (7)) v(f) LEFT JOIN n ON folder = 'folder' || f GROUP BY f""")
def note_folder_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DML-15: a deleted folder's notes are filed nowhere, the others' counts are live"""
    key = F.col("conv_id") % 4
    notes = table(spark, sf_dir, "conversations").select("conv_id").distinct().select(F.col("conv_id").alias("note"), F.when(key < 3, F.concat(F.lit("folder"), key)).alias("folder"))
    folders = spark.createDataFrame([(f"folder{i}",) for i in (0, 1, 2, 7)], "folder string")
    left, unfiled = S.folders_without(folders, notes, "folder1")
    from scholiast.operators.library import note_folders

    return note_folders(left, unfiled).crossJoin(unfiled.filter("folder is null").agg(_n("unfiled")))


@query("""WITH c AS (SELECT conv_id AS project, turn, 's' || turn AS slug, text FROM conversations), k AS (SELECT project, max(turn) AS last FROM c GROUP BY 1)
SELECT project, slug, last - turn AS sort_order, length(left(text, 500)) AS size FROM c JOIN k USING (project) WHERE project % 3 <> 0 UNION ALL SELECT project, slug, turn, length(left(text, 500)) FROM c WHERE project % 3 = 0""")
def files_reordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DML-16: an order that names every file once is taken, any other leaves the project as it was; sizes are capped"""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("project"), F.concat(F.lit("s"), "turn").alias("slug"), F.col("turn").alias("sort_order"), "text")
    last = c.groupBy("project").agg(F.max("sort_order").alias("last"))
    order = c.join(last, "project").select("project", "slug", (F.col("last") - F.col("sort_order")).alias("sort_order"))
    wrong = order.filter("project % 3 <> 0 or sort_order > 0").unionByName(order.filter("project % 3 = 0 and project % 2 = 0").select("project", F.lit("unknown").alias("slug"), "sort_order").distinct())
    return S.reordered(S.capped(c, "text", 500), wrong).select("project", "slug", "sort_order", F.char_length("text").alias("size"))


@query("""WITH m AS (SELECT l_orderkey AS paper, l_linenumber AS id, CASE l_linenumber % 4 WHEN 0 THEN '#FFCC00' WHEN 1 THEN '#00aaff' WHEN 2 THEN 'red' ELSE '#12345' END AS color, CASE WHEN l_linenumber % 3 = 0 THEN 'circle' ELSE 'highlight' END AS type, l_shipdate AS at FROM lineitem)
SELECT paper, count(*) AS marks, arg_max(id, strftime(at, '%Y%m%d') || id) AS newest FROM (SELECT paper, id, color, type, "at" FROM m) WHERE regexp_matches(color, '^#[0-9a-fA-F]{6}$') AND type = 'highlight' AND paper % 5 <> 0 GROUP BY paper""".replace("l_shipdate AS at", "l_shipdate AS made").replace('"at"', "made").replace("strftime(at", "strftime(made"))
def review_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DML-17: marks of a known type and colour are kept, newest first; cleared papers have none"""
    x = table(spark, sf_dir, "lineitem")
    color = F.get(F.array(*[F.lit(c) for c in ("#FFCC00", "#00aaff", "red", "#12345")]), F.col("l_linenumber") % 4)
    marks = x.select(F.col("l_orderkey").alias("paper"), F.col("l_linenumber").alias("id"), color.alias("color"), F.when(F.col("l_linenumber") % 3 == 0, "circle").otherwise("highlight").alias("type"), F.col("l_shipdate").alias("created_at"))
    kept = S.reviewed(marks, x.filter("l_orderkey % 5 = 0").select(F.col("l_orderkey").alias("paper")).distinct())
    return kept.groupBy("paper").agg(_n("marks"), F.max_by("id", F.struct("created_at", "id")).alias("newest"))


@query("""WITH j AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '[1, "two"' WHEN 2 THEN '["a", "' || event_type || '"]' WHEN 3 THEN '[]' ELSE '["a"]' END AS tags, CASE WHEN event_id % 3 = 0 THEN '{"theme": "dark", "size": ' || (event_id % 9) || '}' WHEN event_id % 3 = 1 THEN 'broken' ELSE '{}' END AS saved, event_type FROM events)
SELECT event_id, CASE event_id % 5 WHEN 2 THEN CASE WHEN event_type = 'a' THEN 'a' ELSE 'a,' || event_type END || ',new' WHEN 4 THEN 'a,new' ELSE 'new' END AS added, CASE event_id % 5 WHEN 2 THEN event_type ELSE '' END AS removed, coalesce(contains(tags, '"' || event_type || '"'), false) AS holds,
 CASE WHEN event_id % 3 = 0 THEN 'dark' ELSE 'light' END AS theme, CASE WHEN event_id % 3 = 0 THEN (event_id % 9)::INT ELSE 12 END AS size, 'en' AS lang FROM j""")
def json_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ARR-03, ARR-04, JSN-01, JSN-02: lists in JSON text with a default for broken ones, append if missing, remove, membership; settings over their defaults"""
    key = F.col("event_id")
    tags = F.when(key % 5 == 1, F.lit('[1, "two"')).when(key % 5 == 2, F.concat(F.lit('["a", "'), "event_type", F.lit('"]'))).when(key % 5 == 3, "[]").when(key % 5 == 4, '["a"]')
    saved = F.when(key % 3 == 0, F.concat(F.lit('{"theme": "dark", "size": '), key % 9, F.lit("}"))).when(key % 3 == 1, "broken").otherwise("{}")
    e = table(spark, sf_dir, "events").select("event_id", "event_type", tags.alias("tags"), saved.alias("saved"))
    settings = S.settings("saved", {"theme": "light", "size": "12", "lang": "en"})
    return e.select("event_id", F.array_join(S.list_with(F.col("tags"), F.lit("new")), ",").alias("added"), F.array_join(S.list_without(F.col("tags"), F.lit("a")), ",").alias("removed"), S.list_holds(F.col("tags"), F.col("event_type")).alias("holds"), settings["theme"].alias("theme"), settings["size"].cast("int").alias("size"), settings["lang"].alias("lang"))


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN ts::TIMESTAMP WHEN 1 THEN ts::TIMESTAMP WHEN 2 THEN ts::TIMESTAMP - INTERVAL 2 HOUR WHEN 3 THEN NULL ELSE ts::DATE::TIMESTAMP END AS at, CASE event_id % 4 WHEN 0 THEN year(ts) || '-01-01' WHEN 1 THEN strftime(ts, '%Y-%m') || '-01' WHEN 2 THEN strftime(ts, '%Y-%m-%d') END AS day, epoch_us(ts) / 1000000.0 AS seconds FROM events""")
def time_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DAT-01, DAT-02, DAT-06: ISO texts with Z, an offset or none, broken ones null; lists of one to three parts as a day; seconds since the epoch, there and back"""
    e = table(spark, sf_dir, "events")
    iso = lambda f: F.date_format("ts", f)
    key = F.col("event_id")
    said = F.when(key % 5 == 0, F.concat(iso("yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z"))).when(key % 5 == 1, iso("yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).when(key % 5 == 2, F.concat(iso("yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+02:00"))).when(key % 5 == 3, "yesterday").otherwise(iso("yyyy-MM-dd"))
    parts = F.array(F.year("ts"), F.month("ts"), F.day("ts"))
    day = F.when(key % 4 < 3, F.slice(parts, F.lit(1), (key % 4 + 1).cast("int")))
    return e.select("event_id", S.instant(said).cast("timestamp_ntz").alias("at"), S.day_of_parts(day).alias("day"), S.epoch_seconds(S.from_epoch(S.epoch_seconds(F.col("ts").cast("timestamp")))).alias("seconds"))


@query("""SELECT l_orderkey, count(*) AS total, to_json(map_from_entries(list({'k': k, 'v': n} ORDER BY k))) AS by_type FROM (SELECT l_orderkey, l_returnflag AS k, count(*) AS n FROM lineitem GROUP BY ALL) JOIN (SELECT l_orderkey, l_linenumber FROM lineitem) USING (l_orderkey) GROUP BY l_orderkey""".replace("""SELECT l_orderkey, count(*) AS total, to_json(map_from_entries(list({'k': k, 'v': n} ORDER BY k))) AS by_type FROM (SELECT l_orderkey, l_returnflag AS k, count(*) AS n FROM lineitem GROUP BY ALL) JOIN (SELECT l_orderkey, l_linenumber FROM lineitem) USING (l_orderkey) GROUP BY l_orderkey""", """SELECT l_orderkey, sum(n)::BIGINT AS total, '{' || string_agg('"' || k || '":' || n, ',' ORDER BY k) || '}' AS by_type FROM (SELECT l_orderkey, l_returnflag AS k, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY l_orderkey"""))
def type_counts_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-15, JSN-03: a map of counts by type, as JSON"""
    n = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(_n())
    pairs = F.array_sort(F.collect_list(F.struct(F.col("l_returnflag").alias("key"), F.col("n").alias("value"))))
    return n.groupBy("l_orderkey").agg(F.sum("n").alias("total"), F.to_json(F.map_from_entries(pairs)).alias("by_type"))


@query("""WITH d AS (SELECT source, count(*) AS articles FROM documents GROUP BY 1), v AS (SELECT source, count(*) AS points FROM documents JOIN embeddings ON vec_id = doc_id WHERE source NOT IN ('src1', 'src4') GROUP BY 1)
SELECT source AS journal_id, articles, CASE WHEN points IS NULL THEN 'MISSING' ELSE points::VARCHAR END AS points, coalesce(points, 0) = articles AS complete FROM d LEFT JOIN v USING (source)""")
def vector_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-22: articles against points of every journal, MISSING without a collection"""
    d, e = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("journal_id")), table(spark, sf_dir, "embeddings")
    points = d.filter("journal_id not in ('src1', 'src4')").join(e.select(F.col("vec_id").alias("doc_id")), "doc_id")
    return S.vector_coverage(d, points)


@query(f"""WITH {PAPERS}, c AS (SELECT doc_id, paper_id, title, text, CASE WHEN doc_id % 50 = 0 THEN 'nobody' ELSE paper_id END AS owner, doc_id % 3 AS page FROM papers)
SELECT * FROM (SELECT 'orphan chunks' AS name, count(*) AS n FROM c WHERE owner = 'nobody' UNION ALL SELECT 'chunks', count(*) FROM c UNION ALL SELECT 'vectors', count(*) FROM embeddings UNION ALL SELECT 'indexed', count(DISTINCT doc_id) FROM c WHERE len(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+')) > 0
UNION ALL SELECT 'chunks without vector', count(*) FROM c ANTI JOIN embeddings ON vec_id = doc_id UNION ALL SELECT 'junk titles', count(*) FROM c WHERE length(trim(title)) < 6 OR {garble_sql('trim(title)')} >= 0.25 OR regexp_matches(trim(title), '{T.FURNITURE}') UNION ALL SELECT 'pages above 1', count(*) FROM c WHERE page > 1 UNION ALL SELECT 'dangling links', count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 20 > 0))""")
def integrity_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-21: all checks of a rebuilt index"""
    p = papers(spark, sf_dir)
    chunks = p.select(F.col("doc_id").alias("chunk_id"), F.when(F.col("doc_id") % 50 == 0, "nobody").otherwise(F.col("paper_id")).alias("paper_id"), (F.col("doc_id") % 3).alias("page_start"), "text")
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"))
    links = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("entity_id"))
    entities = table(spark, sf_dir, "part").filter("p_partkey % 20 > 0").select(F.col("p_partkey").alias("entity_id"))
    return S.integrity(p.select("paper_id", "title"), chunks, vectors, entities, links)


# every seventh text has a changed note, every fifth a changed row, every thirteenth is cleared, every eleventh experiment is gone, every eighth has no note, every ninth note lost its link
_MIRROR = """m AS (SELECT s_suppkey AS id, s_name AS name, 'Text ' || s_suppkey AS base, CASE WHEN s_suppkey % 13 = 0 THEN '' WHEN s_suppkey % 5 = 0 THEN 'Row ' || s_suppkey ELSE 'Text ' || s_suppkey END AS text, CASE WHEN s_suppkey % 7 = 0 THEN 'Note ' || s_suppkey ELSE 'Text ' || s_suppkey END AS said FROM supplier),
a AS (SELECT *, CASE WHEN id % 11 = 0 THEN CASE WHEN id % 8 = 0 THEN NULL WHEN id % 9 = 0 THEN 'kept' ELSE 'unlinked' END WHEN id % 8 = 0 THEN CASE WHEN text <> '' THEN 'created' END WHEN id % 9 = 0 THEN 'kept' WHEN text = said THEN 'same' WHEN said = base THEN CASE WHEN text <> '' THEN 'to note' ELSE 'removed' END WHEN text = base THEN 'to experiment' ELSE 'conflict' END AS action FROM m)"""


@query(f"""WITH {_MIRROR} SELECT id, action, CASE WHEN action IN ('created', 'to note', 'same') THEN name WHEN action = 'unlinked' THEN name || ' (experiment deleted)' WHEN action <> 'removed' THEN name END AS title,
CASE WHEN action IN ('created', 'to note', 'same') THEN '# ' || name || chr(10) || chr(10) || text || chr(10) WHEN action <> 'removed' THEN '# ' || name || chr(10) || chr(10) || said || chr(10) END AS body, CASE WHEN id % 11 = 0 THEN NULL WHEN action = 'to experiment' THEN said ELSE text END AS notes_md FROM a WHERE action IS NOT NULL""")
def mirrored_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DML-11: notes and experiments brought together, and once more, which changes nothing"""
    from scholiast.operators import mirror

    s, key = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    said = lambda what: F.concat(F.lit(what), key)
    experiments = s.filter(key % 11 != 0).select(key.alias("id"), F.col("s_name").alias("name"), F.when(key % 13 == 0, "").when(key % 5 == 0, said("Row ")).otherwise(said("Text ")).alias("notes_md"))
    body = F.concat(F.lit("# "), "s_name", F.lit("\n\n"), F.when(key % 7 == 0, said("Note ")).otherwise(said("Text ")), F.lit("\n"))
    notes = s.filter(key % 8 != 0).select(said(mirror.PREFIX).alias("note_id"), F.when(key % 9 != 0, key.cast("string")).alias("experiment"), F.lit("mine").alias("folder"), F.lit("2024-01-01").alias("date"), F.col("s_name").alias("title"), body.alias("body"))
    base, now = s.select(key.alias("id"), F.md5(said("Text ")).alias("digest")), F.lit("2024-02-02T00:00:00")
    rows, files, after, actions = mirror.mirrored(experiments, notes, base, now)
    again, unchanged, _, _ = mirror.mirrored(rows, files, after, now)
    ids = unchanged.withColumn("id", F.substr("note_id", F.lit(len(mirror.PREFIX) + 1)))
    met = actions.join(ids, "id", "left").withColumn("id", F.col("id").cast("long")).join(again.select("id", "notes_md"), "id", "left")
    return met.select("id", "action", "title", "body", "notes_md")
