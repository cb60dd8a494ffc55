"""Queries of the library, planner and links over the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholiast.operators import library as L
from scholiast.plans.registry import query, table


@query("SELECT c_custkey::VARCHAR AS paper_id, c_name AS title, c_mktsegment AS authors, c_nationkey AS year, CASE WHEN c_custkey % 3 = 0 THEN 'f' || (c_custkey % 4) END AS folder_id FROM customer WHERE contains(lower(c_name || ' ' || c_mktsegment || ' ' || c_nationkey), 'auto') AND c_custkey % 3 = 0 AND c_custkey % 4 = 1 ORDER BY lower(c_name), c_custkey::VARCHAR LIMIT 30")
def library_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-08, SRT-02, SRT-04"""
    c = table(spark, sf_dir, "customer")
    papers = c.select(F.col("c_custkey").cast("string").alias("paper_id"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("authors"), F.col("c_nationkey").alias("year"))
    member = c.filter("c_custkey % 3 = 0").select(F.col("c_custkey").cast("string").alias("paper_id"), F.concat(F.lit("f"), (F.col("c_custkey") % 4).cast("string")).alias("folder_id"))
    return L.page(L.listing(papers, member, "AUTO", "f1"), 1)


_KIND = "CASE l_linenumber % 4 WHEN 0 THEN 'cites' WHEN 1 THEN 'contrasts' WHEN 2 THEN 'background' ELSE 'unknown' END"


@query(f"""WITH l AS (SELECT l_orderkey AS manuscript_id, l_suppkey AS paper_id, {_KIND} AS link_type, l_comment AS note, l_shipdate AS made FROM (SELECT *, l_returnflag || l_linenumber AS l_comment FROM lineitem)),
old AS (SELECT manuscript_id, paper_id, link_type, min(made) AS made FROM l WHERE link_type <> 'unknown' AND manuscript_id % 2 = 0 GROUP BY ALL), good AS (SELECT * FROM l WHERE link_type <> 'unknown' AND manuscript_id % 5 <> 0 AND paper_id % 3 <> 0),
k AS (SELECT manuscript_id, paper_id, link_type FROM old UNION SELECT manuscript_id, paper_id, link_type FROM good), n AS (SELECT manuscript_id, paper_id, link_type, arg_max(note, strftime(made, '%Y%m%d') || note) AS note, min(made) AS made FROM good GROUP BY ALL)
SELECT k.*, coalesce(n.note, 'old') AS note, coalesce(old.made, n.made) AS created_at, coalesce(s_name, k.paper_id::VARCHAR) AS title FROM k LEFT JOIN n USING (manuscript_id, paper_id, link_type) LEFT JOIN old USING (manuscript_id, paper_id, link_type) LEFT JOIN supplier ON s_suppkey = k.paper_id AND s_suppkey % 3 <> 0""")
def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DML-12, DML-02: a link of one type changes its note only; unknown types, manuscripts and papers are refused; titles are attached"""
    x = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("manuscript_id"), F.col("l_suppkey").alias("paper_id"), F.expr(_KIND).alias("link_type"), F.concat("l_returnflag", "l_linenumber").alias("note"), F.col("l_shipdate").alias("created_at"))
    old = x.filter("link_type <> 'unknown' and manuscript_id % 2 = 0").groupBy("manuscript_id", "paper_id", "link_type").agg(F.lit("old").alias("note"), F.min("created_at").alias("created_at"))
    papers = table(spark, sf_dir, "supplier").filter("s_suppkey % 3 <> 0").select(F.col("s_suppkey").alias("paper_id"), F.col("s_name").alias("title"), F.lit("").alias("authors"), F.lit(None).cast("int").alias("year"))
    manuscripts = table(spark, sf_dir, "orders").filter("o_orderkey % 5 <> 0").select(F.col("o_orderkey").alias("manuscript_id"))
    after = L.upsert_links(old, x, manuscripts, papers)
    return L.linked_papers(after, papers).select("manuscript_id", "paper_id", "link_type", "note", "created_at", F.col("title").cast("string").alias("title"))


@query("SELECT n_name AS folder, count(s_suppkey) AS n FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_name")
def note_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DML-15"""
    n, s = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    notes = s.join(n, s.s_nationkey == n.n_nationkey).select(F.col("n_name").alias("folder"))
    return L.note_folders(n.select(F.col("n_name").alias("folder")), notes)


@query(r"""WITH c AS (SELECT doc_id, text FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings WHERE label < 5)), w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS token FROM c)
SELECT token, doc_id::VARCHAR AS chunk_id, count(*) AS tf FROM w GROUP BY ALL""")
def new_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-20, FLT-16"""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), "text")
    known = table(spark, sf_dir, "embeddings").filter("label < 5").select(F.col("vec_id").cast("string").alias("chunk_id"))
    return L.index_tables(d, known)[1]
