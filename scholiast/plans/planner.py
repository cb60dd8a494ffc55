"""Queries of planning, searching lists and sessions: orders stand for experiments and submissions, line items for tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scholiast.operators import library as L
from scholiast.operators import stores as S
from scholiast.plans.papers import KEYED, PAPERS, catalog, papers
from scholiast.plans.registry import query, table

RUNS = """runs AS (SELECT o_orderkey AS id, 'run ' || o_orderkey AS name, CASE o_orderkey % 5 WHEN 0 THEN 'planned' WHEN 1 THEN 'in_progress' WHEN 2 THEN 'done' WHEN 3 THEN 'failed' ELSE 'planned' END AS status, o_custkey AS manuscript_id,
CASE WHEN o_orderkey % 3 > 0 THEN o_orderdate::DATE END AS scheduled_for, CASE WHEN o_orderkey % 4 > 1 THEN o_orderdate::DATE + 7 END AS ran_on, o_orderdate::DATE + 1 AS created_at FROM orders)"""
TASKS = """tasks AS (SELECT l_orderkey * 10 + l_linenumber AS id, 'task ' || l_partkey AS title, CASE WHEN l_linestatus = 'F' THEN 'done' WHEN l_linenumber % 2 = 0 THEN 'todo' ELSE 'in_progress' END AS status, CASE WHEN l_linenumber % 4 > 0 THEN l_shipdate::DATE END AS due_date,
CASE WHEN l_linestatus = 'F' THEN l_shipdate::DATE END AS completed_at, CASE WHEN l_linenumber < 6 THEN l_orderkey END AS experiment_id, l_suppkey AS position, l_shipdate::DATE - 3 AS created_at FROM lineitem)"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.to_date("o_orderdate")
    status = F.get(F.array(*[F.lit(x) for x in ("planned", "in_progress", "done", "failed", "planned")]), (F.col("o_orderkey") % 5).cast("int"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("run "), "o_orderkey").alias("name"), status.alias("status"), F.col("o_custkey").alias("manuscript_id"), F.when(F.col("o_orderkey") % 3 > 0, day).alias("scheduled_for"), F.when(F.col("o_orderkey") % 4 > 1, F.date_add(day, 7)).alias("ran_on"), F.date_add(day, 1).alias("created_at"))


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    day, done = F.to_date("l_shipdate"), F.col("l_linestatus") == "F"
    return table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.concat(F.lit("task "), "l_partkey").alias("title"), F.when(done, "done").when(F.col("l_linenumber") % 2 == 0, "todo").otherwise("in_progress").alias("status"), F.when(F.col("l_linenumber") % 4 > 0, day).alias("due_date"), F.when(done, day).alias("completed_at"), F.when(F.col("l_linenumber") < 6, F.col("l_orderkey")).alias("experiment_id"), F.col("l_suppkey").alias("position"), F.date_sub(day, 3).alias("created_at"))


_LIKE = "(contains(lower(citation_key), {q}) OR contains(lower(title), {q}) OR contains(lower(authors), {q}) OR contains(lower(doi), {q}) OR contains(paper_id, {q}))"


@query(f"WITH {PAPERS}, {KEYED} SELECT paper_id, citation_key, year, title FROM keyed WHERE {_LIKE.format(q=chr(39) + 'src1' + chr(39))} ORDER BY year IS NULL, year DESC, title, paper_id LIMIT 50")
def catalog_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-05: wildcards in what is asked are dropped, at most 50 come back, papers without a year last"""
    return L.catalog_search(catalog(spark, sf_dir), "SRC_1%", 80).select("paper_id", "citation_key", "year", "title")


@query(f"""WITH {PAPERS}, {KEYED}, asked AS (SELECT * FROM (VALUES (1, 'a'), (2, 'src2'), (3, 'p7')) q(query_id, q)), known AS (SELECT query_id, paper_id, citation_key AS key, year, title FROM keyed, asked WHERE length(q) >= 2 AND doc_id % 2 = 0 AND {_LIKE.format(q='q')}),
other AS (SELECT query_id, paper_id, NULL AS key, year, title FROM papers, asked WHERE length(q) >= 2 AND query_id NOT IN (SELECT query_id FROM known) AND (contains(lower(title), q) OR contains(lower(authors), q) OR contains(lower(doi), q) OR contains(paper_id, q)))
SELECT query_id, paper_id, key FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY year IS NULL, year DESC, title, paper_id) AS n FROM (SELECT * FROM known UNION ALL SELECT * FROM other)) WHERE n <= 12""")
def picker_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-06: nothing for one character; the catalog, or where it has nothing the papers"""
    c, p = catalog(spark, sf_dir).filter("doc_id % 2 = 0"), papers(spark, sf_dir)
    out = None
    for i, q in enumerate(["a", "src2", "p7"], 1):
        part = L.picker_search(c, p, q).select(F.lit(i).alias("query_id"), "paper_id", F.col("citation_key").alias("key"))
        out = part if out is None else out.unionByName(part)
    return out


@query(f"""WITH {PAPERS}, j AS (SELECT 'journal' AS kind, s_name AS name, row_number() OVER (ORDER BY s_acctbal DESC, s_name) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE contains(lower(s_name), 'am') OR contains(lower(n_name), 'am') OR contains(lower(r_name), 'am')),
a AS (SELECT 'article' AS kind, paper_id AS name, row_number() OVER (ORDER BY year DESC NULLS LAST, paper_id) AS n FROM papers WHERE contains(lower(title), 'am') OR contains(lower(text), 'am')) SELECT * FROM (SELECT * FROM j UNION ALL SELECT * FROM a) WHERE n <= 10""")
def venue_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-07: journals by name, publisher and scope, best impact first; articles by title and abstract, newest first"""
    s, n, r = (table(spark, sf_dir, x) for x in ("supplier", "nation", "region"))
    venues = s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select(F.col("s_name").alias("name"), F.col("n_name").alias("publisher"), F.col("r_name").alias("scope_statement"), F.col("s_acctbal").alias("impact_factor"))
    articles = papers(spark, sf_dir).select(F.col("paper_id").alias("name"), "title", F.col("text").alias("abstract"), F.col("year").alias("published_date"))
    return L.venue_search(venues, articles, "AM", 10)


@query("""WITH m AS (SELECT c_custkey, 'f' || (c_custkey % 4) AS folder FROM customer WHERE c_custkey % 3 = 0), x AS (SELECT c_custkey, contains(lower(c_name || ' ' || c_mktsegment || ' ' || c_nationkey), 'auto') AS hit FROM customer)
SELECT 'total' AS name, count(*) AS n FROM x JOIN m USING (c_custkey) WHERE hit AND folder = 'f1' UNION ALL SELECT 'total_all', count(*) FROM customer UNION ALL SELECT 'unfiled', count(*) FROM x ANTI JOIN m USING (c_custkey)
UNION ALL SELECT f, count(c_custkey) FROM (VALUES ('f0'), ('f1'), ('f2'), ('f3'), ('f9')) v(f) LEFT JOIN m ON folder = f GROUP BY f""")
def library_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-08, AGG-16: papers found, all papers, those in no folder, and the live count of each folder"""
    c = table(spark, sf_dir, "customer")
    shelf = c.select(F.col("c_custkey").cast("string").alias("paper_id"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("authors"), F.col("c_nationkey").alias("year"))
    member = c.filter("c_custkey % 3 = 0").select(F.col("c_custkey").cast("string").alias("paper_id"), F.concat(F.lit("f"), F.col("c_custkey") % 4).alias("folder_id"))
    gone = spark.createDataFrame([("-1", "f0")], "paper_id string, folder_id string")  # a paper that is not there any more
    return L.totals(shelf, member.unionByName(gone), spark.createDataFrame([(f,) for f in ("f0", "f1", "f2", "f3", "f9")], "folder_id string"), "AUTO", "f1")


_KINDS = [("manuscript", "customer", "c_name", "c_custkey", "0001"), ("experiment", "supplier", "s_name", "s_suppkey", "0001"), ("task", "part", "p_name", "p_partkey", "0001")]


@query("""WITH a AS (SELECT 1 AS t, 'manuscript' AS type, c_custkey::VARCHAR AS id, c_name AS title, c_custkey AS o FROM customer UNION ALL SELECT 2, 'experiment', s_suppkey::VARCHAR, s_name, s_suppkey FROM supplier UNION ALL SELECT 3, 'task', p_partkey::VARCHAR, p_name, p_partkey FROM part
UNION ALL SELECT 4, 'paper', page_id::VARCHAR, url, page_id FROM pages UNION ALL SELECT 5, 'memory', (conv_id * 1000 + turn)::VARCHAR, text, conv_id * 1000 + turn FROM conversations WHERE role = 'assistant' UNION ALL SELECT 6, 'note', item_id::VARCHAR, text, item_id FROM benchmark),
r AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY o DESC) AS n FROM a WHERE contains(lower(title), 'an')), k AS (SELECT *, row_number() OVER (ORDER BY t, n) AS place FROM r WHERE n <= 8)
SELECT type, id, CASE WHEN t = 5 AND length(title) > 80 THEN left(title, 80) || '…' ELSE title END AS title, place FROM k WHERE place <= 40""")
def mention_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-09: the newest of six types in their fixed order, forty in all, memories cut at 80 characters"""
    t = lambda n: table(spark, sf_dir, n)
    of = lambda df, key, title: df.select(F.col(key).cast("string").alias("id"), F.col(title).alias("title"), F.col(key).alias("at"))
    memories = t("conversations").filter("role = 'assistant'").withColumn("m", F.col("conv_id") * 1000 + F.col("turn"))
    found = [("manuscript", of(t("customer"), "c_custkey", "c_name")), ("experiment", of(t("supplier"), "s_suppkey", "s_name")), ("task", of(t("part"), "p_partkey", "p_name")), ("paper", of(t("pages"), "page_id", "url")), ("memory", of(memories, "m", "text")), ("note", of(t("benchmark"), "item_id", "text"))]
    return L.mention_search(found, "AN", 8)


@query(f"""WITH {RUNS}, {TASKS}, e AS (SELECT 'experiment' AS kind, id, row_number() OVER (ORDER BY coalesce(ran_on, scheduled_for, created_at) DESC, id) AS place FROM runs WHERE manuscript_id % 10 = 1 AND status = 'planned'),
t AS (SELECT 'task' AS kind, id, row_number() OVER (ORDER BY due_date IS NULL, due_date, position, created_at DESC, id) AS place FROM tasks WHERE status = 'todo' AND position = 3) SELECT * FROM (SELECT * FROM e UNION ALL SELECT * FROM t) WHERE place <= 60""")
def filtered_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-10: the filters that are given, each list in its own order"""
    e = L.filtered(runs(spark, sf_dir).withColumn("m", F.col("manuscript_id") % 10), {"m": 1, "status": "planned", "name": None}, [F.desc(F.coalesce("ran_on", "scheduled_for", "created_at")), F.asc("id")], 60)
    t = L.filtered(tasks(spark, sf_dir), {"status": "todo", "position": 3, "experiment_id": None}, [F.col("due_date").isNull().asc(), F.asc("due_date"), F.asc("position"), F.desc("created_at"), F.asc("id")], 60)
    return e.select(F.lit("experiment").alias("kind"), "id", "place").unionByName(t.select(F.lit("task").alias("kind"), "id", "place"))


@query(f"WITH {RUNS} SELECT id, scheduled_for FROM runs WHERE status = 'planned' AND scheduled_for >= DATE '1996-01-01'")
def upcoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-11: planned experiments from a day on; without a day none"""
    return L.upcoming(runs(spark, sf_dir), F.lit("1996-01-01").cast("date")).select("id", "scheduled_for")


_DAY = "CASE WHEN status <> 'planned' AND ran_on IS NOT NULL THEN ran_on ELSE coalesce(scheduled_for, ran_on) END"


@query(f"""WITH {RUNS}, {TASKS}, c AS (SELECT experiment_id, count(*) AS n, count(*) FILTER (status <> 'done') AS open FROM tasks WHERE experiment_id IS NOT NULL GROUP BY 1)
SELECT 'experiment' AS kind, id, name AS title, {_DAY} AS date, status, CASE status WHEN 'planned' THEN 'todo' WHEN 'in_progress' THEN 'doing' ELSE 'done' END AS "column", status IN ('done', 'failed') AS closed, coalesce(n, 0) AS task_count, coalesce(open, 0) AS open_tasks FROM runs LEFT JOIN c ON experiment_id = id
UNION ALL SELECT 'task', id, title, due_date, status, CASE status WHEN 'in_progress' THEN 'doing' ELSE status END, status = 'done', NULL, NULL FROM tasks""")
def plan_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DML-07, DAT-05: experiments and tasks as items of one shape"""
    return S.plan_items(runs(spark, sf_dir), tasks(spark, sf_dir))


_MOVES = "SELECT id, id % 2 = 0 AS dated, CASE WHEN id % 6 > 0 THEN DATE '1998-03-01' END AS date, CASE id % 5 WHEN 0 THEN 'todo' WHEN 1 THEN 'doing' WHEN 2 THEN 'done' WHEN 3 THEN 'done' END AS \"column\" FROM {} WHERE id % 7 < 5"


def _moves(rows: DataFrame) -> DataFrame:
    key = F.col("id")
    return rows.filter("id % 7 < 5").select("id", (key % 2 == 0).alias("dated"), F.when(key % 6 > 0, F.lit("1998-03-01").cast("date")).alias("date"), F.when(key % 5 == 0, "todo").when(key % 5 == 1, "doing").when((key % 5 == 2) | (key % 5 == 3), "done").alias("column"))


_T = "CASE m.\"column\" WHEN 'doing' THEN 'in_progress' ELSE m.\"column\" END"


@query(f"""WITH {TASKS}, m AS ({_MOVES.format('tasks')}) SELECT t.id, CASE WHEN m.dated THEN m.date ELSE t.due_date END AS due_date, coalesce({_T}, t.status) AS status,
CASE WHEN m."column" IS NULL THEN t.completed_at WHEN m."column" = 'done' THEN CASE WHEN t.status = 'done' THEN t.completed_at ELSE DATE '1998-08-02' END END AS completed_at FROM tasks t LEFT JOIN m ON m.id = t.id""")
def planner_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DML-08, DML-03: moved tasks change only what the move names; done sets the time once"""
    t = tasks(spark, sf_dir)
    return S.moved_tasks(t, _moves(t), F.lit("1998-08-02").cast("date")).select("id", "due_date", "status", "completed_at")


_R = """met AS (SELECT r.*, m.dated, m.date, m."column" AS c, CASE WHEN r.status <> 'planned' AND r.ran_on IS NOT NULL THEN r.ran_on ELSE coalesce(r.scheduled_for, r.ran_on) END AS old_day, r.status <> 'planned' AND r.ran_on IS NOT NULL AS started FROM runs r LEFT JOIN m ON m.id = r.id),
s AS (SELECT *, CASE WHEN coalesce(dated, false) AND started THEN date ELSE ran_on END AS r2, CASE WHEN coalesce(dated, false) AND NOT started THEN date ELSE scheduled_for END AS s2, CASE WHEN c IS NULL OR (c = 'done' AND status IN ('failed', 'abandoned')) THEN status WHEN c = 'todo' THEN 'planned' WHEN c = 'doing' THEN 'in_progress' ELSE c END AS st FROM met),
o AS (SELECT id, st AS status, s2 AS scheduled_for, CASE WHEN c IS NOT NULL AND st IN ('in_progress', 'done') AND r2 IS NULL THEN CASE WHEN s2 <= DATE '1996-06-01' THEN s2 ELSE DATE '1996-06-01' END ELSE r2 END AS ran_on, CASE WHEN coalesce(dated, false) AND date IS NOT NULL THEN date - old_day END AS shift FROM s)"""


@query(f"WITH {RUNS}, m AS ({_MOVES.format('runs')}), {_R} SELECT id, status, scheduled_for, ran_on FROM o")
def experiment_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DML-08: moved experiments with the side effects on their run day"""
    e = runs(spark, sf_dir)
    return S.moved_experiments(e, tasks(spark, sf_dir), _moves(e), F.lit("1996-06-01").cast("date"))[0]


@query(f"WITH {RUNS}, {TASKS}, m AS ({_MOVES.format('runs')}), {_R} SELECT t.id, CASE WHEN t.status <> 'done' AND shift <> 0 THEN (due_date + shift::INT)::DATE ELSE due_date END AS due_date FROM tasks t LEFT JOIN o ON o.id = t.experiment_id")
def shifted_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DAT-04, DML-08: open tasks with a day travel with their experiment"""
    e = runs(spark, sf_dir)
    return S.moved_experiments(e, tasks(spark, sf_dir), _moves(e), F.lit("1996-06-01").cast("date"))[1].select("id", "due_date")


@query("""WITH old AS (SELECT conv_id, turn, text FROM conversations WHERE turn < 3), new AS (SELECT conv_id, turn * 10 AS moment, text FROM conversations WHERE turn >= 3), a AS (SELECT conv_id, coalesce(k, 0) + row_number() OVER (PARTITION BY conv_id ORDER BY moment, text) - 1 AS i, text FROM new LEFT JOIN (SELECT conv_id, max(turn) + 1 AS k FROM old GROUP BY 1) USING (conv_id)),
s AS (SELECT conv_id, count(*) AS n, max(turn) AS moment FROM old GROUP BY 1), x AS (SELECT conv_id, count(*) AS n, max(moment) AS moment FROM new GROUP BY 1), t AS (SELECT conv_id, max(turn) AS last, count(*) AS turns FROM (SELECT conv_id, turn FROM old UNION ALL SELECT conv_id, i FROM a) GROUP BY 1)
SELECT s.conv_id AS session_id, coalesce(x.moment, s.moment) AS updated_at, s.n + coalesce(x.n, 0) AS turn_count, last, turns FROM s LEFT JOIN x USING (conv_id) JOIN t USING (conv_id)""")
def session_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DML-09, WIN-05: turns numbered on, with the session's count and time"""
    c = table(spark, sf_dir, "conversations")
    turns = c.filter("turn < 3").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("turn_index"), F.col("text").alias("content"))
    sessions = turns.groupBy("session_id").agg(F.max("turn_index").alias("updated_at"), F.count(F.lit(1)).alias("turn_count"))
    new = c.filter("turn >= 3").select(F.col("conv_id").alias("session_id"), F.col("text").alias("content"), (F.col("turn") * 10).alias("created_at"))
    after, all_turns = S.turns_appended(sessions, turns, new)
    return after.join(all_turns.groupBy("session_id").agg(F.max("turn_index").alias("last"), F.count(F.lit(1)).alias("turns")), "session_id")


@query("""WITH k AS (SELECT 'c' || doc_id AS chunk_id, source AS paper_id, 'body' AS section_name, 0::BIGINT AS page_start, 0::BIGINT AS page_end, doc_id AS position, text FROM documents UNION ALL SELECT 'clip_' || (conv_id * 1000 + turn), 'src' || (conv_id % 25), 'Saved highlight', turn, turn, 1000000, regexp_replace(text, '^\\s+|\\s+$', '', 'g') FROM conversations WHERE 'src' || (conv_id % 25) IN (SELECT source FROM documents) AND trim(text) <> '')
SELECT chunk_id, paper_id, section_name, page_start, page_end, position, md5(text) AS text FROM k""")
def clip_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DML-10: saved passages of known papers become chunks at position 1,000,000"""
    d, c = table(spark, sf_dir, "documents"), table(spark, sf_dir, "conversations")
    zero = F.lit(0).cast("long")
    chunks = d.select(F.concat(F.lit("c"), "doc_id").alias("chunk_id"), F.col("source").alias("paper_id"), F.lit("body").alias("section_name"), zero.alias("page_start"), zero.alias("page_end"), F.col("doc_id").alias("position"), "text")
    clips = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("clip_id"), F.concat(F.lit("src"), F.col("conv_id") % 25).alias("paper_id"), F.col("turn").alias("page"), "text")
    return S.clip_chunks(chunks, clips, d.select(F.col("source").alias("paper_id")).distinct()).withColumn("text", F.md5("text"))
