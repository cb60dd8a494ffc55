"""Joins, aggregations, windows, sorts and set operations over the star schema.

Orders stand for submissions, lineitem for entity-chunk links (part, order, supplier), events for
transitions, conversations for sections and turns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scholiast.plans.registry import query, table

AS_OF = "1998-08-02"


def _t(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [table(spark, sf_dir, n) for n in names]


@query("SELECT o_orderkey, c_name, n_name, o_orderstatus, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus <> 'F'")
def active_submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOI-01"""
    o, c, n = _t(spark, sf_dir, "orders", "customer", "nation")
    return o.filter("o_orderstatus <> 'F'").join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).select("o_orderkey", "c_name", "n_name", "o_orderstatus", "o_totalprice")


@query("SELECT doc_id, source, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)")
def paper_detail_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOI-02"""
    d, q = _t(spark, sf_dir, "documents", "labels")
    return d.join(q, "doc_id", "left").select("doc_id", "source", "quality", "toxic")


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity >= 49)")
def semi_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOI-03"""
    s, x = _t(spark, sf_dir, "supplier", "lineitem")
    return s.join(x.filter("l_quantity >= 49"), s.s_suppkey == x.l_suppkey, "left_semi").select("s_suppkey", "s_name")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def orphans_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOI-04, SET-02"""
    c, o = _t(spark, sf_dir, "customer", "orders")
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti").select("c_custkey")


@query("SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n_orders, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O') AS n_open FROM customer")
def scalar_subq_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOI-05: counted once per key, then joined"""
    c, o = _t(spark, sf_dir, "customer", "orders")
    counts = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderstatus") == "O").alias("m"))
    return c.join(counts, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"), F.coalesce("m", F.lit(0)).alias("n_open"))


@query("SELECT doc_id, lang, quality FROM documents JOIN labels USING (doc_id)")
def using_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOI-12"""
    d, q = _t(spark, sf_dir, "documents", "labels")
    return d.join(q, "doc_id").select("doc_id", "lang", "quality")


@query("SELECT l_orderkey, l_linenumber, s_name, n_name FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN nation ON s_nationkey = n_nationkey WHERE l_quantity > 45")
def dimension_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOI-06: the small dimension is broadcast when its statistics say so"""
    x, s, n = _t(spark, sf_dir, "lineitem", "supplier", "nation")
    named = s.join(n, s.s_nationkey == n.n_nationkey, "left")
    return x.filter("l_quantity > 45").join(named, x.l_suppkey == named.s_suppkey, "left").select("l_orderkey", "l_linenumber", "s_name", "n_name")


@query("SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM embeddings) AS vectors, (SELECT count(*) FROM pages) AS pages, (SELECT count(DISTINCT conv_id) FROM conversations) AS sessions, (SELECT count(DISTINCT source) FROM documents) AS sources")
def global_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-01, AGG-02"""
    d, e, p, c = _t(spark, sf_dir, "documents", "embeddings", "pages", "conversations")
    one = lambda df, x, name: df.agg(x.alias(name))
    n = F.count(F.lit(1))
    return one(d, n, "documents").crossJoin(one(e, n, "vectors")).crossJoin(one(p, n, "pages")).crossJoin(one(c, F.count_distinct("conv_id"), "sessions")).crossJoin(one(d, F.count_distinct("source"), "sources"))


@query("SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey ORDER BY n DESC, l_orderkey LIMIT 30")
def entity_chunks_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-03, GRF-05"""
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "l_orderkey").limit(30)


@query("SELECT md5(text) AS hash, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY ALL HAVING count(*) > 1")
def having_dupes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-04"""
    return table(spark, sf_dir, "documents").groupBy(F.md5("text").alias("hash")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first")).filter("n > 1")


@query("SELECT source, count(*) AS total, count(label) AS embedded, sum(CASE WHEN lang = 'en' THEN 1 ELSE 0 END) AS english, round(count(label) * 100.0 / count(*), 6) AS coverage FROM documents LEFT JOIN embeddings ON doc_id = vec_id GROUP BY source")
def coverage_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-05"""
    d, e = _t(spark, sf_dir, "documents", "embeddings")
    met = d.select("doc_id", "source", "lang").join(e.select(F.col("vec_id").alias("doc_id"), "label"), "doc_id", "left")
    return met.groupBy("source").agg(F.count(F.lit(1)).alias("total"), F.count("label").alias("embedded"), F.count_if(F.col("lang") == "en").alias("english")).withColumn("coverage", F.round(F.col("embedded") * 100 / F.col("total"), 6))


@query("SELECT o_custkey, min(o_orderdate) AS oldest, max(o_orderdate) AS newest FROM orders GROUP BY o_custkey")
def minmax_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-06"""
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("oldest"), F.max("o_orderdate").alias("newest"))


@query(r"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM documents), t AS (SELECT doc_id, unnest(w) AS topic, generate_subscripts(w, 1) AS i FROM w)
SELECT topic, count(*) AS n FROM t GROUP BY topic ORDER BY n DESC, min(doc_id * 100000 + i) LIMIT 10""")
def top_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-07: ties by first appearance"""
    words = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))).alias("i", "topic"))
    return words.groupBy("topic").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "i")).alias("first")).orderBy(F.desc("n"), "first").limit(10).select("topic", "n")


@query("""SELECT l_partkey, max(l_quantity) AS weight, array_to_string(list_sort(list(DISTINCT l_returnflag || l_linestatus))[1:3], ',') AS relations FROM lineitem WHERE l_partkey <> l_suppkey GROUP BY l_partkey""")
def concat_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-08"""
    kinds = F.slice(F.array_sort(F.collect_set(F.concat("l_returnflag", "l_linestatus"))), 1, 3)
    return table(spark, sf_dir, "lineitem").filter("l_partkey <> l_suppkey").groupBy("l_partkey").agg(F.max("l_quantity").alias("weight"), F.array_join(kinds, ",").alias("relations"))


@query("SELECT conv_id, role, arg_min(text, turn) AS opening, min(turn) AS first_turn, max(turn) AS last_turn FROM conversations GROUP BY conv_id, role")
def min_by_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-09, AGG-18"""
    return table(spark, sf_dir, "conversations").groupBy("conv_id", "role").agg(F.min_by("text", "turn").alias("opening"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"))


@query("SELECT label, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS deviation, round(CASE WHEN count(*) > 1 THEN -0.5 * stddev_pop(x) ELSE 0 END, 6) AS penalty FROM (SELECT label, embedding[1]::DOUBLE AS x FROM embeddings) GROUP BY label")
def mean_and_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-10"""
    x = F.col("embedding")[0].cast("double")
    grouped = table(spark, sf_dir, "embeddings").groupBy("label").agg(F.avg(x).alias("m"), F.stddev_pop(x).alias("s"), F.count(F.lit(1)).alias("n"))
    return grouped.select("label", F.round("m", 6).alias("mean"), F.round("s", 6).alias("deviation"), F.round(F.when(F.col("n") > 1, -0.5 * F.col("s")).otherwise(0.0), 6).alias("penalty"))


@query("""WITH r AS (SELECT source, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS n, max(n_chars) OVER (PARTITION BY source) AS top FROM documents)
SELECT source, round(avg(n_chars) / max(top), 6) AS flatness FROM r WHERE n <= 25 GROUP BY source""")
def top_mean_over_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-11"""
    d = table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    best = d.withColumn("n", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id"))).filter("n <= 25")
    return best.groupBy("source").agg(F.round(F.avg("n_chars") / F.nullif(F.max("n_chars"), F.lit(0)), 6).alias("flatness"))


@query("""WITH d AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events), e AS (SELECT user_id, floor((epoch_us(ts) - epoch_us(before)) / 86400000000.0)::INT AS days FROM d WHERE before IS NOT NULL),
r AS (SELECT user_id, days, row_number() OVER (PARTITION BY user_id ORDER BY days) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM e) SELECT user_id, days AS median FROM r WHERE k = n // 2 + 1""")
def upper_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-12, WIN-09: the upper of the middle elements of the whole days between events"""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    days = table(spark, sf_dir, "events").select("user_id", F.floor((micros - F.lag(micros).over(order)) / 86400e6).cast("int").alias("days")).filter("days >= 0")
    ordered = F.sort_array(F.collect_list("days"))
    return days.groupBy("user_id").agg(F.element_at(ordered, (F.floor(F.count(F.lit(1)) / 2) + 1).cast("int")).alias("median"))


@query("SELECT c_custkey, count(o_orderkey) AS prior, count(*) FILTER (o_orderstatus = 'F') AS accepted, count(*) FILTER (o_orderpriority LIKE '%URGENT%') AS rejected FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def history_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-13"""
    c, o = _t(spark, sf_dir, "customer", "orders")
    met = c.select("c_custkey").join(o, c.c_custkey == o.o_custkey, "left")
    return met.groupBy("c_custkey").agg(F.count("o_orderkey").alias("prior"), F.count_if(F.col("o_orderstatus") == "F").alias("accepted"), F.count_if(F.col("o_orderpriority").contains("URGENT")).alias("rejected"))


@query("SELECT source, round(coalesce(avg(quality), 0), 6) AS mean, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source")
def mean_non_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-14"""
    d, q = _t(spark, sf_dir, "documents", "labels")
    return d.join(q, "doc_id", "left").groupBy("source").agg(F.round(F.coalesce(F.avg("quality"), F.lit(0.0)), 6).alias("mean"), F.count(F.lit(1)).alias("n"))


@query("WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) SELECT user_id, string_agg(event_type || '=' || n, ';' ORDER BY event_type) AS types FROM c GROUP BY user_id")
def type_counts_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-15"""
    c = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    entries = F.array_sort(F.collect_list(F.struct("event_type", "n")))
    return c.groupBy("user_id").agg(F.array_join(F.transform(entries, lambda x: F.concat(x["event_type"], F.lit("="), x["n"].cast("string"))), ";").alias("types"))


@query("SELECT r_name, count(c_custkey) AS n FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal > 0 GROUP BY r_name")
def folder_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-16"""
    r, n, c = _t(spark, sf_dir, "region", "nation", "customer")
    members = c.filter("c_acctbal > 0").join(n, c.c_nationkey == n.n_nationkey).select("n_regionkey", "c_custkey")
    return r.join(members, r.r_regionkey == members.n_regionkey, "left").groupBy("r_name").agg(F.count("c_custkey").alias("n"))


@query("SELECT conv_id, count(*) AS n_turns, string_agg(turn || ':' || role, '|' ORDER BY turn) AS turns FROM conversations GROUP BY conv_id")
def nested_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-17"""
    ordered = F.sort_array(F.collect_list(F.struct("turn", "role")))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"), F.array_join(F.transform(ordered, lambda x: F.concat(x["turn"].cast("string"), F.lit(":"), x["role"])), "|").alias("turns"))


@query("SELECT (SELECT count(*) FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents)) AS vectors_without_text, (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)) AS texts_without_vector, (SELECT count(*) FROM documents WHERE length(text) < 20) AS short_texts, (SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)) AS dangling_labels")
def integrity_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-21"""
    d, e, q = _t(spark, sf_dir, "documents", "embeddings", "labels")
    ids, vectors = d.select("doc_id"), e.select(F.col("vec_id").alias("doc_id"))
    n = F.count(F.lit(1))
    parts = [vectors.join(ids, "doc_id", "left_anti").agg(n.alias("vectors_without_text")), ids.join(vectors, "doc_id", "left_anti").agg(n.alias("texts_without_vector")), d.filter(F.char_length("text") < 20).agg(n.alias("short_texts")), q.join(ids, "doc_id", "left_anti").agg(n.alias("dangling_labels"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)
    return out


@query("SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM conversations")
def rank_in_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-01"""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).alias("place"))


@query("WITH f AS (SELECT o_custkey, o_clerk, min(o_orderkey) AS first FROM (SELECT o_custkey, o_orderpriority AS o_clerk, o_orderkey FROM orders) GROUP BY ALL) SELECT o_custkey, o_clerk AS source, row_number() OVER (PARTITION BY o_custkey ORDER BY first) AS number FROM f")
def first_appearance_no(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-03, WIN-04"""
    first = table(spark, sf_dir, "orders").groupBy("o_custkey", F.col("o_orderpriority").alias("source")).agg(F.min("o_orderkey").alias("first"))
    return first.select("o_custkey", "source", F.row_number().over(Window.partitionBy("o_custkey").orderBy("first")).alias("number"))


@query("WITH m AS (SELECT conv_id, max(turn) AS last FROM conversations GROUP BY conv_id), n AS (SELECT conv_id, coalesce(last, -1) + 1 AS next FROM m) SELECT conv_id, next FROM n")
def next_seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-05"""
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg((F.coalesce(F.max("turn"), F.lit(-1)) + 1).alias("next"))


@query("WITH s AS (SELECT conv_id, turn, length(text) AS n, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) - length(text) AS before FROM conversations) SELECT conv_id, turn, least(n, 1000 - before) AS used FROM s WHERE before < 1000")
def running_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-06"""
    n = F.char_length("text")
    before = F.sum(n).over(Window.partitionBy("conv_id").orderBy("turn")) - n
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", n.alias("n"), before.alias("before")).filter("before < 1000").select("conv_id", "turn", F.least("n", 1000 - F.col("before")).alias("used"))


@query("SELECT user_id, arg_max(event_type, epoch_us(ts)::HUGEINT * 1000000 + event_id) AS last_type, max(ts) AS last_at FROM events GROUP BY user_id")
def latest_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-07"""
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last_type"), F.max("ts").alias("last_at"))


@query("SELECT event_id, user_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS from_state, event_type AS to_state FROM events")
def state_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-08"""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select("event_id", "user_id", F.lag("event_type").over(order).alias("from_state"), F.col("event_type").alias("to_state"))


@query(f"SELECT o_orderkey, floor((epoch_us(TIMESTAMP '{AS_OF} 12:00:00') - epoch_us(o_orderdate)) / 86400000000.0)::INT AS days FROM orders")
def days_elapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-09, DAT-01: whole periods of 24 hours up to a given moment"""
    gap = F.unix_micros(F.lit(f"{AS_OF} 12:00:00").cast("timestamp")) - F.unix_micros(F.col("o_orderdate").cast("timestamp"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.floor(gap / 86400e6).cast("int").alias("days"))


@query("SELECT source, lang, doc_id FROM (SELECT source, lang, doc_id, row_number() OVER (PARTITION BY source, lang ORDER BY n_chars DESC, doc_id) AS n FROM documents) WHERE n = 1")
def keep_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-10"""
    return table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.min_by("doc_id", F.struct(-F.col("n_chars"), "doc_id")).alias("doc_id"))


@query("SELECT c_custkey, c_name, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal END AS balance FROM customer ORDER BY (CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal END) IS NULL, balance DESC, c_name LIMIT 200")
def null_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRT-01, SRT-06"""
    balance = F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal"))
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name", balance.alias("balance")).orderBy(F.col("balance").isNull(), F.desc("balance"), "c_name").limit(200)


@query("SELECT p_partkey, p_name FROM part ORDER BY lower(p_name), p_partkey LIMIT 30 OFFSET 30")
def paging(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRT-02, SRT-04, FLT-08: the second page of thirty"""
    return table(spark, sf_dir, "part").select("p_partkey", "p_name").orderBy(F.lower("p_name"), "p_partkey").offset(30).limit(30)


@query("SELECT doc_id, md5(doc_id::VARCHAR) AS draw FROM documents ORDER BY draw, doc_id LIMIT 12")
def hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRT-05: a sample that is the same in every run"""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(F.col("doc_id").cast("string")).alias("draw")).orderBy("draw", "doc_id").limit(12)


@query("SELECT DISTINCT l_partkey, l_suppkey FROM lineitem")
def distinct_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET-04, GRF-03"""
    return table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct()


@query("SELECT 'order' AS kind, o_orderkey AS id, o_orderstatus AS status, o_totalprice AS amount, NULL::VARCHAR AS name FROM orders UNION ALL SELECT 'customer', c_custkey, NULL, c_acctbal, c_name FROM customer")
def heterogeneous_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET-05, DML-07"""
    o, c = _t(spark, sf_dir, "orders", "customer")
    left = o.select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("amount"))
    right = c.select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("amount"), F.col("c_name").alias("name"))
    return left.unionByName(right, allowMissingColumns=True)


@query("SELECT event_id, (props->>'$.k')::INT AS k, coalesce((props->>'$.missing')::INT, 0) AS missing FROM events")
def json_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSN-01, ARR-03"""
    p = F.from_json("props", "k int, missing int")
    return table(spark, sf_dir, "events").select("event_id", p["k"].alias("k"), F.coalesce(p["missing"], F.lit(0)).alias("missing"))


@query("SELECT doc_id, round(0.5 * quality + 0.25 * toxic + 0.25 * (doc_id % 7) / 7.0, 4) AS score, CASE quality WHEN 1 THEN 'good' ELSE 'poor' END AS verdict FROM labels")
def weighted_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MTH-02, MAP-01"""
    names = F.create_map(F.lit(1), F.lit("good"))
    score = 0.5 * F.col("quality") + 0.25 * F.col("toxic") + 0.25 * (F.col("doc_id") % 7) / F.lit(7.0)
    return table(spark, sf_dir, "labels").select("doc_id", F.round(score, 4).alias("score"), F.coalesce(F.element_at(names, F.col("quality")), F.lit("poor")).alias("verdict"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-01') AS month, strftime(o_orderdate - INTERVAL 60 DAY, '%Y-%m-%d') AS cut_off FROM orders WHERE o_orderdate >= DATE '1995-01-01'")
def partial_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DAT-02, DAT-03"""
    d = F.to_date("o_orderdate")
    month = F.format_string("%04d-%02d-%02d", F.year(d), F.month(d), F.lit(1))
    return table(spark, sf_dir, "orders").filter("o_orderdate >= '1995-01-01'").select("o_orderkey", month.alias("month"), F.date_format(F.date_sub(d, 60), "yyyy-MM-dd").alias("cut_off"))
