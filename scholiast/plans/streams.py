"""Streaming queries: each runs all available events through a stream to a table in a temporary shared folder and returns that."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholiast.operators.graph import shared_folder
from scholiast.plans.registry import query, table
from scholiast.streaming import ingest as I
from scholiast.streaming import sessions as S
from scholiast.streaming import windows as W


def _run(stream: DataFrame, folder: str) -> DataFrame:
    """All that a stream without open windows appends."""
    spark = stream.sparkSession
    target = f"{folder}/out"
    stream.writeStream.outputMode("append").format("parquet").option("path", target).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(target)


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


DELAY = "4 days"
#: Events arrive in up to four parts: those of ten days together, every tenth one part too late. A mark is the watermark before a part; the last one is that at the end.
_ARRIVALS = """ev AS (SELECT *, (day(ts) - 1) // 10 + (event_id % 10 = 0)::INT AS arrival FROM events), mark AS (SELECT k AS arrival, (SELECT date_trunc('milliseconds', max(ts)) FROM ev WHERE arrival < k) - INTERVAL 4 DAY AS w FROM range(5) r(k))"""
_WINDOWS = """kept AS (SELECT {columns}, start FROM {rows} JOIN mark USING (arrival) WHERE w IS NULL OR start + INTERVAL 1 DAY > w), closed AS (SELECT * FROM kept WHERE start + INTERVAL 1 DAY <= (SELECT w FROM mark WHERE arrival = 4))"""


def _arrivals(spark: SparkSession, sf_dir: str, folder: str) -> Iterator[DataFrame]:
    """The stream of events with watermark, once for each part that has arrived; part by part lands in a folder of files."""
    events = table(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))
    arrival = F.expr("(day(ts) - 1) div 10 + IF(event_id % 10 = 0, 1, 0)")
    for part in range(4):
        events.filter(arrival == part).write.mode("append").parquet(f"{folder}/in")
        yield spark.readStream.schema(events.schema).parquet(f"{folder}/in").withWatermark("at", DELAY)


def _windowed(spark: SparkSession, sf_dir: str, of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """All closed windows after four runs of one stream, each over what had arrived by then."""
    folder = _folder(spark)
    for stream in _arrivals(spark, sf_dir, folder):
        W.append(of(stream), f"{folder}/out", f"{folder}/checkpoint")
    return spark.read.parquet(f"{folder}/out")


@query(f"WITH {_ARRIVALS}, b AS (SELECT *, time_bucket(INTERVAL 1 DAY, ts) AS start FROM ev), {_WINDOWS.format(columns='event_type, value', rows='b')} SELECT start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM closed GROUP BY ALL")
def tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM-07 (extension): days in append mode over four arrivals; rows of closed days are dropped, open days not given yet"""
    return _windowed(spark, sf_dir, lambda e: W.tumbling(e, "1 day")).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(f"""WITH {_ARRIVALS}, b AS (SELECT event_type, arrival, unnest(range(time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 18 HOUR, time_bucket(INTERVAL 6 HOUR, ts) + INTERVAL 1 HOUR, INTERVAL 6 HOUR)) AS start FROM ev), {_WINDOWS.format(columns='event_type', rows='b')}
SELECT start, event_type, count(*) AS n FROM closed GROUP BY ALL""")
def sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM-07 (extension): days that begin every six hours; a late row still counts in those of its windows that are open"""
    return _windowed(spark, sf_dir, lambda e: W.sliding(e, "1 day", "6 hours")).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(f"WITH {_ARRIVALS} SELECT event_id, user_id, event_type, value, ts FROM ev JOIN mark USING (arrival) WHERE time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY <= w")
def late_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM-07 (extension): the rows that the days of `tumbling` drop, kept apart"""
    folder = _folder(spark)
    for stream in _arrivals(spark, sf_dir, folder):
        W.late_rows(stream, DELAY, F.window("at", "1 day")["end"], f"{folder}/late", f"{folder}/checkpoint")
    return W.read_late(spark, f"{folder}/late").select("event_id", "user_id", "event_type", "value", "ts")


def _sessions_sql() -> str:
    """Sessions arrival by arrival: rows that aren't late join the open ones, and what the next watermark has passed is closed."""
    steps = []
    for k in range(4):
        new = f"SELECT user_id, ts FROM ev JOIN mark m USING (arrival) WHERE arrival = {k} AND (w IS NULL OR ts + INTERVAL 12 HOUR > w)"
        pool = new if not k else f"{new} UNION ALL SELECT user_id, ts FROM s{k - 1}, mark WHERE arrival = {k} AND last + INTERVAL 12 HOUR > w"
        steps.append(f"""g{k} AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS fresh FROM ({pool})),
n{k} AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g{k}), s{k} AS (SELECT user_id, ts, k, max(ts) OVER (PARTITION BY user_id, k) AS last FROM n{k})""")
    closed = " UNION ALL ".join(f"SELECT user_id, min(ts) AS start, last + INTERVAL 12 HOUR AS \"end\", count(*) AS n FROM s{k}, mark WHERE arrival = {k + 1} AND last + INTERVAL 12 HOUR <= w GROUP BY user_id, k, last" for k in range(4))
    return f"WITH {_ARRIVALS}, {', '.join(steps)} {closed}"


@query(_sessions_sql())
def session_win(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM-07 (extension): runs of a user's events in append mode; a session that is closed takes nothing more"""
    return _windowed(spark, sf_dir, lambda e: W.sessions(e, "12 hours")).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@query("SELECT DISTINCT user_id, event_type, value FROM events")
def dedup_wm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM-07 (extension)"""
    stream = I.event_stream(spark, sf_dir, "60 days").select("user_id", "event_type", "value", "at")
    return _run(I.first_of_each(stream, ["user_id", "event_type", "value"]).drop("at"), _folder(spark))


@query("SELECT source, count(*) AS n, sum(length(text)) AS size FROM documents GROUP BY source")
def ingest_available_now(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM-01, STM-02: documents arrive as files, every run takes what is new"""
    folder = _folder(spark)
    for _ in range(2):
        I.ingest_available(I.arriving(spark, sf_dir, "documents"), lambda b: b.select("doc_id", "source", F.char_length("text").alias("size")), f"{folder}/out", f"{folder}/checkpoint")
    return spark.read.parquet(f"{folder}/out").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))


@query("""WITH r1 AS (SELECT source, doc_id FROM documents WHERE doc_id % 2 = 0 QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) <= 500), r2 AS (SELECT source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) <= 500),
k AS (SELECT 1 AS run, * FROM r1 UNION ALL SELECT 2, * FROM r2 WHERE doc_id NOT IN (SELECT doc_id FROM r1)) SELECT source AS journal_id, count(*) FILTER (run = 1) AS first_run, count(*) FILTER (run = 2) AS second_run, count(*) AS vectors FROM k GROUP BY source""")
def corpus_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM-03: every run fetches the newest 500 articles of each journal, adds those whose DOI is unknown and embeds what has no vector"""
    from scholiast.functions.models import hashed_embedder

    folder = _folder(spark)
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("source").alias("journal_id"), F.col("doc_id").cast("string").alias("doi"), F.col("doc_id").alias("key"), F.col("text").alias("abstract"), F.col("n_chars").alias("published"))
    for run, offered in enumerate((d.filter("key % 2 = 0"), d), 1):
        I.refresh(spark, folder, run, offered, hashed_embedder(), most=500)
    runs = spark.read.parquet(f"{folder}/articles")
    vectors = spark.read.parquet(f"{folder}/vectors").groupBy("journal_id").agg(F.count(F.lit(1)).alias("vectors"))
    return runs.groupBy("journal_id").agg(F.count_if(F.col("run") == 1).alias("first_run"), F.count_if(F.col("run") == 2).alias("second_run")).join(vectors, "journal_id")


_BROKEN = "CASE doc_id % 5 WHEN 0 THEN replace(replace(text, 'e', '❈'), 'a', '▲') WHEN 1 THEN replace(text, ' ', ' /a114 ') ELSE text END"


def _phases_oracle() -> str:
    from scholiast.plans.papers import garble_sql

    bad = f"length(left(t, 40000)) >= 80 AND {garble_sql('left(t, 40000)')} >= 0.25"
    return f"""WITH d AS (SELECT doc_id, text, {_BROKEN} AS t FROM documents), g AS (SELECT doc_id, {bad} AS bad, CASE WHEN {bad} THEN text ELSE t END AS final FROM d),
n AS (SELECT count(*) AS parsed, count(*) FILTER (bad) AS repaired, count(*) FILTER (length(final) >= 200) AS summarised FROM g) SELECT 1 AS run, 'parse' AS phase, parsed AS rows FROM n UNION ALL SELECT 1, 'index', parsed FROM n UNION ALL SELECT 1, 'repair', repaired FROM n UNION ALL SELECT 1, 'summaries', summarised FROM n UNION ALL SELECT 2, p, 0 FROM (VALUES ('parse'), ('index'), ('repair'), ('summaries')) v(p)"""


@query(_phases_oracle())
def batch_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM-09: parse, index, repair and summaries, each for what is new only; a second run does nothing"""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    first = d.select(F.col("doc_id").cast("string").alias("paper_id"), F.expr(_BROKEN).alias("text"))
    again = d.select(F.col("doc_id").cast("string").alias("paper_id"), "text")
    folder, out = _folder(spark), None
    for run in (1, 2):
        for phase, rows in I.phases(spark, folder, run, first, again, lambda texts: [t[:60] for t in texts]).items():
            part = rows.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(run).alias("run"), F.lit(phase).alias("phase"), "rows")
            out = part if out is None else out.unionByName(part)
    return out


@query(r"""WITH p AS (SELECT conv_id, turn * 3 + i AS n, CASE i WHEN 0 THEN CASE WHEN turn % 3 = 1 THEN '<th' ELSE '' END WHEN 1 THEN CASE WHEN turn % 3 = 1 THEN 'ink>' ELSE '' END || text WHEN 2 THEN CASE WHEN turn % 3 = 1 THEN '</think> ' ELSE ' ' END END AS token FROM conversations, range(3) r(i))
SELECT conv_id, regexp_replace(string_agg(token, '' ORDER BY n), '(?s)<think>.*?(</think>|$)', '', 'g') AS text FROM p GROUP BY conv_id""")
def token_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM-04: thought spans go while tokens stream in, tags that are split over tokens or over micro-batches too; state ends with the session"""
    hidden = F.col("turn") % 3 == 1
    parts = F.array(F.when(hidden, "<th").otherwise(""), F.concat(F.when(hidden, "ink>").otherwise(""), "text"), F.when(hidden, "</think> ").otherwise(" "))
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(parts).alias("i", "token")).select(F.col("conv_id").alias("session"), (F.col("turn") * 3 + F.col("i")).alias("n"), "token")
    ends = said.groupBy("session").agg(F.max("n").alias("end"))
    tokens = said.join(ends, "session").select("session", "n", "token", (F.col("n") == F.col("end")).alias("last"), F.timestamp_seconds("n").alias("at"))
    folder, provider = _folder(spark), "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, S.ROCKS_DB)
    try:
        for part in range(4):
            tokens.filter(F.least(F.expr("n div 5"), F.lit(3)) == part).write.mode("append").parquet(f"{folder}/in")
            stream = S.without_thoughts(spark.readStream.schema(tokens.schema).parquet(f"{folder}/in").withWatermark("at", "1 hour"))
            W.append(stream, f"{folder}/out", f"{folder}/checkpoint")
    finally:
        spark.conf.set(provider, before)
    shown = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "ended", "text"))), lambda x: x["text"]), "")
    return spark.read.parquet(f"{folder}/out").groupBy(F.col("session").alias("conv_id")).agg(shown.alias("text"))
