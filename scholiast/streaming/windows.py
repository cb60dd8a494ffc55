"""Event time in append mode: windows leave the state when the watermark has passed them, late rows go to a table of their own (STM-07, an extension)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scholiast.operators.graph import path_exists


def tumbling(events: DataFrame, width: str) -> DataFrame:
    """(start, event_type, n, total): closed windows of fixed width."""
    counted = events.groupBy(F.window("at", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return counted.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str, step: str) -> DataFrame:
    """(start, event_type, n): closed windows that begin every `step`."""
    counted = events.groupBy(F.window("at", width, step).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str) -> DataFrame:
    """(user_id, start, end, n): closed runs of a user's events with no gap of `gap` or more."""
    counted = events.groupBy(F.session_window("at", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return counted.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def append(stream: DataFrame, target: str, checkpoint: str, trigger: dict | None = None) -> None:
    """One run over what has arrived: closed windows are appended to `target`, open ones stay in the checkpoint's state."""
    stream.writeStream.outputMode("append").format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start().awaitTermination()


def late_rows(events: DataFrame, delay: str, closes: Column, target: str, checkpoint: str) -> None:
    """One run that appends to `target` the rows of `events` (with time `at`) that come when the watermark has passed `closes`, the end of their last window.

    The watermark of a micro-batch is the latest `at` of those before it less `delay`, as Spark's own. Each micro-batch leaves its latest time in a
    folder of its own, so one that is run again finds the same ones before it and overwrites what it wrote.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        marks = f"{target}-marks"
        before = spark.read.parquet(marks).filter(F.col("batch") < number).agg(F.max("at").alias("latest")) if path_exists(spark, marks) else spark.createDataFrame([(None,)], "latest timestamp")
        mark = before.select((F.date_trunc("millisecond", "latest") - F.expr(f"interval {delay}")).alias("mark")).first()["mark"]
        batch.filter(closes <= F.lit(mark).cast("timestamp")).write.mode("overwrite").parquet(f"{target}/batch={number}")
        batch.agg(F.max("at").alias("at")).write.mode("overwrite").parquet(f"{marks}/batch={number}")

    events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def read_late(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.parquet(target).drop("batch")
