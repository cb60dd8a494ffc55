"""Incremental ingest and event streams with Structured Streaming (STM)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholiast.operators.graph import path_exists


def ingest_available(source: DataFrame, process: Callable[[DataFrame], DataFrame], target: str, checkpoint: str) -> None:
    """One run over what has arrived since the last one (STM-01, STM-02): the checkpoint replaces the difference of file lists, and a batch that is run again overwrites its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        process(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def arriving(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of `folder`, one file or a folder of files, as a stream of files."""
    path = f"{folder}/{name}.parquet"
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    many = there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(there).isDirectory()
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    return reader.parquet(path) if many else reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def event_stream(spark: SparkSession, folder: str, late: str = "1 day") -> DataFrame:
    """Events as a stream with event time `at`; the stored time has no zone and becomes a UTC instant."""
    return arriving(spark, folder, "events").withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)


def first_of_each(events: DataFrame, keys: list[str]) -> DataFrame:
    """Each key once within the watermark (STM-07, an extension)."""
    return events.dropDuplicatesWithinWatermark(keys)


def _known(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The table at `path`, or none of `like` where there is no table yet."""
    return spark.read.schema(like.schema).parquet(path) if path_exists(spark, path) else like.limit(0)


def refresh(spark: SparkSession, folder: str, run: int, offered: DataFrame, embed, most: int = 500) -> None:  # noqa: ANN001
    """One scheduled run over a corpus (STM-03): of the articles offered (journal_id, doi, key, abstract, published) the newest of each journal whose DOI is unknown are added with the number of the run, then those without a vector embedded.

    A run that is repeated finds nothing new; a run after an empty one fills the corpus.
    """
    from scholiast.functions.models import embedded
    from scholiast.operators.recommend import recent

    newest = recent(offered, "journal_id", "published", "key", most)
    known = _known(spark, f"{folder}/articles", offered.withColumn("run", F.lit(run)))
    newest.join(known.select("doi"), "doi", "left_anti").select(*offered.columns).withColumn("run", F.lit(run)).write.mode("append").parquet(f"{folder}/articles")
    articles = spark.read.parquet(f"{folder}/articles").select("journal_id", "doi", "abstract")
    vectors = _known(spark, f"{folder}/vectors", embedded(articles, "abstract", embed).drop("abstract"))
    missing = articles.join(vectors.select("doi"), "doi", "left_anti")
    embedded(missing, "abstract", embed).drop("abstract").write.mode("append").parquet(f"{folder}/vectors")


def phases(spark: SparkSession, folder: str, run: int, files: DataFrame, again: DataFrame, model) -> dict[str, DataFrame]:  # noqa: ANN001
    """What each phase of one batch run has done (STM-09): files (paper_id, text) that are unknown are parsed, unknown papers indexed, garbled ones replaced by a second reading, papers without a summary summarised. Each phase appends to a table of its own, so a run can be repeated after a failure."""
    from scholiast.functions import text as T
    from scholiast.functions.models import summarised

    def added(name: str, rows: DataFrame) -> DataFrame:
        path = f"{folder}/{name}"
        known = _known(spark, path, rows.withColumn("run", F.lit(run)))
        rows.join(known.select("paper_id"), "paper_id", "left_anti").withColumn("run", F.lit(run)).write.mode("append").parquet(path)
        return spark.read.parquet(path).filter(F.col("run") == run)

    def table(name: str) -> DataFrame:
        return spark.read.parquet(f"{folder}/{name}").drop("run")

    done = {"parse": added("parsed", files)}
    done["index"] = added("indexed", table("parsed"))
    bad = table("indexed").filter(T.is_garbled("text")).select("paper_id")
    done["repair"] = added("repaired", again.join(bad, "paper_id", "left_semi"))
    whole = table("indexed").join(table("repaired").select("paper_id"), "paper_id", "left_anti").unionByName(table("repaired"))
    said = summarised(whole.withColumn("summary", F.lit("")), "text", "summary", model).filter("state = 'done'").select("paper_id", "summary")
    done["summaries"] = added("summaries", said)
    return done
