"""The corpus pipeline: each stage is written as Parquet and read again as the next one's documents.

Stages take and, but for the last, return the columns of `documents`; further columns pass through whatever their names are. Empty tables give
empty ones, texts are handled whole however long they are, and repeated rows are decided alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholiast.llm.decontaminate import drop_contaminated
from scholiast.llm.line_dedup import drop_repeated_lines
from scholiast.llm.mixing import mixed
from scholiast.llm.near_dedup import drop_near_duplicates
from scholiast.llm.quality import keep_good
from scholiast.llm.store import drop, store


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go: those whose own text scores under 0.5. Null and empty texts are scored as empty ones; without labels of both classes the share of label 1 decides for all."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier one go, and documents of which nothing is left; n_chars follows the text. Documents without any line of words stay; a null doc_id keeps its lines; of equal lines the earliest by doc_id and place stays."""
    return drop_repeated_lines(docs).withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: sets of five-word shingles of similarity 0.8 or more, where op1 asks for 0.85. The smallest doc_id of a group stays, rows of one doc_id together; documents without words and with a null doc_id stay."""
    return drop_near_duplicates(docs, numerator=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold half of the words of a benchmark item, in runs of four words or more, go. Null and empty texts hold nothing; a null doc_id stays."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with their number of `copies`, 1 or 2. Documents without words are never taken; sources weigh 3, 1, 2 in turn, null last; equal rows get equal copies."""
    return mixed(docs)


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mixing", mix)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over `documents`."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs, path = store(stage(spark, docs, sf_dir), name)
        if before:
            drop(spark, before)  # the stage that read it is written
        before = path
    return docs
