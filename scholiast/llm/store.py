"""Intermediate tables in the folder that all executors share, and bounded samples."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholiast.operators.graph import shared_folder

_written: ContextVar[set[str] | None] = ContextVar("written", default=None)


def store(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Writes `df` as Parquet in the shared folder and reads it back: lineage ends there, and a lost executor costs only its own tasks."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if (own := _written.get()) is not None:
        own.add(path)
    return spark.read.schema(df.schema).parquet(path), path


def stored(df: DataFrame, name: str) -> DataFrame:
    return store(df, name)[0]


def stored_alone(df: DataFrame, name: str) -> DataFrame:
    """`stored`, after which Spark deletes the shuffle files of the write, which nothing else reads."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    old = conf.get(key, None)
    conf.set(key, "true")
    try:
        return stored(df, name)
    finally:
        conf.unset(key) if old is None else conf.set(key, old)


def drop(spark: SparkSession, path: str) -> None:
    """Deletes a stored table that nothing reads any more."""
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jvm_path, True)


def tidy(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The operator, after which the tables that it stored and its result doesn't read are deleted."""

    @functools.wraps(operator)
    def run(*args: object, **named: object) -> DataFrame:
        token = _written.set(set())
        try:
            out = operator(*args, **named)
        finally:
            own = _written.get()
            _written.reset(token)
        read = {file.rsplit("/", 2)[-2] for file in out.inputFiles()}
        kept = {path for path in own if path.rsplit("/", 1)[1] in read}
        for path in own - kept:
            drop(out.sparkSession, path)
        if (outer := _written.get()) is not None:
            outer |= kept
        return out

    return run


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores in front as make it a new column's."""
    out = []
    for name in names:
        while name.lower() in {c.lower() for c in df.columns}:
            name = f"_{name}"
        out.append(name)
    return out


def broadcast_if_small(df: DataFrame, rows: int = 50_000) -> DataFrame:
    """A stored table of narrow rows, marked for a broadcast join if it has at most `rows` of them; else left to a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def hashed_sample(rows: DataFrame, key: list[str], most: int) -> pa.Table:
    """`most` rows, or all if there are fewer: those whose hashed `key` is smallest, in that order; ties in order of the key.

    Rows whose hash is above a threshold are left out first, so all tasks together send about four times
    `most` rows, whatever the size of the table. Where repeated keys leave too few, the threshold is raised.
    """
    cells = 1 << 30
    place = F.pmod(F.xxhash64(*key), F.lit(cells))
    share = 4 * most / max(1, rows.count())
    while True:
        near = rows.withColumn("_place", place)
        near = near.filter(F.col("_place") < int(share * cells)) if share < 1 else near
        found = near.orderBy("_place", *key).limit(most).drop("_place").toArrow()
        if share >= 1 or len(found) == most:
            return found.combine_chunks()
        share *= 8
