"""Submission tracking and planning: validated transitions, stalled submissions, plan items, memberships (DML, FLT-18)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F



def accepted_moves(moves: DataFrame, key: str, state: str, order: list[str], first: str, legal: dict[str, list[str]]) -> DataFrame:
    """`moves` with `from_state` and `accepted`: a move counts only if the last accepted state allows it (DML-01).

    A rejected attempt leaves the state as it was, so this is a fold over each key's ordered moves, not a comparison of
    neighbours. Keys are dealt over all tasks and rows come sorted: the fold holds one state, however many moves a key has.
    """
    fields = moves.schema
    kinds = ", ".join(f"{c} {fields[c].dataType.simpleString()}" for c in (key, *order))
    rows = moves.select(key, *order, F.col(state).alias("to_state")).repartition(key).sortWithinPartitions(key, *order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, now = None, first
        for batch in batches:
            before, good = [], []
            for k, to in zip(batch[key], batch["to_state"], strict=True):
                if k != last:
                    last, now = k, first
                before.append(now)
                good.append(to in legal.get(now, ()))
                now = to if good[-1] else now
            yield batch.assign(from_state=before, accepted=good)

    return rows.mapInPandas(run, f"{kinds}, to_state string, from_state string, accepted boolean").select(key, *order, "from_state", "to_state", "accepted")


def stalled(rows: DataFrame, as_of: Column, since: list[str], state: str, limits: dict[str, int], usual: int = 90) -> DataFrame:
    """Rows whose whole days since the first known time of `since` reach their state's limit (FLT-18)."""
    moment = F.coalesce(*[F.col(c) for c in since]).cast("timestamp")
    days = F.floor((F.unix_micros(as_of) - F.unix_micros(moment)) / 86400e6).cast("int")
    limit = F.coalesce(F.element_at(F.create_map(*[x for k, v in limits.items() for x in (F.lit(k), F.lit(v))]), F.col(state)), F.lit(usual))
    return rows.withColumn("days", days).filter(F.col("days") >= limit)


def assign_all_or_nothing(membership: DataFrame, wanted: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Membership with `wanted` rows replacing those of their keys, or unchanged if any of their keys is unknown (DML-06)."""
    unknown = wanted.join(known, key, "left_anti").limit(1).count()
    return membership if unknown else membership.join(wanted.select(key), key, "left_anti").unionByName(wanted)


def reordered(files: DataFrame, order: DataFrame, key: str) -> DataFrame:
    """`files` with the sort_order of `order` (key, sort_order), which must name exactly the same keys (DML-16)."""
    if files.select(key).exceptAll(order.select(key)).limit(1).count() or order.select(key).exceptAll(files.select(key)).limit(1).count():
        raise ValueError("the order must name every file exactly once")
    return files.drop("sort_order").join(order.select(key, "sort_order"), key)


def shift_open(tasks: DataFrame, moved: DataFrame) -> DataFrame:
    """Due dates of open tasks follow their experiment's new date (DAT-04, DML-08): moved has experiment_id, old_date, new_date."""
    met = tasks.join(moved, "experiment_id", "left")
    due = F.when((F.col("status") != "done") & F.col("new_date").isNotNull(), F.date_add("due_date", F.datediff("new_date", "old_date"))).otherwise(F.col("due_date"))
    return met.withColumn("due_date", due).drop("old_date", "new_date")


def numbered_ids(rows: DataFrame, base: str, key: str) -> DataFrame:
    """Ids from a base name, with _2, _3 ... for repeated ones in order of key (DML-18, STR-12)."""
    n = F.row_number().over(Window.partitionBy(base).orderBy(key))
    return rows.withColumn("id", F.when(n == 1, F.col(base)).otherwise(F.concat_ws("_", base, n.cast("string"))))


def created_submissions(new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Submissions (id, manuscript_id, journal_id, created_at) in their first state, and the transition from nothing that each begins with (DML-13)."""
    made = new.withColumn("current_state", F.lit("draft"))
    return made, made.select(F.col("id").alias("submission_id"), F.lit(None).cast("string").alias("from_state"), F.col("current_state").alias("to_state"), F.col("created_at").alias("transitioned_at"))
