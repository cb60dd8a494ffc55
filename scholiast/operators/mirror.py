"""Notes that mirror the texts of experiments, in both directions (DML-11)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: id of a mirroring note, its folder, and what the title of a note says whose experiment is gone
PREFIX, FOLDER, GONE = "experiment-", "experiments", " (experiment deleted)"


def one_line(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def _bare(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")


def note_text(title: Column, body: Column) -> Column:
    """A note's text without the heading that repeats its title and without blank lines around it."""
    inner = F.regexp_replace(F.coalesce(body, F.lit("")), r"^\n+", "")
    head = F.regexp_extract(inner, r"^#\s+(.+?)\s*\n", 1)
    cut = F.when((head != "") & (head == F.trim(title)), F.regexp_replace(inner, r"^#\s+.+?\s*\n", "")).otherwise(inner)
    return _bare(cut)


def mirrored(experiments: DataFrame, notes: DataFrame, base: DataFrame, now: Column) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(experiments, notes, base, actions) after both sides have been brought together.

    experiments: id, name, notes_md. notes: note_id, experiment, folder, date, title, body. base: id and digest of the text that both had last.
    The side that differs from the base wins; where both do, and differently, or where there is no base, the action is `conflict` and both
    stay. Other actions: `created`, a text without a note; `to note` and `to experiment`; `same`; `removed`, a cleared text whose
    note is as it was; `unlinked`, a note of an experiment that is gone: it keeps its body and says so in its title; `kept`, a note under an
    experiment's id that is linked to it no more: it is its owner's. Notes of other ids aren't touched, and a second run does nothing.
    """
    own = notes.filter(F.startswith("note_id", F.lit(PREFIX)))
    x = experiments.filter("id is not null").select(F.col("id").cast("string").alias("_id"), one_line(F.col("name")).alias("_name"), _bare(F.col("notes_md")).alias("_text"), F.lit(True).alias("_there"))
    n = own.select(F.substr("note_id", F.lit(len(PREFIX) + 1)).alias("_id"), "note_id", "experiment", "folder", "date", "title", "body", note_text(F.col("title"), F.col("body")).alias("_said"))
    met = x.join(n, "_id", "full_outer").join(base.select(F.col("id").cast("string").alias("_id"), "digest"), "_id", "left")
    linked = F.col("experiment") == F.col("_id")
    noted, written = F.col("note_id").isNotNull(), F.coalesce("_text", F.lit("")) != ""
    same_row, same_note = F.md5("_text") == F.col("digest"), F.md5("_said") == F.col("digest")
    yes = lambda c: F.coalesce(c, F.lit(False))
    action = (
        F.when(F.col("_there").isNull(), F.when(yes(linked), "unlinked").otherwise("kept"))
        .when(~noted, F.when(written, "created"))
        .when(~yes(linked), "kept")
        .when(F.col("_text") == F.col("_said"), "same")
        .when(yes(same_note), F.when(written, "to note").otherwise("removed"))
        .when(yes(same_row), "to experiment")
        .otherwise("conflict")
    )
    done = met.withColumn("action", action).filter("action is not null")
    to_note = F.col("action").isin("created", "to note", "same")
    title = F.when(F.col("_name") != "", F.col("_name")).otherwise(F.col("_id"))
    gone = F.concat(F.coalesce(F.nullif(one_line(F.col("title")), F.lit("")), F.col("_id")), F.lit(GONE))
    after = done.filter("action <> 'removed'").select(
        F.concat(F.lit(PREFIX), "_id").alias("note_id"),
        F.when(F.col("action") == "unlinked", F.lit(None).cast("string")).when(to_note, F.col("_id")).otherwise(F.col("experiment")).alias("experiment"),
        F.when(to_note, F.coalesce(F.nullif("folder", F.lit("")), F.lit(FOLDER))).otherwise(F.col("folder")).alias("folder"),
        F.when(to_note, F.coalesce(F.nullif("date", F.lit("")), now)).otherwise(F.col("date")).alias("date"),
        F.when(F.col("action") == "unlinked", gone).when(to_note, title).otherwise(F.col("title")).alias("title"),
        F.when(to_note, F.concat(F.lit("# "), title, F.lit("\n\n"), "_text", F.lit("\n"))).otherwise(F.col("body")).alias("body"),
    )
    back = done.filter("action = 'to experiment'").select(F.col("_id").alias("_k"), F.col("_said").alias("_new"))
    rows = experiments.join(back, F.col("id").cast("string") == F.col("_k"), "left").withColumn("notes_md", F.when(F.col("_k").isNotNull(), F.col("_new")).otherwise(F.col("notes_md"))).select(*experiments.columns)
    settled = F.when(F.col("action").isin("created", "to note", "same"), F.md5("_text")).when(F.col("action") == "to experiment", F.md5("_said")).when(F.col("action") == "conflict", F.col("digest"))
    return rows, notes.filter(~yes(F.startswith("note_id", F.lit(PREFIX)))).unionByName(after.select(*notes.columns)), done.select(F.col("_id").alias("id"), settled.alias("digest")).filter("digest is not null"), done.select(F.col("_id").alias("id"), "action")
