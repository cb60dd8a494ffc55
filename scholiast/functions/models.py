"""Model boundaries as small interfaces with deterministic offline stand-ins (UDF-01 to UDF-04, SRC-03, GRF-09, GRF-10)."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from scholiast.functions import text as T

Embed = Callable[[list[str]], np.ndarray]


def hashed_embedder(dimensions: int = 64) -> Embed:
    """Unit vectors of signed word hashes: a stand-in for an embedding model."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dimensions), np.float32)
        for row, text in zip(out, texts, strict=True):
            for w in (text or "").lower().split():
                h = int.from_bytes(hashlib.md5(w.encode()).digest()[:8], "little")
                row[h % dimensions] += 1 if h >> 63 else -1
        return out / np.maximum(1e-9, np.linalg.norm(out, axis=1, keepdims=True))

    return embed


def embedded(rows: DataFrame, text: str, embed: Embed, batch: int = 16, name: str = "embedding") -> DataFrame:
    """Adds the vector of `text`; the model sees `batch` texts at once and is loaded once a task (UDF-01, UDF-02, UDF-09)."""

    @F.pandas_udf(ArrayType(FloatType()))
    def vectors(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            values = part.fillna("").tolist()
            found = [v for i in range(0, len(values), batch) for v in embed(values[i : i + batch])]
            yield pd.Series(found, index=part.index)

    return rows.withColumn(name, vectors(text))


def stale(rows: DataFrame, vector: str, model: str, current: str) -> DataFrame:
    """Rows without a vector, or with one of another model; a null model name with a vector is not stale (FLT-16, UDF-02)."""
    return rows.filter(F.col(vector).isNull() | (F.col(model) != current))


def named_entities(rows: DataFrame, key: str, text: str, stop: list[str] | None = None) -> DataFrame:
    """(key, sentence, name): runs of capitalised words within sentences, once each without regard to case: a stand-in for a tagger (GRF-10). Texts under 80 characters are skipped."""
    said = rows.filter(F.char_length(text) >= 80).select(key, F.posexplode(T.sentences(text)).alias("sentence", "s"))
    found = said.select(key, "sentence", F.explode(F.regexp_extract_all("s", F.lit(r"(?<=\s)\p{Lu}[\p{L}\p{N}-]+(?:\s\p{Lu}[\p{L}\p{N}-]+)*"), F.lit(0))).alias("name"))
    kept = found.filter((F.char_length("name") >= 2) & ~F.lower("name").isin(stop or ["the", "a", "an"]))
    return kept.groupBy(key, "sentence", F.lower("name").alias("_k")).agg(F.min("name").alias("name")).drop("_k")


def verb_by_ending(sentence: Column) -> Column:
    """The first lower-case word with an ending of a verb, null without one: a stand-in for a tagger's first verb (GRF-09)."""
    return F.nullif(F.regexp_extract(sentence, r"(?<![\p{L}\p{N}_-])\p{Ll}{2,}(?:ed|ing|es)(?![\p{L}\p{N}_-])", 0), F.lit(""))


def verb_relations(entities: DataFrame, rows: DataFrame, key: str, text: str, verb: Callable[[Column], Column] = verb_by_ending) -> DataFrame:
    """(key, sentence, a, b, relation): every two entities of one sentence that has a verb, which names their relation (GRF-09). `verb` gives a sentence's first verb, or null."""
    said = rows.select(key, F.posexplode(T.sentences(text)).alias("sentence", "_s")).select(key, "sentence", verb(F.col("_s")).alias("relation")).filter("relation is not null")
    return co_occurrences(entities, key).join(said, [key, "sentence"])


def co_occurrences(entities: DataFrame, key: str) -> DataFrame:
    """(key, sentence, a, b), a < b: every two entities of one sentence (GRF-09). A sentence bounds the pairs."""
    right = entities.select(key, "sentence", F.col("name").alias("b"))
    return entities.withColumnRenamed("name", "a").join(right, [key, "sentence"]).filter("a < b").select(key, "sentence", "a", "b")


def retrieval_quality(ranked: DataFrame, total: DataFrame, k: int) -> DataFrame:
    """(query_id, recall, reciprocal_rank) of the ranked (query_id, relevant, rank) results of queries that have `total` (query_id, total) relevant ones (UDF-07); only counts are needed of those that weren't found."""
    hits = ranked.filter((F.col("rank") <= k) & F.col("relevant")).groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"), F.min("rank").alias("first"))
    return total.join(hits, "query_id", "left").select("query_id", F.round(F.coalesce("hits", F.lit(0)) / F.least("total", F.lit(k)), 6).alias("recall"), F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("reciprocal_rank"))


def resolved_models(asked: DataFrame, installed: DataFrame, preferences: list[str]) -> DataFrame:
    """(asked, model) for every pinned name of `asked` (asked, pinned): the same installed name, else the first one of its base, else the first of the first preference that a name holds, else the first name (UDF-06). Without installed names nothing is resolved.

    Names and bases meet in joins; what no question decides is one name for all.
    """
    base = lambda c: F.split_part(c, F.lit(":"), F.lit(1))
    names = installed.select("name").distinct()
    least = names.agg(F.min("name").alias("first"), *[F.min(F.when(F.contains("name", F.lit(p)), F.col("name"))).alias(f"p{i}") for i, p in enumerate(preferences)]).first()
    rest = next((least[f"p{i}"] for i in range(len(preferences)) if least[f"p{i}"]), least["first"])
    by_base = names.groupBy(base("name").alias("_base")).agg(F.min("name").alias("_based"))
    met = asked.join(names.withColumn("_same", F.col("name")).withColumnRenamed("name", "pinned"), "pinned", "left").withColumn("_base", base("pinned")).join(by_base, "_base", "left")
    return met.select("asked", F.coalesce("_same", "_based", F.lit(rest).cast("string")).alias("model")).filter("model is not null")


def parsed_sections(items: DataFrame, key: str) -> DataFrame:
    """(key, sections, references_raw) from layout items (key, pos, kind, text, page): page furniture goes, headings open sections, back matter goes to the references (SRC-03)."""
    kept = items.filter(~F.col("kind").isin("page_header", "page_footer", "table"))
    head = F.when(F.col("kind") == "heading", F.col("text"))
    back = F.lower(F.trim("section")).rlike(r"^(references|bibliography|literature cited)")
    placed = kept.withColumn("section", F.coalesce(F.last(head, ignorenulls=True).over(Window.partitionBy(key).orderBy("pos")), F.lit("body"))).filter("kind <> 'heading'").withColumn("back", back)
    line = F.struct("pos", "text")
    joined = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(c)), lambda x: x["text"]), "\n")
    sections = placed.filter("not back").groupBy(key, "section").agg(F.min("pos").alias("first"), joined(line).alias("text"), F.min("page").alias("page_start"), F.max("page").alias("page_end"))
    whole = sections.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("first", "section", "text", "page_start", "page_end"))), lambda x: F.struct(x["section"].alias("name"), x["text"].alias("text"), x["page_start"].alias("page_start"), x["page_end"].alias("page_end"))).alias("sections"))
    references = placed.filter("back").groupBy(key).agg(joined(line).alias("references_raw"))
    return whole.join(references, key, "full_outer")


def summarised(rows: DataFrame, text: str, summary: str, model: Callable[[list[str]], list[str]], least: int = 200, force: bool = False) -> DataFrame:
    """Rows with a summary from `model` where it is null or '' (or everywhere, forced), and `state`: done, skipped for texts of fewer than `least` characters, kept (STM-08, UDF-04).

    Thoughts are taken out of an answer, and one that says INSUFFICIENT_TEXT is none.
    """

    @F.pandas_udf("string")
    def said(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series(model(part.fillna("").tolist()), index=part.index)

    open_ = F.lit(force) | (F.coalesce(F.col(summary), F.lit("")) == "")
    state = F.when(~open_, "kept").when(F.char_length(text) < least, "skipped").otherwise("done")
    known = rows.withColumn("state", state)
    asked = known.filter("state = 'done'").withColumn(summary, F.regexp_replace(T.without_thoughts(said(text)), r"^INSUFFICIENT_TEXT.*", ""))
    return asked.unionByName(known.filter("state <> 'done'").withColumn(summary, F.coalesce(F.col(summary), F.lit(""))))
