"""Ranked retrieval: inverted index, BM25, exact dense search, fusion, hydration and diversification (RET).

Every function takes a batch of queries, so one plan serves all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholiast.functions.text import TOKEN, tokens
from scholiast.operators.graph import cut_lineage

K1, B, RRF_K = 1.2, 0.75, 60
#: Rows of query tokens up to which they are broadcast; more meet the words by a shuffled join.
FEW = 100_000


def broadcast_if_few(rows: DataFrame, most: int = FEW) -> DataFrame:
    """The rows, marked for a broadcast if there are at most `most`."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(token, key, tf, len): one row per token of each document (SRC-20's inverted index). The count runs inside each document's rows, before any shuffle."""
    words = docs.select(key, F.explode(tokens(text)).alias("token"))
    return words.groupBy(key, "token").agg(F.count(F.lit(1)).alias("tf"))


def bm25(docs: DataFrame, key: str, text: str, queries: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, key, score): BM25 with idf ln(1 + (N - df + .5) / (df + .5)) for `queries` (query_id, query) (RET-01, FLT-01).

    A query is the OR of its distinct tokens. Words meet the query tokens in a hash join within the scan, before any
    shuffle, so only matches are counted and moved; lengths come with them, their mean from a count of words.
    The tokens of the queries are broadcast behind a check of their number.
    """
    asked = cut_lineage(queries.select("query_id", F.explode(F.array_distinct(tokens("query"))).alias("token")))
    wanted = broadcast_if_few(asked.select("token").distinct())
    stats = docs.agg(F.count(F.lit(1)).alias("n"), F.avg(F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0))).alias("mean"))
    sized = docs.select(key, tokens(text).alias("words")).select(key, F.size("words").alias("len"), F.explode("words").alias("token"))
    tf = cut_lineage(sized.join(wanted, "token").groupBy(key, "len", "token").agg(F.count(F.lit(1)).alias("tf")))
    df = tf.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    weighed = tf.join(df, "token").crossJoin(F.broadcast(stats))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("mean")))
    return asked.join(weighed.select(key, "token", part.alias("part")), "token").groupBy("query_id", key).agg(F.round(F.sum("part"), 6).alias("score"))


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def knn(vectors: DataFrame, key: str, vector: str, queries: DataFrame, most: int = 10_000) -> DataFrame:
    """(query_id, key, score): exact cosine of every vector with every query vector of `queries` (query_id, query_vector) (RET-02, MTH-01).

    Restrict `vectors` before the call: a restriction after the top k would lose rows (FLT-04). Up to `most` queries are broadcast; more are
    cut into blocks, and slices of the vectors meet them cell by cell. `top` keeps the k best of each query in every task before anything is moved.
    """
    known = vectors.select(key, vector, F.sqrt(dot(F.col(vector), F.col(vector))).alias("_v"))
    asked = queries.select("query_id", "query_vector", F.sqrt(dot(F.col("query_vector"), F.col("query_vector"))).alias("_q"))
    score = F.round(dot(F.col(vector), F.col("query_vector")) / F.nullif(F.col("_v") * F.col("_q"), F.lit(0.0)), 6).alias("score")
    if asked.limit(most + 1).count() <= most:
        return known.crossJoin(F.broadcast(asked)).select("query_id", key, score)
    blocks, slices = -(-asked.count() // most), int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = known.withColumn("_slice", F.pmod(F.xxhash64(key), F.lit(slices)).cast("int")).withColumn("_block", spread(blocks))
    right = asked.withColumn("_block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).withColumn("_slice", spread(slices))
    return left.join(right, ["_slice", "_block"]).select("query_id", key, score)


#: Scores of one product held at a time, pairs scored in double precision at a time, what 32-bit sums can be off at least, the most that rounding to six places moves.
PRODUCT, PAIRS, OFF, ROUNDED = 1 << 22, 1 << 16, 2e-5, 1.1e-6


def nearest(vectors: DataFrame, key: str, vector: str, queries: DataFrame, k: int, most: int = 10_000) -> DataFrame:
    """(query_id, key, score, rank): of each query of `queries` (query_id, query_vector) the k vectors of other keys with the highest cosine, as `knn` and `top` give them.

    Products of matrices in 32 bits leave out what can't be among the k best of a task; the rest is scored in double precision, in `dot`'s order. Vectors
    that no product fits (other lengths, nulls, no numbers) and more than `most` queries take the way of `knn`.
    """
    plain = lambda c: F.coalesce(F.forall(c, lambda x: F.coalesce(F.abs(x) < 1e15, F.lit(False))), F.lit(False))
    rest = lambda rows: knn(rows, key, vector, queries).filter(F.col(key) != F.col("query_id"))
    asked = queries.select("query_id", F.col("query_vector").cast("array<double>"), plain("query_vector").alias("plain")).limit(most + 1).toArrow()
    size = {len(x) for x in asked["query_vector"].to_pylist() if x is not None} if asked.num_rows <= most and all(asked["plain"].to_pylist()) else set()
    if len(size) != 1 or not (width := size.pop()) or asked["query_id"].null_count:
        return top(rest(vectors), key, k)
    ids, q = asked["query_id"].to_numpy(), np.array(asked["query_vector"].to_pylist(), np.float64)
    known = vectors.sparkSession.sparkContext.broadcast((ids, q))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = known.value
        norm = lambda x: np.sqrt(_dots(x, x))
        own = norm(q)
        unit = (q / np.where(own > 0, own, 1)[:, None]).astype(np.float32)
        least, off = np.full(len(ids), -np.inf, np.float32), max(OFF, 1.2e-7 * width)
        held: list[tuple[np.ndarray, ...]] = []

        def kept() -> tuple[np.ndarray, ...]:
            """Per query the k best rows and those that rounding may make their equals; of exactly equal scores the k smallest keys."""
            at, keys, score = map(np.concatenate, zip(*held, strict=True))
            order = np.lexsort((keys, -score, at))
            at, keys, score = at[order], keys[order], score[order]
            place = np.arange(len(at)) - np.searchsorted(at, at, "left")
            same = np.concatenate([[True], (at[1:] != at[:-1]) | (score[1:] != score[:-1])])[: len(at)]
            run = np.arange(len(at)) - np.maximum.accumulate(np.where(same, np.arange(len(at)), 0))
            last = np.full(len(ids), -np.inf)
            last[at[place == k - 1]] = score[place == k - 1]
            stay = (score >= last[at] - ROUNDED) & (run < k)
            np.copyto(least, (last - ROUNDED - off).astype(np.float32))
            return at[stay], keys[stay], score[stay]

        step, fresh = max(1, PRODUCT // max(1, len(ids))), 0
        for batch in batches:
            keys = batch.column("key").to_numpy()
            rows = batch.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
            size = norm(rows)
            flat = (rows / np.where(size > 0, size, 1)[:, None]).astype(np.float32)
            for first in range(0, len(keys), step):
                near = unit @ flat[first : first + step].T
                near[ids[:, None] == keys[first : first + step]] = -np.inf
                if near.shape[1] > k and np.count_nonzero(near >= least[:, None]) > 4 * k * len(ids):
                    np.maximum(least, np.partition(near, -k, axis=1)[:, -k] - np.float32(ROUNDED + 2 * off), out=least)
                i, j = np.nonzero((near >= least[:, None]) & (near > -np.inf))
                for at in range(0, len(i), PAIRS):
                    p, r = i[at : at + PAIRS], j[at : at + PAIRS] + first
                    whole = own[p] * size[r]
                    score = np.where(whole > 0, _dots(rows[r], q[p]) / np.where(whole > 0, whole, 1), -2.0)  # -2: no score
                    held.append((p, keys[r], score))
                    fresh += len(p)
                    if fresh > max(PAIRS, 2 * k * len(ids)):
                        held[:], fresh = [kept()], 0
        if held:
            at, keys, score = kept()
            yield pa.record_batch([pa.array(ids[at]), pa.array(keys), pa.array(score, mask=score < -1.5)], ["query_id", key, "score"])

    kinds = f"query_id {queries.schema['query_id'].dataType.simpleString()}, {key} {vectors.schema[key].dataType.simpleString()}, score double"
    fits = plain(vector) & (F.size(vector) == width) & F.col(key).isNotNull()
    fit = vectors.filter(fits).select(F.col(key).alias("key"), F.col(vector).alias("vector")).mapInArrow(scan, kinds).withColumn("score", F.round("score", 6))
    return top(fit.unionByName(rest(vectors.filter(~fits))), key, k)


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products row by row, added up in the order of the components."""
    out = np.zeros(len(a))
    for d in range(a.shape[1]):
        out += a[:, d] * b[:, d]
    return out


def top(scored: DataFrame, key: str, k: int) -> DataFrame:
    """The k best of each query with their rank from 1; ties to the smaller key (SRT-03, WIN-01)."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def fuse(arms: list[DataFrame], key: str, most: int = 40, k: int = RRF_K) -> DataFrame:
    """(query_id, key, score, rank): reciprocal-rank fusion of ranked arms (RET-03, SET-01); ties to the earlier arm, then rank there."""
    union = None
    for i, arm in enumerate(arms):
        part = arm.select("query_id", key, F.col("rank").alias("r"), F.lit(i).alias("arm"))
        union = part if union is None else union.unionByName(part)
    fused = union.groupBy("query_id", key).agg(F.round(F.sum(1.0 / (k + F.col("r"))), 9).alias("score"), F.min(F.struct("arm", "r")).alias("first"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "first.arm", "first.r", key)
    return fused.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most).select("query_id", key, "score", "rank")


def diversify(ranked: DataFrame, group: str, key: str, cap: int = 2, least: int = 6, k: int = 8) -> DataFrame:
    """At most `cap` of a group in rank order, filled up with the overflow to `least`, then the first k (RET-06, WIN-02)."""
    ranked = ranked.withColumn("in_group", F.row_number().over(Window.partitionBy("query_id", group).orderBy("rank", key)))
    over = F.col("in_group") > cap
    order = Window.partitionBy("query_id").orderBy(over, "rank", key)
    placed = ranked.withColumn("place", F.row_number().over(order)).withColumn("over", over)
    return placed.filter((~F.col("over") | (F.col("place") <= least)) & (F.col("place") <= k)).drop("in_group", "over")


def rerank(ranked: DataFrame, query: str, text: str) -> DataFrame:
    """Adds `overlap`, the share of query tokens that the text holds: a deterministic stand-in for a cross-encoder (RET-05)."""
    q = F.array_distinct(tokens(query))
    return ranked.withColumn("overlap", F.round(F.size(F.array_intersect(q, tokens(text))) / F.greatest(F.lit(1), F.size(q)), 6))


def reranked(ranked: DataFrame, query: str, text: str, most: int) -> DataFrame:
    """The `most` of each query that the reranker puts first, with their new rank (RET-05, RET-07)."""
    order = Window.partitionBy("query_id").orderBy(F.desc("overlap"), "rank")
    placed = rerank(ranked, query, text).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)
    return placed.drop("rank", query, text).withColumnRenamed("place", "rank")


def hybrid(lexical: DataFrame, dense: DataFrame, chunks: DataFrame, queries: DataFrame, key: str, group: str, text: str, k: int = 8, fused: int = 40) -> DataFrame:
    """The whole search (RET-07): both arms fused to `fused`, hydrated, reranked to 2 k, at most two of a group, k in all."""
    found = fuse([lexical, dense], key, fused).join(chunks.select(key, group, text), key).join(F.broadcast(queries), "query_id")
    return diversify(reranked(found, "query", text, 2 * k), group, key, k=k)


def enriched(found: DataFrame, catalog: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Results whose empty fields take the catalog's values, with its citation_key (RET-08)."""
    right = catalog.select(key, "citation_key", *[F.col(c).alias(f"_{c}") for c in fields])
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).isin("", "0")
    met = found.join(right, key, "left")
    return met.select(*[F.when(empty(c) & ~empty(f"_{c}"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in found.columns], "citation_key")


def graph_additions(seeds: DataFrame, edges: DataFrame, links: DataFrame, known: DataFrame, most: int = 20, added: int = 6) -> DataFrame:
    """(query_id, chunk, n): of the chunks with most links to the seeds (query_id, id) and their neighbours the first `most`, without those known (query_id, chunk), the first `added` (RET-09)."""
    both = edges.select("source_id", "target_id").unionByName(edges.select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"))).distinct()
    near = both.join(seeds.withColumnRenamed("id", "source_id"), "source_id").select("query_id", F.col("target_id").alias("id"))
    wide = seeds.select("query_id", "id").unionByName(near).distinct()
    counted = links.join(wide, "id").groupBy("query_id", "chunk").agg(F.count(F.lit(1)).alias("links"))
    best = counted.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("links"), "chunk"))).filter(F.col("n") <= most)
    new = best.join(known.select("query_id", "chunk"), ["query_id", "chunk"], "left_anti")
    return new.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("n"))).filter(F.col("n") <= added).select("query_id", "chunk", "links", "n")


# fixed values: sections in the order in which a summary takes them
SUMMARY_ORDER = ["abstract", "summary", "introduction", "conclusion", "conclusions", "discussion", "results"]


def gathered(chunks: DataFrame, paper: str, section: str, position: str, text: str, most: int = 8000) -> DataFrame:
    """(paper, text): a paper's blocks, preferred sections first and then by position, joined until `most` characters are used, the last block cut (RET-13)."""
    named = F.lower(F.trim(section))
    priority = F.coalesce(*[F.when(F.startswith(named, F.lit(s)), i) for i, s in enumerate(SUMMARY_ORDER)], F.lit(len(SUMMARY_ORDER)))
    rows = chunks.select(paper, priority.alias("_p"), F.col(position).alias("_i"), F.regexp_replace(text, r"^\s+|\s+$", "").alias("_t")).filter("_t <> ''")
    order = Window.partitionBy(paper).orderBy("_p", "_i").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.char_length("_t")).over(order), F.lit(0))
    kept = rows.withColumn("_b", before).filter(F.col("_b") < most).withColumn("_t", F.left("_t", (F.lit(most) - F.col("_b")).cast("int")))
    return kept.groupBy(paper).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_p", "_i", "_t"))), lambda x: x["_t"]), "\n\n").alias("text"))


def excerpts(ranked: DataFrame, paper: str) -> DataFrame:
    """(query_id, prompt): the excerpts of a prompt, one number per paper in order of first appearance (RET-14): ranked has query_id, rank, paper, title, section, page_start, page_end, text."""
    first = F.min("rank").over(Window.partitionBy("query_id", paper))
    numbered = ranked.withColumn("_f", first).withColumn("number", F.dense_rank().over(Window.partitionBy("query_id").orderBy("_f")))
    block = F.format_string("---\n[%d] %s\nSection: %s (pages %s-%s)\n%s\n---", "number", "title", "section", F.col("page_start").cast("string"), F.col("page_end").cast("string"), "text")
    parts = numbered.select("query_id", "rank", block.alias("block")).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "block"))).alias("b"))
    return parts.select("query_id", F.array_join(F.transform("b", lambda x: x["block"]), "\n\n").alias("prompt"))
