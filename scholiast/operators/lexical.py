"""A stored inverted index with positions and block maxima, ranked search and phrases on it (SRC-20, RET-01, FLT-01, FLT-02).

The folder of an index has two tables. `postings` has one row for a token and a slice of documents, laid
out in folders by hash of the token and sorted by it: the keys of the slice's documents that hold the token, how
often, how long they are, where it stands, and for the whole row the largest frequency and the least
length. A row without token, in a folder of its own, has all documents of the slice. `sizes` has the number and
summed length of each insertion's. Slices are the same for all tokens, so what a query can score at most in a slice is a sum over
its tokens' rows, and slices that stay below what k documents score already are never unpacked.

Inserting writes new slices beside the old ones and changes none of them. An insertion counts once its row
in `sizes`, which is written last, is there.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from scholiast.functions.text import tokens
from scholiast.operators.graph import path_exists
from scholiast.operators.retrieval import K1, B, top

#: Documents of a slice, folders by token hash, slices that are scored before others are left out, rows of query tokens up to which a scan's filter names them.
SLICE, CELLS, LEADING, NAMED = 1024, 64, 4, 1000
#: Folder of the rows of all documents of a slice.
EVERY = -1


def _sliced(batch: int, slice_docs: int, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Numbered slices of a task's documents."""
    number = (batch << 48) | (TaskContext.get().partitionId() << 24)
    for rows in batches:
        for first in range(0, rows.num_rows, slice_docs):
            yield number, rows.slice(first, slice_docs)
            number += 1


def _postings(number: int, rows: pa.RecordBatch) -> pa.RecordBatch:
    """The rows of one slice of documents (key, words), one for each of its tokens and one for all of them."""
    words = rows.column("words")
    size = words.value_lengths().fill_null(0).to_numpy().astype(np.int64)
    coded = words.flatten().dictionary_encode()
    order = np.argsort(coded.indices.to_numpy(), kind="stable")
    token = coded.indices.to_numpy()[order]
    doc = np.repeat(np.arange(len(size)), size)[order]
    place = (np.arange(len(order)) - np.repeat(np.cumsum(size) - size, size))[order]
    row_at = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(order) else np.zeros(0, np.int64)
    at = np.flatnonzero(np.concatenate([[True], (token[1:] != token[:-1]) | (doc[1:] != doc[:-1])])) if len(order) else row_at
    tf = np.diff(np.append(at, len(order)))
    length = size[doc[at]]
    first = np.searchsorted(at, row_at)
    offsets = pa.array(np.append(first, len(at)).astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, x) for x in (rows.column("key").take(pa.array(doc[at])), pa.array(tf.astype(np.int32)), pa.array(length.astype(np.int32)))]
    places = pa.ListArray.from_arrays(offsets, pa.ListArray.from_arrays(pa.array(np.append(at, len(order)).astype(np.int32)), pa.array(place.astype(np.int32))))
    most, least = (np.maximum.reduceat(tf, first), np.minimum.reduceat(length, first)) if len(first) else (tf, length)
    n = np.diff(np.append(first, len(at)))
    names = ["token", "slice", "n", "max_tf", "min_len", "keys", "tfs", "lens", "places"]
    columns = [coded.dictionary.take(pa.array(token[row_at])), pa.array(np.full(len(n), number)), pa.array(n.astype(np.int32)), pa.array(most.astype(np.int32)), pa.array(least.astype(np.int32)), *lists, places]
    one = pa.array([0, len(size)], pa.int32())
    every = [pa.ListArray.from_arrays(one, x) for x in (rows.column("key"), pa.array(np.zeros(len(size), np.int32)), pa.array(size.astype(np.int32)))]
    nowhere = pa.ListArray.from_arrays(pa.array([0, 0], pa.int32()), pa.array([], pa.list_(pa.int32())))
    whole = [pa.nulls(1, pa.string()), pa.array([number]), pa.array([len(size)], pa.int32()), pa.array([0], pa.int32()), pa.array([size.min(initial=0)], pa.int32()), *every, nowhere]
    return pa.RecordBatch.from_arrays([pa.concat_arrays([a.cast(b.type), b]) for a, b in zip(columns, whole, strict=True)], names)


@dataclass
class LexicalIndex:
    """An index in a folder that all executors can reach; `key` is the documents' identifier there."""

    spark: SparkSession
    path: str
    key: str

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    @functools.cached_property
    def _sizes(self) -> list[Row]:
        """(batch, n, total, cells) of the insertions that are whole; they are as many as insertions, not as documents."""
        return self._table("sizes").collect() if path_exists(self.spark, f"{self.path}/sizes") else []

    @functools.cached_property
    def _rows(self) -> DataFrame:
        """All rows of whole insertions; the folders are listed once, an insertion gives a new index."""
        return self._table("postings").filter(F.col("batch").isin(self._kept))

    @property
    def _kept(self) -> list[int]:
        return [r["batch"] for r in self._sizes]

    def documents(self) -> DataFrame:
        """(key, len, slice) of all documents."""
        every = self._rows.filter(F.col("cell") == EVERY)
        return every.select("slice", F.explode(F.arrays_zip("keys", "lens")).alias("d")).select(F.col("d.keys").alias("key"), F.col("d.lens").alias("len"), "slice")

    def postings(self) -> DataFrame:
        """(token, slice, n, max_tf, min_len, keys, tfs, lens, places, batch, cell) of all tokens."""
        return self._rows.filter(F.col("cell") != EVERY)

    def insert(self, docs: DataFrame, text: str, cells: int = CELLS, slice_docs: int = SLICE) -> LexicalIndex:
        """The index with the documents (key, text) whose key it doesn't have yet (FLT-16).

        A null text is an empty document, a null key none; of rows with one key one stays. `cells` counts for a new index,
        later insertions keep it. Texts are read once and not moved: a task makes the rows of its own slices, and
        those are dealt by token, of which large ones are split again when written.
        """
        rows = docs.select(F.col(self.key).alias("key"), F.col(text).alias("text")).filter("key is not null")
        if self._kept:
            rows = rows.join(self.documents().select("key"), "key", "left_anti")
            cells = self._sizes[0]["cells"]
        if not rows.groupBy("key").count().filter("count > 1").isEmpty():
            rows = rows.dropDuplicates(["key"])
        batch = max(self._kept, default=-1) + 1
        kind = rows.schema["key"].dataType.simpleString()
        words = rows.select("key", tokens("text").alias("words"))

        def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for number, part in _sliced(batch, slice_docs, batches):
                yield _postings(number, part)

        found = words.mapInArrow(make, f"token string, slice long, n int, max_tf int, min_len int, keys array<{kind}>, tfs array<int>, lens array<int>, places array<array<int>>")
        cell = F.when(F.col("token").isNull(), EVERY).otherwise(F.pmod(F.xxhash64("token"), F.lit(cells)))
        found = found.withColumn("cell", cell.cast("int")).hint("rebalance", "cell").sortWithinPartitions("cell", "token", "slice")
        found.write.partitionBy("cell").parquet(f"{self.path}/postings/batch={batch}")
        every = self.spark.read.schema(found.schema).parquet(f"{self.path}/postings/batch={batch}").filter(F.col("cell") == EVERY)
        length = F.aggregate("lens", F.lit(0).cast("long"), lambda s, x: s + x)
        size = every.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(length), F.lit(0)).alias("total"))
        size.withColumn("cells", F.lit(cells)).coalesce(1).write.parquet(f"{self.path}/sizes/batch={batch}")
        return LexicalIndex(self.spark, self.path, self.key)

    def _asked(self, queries: DataFrame, distinct: bool = True) -> tuple[DataFrame, DataFrame]:
        """(query_id, token, place) of the queries and the postings of their tokens. Up to NAMED tokens are named in the scan's filter, which then reads only their folders and row groups; more meet the postings in a join."""
        words, cells = tokens("query"), self._sizes[0]["cells"]
        asked = queries.select("query_id", F.posexplode(F.array_distinct(words) if distinct else words).alias("place", "token"))
        rows = self.postings()
        few = asked.withColumn("cell", F.pmod(F.xxhash64("token"), F.lit(cells)).cast("int")).limit(NAMED + 1).collect()
        if len(few) > NAMED:
            return asked, rows.drop("batch", "cell")
        here = rows.filter(F.col("cell").isin(sorted({r["cell"] for r in few})) & F.col("token").isin(sorted({r["token"] for r in few})))
        return F.broadcast(self.spark.createDataFrame([r[:3] for r in few], asked.schema)), here.drop("batch", "cell")

    def search(self, queries: DataFrame, k: int, k1: float = K1, b: float = B) -> DataFrame:
        """(query_id, key, score, rank): the k best documents of each of `queries` (query_id, query) by BM25 over all documents, ties to the smaller key.

        A query is the OR of its distinct tokens; idf is ln(1 + (N - df + .5) / (df + .5)); scores have six decimals. The slices in which a query
        can score most are unpacked first; their k-th best score is a bound that the others' maxima must reach.
        """
        if not self._kept:
            return queries.select("query_id", F.lit(None).cast("long").alias(self.key), F.lit(0.0).alias("score"), F.lit(1).alias("rank")).limit(0)
        asked, rows = self._asked(queries)
        n, total = (sum(r[c] for r in self._sizes) for c in ("n", "total"))
        df = rows.groupBy("token").agg(F.sum("n").alias("df"))
        idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
        weighed = df.join(asked, "token").select("query_id", "token", idf.alias("idf"))

        def part(tf: Column, length: Column) -> Column:
            return F.col("idf") * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / F.lit(total / max(1, n))))

        def scored(wanted: DataFrame) -> DataFrame:
            """Scores of all documents in the wanted (query_id, slice); they are as many as slices times queries at most."""
            met = rows.join(weighed, "token").join(wanted, ["query_id", "slice"], "left_semi")
            each = met.select("query_id", "idf", F.explode(F.arrays_zip("keys", "tfs", "lens")).alias("p"))
            return each.groupBy("query_id", F.col("p.keys").alias(self.key)).agg(F.round(F.sum(part(F.col("p.tfs"), F.col("p.lens"))), 6).alias("score"))

        most = rows.select("token", "slice", "max_tf", "min_len").join(weighed, "token").groupBy("query_id", "slice").agg(F.sum(part(F.col("max_tf"), F.col("min_len"))).alias("score"))
        leading = top(most, "slice", LEADING)
        reached = top(scored(leading), self.key, k).filter(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
        others = most.join(reached, "query_id", "left").filter(F.col("score") >= F.coalesce("least", F.lit(0.0)) - 1e-6)
        return top(scored(others.select("query_id", "slice")), self.key, k)

    def holding(self, queries: DataFrame) -> DataFrame:
        """(query_id, key): the documents that hold a token of a query."""
        asked, rows = self._asked(queries)
        return rows.select("token", "keys").join(asked, "token").select("query_id", F.explode("keys").alias(self.key)).distinct()

    def phrases(self, queries: DataFrame) -> DataFrame:
        """(query_id, key, n): the documents that hold a query's tokens one after another, and how often (FLT-02).

        Slices that lack a token are left out, then documents that do; of the others the places of token i, less i, must agree
        for all i. A query without tokens finds nothing.
        """
        asked, rows = self._asked(queries, distinct=False)
        wanted = asked.groupBy("query_id").agg(F.count(F.lit(1)).alias("tokens"), F.countDistinct("token").alias("kinds"))
        met = rows.select("token", "slice", "keys", "places").join(asked, "token")
        whole = met.groupBy("query_id", "slice").agg(F.countDistinct("token").alias("kinds")).join(wanted, ["query_id", "kinds"], "left_semi")
        pairs = F.explode(F.arrays_zip("keys", "places")).alias("p")
        each = met.join(whole, ["query_id", "slice"], "left_semi").select("query_id", "place", pairs).select("query_id", "place", F.col("p.keys").alias("key"), F.col("p.places").alias("at"))
        every = each.groupBy("query_id", "key").agg(F.count(F.lit(1)).alias("tokens")).join(wanted, ["query_id", "tokens"], "left_semi")
        begins = each.join(every, ["query_id", "key"], "left_semi").select("query_id", "key", F.explode("at").alias("at"), "place")
        agreed = begins.groupBy("query_id", "key", (F.col("at") - F.col("place")).alias("begin")).agg(F.count(F.lit(1)).alias("tokens")).join(wanted, ["query_id", "tokens"], "left_semi")
        return agreed.groupBy("query_id", F.col("key").alias(self.key)).agg(F.count(F.lit(1)).alias("n"))
