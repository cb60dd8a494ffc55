"""Nearest neighbours by additive quantisation, exact.

A vector is stored as one code from each of several full-dimensional codebooks whose sum approaches it,
found by beam search, with the squared norm of that sum and the vector's distance from it, its error. A
query is scored against codes alone: its products with all codewords make a table, and |q - x|^2 is
|q|^2 + norm - 2 * (sum of looked-up products). The best by code are measured on the original vectors; the
k-th of them bounds the result, and every vector that this distance by code less its error doesn't exclude is measured too.

Codebooks are learned on a bounded sample; every row is indexed, and the result doesn't depend on them. Equal
vectors are indexed once, with the smallest ids that any query could ask for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholiast.llm.store import hashed_sample, stored, tidy

BOOKS, CODES, BEAM = 16, 256, 4
#: Rows from which codebooks are learned: those with the smallest hashed ids.
SAMPLE = 8192
#: Fewest rows in a slice of a cell of the search, and most bytes of its vectors and of its queries.
LEAST_SLICE, MOST_BYTES = 1 << 12, 1 << 25
#: Distinct vectors of a slice that are measured first for a query.
SHORTLIST = 100
#: Shares by which bounds are widened for rounding: of distances, and of the vectors' own size in distances by code.
WIDER, SLACK = 1e-9, 1e-12


def _matrix(vectors: pa.Array) -> np.ndarray:
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    return np.asarray(flat, np.float64).reshape(len(vectors), -1)


def _nearest_codes(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    return np.argmin((book * book).sum(1) - 2 * x @ book.T, 1)


def learn_codebooks(sample: np.ndarray, books: int = BOOKS, codes: int = CODES, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """(books, codes, dimensions): each codebook by k-means on what the beam-free encoding by those before it leaves, then all of them together by least squares."""
    r = np.random.default_rng(seed)
    codes = max(1, min(codes, len(sample)))
    rest, out, chosen = sample.copy(), np.zeros((books, codes, sample.shape[1])), np.zeros((len(sample), books), np.int64)
    for m in range(books):
        book = rest[r.choice(len(rest), codes, replace=False)]
        for _ in range(rounds):
            near = _nearest_codes(rest, book)
            count = np.bincount(near, minlength=codes)
            sums = np.zeros_like(book)
            np.add.at(sums, near, rest)
            full = count > 0
            book[full] = sums[full] / count[full, None]
            if (~full).any():
                book[~full] = rest[r.choice(len(rest), int((~full).sum()))]
        out[m], chosen[:, m] = book, _nearest_codes(rest, book)
        rest = rest - book[chosen[:, m]]
    # codewords that go best with the codes chosen: one sweep of means of what the other books leave
    for _ in range(3):
        chosen = encode(sample, out)[0]
        rest = sample - sum(out[m][chosen[:, m]] for m in range(books))
        for m in range(books):
            own = rest + out[m][chosen[:, m]]
            count = np.bincount(chosen[:, m], minlength=codes)
            sums = np.zeros_like(out[m])
            np.add.at(sums, chosen[:, m], own)
            out[m][count > 0] = sums[count > 0] / count[count > 0, None]
            rest = own - out[m][chosen[:, m]]
    return out


def reach(books: np.ndarray) -> float:
    """The longest that a sum of codewords can be."""
    return float(np.sqrt((books * books).sum(2)).max(1).sum())


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, squared norm of their sum, distance from it) by beam search: after each codebook the `beam` partial sums nearest to the vector stay."""
    n, k = len(x), books.shape[1]
    codes, rest = np.zeros((n, 1, 0), np.int64), x[:, None, :].copy()
    for book in books:
        error = (rest * rest).sum(2)[:, :, None] + (book * book).sum(1) - 2 * rest @ book.T
        width = min(beam, error.shape[1] * k)
        flat = error.reshape(n, -1)
        best = np.argpartition(flat, width - 1, 1)[:, :width] if width < flat.shape[1] else np.tile(np.arange(width), (n, 1))
        parent, code = best // k, best % k
        rows = np.arange(n)[:, None]
        codes = np.concatenate([codes[rows, parent], code[:, :, None]], 2)
        rest = rest[rows, parent] - book[code]
    codes = codes[np.arange(n), np.argmin((rest * rest).sum(2), 1)]
    total = sum(book[codes[:, m]] for m, book in enumerate(books))
    length = lambda v: np.sqrt((v * v).sum(1))
    return codes, (total * total).sum(1), length(x - total) * (1 + WIDER) + SLACK * (length(x) + reach(books))


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding as doubles, size): rows with an id and a vector that has only finite components, not all zero."""
    v = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).filter("vec_id is not null and embedding is not null and size(embedding) > 0")
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    v = v.filter(~F.coalesce(bad, F.lit(True)) & F.exists("embedding", lambda x: x != 0))
    return v.withColumn("size", F.size("embedding"))


def build_index(v: DataFrame, k: int, sample: int = SAMPLE, books: int = BOOKS) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(index, codebooks, centre) of `v` (vec_id, embedding), all of one length.

    The index has (row, other, embedding, ids, codes, norm, error) of each distinct vector; row has the smallest of its ids and other
    the next one, if any. ids are the smallest that have it, at most `k` times each and so many that k are left without any one.
    Codes are of the vector less the centre, the mean of the sample, so that they keep their digits far from zero.
    """
    taken = _matrix(hashed_sample(v.select("vec_id", "embedding"), ["vec_id", "embedding"], sample).column("embedding").combine_chunks())
    centre = taken.mean(0)
    codebooks = learn_codebooks(taken - centre, books)
    shared = v.sparkSession.sparkContext.broadcast((codebooks, centre))
    of_id = v.withColumn("place", F.row_number().over(Window.partitionBy("embedding", "vec_id").orderBy("vec_id"))).filter(F.col("place") <= k)
    of_vector = of_id.withColumn("place", F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))).filter(F.col("place") <= 2 * k)
    distinct = of_vector.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.slice(at, 512)
                codes, norms, errors = encode(_matrix(part.column("embedding")) - shared.value[1], shared.value[0])
                yield pa.RecordBatch.from_arrays([part.column("embedding"), part.column("ids"), pa.array([c.tobytes() for c in codes.astype(np.uint8)], pa.binary()), pa.array(norms), pa.array(errors)], ["embedding", "ids", "codes", "norm", "error"])

    coded = distinct.mapInArrow(run, "embedding array<double>, ids array<long>, codes binary, norm double, error double")
    # rows of one id with different vectors have the same smallest id: the hash of the vector tells them apart
    coded = coded.select(F.struct(F.get("ids", F.lit(0)).alias("id"), F.xxhash64("embedding").alias("hash")).alias("row"), F.array_min(F.filter("ids", lambda i: i > F.get("ids", F.lit(0)))).alias("other"), "embedding", "ids", "codes", "norm", "error")
    return stored(coded, "index"), codebooks, centre


def _nearest_in(x: np.ndarray, q: np.ndarray, first: np.ndarray, near: np.ndarray, slack: float, error: np.ndarray, k: int, shortlist: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, distances) of the `k` vectors of `x` nearest to `q`, ties to the smaller `first`; near are squared distances by code, right up to `slack`.

    Distances that decide add up components in their order, as Spark's do.
    """
    few = max(k, shortlist)
    if few < len(x):
        some = np.argpartition(near, few - 1)[:few]
        bound = np.sqrt(np.partition(((x[some] - q) ** 2).sum(1), k - 1)[k - 1]) * (1 + WIDER)
        places = np.flatnonzero(~(near - slack > (bound + error) ** 2))  # what is not a number is measured
    else:
        places = np.arange(len(x))
    about = np.concatenate([((x[p] - q) ** 2).sum(1) for p in np.array_split(places, 1 + len(places) // 4096)])
    if k < len(places):
        places = places[about <= np.partition(about, k - 1)[k - 1] * (1 + WIDER)]
    exact = np.sqrt(np.cumsum((x[places] - q) ** 2, 1)[:, -1])
    order = np.lexsort((first[places], exact))[:k]
    return places[order], exact[order]


def nearest_rows(index: DataFrame, asked: DataFrame, codebooks: np.ndarray, centre: np.ndarray, k: int, shortlist: int) -> DataFrame:
    """(query_id, row): for each query of `asked` (query_id, embedding) the rows of the index that hold its `k` nearest candidates, other than itself.

    Cells of a slice of the rows and a block of the queries are dealt to tasks. A cell returns its own `k`
    nearest, so the result is that of one pass over all rows, however they are dealt.
    """
    shared = index.sparkSession.sparkContext.broadcast((codebooks, centre))
    n, n_queries = index.count(), asked.count()
    most = max(1 << 10, MOST_BYTES // (8 * len(centre)))
    slices = max(1, -(-n // min(most, max(LEAST_SLICE, n // 64))))
    n_blocks = max(1, -(-n_queries // most))
    columns = ["slice", "block", "asked", "row", "other", "query_id", "embedding", "codes", "norm", "error"]
    every = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    none = lambda name: F.lit(None).cast(index.schema[name].dataType).alias(name)
    rows = index.select("row", "other", "embedding", "codes", "norm", "error", F.pmod(F.xxhash64("row"), F.lit(slices)).cast("int").alias("slice"), every(n_blocks, "block"))
    rows = rows.withColumns({"asked": F.lit(False), "query_id": F.lit(None).cast("long")})
    queries = asked.select("query_id", "embedding", F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)).cast("int").alias("block"), every(slices, "slice"))
    queries = queries.select("slice", "block", F.lit(True).alias("asked"), none("row"), none("other"), "query_id", "embedding", none("codes"), none("norm"), none("error"))
    dealt = rows.select(*columns).unionByName(queries).repartition(slices * n_blocks, "slice", "block").sortWithinPartitions("slice", "block", F.desc("asked"), "query_id")
    kind = index.schema["row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, middle = shared.value
        farthest = reach(books)
        cell, questions, held = None, [], []

        def done() -> Iterator[pa.RecordBatch]:
            if not questions or not held:
                return
            x = np.concatenate([_matrix(h.column("embedding")) for h in held])
            code = np.concatenate([np.frombuffer(b"".join(h.column("codes").to_pylist()), np.uint8).reshape(len(h), -1) for h in held])
            code = np.ascontiguousarray(code.T).astype(np.intp)
            norm, error = (np.concatenate([h.column(c).to_numpy() for h in held]) for c in ("norm", "error"))
            row, other = (pa.concat_arrays([h.column(c) for h in held]) for c in ("row", "other"))
            ids, lone, other = row.field("id").to_numpy(), pc.is_null(other).to_numpy(zero_copy_only=False), pc.fill_null(other, 0).to_numpy()
            for part in questions:
                found = []
                for i, q in zip(part.column("query_id").to_numpy(zero_copy_only=False), _matrix(part.column("embedding")), strict=True):
                    table = 2 * (books @ (q - middle))
                    near = norm + ((q - middle) ** 2).sum()
                    for m in range(len(code)):
                        near -= table[m].take(code[m])
                    slack = SLACK * (np.sqrt(((q - middle) ** 2).sum()) + farthest) ** 2
                    # of vectors of this id the next id counts; those that only it has take up places and go
                    own = np.flatnonzero(ids == i)
                    first, alone = ids, own[lone[own]]
                    if len(own):
                        first = ids.copy()
                        first[own] = other[own]
                    places, far = _nearest_in(x, q, first, near, slack, error, k + len(alone), shortlist)
                    able = np.flatnonzero(~np.isin(places, alone))[:k]
                    places, far = places[able], far[able]
                    found.append((np.full(len(places), i, np.int64), places, first[places], far))
                query, places, first, far = (np.concatenate(c) for c in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(query), row.take(pa.array(places)), pa.array(first), pa.array(far)], ["query_id", "row", "first", "far"])

        for batch in batches:
            if not len(batch):
                continue
            keys = batch.column("slice").to_numpy().astype(np.int64) << 32 | batch.column("block").to_numpy()
            cuts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            for a, b in zip(cuts, [*cuts[1:], len(keys)], strict=True):
                if keys[a] != cell:
                    yield from done()
                    cell, questions, held = keys[a], [], []
                part = batch.slice(a, b - a)
                kinds = part.column("asked")
                for rows, to in ((part.filter(kinds), questions), (part.filter(pc.invert(kinds)), held)):
                    if len(rows):
                        to.append(rows)
        yield from done()

    found = dealt.mapInArrow(run, f"query_id long, row {kind}, first long, far double")
    order = Window.partitionBy("query_id").orderBy("far", "first", "row")
    return found.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k).select("query_id", "row")


def _distance(a: str, b: str) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


@tidy
def nearest(vectors: DataFrame, every: int = 100, k: int = 10, shortlist: int = SHORTLIST) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose vec_id is divisible by `every` its k nearest other rows, by Euclidean distance.

    Nearest first, ties to the smaller vec_id; score is the distance of the original vectors in double precision.
    Null, zero and non-finite vectors take no part. Vectors of different lengths have no distance: each length is a
    space of its own, with its own queries, candidates and codebooks. Fewer than k candidates give fewer rows; of rows with one id each
    is a candidate and the query of that id is the one whose vector is shortest, then sorts first. Codes choose the
    `shortlist` vectors that are measured first and exclude others by their errors; what they don't exclude is measured, so the
    result is exact on any rows, and where codes tell little apart nearly all are measured. Extra columns are ignored.
    """
    spark = vectors.sparkSession
    v = stored(usable(vectors), "vectors")
    asked = stored(v.filter(F.col("vec_id") % every == 0).groupBy(F.col("vec_id").alias("query_id")).agg(F.min(F.struct("size", "embedding")).alias("q")).select("query_id", "q.embedding", "q.size"), "queries")
    found = spark.createDataFrame([], "query_id long, vec_id long, score double")
    for row in asked.select("size").distinct().orderBy("size").collect():  # lengths, not rows
        own, same = asked.filter(F.col("size") == row["size"]).drop("size"), v.filter(F.col("size") == row["size"]).drop("size")
        index, codebooks, centre = build_index(same, k)
        short = stored(nearest_rows(index, own, codebooks, centre, k, shortlist), "short")
        near = short.join(index.select("row", "embedding", "ids"), "row").join(own.withColumnRenamed("embedding", "query"), "query_id")
        near = near.select("query_id", F.explode("ids").alias("vec_id"), _distance("embedding", "query").alias("score")).filter("vec_id <> query_id")
        found = found.unionByName(near)
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
