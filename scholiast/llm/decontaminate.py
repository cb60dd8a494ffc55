"""Benchmark decontamination by greedy string tiling.

Shared k-word seeds join test items with documents. For each pair whose seeds could cover enough of
the item, the longest non-overlapping common runs are marked again and again, found by running
Karp-Rabin with a falling search length, so that reordered pieces of an item count in full. The pair
is a leak if tiles cover the given share of the item's words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholiast.llm.store import free_names
from scholiast.llm.tokens import U64, blocks, cached_powers, grams, word_hashes

#: Words of test items that one broadcast holds (8 bytes each, and a seed of 20 bytes); more items take more passes over the documents.
SHARD_WORDS = 1_000_000
#: Pairs of seeds of documents and items that are looked at together.
MEETINGS = 1 << 20
_BASE = 0xA0761D6478BD642F


def _windows(prefix: np.ndarray, size: int, free: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Karp-Rabin hashes of all windows of `size` words without marked ones, and where they begin."""
    n = len(free) - size + 1
    if n <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    marked = np.concatenate([[0], np.cumsum(~free)])
    at = np.flatnonzero(marked[size:] == marked[:n])
    # Horner sums: prefix[i + size] - prefix[i] * base**size
    step = U64(pow(_BASE, size, 1 << 64))
    return prefix[at + size] - prefix[at] * step, at


def _prefix(words: np.ndarray) -> np.ndarray:
    """prefix[i]: hash of the first i words, sum of words[j] * base**(i - 1 - j)."""
    n = len(words)
    inverse = cached_powers(pow(_BASE, -1, 1 << 64), n + 1)[:n]
    sums = np.concatenate([np.zeros(1, U64), np.cumsum(words * inverse, dtype=U64)])
    return sums * np.concatenate([np.zeros(1, U64), cached_powers(_BASE, n + 1)[:n]])


def tiles(item: np.ndarray, doc: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Non-overlapping common runs (length, position in item, position in doc) of at least `least` words, longest first.

    Ties go to the earlier place in the item, then in the document.
    """
    free_item, free_doc = np.ones(len(item), bool), np.ones(len(doc), bool)
    item_sums, doc_sums = _prefix(item), _prefix(doc)
    found: list[tuple[int, int, int]] = []
    size = min(len(item), len(doc))
    while size >= least:
        a, a_at = _windows(item_sums, size, free_item)
        b, b_at = _windows(doc_sums, size, free_doc)
        by = np.argsort(b, kind="stable")
        low, high = np.searchsorted(b[by], a, "left"), np.searchsorted(b[by], a, "right")
        if not (high > low).any():
            longest = _longest(item, doc, free_item, free_doc, item_sums, doc_sums, least, size - 1)
            if longest < least:
                break
            size = longest
            continue
        for i in np.flatnonzero(high > low):
            p = int(a_at[i])
            if not free_item[p : p + size].all():
                continue
            for t in b_at[by[low[i] : high[i]]].tolist():
                if free_doc[t : t + size].all() and (item[p : p + size] == doc[t : t + size]).all():
                    free_item[p : p + size] = False
                    free_doc[t : t + size] = False
                    found.append((size, p, t))
                    break
        size -= 1
    return found


def _longest(item, doc, free_item, free_doc, item_sums, doc_sums, least: int, most: int) -> int:  # noqa: ANN001
    """Largest size up to `most` for which an unmarked common run exists, by bisection; 0 if none of `least` does. A common run of some length contains one of every smaller length."""
    low, high = least - 1, most
    while low < high:
        size = (low + high + 1) // 2
        if np.isin(_windows(item_sums, size, free_item)[0], _windows(doc_sums, size, free_doc)[0]).any():
            low = size
        else:
            high = size - 1
    return low if low >= least else 0


class Shard:
    """Test items and an index of their seeds."""

    def __init__(self, ids: list, texts: list[str | None], k: int):
        self.ids, self.items, self.k = [], [], k
        for block_first, _, raw, at in blocks(pa.array(texts, pa.string())):
            words, word_at, _, _ = word_hashes(raw, at)
            for i in range(len(word_at) - 1):
                if word_at[i + 1] > word_at[i]:
                    self.ids.append(ids[block_first + i])
                    self.items.append(words[word_at[i] : word_at[i + 1]])
        self.lengths = np.array([len(x) for x in self.items], np.int64)
        # an item of fewer than k words has one seed, all of it; such seeds are looked up by their own length
        self.sizes = sorted({min(k, len(x)) for x in self.items})
        self.index = {}
        for size in self.sizes:
            rows = [(i, x) for i, x in enumerate(self.items) if min(k, len(x)) == size]
            seeds = [grams(x, size) for _, x in rows]
            seed = np.concatenate(seeds)
            of = np.concatenate([np.full(len(s), i) for (i, _), s in zip(rows, seeds, strict=True)])
            at = np.concatenate([np.arange(len(s)) for s in seeds])
            order = np.argsort(seed, kind="stable")
            maybe = np.zeros(1 << 22, bool)
            maybe[(seed >> U64(42)).astype(np.int64)] = True
            self.index[size] = seed[order], of[order], at[order], maybe

    def seeds_of(self, item: int, size: int) -> np.ndarray:
        return grams(self.items[item], size)


def leaks(shard: Shard, words: np.ndarray, doc_at: np.ndarray, coverage: float) -> Iterator[tuple[int, int, float, int, int]]:
    """(row, item, covered share, tiles, covered words) for texts given as word hashes.

    Seeds of a document meet those of the items in parts of MEETINGS pairs, which are added up item by item, so a seed that
    all items share needs no more memory than the items do.
    """
    doc_of = np.repeat(np.arange(len(doc_at) - 1), np.diff(doc_at))
    for size, (seed, of, at, maybe) in shard.index.items():
        g = grams(words, size)
        where = np.flatnonzero(maybe[(g >> U64(42)).astype(np.int64)])
        where = where[doc_of[where] == doc_of[where + size - 1]]
        low, high = np.searchsorted(seed, g[where], "left"), np.searchsorted(seed, g[where], "right")
        where, low, high = where[high > low], low[high > low], high[high > low]
        rows = doc_of[where]
        # a seed that a document repeats covers an item's words once
        order = np.lexsort((low, rows))
        once = order[np.concatenate([[True], (np.diff(low[order]) != 0) | (np.diff(rows[order]) != 0)])] if len(order) else order
        for row, item in _covered(rows[once], low[once], high[once], of, at, size, np.ceil(coverage * shard.lengths - 1e-9)):
            own = where[np.searchsorted(rows, row) : np.searchsorted(rows, row, "right")]
            held = shard.seeds_of(item, size)
            place = own[np.isin(g[own], held)]
            # only words under some seed can be in a tile; gaps between them are kept apart by a number that no item holds
            under = np.unique((place[:, None] + np.arange(size)).ravel())
            gaps = np.flatnonzero(np.diff(under) > 1) + 1
            marked = tiles(shard.items[item], np.insert(words[under], gaps, U64(0)), size)
            n = sum(x[0] for x in marked)
            if n >= coverage * shard.lengths[item]:
                yield row, item, n / int(shard.lengths[item]), len(marked), n


def _covered(rows: np.ndarray, low: np.ndarray, high: np.ndarray, of: np.ndarray, at: np.ndarray, size: int, least: np.ndarray) -> Iterator[tuple[int, int]]:
    """(row, item): whose words under shared seeds, given as index runs low to high in order of row, are `least` of the item or more."""
    n = high - low
    upto = np.cumsum(n)
    first = 0
    while first < len(rows):
        # whole rows of about MEETINGS pairs; a row with more is worked off in ranges of items
        end = int(np.searchsorted(upto, (upto[first - 1] if first else 0) + MEETINGS, "right"))
        end = int(np.searchsorted(rows, rows[end], "left")) if end < len(rows) else end
        end = end if end > first else int(np.searchsorted(rows, rows[first], "right"))
        many = int(upto[end - 1] - (upto[first - 1] if first else 0))
        parts = -(-many // MEETINGS)
        for part in range(parts):
            a, b = low[first:end], high[first:end]
            if parts > 1:  # within a run of one seed items ascend
                cut = lambda item, a=a, b=b: np.array([x + np.searchsorted(of[x:y], item) for x, y in zip(a, b, strict=True)])
                a, b = cut(part * len(least) // parts), cut((part + 1) * len(least) // parts)
            m = b - a
            if not m.sum():
                continue
            place = np.repeat(a, m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            key = np.repeat(rows[first:end], m) * len(least) + of[place]
            spot = at[place]
            by = np.lexsort((spot, key))
            key, spot = key[by], spot[by]
            # each seed adds the words up to the pair's next one, at most its size
            same = key[1:] == key[:-1]
            gain = np.full(len(key), size)
            gain[:-1][same] = np.minimum(size, np.diff(spot)[same])
            starts = np.flatnonzero(np.concatenate([[True], ~same]))
            key, gain = key[starts], np.add.reduceat(gain, starts)
            for x in key[gain >= least[key % len(least)]].tolist():
                yield divmod(x, len(least))
        first = end


def contaminated(docs: DataFrame, benchmark: DataFrame, k: int = 4, coverage: float = 0.5) -> DataFrame:
    """(doc_id, item_id, coverage, n_tiles, n_words): pairs of a document and a test item of whose words tiles of at least k words cover the share `coverage` or more.

    Words are compared without the case of A-Z. An item of fewer than k words must occur whole. Null and
    empty texts match nothing; rows repeated in a table give repeated pairs; extra columns are ignored. Documents
    are read once for every SHARD_WORDS words of the benchmark and never shuffled.
    """
    items = benchmark.select("item_id", F.col("text").cast("string")).filter("text is not null")
    total = items.agg(F.coalesce(F.sum(F.size(F.split("text", r"[\x20\x09-\x0D]+"))), F.lit(0))).first()[0]
    n_shards = max(1, math.ceil(total / SHARD_WORDS))
    spark, source = docs.sparkSession, docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    item_type = benchmark.schema["item_id"].dataType
    schema = f"doc_id long, item_id {item_type.simpleString()}, coverage double, n_tiles int, n_words int"
    out = None
    for number in range(n_shards):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_shards)) == number).collect()  # about SHARD_WORDS words
        shared = spark.sparkContext.broadcast(Shard([r.item_id for r in rows], [r.text for r in rows], k))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            shard = shared.value
            for batch in batches:
                ids = batch.column("doc_id")
                for first, _, raw, at in blocks(batch.column("text")):
                    words, doc_at, _, _ = word_hashes(raw, at)
                    found = list(leaks(shard, words, doc_at, coverage))
                    if found:
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array([first + x[0] for x in found])), pa.array([shard.ids[x[1]] for x in found]), pa.array([x[2] for x in found], pa.float64()), pa.array([x[3] for x in found], pa.int32()), pa.array([x[4] for x in found], pa.int32())], ["doc_id", "item_id", "coverage", "n_tiles", "n_words"])

        part = source.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, k: int = 4, coverage: float = 0.5) -> DataFrame:
    """The rows of `docs` that hold no test item; a row with a null doc_id stays."""
    (own,) = free_names(docs, "_gone_id")
    gone = contaminated(docs, benchmark, k, coverage).select(F.col("doc_id").alias(own)).distinct()
    return docs.join(gone, F.col("doc_id").cast("long") == F.col(own), "left_anti")
