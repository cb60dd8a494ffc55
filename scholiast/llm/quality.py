"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE words. A passage is encoded as tanh of the mean of learned
vectors of its words and of their shapes, plus a projection of a few character rates. Gated attention
weighs the passages; the weighted sum is scored. All weights are learned together from document labels.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import zip_longest

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholiast.llm.store import drop, hashed_sample, store
from scholiast.llm.tokens import U64, blocks, mix, word_hashes

PASSAGE = 64
WORD_BUCKETS = 1 << 13
SHAPE_BUCKETS = 1 << 10
DIM, GATE = 16, 8

# character classes: 0 other ASCII, 1 lower, 2 upper, 3 digit, 4 beyond ASCII; every punctuation mark is a class of its own
_CLASS = np.zeros(256, np.uint8)
_CLASS[ord("a") : ord("z") + 1], _CLASS[ord("A") : ord("Z") + 1], _CLASS[ord("0") : ord("9") + 1], _CLASS[128:] = 1, 2, 3, 4
for _i in range(33, 127):
    if not chr(_i).isalnum():
        _CLASS[_i] = _i
_RATES = ("upper", "digit", "mark", "high", "length", "single")


class Bags:
    """Passages of some texts: words as bucket numbers, and where passages and texts begin."""

    def __init__(self, words: np.ndarray, shapes: np.ndarray, rates: np.ndarray, word_at: np.ndarray, passage_at: np.ndarray):
        self.words, self.shapes, self.rates, self.word_at, self.passage_at = words, shapes, rates, word_at, passage_at

    def part(self, first: int, end: int) -> Bags:
        p, q = self.passage_at[first], self.passage_at[end]
        a, b = self.word_at[p], self.word_at[q]
        return Bags(self.words[a:b], self.shapes[a:b], self.rates[p:q], self.word_at[p : q + 1] - a, self.passage_at[first : end + 1] - p)


def bags(raw: np.ndarray, at: np.ndarray) -> Bags:
    """Cuts texts into passages. A text without words is one empty passage."""
    hashes, doc_at, starts, ends = word_hashes(raw, at)
    n_words = np.diff(doc_at)
    n_passages = np.maximum(1, -(-n_words // PASSAGE))
    passage_at = np.concatenate([[0], np.cumsum(n_passages)])
    of = np.repeat(np.arange(len(n_words)), n_passages)
    nth = np.arange(passage_at[-1]) - passage_at[of]
    word_at = np.concatenate([np.minimum(doc_at[of] + nth * PASSAGE, doc_at[of + 1]), doc_at[-1:]])
    kind = _CLASS[raw]
    if len(hashes):
        first, last = kind[starts].astype(U64), kind[ends - 1].astype(U64)
        second, before = kind[np.minimum(starts + 1, ends - 1)].astype(U64), kind[np.maximum(ends - 2, starts)].astype(U64)
        long = np.minimum(ends - starts, 12).astype(U64)
        shapes = (mix((((first * U64(131) + second) * U64(131) + before) * U64(131) + last) * U64(16) + long) % U64(SHAPE_BUCKETS)).astype(np.uint16)
        sums = np.zeros((len(raw) + 1, 4), np.int32)
        for j, test in enumerate((kind == 2, kind == 3, kind > 4, kind == 4)):
            np.cumsum(test, out=sums[1:, j])
        rows = np.column_stack([sums[ends] - sums[starts], np.minimum(ends - starts, 40), ends - starts == 1]).astype(np.float32)
    else:
        shapes, rows = np.zeros(0, np.uint16), np.zeros((0, len(_RATES)), np.float32)
    total = np.concatenate([np.zeros((1, rows.shape[1])), np.cumsum(rows, 0, dtype=np.float64)])
    many = np.maximum(1, np.diff(word_at))[:, None]
    rates = (total[word_at[1:]] - total[word_at[:-1]]) / many
    rates[:, :4] /= np.maximum(1, rates[:, 4:5])
    rates[:, 4] /= 8
    return Bags((hashes % U64(WORD_BUCKETS)).astype(np.uint16), shapes, rates.astype(np.float32), word_at, passage_at)


def joined(parts: list[Bags]) -> Bags:
    """The bags of all parts, in order."""
    words, passages = (np.cumsum([0, *(len(x) for x in sizes)]) for sizes in ([q.words for q in parts], [q.rates for q in parts]))
    over = lambda name, shift: np.concatenate([*(getattr(q, name)[:-1] + s for q, s in zip(parts, shift, strict=False)), shift[-1:]])
    return Bags(*(np.concatenate([getattr(q, name) for q in parts]) for name in ("words", "shapes", "rates")), over("word_at", words), over("passage_at", passages))


def _means(table: np.ndarray, rows: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Mean of table[rows] over each passage; zero for an empty one."""
    out = np.zeros((len(at) - 1, table.shape[1]), np.float32)
    full = np.flatnonzero(np.diff(at))
    if len(full):
        out[full] = np.add.reduceat(table[rows], at[full], axis=0) / np.diff(at)[full][:, None]
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Model:
    """Encoder, gated attention and classifier; `fit` learns them by Adam on whole bags."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        small = lambda *shape, by=0.1: (r.standard_normal(shape) * by).astype(np.float32)
        self.p = {"word": small(WORD_BUCKETS, DIM, by=0.02), "shape": small(SHAPE_BUCKETS, DIM, by=0.3), "rate": small(len(_RATES), DIM, by=0.5), "bias": np.zeros(DIM, np.float32), "v": small(DIM, GATE, by=0.4), "u": small(DIM, GATE, by=0.4), "w": small(GATE, by=0.4), "out": small(DIM, by=0.4), "at": np.zeros(1, np.float32)}

    def forward(self, x: Bags) -> tuple[np.ndarray, tuple]:
        p = self.p
        h = np.tanh(_means(p["word"], x.words, x.word_at) + _means(p["shape"], x.shapes, x.word_at) + x.rates @ p["rate"] + p["bias"])
        t, s = np.tanh(h @ p["v"]), _sigmoid(h @ p["u"])
        a = (t * s) @ p["w"]
        first, n = x.passage_at[:-1], np.diff(x.passage_at)
        a = np.exp(a - np.repeat(np.maximum.reduceat(a, first), n))
        a /= np.repeat(np.add.reduceat(a, first), n)
        z = np.add.reduceat(a[:, None] * h, first, axis=0)
        return _sigmoid(z @ p["out"] + p["at"]), (h, t, s, a, z, first, n)

    def scores(self, x: Bags) -> np.ndarray:
        return self.forward(x)[0] if len(x.passage_at) > 1 else np.zeros(0)

    def gradient(self, x: Bags, label: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        y, (h, t, s, a, z, first, n) = self.forward(x)
        d = ((y - label) * weight / weight.sum()).astype(np.float32)
        g = {"out": z.T @ d, "at": d.sum(keepdims=True)}
        dz = np.repeat(d[:, None] * p["out"], n, axis=0)
        da = (dz * h).sum(1)
        da = a * (da - np.repeat(np.add.reduceat(a * da, first), n))
        g["w"] = (t * s).T @ da
        dt, ds = da[:, None] * p["w"] * s * (1 - t * t), da[:, None] * p["w"] * t * s * (1 - s)
        g["v"], g["u"] = h.T @ dt, h.T @ ds
        dh = (a[:, None] * dz + dt @ p["v"].T + ds @ p["u"].T) * (1 - h * h)
        g["rate"], g["bias"] = x.rates.T @ dh, dh.sum(0)
        size = np.diff(x.word_at)
        each = np.repeat(dh / np.maximum(1, size)[:, None], size, axis=0)
        for name, rows in (("word", x.words), ("shape", x.shapes)):
            g[name] = np.column_stack([np.bincount(rows, each[:, j], len(p[name])) for j in range(DIM)]) if len(rows) else np.zeros_like(p[name])
        return g

    def fit(self, x: Bags, labels: np.ndarray, rounds: int = 6, batch: int = 64, rate: float = 0.01, decay: float = 1e-4) -> Model:
        """Both classes weigh the same in all; the order of bags is fixed by a seed."""
        r, n = np.random.default_rng(11), len(labels)
        weights = np.where(labels == 1, 0.5 / max(1, labels.sum()), 0.5 / max(1, n - labels.sum())) * n
        first, second, step = {k: np.zeros_like(v) for k, v in self.p.items()}, {k: np.zeros_like(v) for k, v in self.p.items()}, 0
        for _ in range(rounds):
            order = r.permutation(n)
            for i in range(0, n, batch):
                ids = order[i : i + batch]
                step += 1
                for k, g in self.gradient(joined([x.part(j, j + 1) for j in ids]), labels[ids], weights[ids]).items():
                    g = g.astype(np.float32) + decay * self.p[k]
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    self.p[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-7)
        return self


def held_out() -> Column:
    """Documents from whose labels nothing is learned."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1


def train(docs: DataFrame, labels: DataFrame, per_class: int = 2500, most_mb: float = 64) -> Model | float:
    """A model learned from at most `per_class` labelled documents of each class, those whose hashed ids are smallest; whole texts.

    Documents are taken in that order, both classes in turn; one whose text doesn't fit in what is left of `most_mb` MB is
    passed over. Where the labels have one class only, the smoothed share of label 1 stands in for a model. Null labels and labels of no document are left out;
    of several labels of one document the largest counts, of several texts of one doc_id the first in order.
    """
    known = labels.filter("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") >= 1).cast("int")).alias("label"))
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    sized = texts.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size")).join(known.filter(~held_out()), "doc_id")
    there, path = store(sized.groupBy("doc_id").agg(F.max("label").alias("label"), F.max("size").alias("size")), "labelled")
    picked = [hashed_sample(there.filter(F.col("label") == c), ["doc_id"], per_class).to_pylist() for c in (0, 1)]
    drop(docs.sparkSession, path)
    if not all(picked):
        n, good = sum(map(len, picked)), len(picked[1])
        return float((good + 1) / (n + 2))
    chosen, left = [], most_mb * 1e6
    for row in (row for pair in zip_longest(*picked) for row in pair if row):
        if row["size"] <= left or len(chosen) < 2:  # one document of each class at least
            chosen.append((row["doc_id"], row["label"]))
            left -= row["size"]
    own = docs.sparkSession.createDataFrame(chosen, "doc_id long, label int")  # at most 2 * per_class pairs of numbers
    sample = texts.join(F.broadcast(own), "doc_id").groupBy("doc_id", "label").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    sample = sample.toArrow()
    order = pc.sort_indices(sample.column("doc_id"))
    label = sample.column("label").take(order).to_numpy().astype(np.int64)
    # some texts at a time: the driver holds the sample once, and of its words only their bucket numbers
    parts = [bags(raw, at) for i in range(0, len(order), 256) for chunk in sample.column("text").take(order.slice(i, 256)).chunks for _, _, raw, at in blocks(chunk)]
    del sample
    whole = joined(parts)
    del parts
    pa.default_memory_pool().release_unused()
    return Model().fit(whole, label)


def score_quality(docs: DataFrame, model: Model | float) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, held_out, score, predicted. Null text counts as empty; extra columns are ignored. The model, some 150,000 numbers whatever the input, goes to every worker."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for first, end, raw, at in blocks(batch.column("text")):
                score = own.scores(bags(raw, at)).astype(np.float64) if isinstance(own, Model) else np.full(end - first, own)
                yield pa.record_batch([batch.column("doc_id").slice(first, end - first), pa.array(score)], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, per_class: int = 2500) -> DataFrame:
    """The rows of `docs` that a model learned from `labels` predicts to be good. A row is judged by its own text, without a join."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, per_class))
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            keep = [own.scores(bags(raw, at)) >= 0.5 if isinstance(own, Model) else np.full(end - first, own >= 0.5) for first, end, raw, at in blocks(batch.column("text"))]
            if keep:
                yield batch.filter(pa.array(np.concatenate(keep)))

    return docs.mapInArrow(run, schema)
