"""Phrases whose words occur together more often than alone, by merged stripes.

Every word occurrence adds one to the stripe of its word: an associative counter of the words that follow it, each
with a counter of the words that follow both; where a piece of text ends, an end mark follows. A task adds up the
stripes of a million words at a time and hands them on packed by bucket of their prefix, and the stripes of a bucket
are merged elementwise. A merged stripe gives everything at once: the frequencies of its phrases of two and three words
(the extensions), the frequencies of its prefixes (the totals, ends included) and for each pair the most frequent
phrase that continues it, which decides whether it is subsumed on the right; the maximum over the first words
of a phrase gives the same on the left.

Buckets follow from the number of words, so each holds some half a million occurrences. The stripe of a word that has more
than a quarter million is cut into cells by the hash of what follows; cells are stripes of their own, and only
the totals and maxima of such words are added up once more. Words are told apart by 64-bit hashes, phrases by
the hashes of all their words; a count of the words, a table of its own, gives them their strings.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scholiast.llm.store import broadcast_if_small, stored, tidy
from scholiast.llm.tokens import U64, blocks, mix, span_hashes, spans, word_strings

#: Words that a task counts before it hands on their stripes; occurrences of one bucket; least occurrences of one cell.
FLUSH_WORDS, BUCKET_WORDS, CELL_WORDS = 1 << 20, 1 << 19, 1 << 18
#: Cells of all hot words together, so that their table has a bound.
MOST_CELLS = 1 << 20
_STOP = np.zeros(256, bool)
_STOP[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_GAP = _STOP.copy()
_GAP[[0x20, 0x09]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def _by_lang(batch: pa.RecordBatch) -> Iterator[tuple[str, pa.Array]]:
    """(lang, texts) of a batch's rows."""
    langs = batch.column("lang").fill_null("und").dictionary_encode()
    numbers = langs.indices.to_numpy()
    order = np.argsort(numbers, kind="stable")
    ends = np.searchsorted(numbers[order], np.arange(len(langs.dictionary)), "right").tolist()
    for lang, first, end in zip(langs.dictionary.to_pylist(), [0, *ends], ends, strict=False):
        yield lang, batch.column("text").take(pa.array(order[first:end]))


def _words(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(codes, whether a word begins a piece, first byte, end byte) of the words of a block."""
    starts, ends, row_at = spans(raw, at, _GAP[raw])
    codes = np.maximum(span_hashes(raw, starts, ends), U64(1)) if len(starts) else np.zeros(0, U64)
    piece = np.cumsum(_STOP[raw])[starts]
    begins = np.ones(len(starts), bool)
    begins[1:] = piece[1:] != piece[:-1]
    begins[row_at[row_at < len(starts)]] = True
    return codes, begins, starts, ends


def vocabulary(docs: DataFrame) -> DataFrame:
    """(lang, code, word, f): how often each word of each language occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, texts in _by_lang(batch):
                for _, _, raw, at in blocks(texts, 1 << 21):
                    codes, _, starts, ends = _words(raw, at)
                    found, first, counts = np.unique(codes, return_index=True, return_counts=True)
                    words = word_strings(_LOWER[raw], starts, ends, _GAP[raw]).take(pa.array(first)).cast(pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(found.view(np.int64)), words, pa.array(counts)], ["lang", "code", "word", "f"])

    found = docs.select(F.col("lang").cast("string"), F.col("text").cast("string")).mapInArrow(run, "lang string, code long, word string, f long")
    return found.groupBy("lang", "code", "word").agg(F.sum("f").alias("f"))


def summed(codes: np.ndarray, ranks: tuple[np.ndarray, ...], counts: np.ndarray | None) -> tuple[np.ndarray, ...]:
    """(w1, w2, w3, count) of distinct triples of ranks among sorted codes, in order; `counts` adds up, none being one each."""
    n, bits = len(ranks[0]), max(1, int(len(codes)).bit_length())
    if 3 * bits <= 63:
        keys = (ranks[0] << (2 * bits)) | (ranks[1] << bits) | ranks[2]
        del ranks
        if counts is None:
            keys, counts = np.unique(keys, return_counts=True)
        else:
            order = np.argsort(keys)
            keys, counts = keys[order], counts[order]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if n else np.zeros(0, np.int64)
            keys, counts = keys[first], np.add.reduceat(counts, first) if n else counts
        mask = (1 << bits) - 1
        return codes[keys >> (2 * bits)], codes[(keys >> bits) & mask], codes[keys & mask], counts
    order = np.lexsort((ranks[2], ranks[1], ranks[0]))
    r = [x[order] for x in ranks]
    first = np.flatnonzero(np.concatenate([[True], (r[0][1:] != r[0][:-1]) | (r[1][1:] != r[1][:-1]) | (r[2][1:] != r[2][:-1])]))
    counts = np.add.reduceat(np.ones(n, np.int64) if counts is None else counts[order], first)
    return (*(codes[x[first]] for x in r), counts)


def counted(line: np.ndarray) -> tuple[np.ndarray, ...]:
    """(w1, w2, w3, count) of the words of a line of codes, two end marks after the last piece: w3 is an end where w2 is."""
    codes, ranks = np.unique(line, return_inverse=True)
    at = np.flatnonzero(line)
    second = ranks[at + 1]
    third = np.where(second == 0, 0, ranks[at + 2])  # the end mark is the smallest code
    first = ranks[at]
    del line, ranks, at
    return summed(codes, (first, second, third), None)


class Hot:
    """The words whose stripes are cut, per language: sorted codes and how many cells each has."""

    def __init__(self, rows: list[tuple[str, int, int]]):
        self.of: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        by_lang: dict[str, list[tuple[int, int]]] = {}
        for lang, code, cells in rows:
            by_lang.setdefault(lang, []).append((code % (1 << 64), cells))
        for lang, pairs in by_lang.items():
            codes, cells = zip(*sorted(pairs), strict=True)
            self.of[lang] = np.array(codes, U64), np.array(cells, U64)

    def cells(self, lang: str, w1: np.ndarray) -> np.ndarray:
        """Cells of each word: 1 where the stripe is whole."""
        out = np.ones(len(w1), U64)
        if lang in self.of and len(w1):
            codes, cells = self.of[lang]
            at = np.minimum(np.searchsorted(codes, w1), len(codes) - 1)
            out = np.where(codes[at] == w1, cells[at], out)
        return out


def _packed(lang: str, entries: tuple[np.ndarray, ...], hot: Hot, buckets: int) -> pa.RecordBatch:
    """One row for each bucket: the stripes that belong to it, as (prefix, next word, word after it) with the sizes of each level."""
    w1, w2, w3, counts = entries
    cells = hot.cells(lang, w1)
    cell = np.where(cells > 1, mix(w2 * U64(0x9E3779B97F4A7C15) + w3) % cells, U64(0))
    bucket = (mix(w1 + cell * U64(0xD1342543DE82EF95)) % U64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    w1, w2, w3, counts, bucket = (x[order] for x in (w1, w2, w3, counts, bucket))
    n = len(w1)
    new1 = np.ones(n, bool)
    new1[1:] = (w1[1:] != w1[:-1]) | (bucket[1:] != bucket[:-1])
    new2 = new1.copy()
    new2[1:] |= w2[1:] != w2[:-1]
    first1, first2 = np.flatnonzero(new1), np.flatnonzero(new2)
    pairs = np.diff(np.append(np.searchsorted(first2, first1), len(first2)))
    thirds = np.diff(np.append(first2, n))
    numbers = np.unique(bucket)

    def cut(values: np.ndarray, of: np.ndarray, kind: str) -> pa.Array:
        at = np.append(np.searchsorted(of, numbers), len(of)) * np.dtype(kind).itemsize
        return pa.Array.from_buffers(pa.binary(), len(numbers), [None, pa.py_buffer(at.astype(np.int32).tobytes()), pa.py_buffer(values.astype(kind).tobytes())])

    columns = [cut(w1[first1], bucket[first1], "<u8"), cut(pairs, bucket[first1], "<u4"), cut(w2[first2], bucket[first2], "<u8"), cut(thirds, bucket[first2], "<u4"), cut(w3, bucket, "<u8"), cut(counts, bucket, "<u4")]
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(numbers), pa.string()), pa.array(numbers), *columns], ["lang", "bucket", "w1", "n1", "w2", "n2", "w3", "c"])


def stripes(docs: DataFrame, hot: Hot, buckets: int) -> DataFrame:
    """(lang, bucket, packed stripes): what each task has added up."""
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                yield _packed(lang, counted(np.concatenate([*parts, np.zeros(2, U64)])), shared.value, buckets)
            held.clear()

        for batch in batches:
            for lang, texts in _by_lang(batch):
                for _, _, raw, at in blocks(texts):
                    codes, begins, _, _ = _words(raw, at)
                    if not len(codes):
                        continue
                    if size + len(codes) > FLUSH_WORDS:
                        yield from flush()
                        size = 0
                    line = np.zeros(len(codes) + int(begins.sum()), U64)  # an end mark before each piece but the first and after the last
                    line[np.arange(len(codes)) + np.cumsum(begins) - 1] = codes
                    held.setdefault(lang, []).append(line)
                    size += len(codes)
        yield from flush()

    schema = "lang string, bucket long, w1 binary, n1 binary, w2 binary, n2 binary, w3 binary, c binary"
    return docs.select(F.col("lang").cast("string"), F.col("text").cast("string")).mapInArrow(run, schema)


def _numbers(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_buffer() for chunk in column.chunks for x in chunk), kind)


def merged(packed: DataFrame, hot: Hot, least: int) -> DataFrame:
    """(k, lang, w1, w2, w3, a, m): phrases of k words with at least `least` occurrences a, and for k = 2 the most that a phrase of three words continuing it has (m). Of hot words all cells' parts, for k under 3 not added up."""
    shared = packed.sparkSession.sparkContext.broadcast(hot)
    names = ["k", "lang", "w1", "w2", "w3", "a", "m"]

    def merge(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        lang = key[0].as_py()
        n1, n2 = _numbers(group["n1"], "<u4"), _numbers(group["n2"], "<u4")
        w1 = np.repeat(np.repeat(_numbers(group["w1"], "<u8"), n1), n2)
        words = w1, np.repeat(_numbers(group["w2"], "<u8"), n2), _numbers(group["w3"], "<u8")
        codes, ranks = np.unique(np.concatenate(words), return_inverse=True)
        w1, w2, w3, c = summed(codes, tuple(np.split(ranks, 3)), _numbers(group["c"], "<u4").astype(np.int64))
        new1 = np.ones(len(w1), bool)
        new1[1:] = w1[1:] != w1[:-1]
        new2 = new1.copy()
        new2[1:] |= w2[1:] != w2[:-1]
        first1, first2 = np.flatnonzero(new1), np.flatnonzero(new2)
        totals, pairs = np.add.reduceat(c, first1), np.add.reduceat(c, first2)
        most = np.maximum.reduceat(np.where(w3 == 0, 0, c), first2)
        part = shared.value.cells(lang, w1) > 1
        keep1 = part[first1] | (totals >= least)
        keep2 = (w2[first2] != 0) & (part[first2] | (pairs >= least))
        keep3 = (w3 != 0) & (c >= least)
        none1, none2 = np.zeros(keep1.sum(), np.int64), np.zeros(keep2.sum(), np.int64)
        at1, at2 = first1[keep1], first2[keep2]
        columns = [
            np.repeat([1, 2, 3], [keep1.sum(), keep2.sum(), keep3.sum()]),
            np.concatenate([w1[at1], w1[at2], w1[keep3]]).view(np.int64),
            np.concatenate([none1, w2[at2].view(np.int64), w2[keep3].view(np.int64)]),
            np.concatenate([none1, none2, w3[keep3].view(np.int64)]),
            np.concatenate([totals[keep1], pairs[keep2], c[keep3]]),
            np.concatenate([none1, most[keep2], np.zeros(keep3.sum(), np.int64)]),
        ]
        arrays = [pa.array(x) for x in columns]
        return pa.table([arrays[0], pa.array([lang] * len(arrays[0]), pa.string()), *arrays[1:]], names)

    return packed.groupBy("lang", "bucket").applyInArrow(merge, "k long, lang string, w1 long, w2 long, w3 long, a long, m long")


def _ranked(rows: DataFrame, top: int, expected: int) -> DataFrame:
    """The first `top` rows of each language with their rank: first of pieces of each language, then of what these leave, so that no task sees more than some square root of all."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    pieces = max(1, math.ceil(math.sqrt(expected / top)))
    piece = F.pmod(F.xxhash64("phrase"), F.lit(pieces))
    first = rows.withColumn("piece", piece).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "piece").orderBy(*order))).filter(F.col("rank") <= top)
    return first.drop("piece").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)


@tidy
def collocations(docs: DataFrame, least: int = 10, inside: int = 50, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the `top` phrases of two and three words of each language with the highest scores.

    Texts, A-Z in lower case, are cut at `[.,;:!?\\x0A-\\x0D]` into pieces and these into words `[^\\x20\\x09]+`. f counts a
    phrase's occurrences within pieces, overlaps included; candidates have a = f >= `least`. Cut after its first k words a
    candidate has l = f(first part), r = f(rest) and the score floor(1000000 a a / (l r)); its lowest cut counts, ties by the
    smaller k. Candidates within a longer candidate (dropped or not) with 100 f(longer) >= `inside` * a are left out. Order: score, then a,
    both descending, then phrase by its bytes. Null texts are empty, a null lang is `und`; repeated rows count as often as they
    stand; doc_id and other columns aren't looked at. An empty table gives no rows. Numbers are added as longs and multiplied as decimals of 38 digits.
    """
    words = stored(vocabulary(docs), "vocabulary")
    total = words.agg(F.sum("f")).first()[0] or 0
    per = max(CELL_WORDS, total // MOST_CELLS)
    hot = Hot([(r.lang, r.code, -(-r.f // per)) for r in words.filter(F.col("f") > per).select("lang", "code", "f").toLocalIterator()])
    parts = merged(stripes(docs, hot, max(1, total // BUCKET_WORDS)), hot, least)
    sums = parts.groupBy("k", "lang", "w1", "w2", "w3").agg(F.sum("a").alias("a"), F.max("m").alias("m"))
    counts = stored(sums.filter(F.col("a") >= least), "counts")
    known = words.filter(F.col("f") >= least).select("lang", "code", "word")
    single = counts.filter("k = 1").select("lang", F.col("w1").alias("code"), F.col("a").alias("f")).join(known, ["lang", "code"])
    single = stored(single, "single")

    def word(i: int) -> DataFrame:
        return broadcast_if_small(single.select("lang", F.col("code").alias(f"w{i}"), F.col("f").alias(f"f{i}"), F.col("word").alias(f"s{i}")))

    pairs, triples = counts.filter("k = 2").select("lang", "w1", "w2", "a", "m"), counts.filter("k = 3").select("lang", "w1", "w2", "w3", "a")
    left = triples.groupBy("lang", F.col("w2").alias("w1"), F.col("w3").alias("w2")).agg(F.max("a").alias("before"))
    longer = F.greatest(F.coalesce("before", F.lit(0)), F.when(F.col("m") >= least, F.col("m")).otherwise(0))
    twos = pairs.join(left, ["lang", "w1", "w2"], "left").filter(longer * 100 < F.col("a") * inside)
    twos = twos.join(word(1), ["lang", "w1"]).join(word(2), ["lang", "w2"])
    score = "(1000000 * CAST(a AS DECIMAL(19)) * CAST(a AS DECIMAL(19))) div (CAST({} AS DECIMAL(19)) * CAST({} AS DECIMAL(19)))"
    twos = twos.select("lang", F.concat_ws(" ", "s1", "s2").alias("phrase"), "a", F.col("f1").alias("l"), F.col("f2").alias("r"), F.expr(score.format("f1", "f2")).alias("score"))
    first, last = (pairs.select("lang", F.col("w1").alias(x), F.col("w2").alias(y), F.col("a").alias(f)) for x, y, f in (("w1", "w2", "f12"), ("w2", "w3", "f23")))
    threes = triples.join(first, ["lang", "w1", "w2"]).join(last, ["lang", "w2", "w3"]).join(word(1), ["lang", "w1"]).join(word(2).drop("f2"), ["lang", "w2"]).join(word(3), ["lang", "w3"])
    threes = threes.withColumns({"one": F.expr(score.format("f1", "f23")), "two": F.expr(score.format("f12", "f3"))})
    cut = [F.when(F.col("one") <= F.col("two"), F.col(x)).otherwise(F.col(y)) for x, y in (("f1", "f12"), ("f23", "f3"), ("one", "two"))]
    threes = threes.select("lang", F.concat_ws(" ", "s1", "s2", "s3").alias("phrase"), "a", cut[0].alias("l"), cut[1].alias("r"), cut[2].alias("score"))
    sizes = words.groupBy("lang").agg(F.sum("f").alias("n"))
    out = stored(_ranked(twos.unionByName(threes), top, counts.count()), "ranked").join(broadcast_if_small(stored(sizes, "sizes")), "lang")
    return out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
