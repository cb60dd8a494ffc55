"""Line dedup by a deletion-neighbourhood join.

A line is a sequence of words; its edit distance to another counts words inserted, deleted or
replaced. Lines within one edit share a variant: the line itself or what is left of it without one
word. Equal lines are merged first, then every distinct line that can have a partner emits all its
variants as hashed keys, equal keys meet, and the distance is verified by the positions deleted: equal
variants mean one replaced word if the same position was deleted in both, and one inserted word if
nothing was deleted in one of them; any other meeting is two edits apart. The earliest line stays.

A line can only have a partner if its first or its last half occurs in another line of its length or
one word more or less (an edit leaves one half as it is), which is found by one aggregation and loses
no partner.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholiast.llm.store import free_names, stored, tidy
from scholiast.llm.tokens import U64, blocks, cached_powers, mix, word_hashes

#: Lines of fewer words are only compared as a whole: one edit would be too much of them.
NEAR_WORDS = 10
_BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


class Lines:
    """The lines of a block of texts that have words, with prefix sums that give the hash of any run of words."""

    def __init__(self, raw: np.ndarray, at: np.ndarray):
        words, _, starts, _ = word_hashes(raw, at)
        breaks = np.flatnonzero(raw == 10) + 1
        begins = np.unique(np.concatenate([at[:-1], breaks[breaks < len(raw)]])).astype(np.int64)
        row = np.minimum(np.searchsorted(at, begins, "right") - 1, len(at) - 2)
        # rows without bytes begin where the next one does and have no line of their own here
        number = np.arange(len(begins)) - np.searchsorted(begins, at[:-1])[row]
        word_at = np.searchsorted(starts, np.concatenate([begins, [len(raw)]]))
        full = np.flatnonzero(np.diff(word_at))
        self.row, self.number = row[full], number[full]
        self.first, self.n = word_at[full], np.diff(word_at)[full]
        self.words = words
        self.sums = [np.concatenate([np.zeros(1, U64), np.cumsum(words * cached_powers(b, len(words)), dtype=U64)]) for b in _BASES]

    def run(self, which: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Position-free hash of the words a..b."""
        base = _BASES[which]
        return (self.sums[which][b] - self.sums[which][a]) * cached_powers(pow(base, -1, 1 << 64), len(self.words) + 1)[a]

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        size = self.n.astype(U64)
        return tuple(mix(self.run(j, self.first, self.first + self.n) + size * U64(0x9E3779B97F4A7C15)) for j in (0, 1))

    def halves(self) -> list[np.ndarray]:
        """For partners of at most n words and of n + 1 words: hashes of the first and of the last half."""
        out = []
        for longest in (self.n, self.n + 1):
            half = (longest - 1) // 2
            size = longest.astype(U64) * U64(2)
            out.append(mix(self.run(0, self.first, self.first + half) + size * U64(0xC2B2AE3D27D4EB4F)))
            out.append(mix(self.run(0, self.first + self.n - half, self.first + self.n) + (size + U64(1)) * U64(0xC2B2AE3D27D4EB4F)))
        return out

    def variants(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(line, deleted position or -1, two keys) of every line and every line without one word."""
        many = self.n + 1
        line = np.repeat(np.arange(len(many)), many)
        position = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) - 1
        first, end = self.first[line], self.first[line] + self.n[line]
        cut = np.where(position < 0, end, first + position)
        after = np.where(position < 0, end, cut + 1)
        size = (self.n[line] - (position >= 0)).astype(U64)
        keys = []
        for j, base in enumerate(_BASES):
            moved = cached_powers(base, len(self.words) + 1)[cut - first]
            tail = np.where(after < end, self.run(j, np.minimum(after, len(self.words)), end), U64(0))
            keys.append(mix(self.run(j, first, cut) + tail * moved + size * U64(0x9E3779B97F4A7C15)))
        return line, position, keys[0], keys[1]


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def line_table(docs: DataFrame) -> DataFrame:
    """(doc_id, line, n, key1, key2, h1..h4) for every line with words; lines are split at \\n and numbered from 0."""
    names = ["doc_id", "line", "n", "key1", "key2", "h1", "h2", "h3", "h4"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, _, raw, at in blocks(batch.column("text")):
                lines = Lines(raw, at)
                ids = batch.column("doc_id").take(pa.array(first + lines.row))
                yield pa.RecordBatch.from_arrays([ids, pa.array(lines.number), pa.array(lines.n.astype(np.int64)), *map(_long, lines.keys()), *map(_long, lines.halves())], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, ", ".join(f"{n} long" for n in names))


def _variant_table(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, line, n, position, v1, v2) for the lines that `wanted` (id, numbers) names."""
    names = ["doc_id", "line", "n", "position", "v1", "v2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = batch.column("numbers").to_pylist()
            for first, _, raw, at in blocks(batch.column("text")):
                lines = Lines(raw, at)
                wanted_here = {i: frozenset(numbers[first + i]) for i in np.unique(lines.row).tolist()}
                keep = np.array([x in wanted_here[r] for r, x in zip(lines.row.tolist(), lines.number.tolist(), strict=True)], bool)
                for part in ("row", "number", "first", "n"):
                    setattr(lines, part, getattr(lines, part)[keep])
                line, position, v1, v2 = lines.variants()
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(first + lines.row[line])), pa.array(lines.number[line]), pa.array(lines.n[line].astype(np.int64)), pa.array(position.astype(np.int64)), _long(v1), _long(v2)], names)

    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(wanted, "doc_id").select("doc_id", "text", "numbers")
    return texts.mapInArrow(run, ", ".join(f"{n} long" for n in names))


def kept_lines(docs: DataFrame, near_words: int = NEAR_WORDS) -> DataFrame:
    """(doc_id, numbers): for each document the numbers of the lines that stay, the earliest of all within one edit of each other.

    Earlier is the smaller doc_id, then the smaller line number. A line goes if any earlier line is equal or,
    from `near_words` words on, within one edit, whether or not that earlier line stays itself.
    """
    lines = stored(line_table(docs.filter("doc_id is not null")), "lines")
    place = F.struct("doc_id", "line")
    distinct = lines.groupBy("key1", "key2", "n").agg(F.min(F.struct("doc_id", "line", "h1", "h2", "h3", "h4")).alias("e"))
    distinct = stored(distinct.select("n", "e.*"), "distinct")
    able = distinct.filter(F.col("n") >= near_words)
    halves = able.select(F.explode(F.array("h1", "h2", "h3", "h4")).alias("half"), "doc_id", "line")
    shared = halves.groupBy("half").agg(F.min(place).alias("x"), F.max(place).alias("y")).filter("x <> y").select("half")
    wanted = halves.join(shared, "half", "left_semi").groupBy("doc_id").agg(F.collect_set("line").alias("numbers"))
    variants = stored(_variant_table(docs, stored(wanted, "wanted")), "variants")
    # replaced words: lines that miss the same position of one variant
    replaced = variants.filter("position >= 0").groupBy("v1", "v2", "position").agg(F.min(place).alias("least"), F.count(F.lit(1)).alias("many")).filter("many > 1").select("v1", "v2", "position", "least")
    gone = variants.join(replaced, ["v1", "v2", "position"]).filter(place > F.col("least")).select("doc_id", "line")
    # inserted words: a line and what another is without one word
    whole, cut = F.when(F.col("position") < 0, place), F.when(F.col("position") >= 0, place)
    inserted = variants.groupBy("v1", "v2").agg(F.min(whole).alias("whole"), F.min(cut).alias("cut")).filter("whole is not null and cut is not null")
    met = variants.join(inserted, ["v1", "v2"])
    gone = gone.unionByName(met.filter(F.when(F.col("position") < 0, F.col("cut") < place).otherwise(F.col("whole") < place)).select("doc_id", "line"))
    stay = distinct.join(gone.distinct(), ["doc_id", "line"], "left_anti")
    return stay.groupBy("doc_id").agg(F.collect_list("line").alias("numbers"))


def _dedup(docs: DataFrame, near_words: int, counts: tuple[str, str]) -> DataFrame:
    own, numbered = free_names(docs, "_kept_id", "_numbers")
    kept = stored(kept_lines(docs, near_words), "kept").select(F.col("doc_id").alias(own), F.col("numbers").alias(numbered))
    with_kept = docs.join(kept, F.col("doc_id").cast("long") == F.col(own), "left").drop(own)
    names = docs.columns
    schema = docs.withColumns({c: F.lit(0) for c in counts}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, before, after = [], [], []
            for text, numbers, known in zip(batch.column("text").to_pylist(), batch.column(numbered).to_pylist(), batch.column("doc_id").is_valid().to_pylist(), strict=True):
                lines = (text or "").split("\n")
                full = [bool(x.strip(" \t\n\v\f\r")) for x in lines]
                stays = set(numbers or ()) if known else set(range(len(lines)))
                out.append(None if text is None else "\n".join(x for i, x in enumerate(lines) if not full[i] or i in stays))
                before.append(sum(full))
                after.append(sum(1 for i, f in enumerate(full) if f and i in stays))
            columns = [pa.array(out, pa.string()) if n == "text" else batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(before, pa.int32()), pa.array(after, pa.int32())], [*names, *counts])

    return with_kept.select(*names, numbered).mapInArrow(run, schema)


@tidy
def dedup_lines(docs: DataFrame, near_words: int = NEAR_WORDS) -> DataFrame:
    """The rows of `docs` with `text` less the lines that repeat an earlier one, and n_lines, n_kept (lines with words before and after).

    Lines without words stay where they are. Null text stays null and an empty one empty; of rows with one
    doc_id all keep the same line numbers, so a repeated row keeps what the first has. A row with a null doc_id
    keeps all its lines. Columns named n_lines and n_kept are replaced, other extra columns stay.
    """
    return _dedup(docs.drop("n_lines", "n_kept"), near_words, ("n_lines", "n_kept"))


def drop_repeated_lines(docs: DataFrame, near_words: int = NEAR_WORDS) -> DataFrame:
    """The rows of `docs`, in its columns, without repeated lines; rows of which no line with words is left go, rows that had none stay."""
    before, after = free_names(docs, "_n_lines", "_n_kept")
    return _dedup(docs, near_words, (before, after)).filter((F.col(after) > 0) | (F.col(before) == 0)).select(*docs.columns)
