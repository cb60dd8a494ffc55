"""Fuzzy passages that repeat across documents, by collinear chaining.

Every document emits the k-word seeds that are minimal in some window of W seeds, so any equal run of
k + W - 1 words in two documents yields a common seed. A seed's first places are matched with each other, all
pairs of them; each further one with the earliest, and with the first places that share the next 18 or 30 words with it,
which tells places of frequent seeds apart by more of their text. The matches of two documents that
overlap or meet on one diagonal are joined to exact fragments.
Fragments are chained in order of both documents: a chain's score is its words less a cost for the gaps
on both sides, and the best predecessor of a fragment is the maximum of a prefix, kept in a Fenwick
tree. The words before, between and after the fragments of a chain are then aligned, which extends it to
its true ends and tells how many of its words agree.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scholiast.llm.store import stored_alone, tidy
from scholiast.llm.tokens import U64, blocks, cached_powers, grams, mix, runs_at, word_hashes

SEED, WINDOW = 6, 4
#: Places of a seed, or of a seed with the words ahead of it, that are matched with all before them; and how many words tell those of more apart.
PLACES, AHEAD = 8, (18, 30)
#: Cost of one unmatched word on either side of a gap, and the longest gap within a chain.
GAP_COST, MOST_GAP = 0.15, 40
#: Words that a single fragment must match when it is aligned.
CHAIN_WORDS = 12
#: Words on either side of a chain that alignment may add, and of a single fragment of under CHAIN_WORDS words.
REACH, LONE_REACH = 44, 24
_BASE = 0xB5026F5AA96619E9


def seeds(words: np.ndarray, word_at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, hash, position, half a hash of each number of words in AHEAD from it on) of the winnowed seeds of documents whose words begin at word_at."""
    doc = np.repeat(np.arange(len(word_at) - 1), np.diff(word_at))
    end = word_at[1:][doc]
    at = np.flatnonzero(np.arange(len(words)) + SEED <= end)
    g = grams(words, SEED)[at]
    least, place = g.copy(), np.arange(len(at))
    for ahead in range(1, WINDOW):
        n = max(0, len(at) - ahead)
        lower = (doc[at[ahead:]] == doc[at[:n]]) & (g[ahead:] <= least[:n])  # the last of equal minima, as runs of one seed then give few
        least[:n][lower], place[:n][lower] = g[ahead:][lower], np.flatnonzero(lower) + ahead
    place = np.unique(place[(at + WINDOW - 1 + SEED <= end[at]) | (at == word_at[doc[at]])])
    at, g = at[place], g[place]
    sums = np.concatenate([np.zeros(1, U64), np.cumsum(words * cached_powers(_BASE, len(words)), dtype=U64)])
    back = cached_powers(pow(_BASE, -1, 1 << 64), len(words))[at]
    near, far = (mix((sums[np.minimum(at + n, end[at])] - sums[at]) * back) for n in AHEAD)
    return doc[at], g, at - word_at[doc[at]], near >> U64(32) << U64(32) | far >> U64(32)


def seed_table(docs: DataFrame) -> DataFrame:
    """(seed, doc_id, at, ahead): all winnowed seeds of all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, _, raw, at in blocks(batch.column("text")):
                words, word_at, _, _ = word_hashes(raw, at)
                doc, seed, place, ahead = seeds(words, word_at)
                yield pa.RecordBatch.from_arrays([pa.array(seed.view(np.int64)), batch.column("doc_id").take(pa.array(first + doc)), pa.array(place.astype(np.int32)), pa.array(ahead.view(np.int64))], ["seed", "doc_id", "at", "ahead"])

    return docs.mapInArrow(run, "seed long, doc_id long, at int, ahead long")


_PLACES = "seed long, doc_id long, at int, ahead long, ref_id long, ref_at int, earliest boolean"


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Matches of places (seed, doc_id, at, ahead) that come sorted: each of a seed's first PLACES + 1 with all before it, each further one with the earliest.

    Of a seed with more places every place is also given without a ref, if ahead isn't 0; seed and ahead are given only there. A place that comes twice counts once.
    """
    names = ["seed", "doc_id", "at", "ahead"]
    kept = {n: np.zeros(0, np.int64) for n in names}  # the first places of the seed that is open, and the number of its places
    count, last = 0, (0, 0)
    for batch in batches:
        if not len(batch):
            continue
        own = {n: batch.column(n).to_numpy().astype(np.int64) for n in names}
        old = len(kept["seed"]) if len(kept["seed"]) and kept["seed"][0] == own["seed"][0] else 0
        if old and count > old:  # a repeat of the last place would not be seen among the first ones
            fresh = (own["seed"] != kept["seed"][0]) | (own["doc_id"] != last[0]) | (own["at"] != last[1])
            own = {n: c[fresh] for n, c in own.items()}
            if not len(own["seed"]):
                continue
        cols = {n: np.concatenate([kept[n][:old], own[n]]) for n in names}
        if not old:
            count = 0
        fresh = np.concatenate([[True], (np.diff(cols["seed"]) != 0) | (np.diff(cols["doc_id"]) != 0) | (np.diff(cols["at"]) != 0)]) if len(cols["seed"]) else np.zeros(0, bool)
        fresh[:old] = True
        cols = {n: c[fresh] for n, c in cols.items()}
        n = len(cols["seed"])
        first = np.flatnonzero(np.concatenate([[True], np.diff(cols["seed"]) != 0]))
        size = np.diff(np.concatenate([first, [n]]))
        begin = np.repeat(first, size)
        place = np.arange(n) - begin
        place[old : size[0]] += max(count - old, 0)
        new = np.arange(n) >= old
        pairs = [(at, at - back) for back in range(1, PLACES + 1) for at in [np.flatnonzero(new & (place >= back) & (place <= PLACES))]]
        late = np.flatnonzero(new & (place > PLACES))
        pairs.append((late, begin[late]))
        x, y = (np.concatenate(c) for c in zip(*pairs, strict=True))
        # when a seed turns out to have more places its first ones follow; they lie in this batch or are kept
        many = np.concatenate([late, *(begin[late[place[late] == PLACES + 1]] + i for i in range(PLACES + 1))])
        many = many[cols["ahead"][many] != 0]
        rows = np.concatenate([x, many])
        none = np.arange(len(rows)) >= len(x)
        ref = np.concatenate([y, np.zeros(len(many), np.int64)])
        yield pa.RecordBatch.from_arrays([pa.array(cols["seed"][rows], mask=~none), pa.array(cols["doc_id"][rows]), pa.array(cols["at"][rows].astype(np.int32)), pa.array(cols["ahead"][rows], mask=~none), pa.array(cols["doc_id"][ref], mask=none), pa.array(cols["at"][ref].astype(np.int32), mask=none), pa.array(ref == begin[rows])], ["seed", "doc_id", "at", "ahead", "ref_id", "ref_at", "earliest"])
        count = int(place[-1]) + 1
        last = int(cols["doc_id"][-1]), int(cols["at"][-1])
        kept = {c: v[first[-1] : first[-1] + PLACES + 1] for c, v in cols.items()}


def matches(table: DataFrame) -> DataFrame:
    """(doc_id, ref_id, at, ref_at, earliest) of the places (seed, doc_id, at, ahead); earliest: ref is the first place of the seed."""
    dealt = lambda t: t.repartition("seed").sortWithinPartitions("seed", "doc_id", "at").mapInArrow(_places, _PLACES)
    found = stored_alone(dealt(table), "places")
    near, far = F.shiftrightunsigned("ahead", 32), F.col("ahead").bitwiseAND((1 << 32) - 1)
    longer = found.filter("ref_id is null").withColumn("key", F.explode(F.array(F.xxhash64("seed", F.lit(AHEAD[0]), near), F.xxhash64("seed", F.lit(AHEAD[1]), far))))
    again = dealt(longer.select(F.col("key").alias("seed"), "doc_id", "at", F.lit(0).cast("long").alias("ahead")))
    columns = ["doc_id", "ref_id", "at", "ref_at", "earliest"]
    return found.filter("ref_id is not null").select(*columns).unionByName(again.select(*columns).withColumn("earliest", F.lit(False)))


class Fenwick:
    """Running maxima: the best (value, number) at keys up to a bound."""

    def __init__(self, size: int):
        self.best: list[tuple[float, int]] = [(0.0, -1)] * (size + 1)

    def put(self, key: int, value: tuple[float, int]) -> None:
        i = key + 1
        while i < len(self.best):
            if self.best[i] < value:
                self.best[i] = value
            i += i & -i

    def upto(self, key: int) -> tuple[float, int]:
        i, out = min(key + 1, len(self.best) - 1), (0.0, -1)
        while i > 0:
            out = max(out, self.best[i])
            i -= i & -i
        return out


def fragments(doc: np.ndarray, ref: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begins of pairs in the sorted matches, their order, (pair, begin in x, begin in y, words) of their exact fragments, sorted): runs on one diagonal whose seeds overlap or meet."""
    order = np.lexsort((x, x - y, ref, doc))
    doc, ref, x, y = doc[order], ref[order], x[order], y[order]
    new = np.concatenate([[True], (np.diff(doc) != 0) | (np.diff(ref) != 0)])
    first = np.flatnonzero(new | np.concatenate([[True], (np.diff(x - y) != 0) | (np.diff(x) > SEED)]))
    last = np.concatenate([first[1:] - 1, [len(x) - 1]])
    parts = np.stack([np.cumsum(new)[first] - 1, x[first], y[first], x[last] - x[first] + SEED], 1)
    return np.flatnonzero(new), order, parts[np.lexsort(parts.T[::-1])]


def chains(parts: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """Disjoint chains of fragments, best first; every fragment is in one.

    score(i) = words(i) + max(0, score(j) - GAP_COST * (gap in x + gap in y)) over j that end before i begins on both
    sides, by at most MOST_GAP words. With c * (x + y) of a fragment's end added to its score, the maximum over j is that
    of a prefix of y; where that one lies too far back, the ends in the square of MOST_GAP words before i are looked through.
    """
    n = len(parts)
    ends = sorted({y + w for _, y, w in parts})
    rank = {y: i for i, y in enumerate(ends)}
    tree, score, before = Fenwick(len(ends)), [0.0] * n, [-1] * n
    starts = sorted(range(n), key=lambda i: (parts[i][0], parts[i][1]))
    closing = sorted(range(n), key=lambda i: (parts[i][0] + parts[i][2], parts[i][1]))
    done, side = 0, MOST_GAP + 1
    squares: dict[tuple[int, int], list[int]] = {}
    gaps = lambda i, j: (parts[i][0] - parts[j][0] - parts[j][2], parts[i][1] - parts[j][1] - parts[j][2])
    bounds = np.asarray(ends)
    for i in starts:
        x, y, w = parts[i]
        while done < n and parts[closing[done]][0] + parts[closing[done]][2] <= x:
            j = closing[done]
            a, b, v = parts[j]
            tree.put(rank[b + v], (score[j] + GAP_COST * (a + v + b + v), j))
            squares.setdefault(((a + v) // side, (b + v) // side), []).append(j)
            done += 1
        value, j = tree.upto(int(np.searchsorted(bounds, y, "right")) - 1)
        if j >= 0 and max(gaps(i, j)) > MOST_GAP:
            close = [j for p in (x // side - 1, x // side) for q in (y // side - 1, y // side) for j in squares.get((p, q), ()) if 0 <= min(gaps(i, j)) and max(gaps(i, j)) <= MOST_GAP]
            value, j = max([(0.0, -1), *((score[j] + GAP_COST * (x + y - sum(gaps(i, j))), j) for j in close)])
        gain = value - GAP_COST * (x + y)
        if j >= 0 and gain > 0:
            score[i], before[i] = w + gain, j
        else:
            score[i] = w
    used, out = [False] * n, []
    for i in sorted(range(n), key=lambda i: (-score[i], parts[i])):
        chain = []
        while i >= 0 and not used[i]:
            used[i] = True
            chain.append(parts[i])
            i = before[i]
        if chain:
            out.append(chain[::-1])
    return out


def _binary(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """A binary column whose rows hold `sizes` of the values each."""
    ends = np.concatenate([[0], np.cumsum(sizes)]) * values.itemsize
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(values.tobytes())])


def _values(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """What the rows of a binary column without nulls hold, one row after another, and how many values each."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    flat = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return flat.view(kind).astype(np.int64), np.diff(ends) // np.dtype(kind).itemsize


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chains (doc_id, ref_id, main, parts) of each pair of documents, parts being the fragments as 32-bit numbers; rows come sorted by doc_id."""
    held: list[dict[str, np.ndarray]] = []

    def done(cols: dict[str, np.ndarray]) -> pa.RecordBatch:
        first, order, found = fragments(cols["doc_id"], cols["ref_id"], cols["at"], cols["ref_at"])
        earliest = np.logical_or.reduceat(cols["earliest"][order] != 0, first)
        doc, ref = cols["doc_id"][order[first]], cols["ref_id"][order[first]]
        of, parts = found[:, 0], found[:, 1:]
        size = np.bincount(of, minlength=len(first))
        lone = size[of] == 1
        owners, sizes, found = [of[lone]], [np.ones(int(lone.sum()), np.int64)], [parts[lone]]
        begin = np.cumsum(size) - size
        for i in np.flatnonzero(size > 1):
            own = chains([tuple(f) for f in parts[begin[i] : begin[i] + size[i]].tolist()])
            owners.append(np.full(len(own), i))
            sizes.append(np.array([len(c) for c in own]))
            found.append(np.array([f for c in own for f in c]))
        owner, number, flat = (np.concatenate(c) for c in (owners, sizes, found))
        words = flat[np.cumsum(number) - 1, 2]
        main = earliest[owner] & ((number > 1) | (words >= CHAIN_WORDS))
        return pa.RecordBatch.from_arrays([pa.array(doc[owner]), pa.array(ref[owner]), pa.array(main), _binary(flat.astype(np.int32), 3 * number)], ["doc_id", "ref_id", "main", "parts"])

    for batch in batches:
        if not len(batch):
            continue
        cols = {c: batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("doc_id", "ref_id", "at", "ref_at", "earliest")}
        cut = int(np.searchsorted(cols["doc_id"], cols["doc_id"][-1]))
        if held and (cut or held[-1]["doc_id"][-1] != cols["doc_id"][0]):
            yield done({c: np.concatenate([*(h[c] for h in held), v[:cut]]) for c, v in cols.items()})
            held = []
        elif cut:
            yield done({c: v[:cut] for c, v in cols.items()})
        held.append({c: v[cut:] for c, v in cols.items()})
    if held:
        yield done({c: np.concatenate([h[c] for h in held]) for c in held[0]})


def _padded(flat: np.ndarray, at: np.ndarray, size: np.ndarray, step: int, none: int) -> np.ndarray:
    """Column i: the `size[i]` values from at[i] on, forwards or backwards (step 1 or -1), then `none`."""
    along = np.arange(int(size.max(initial=0)))[:, None]
    if not len(flat):
        return np.full((len(along), len(at)), none)
    return np.where(along < size, flat.take(at + step * along, mode="clip"), none)


Runs = tuple[np.ndarray, np.ndarray, np.ndarray]  # values, begins, sizes


def _extensions(x: Runs, y: Runs, step: int) -> np.ndarray:
    """(words of x, words of y, equal words) by which ends move over two runs that begin there; step -1: over words before them.

    Ungapped stretches with most equal less twice unequal words, joined over up to three words left out on one
    side, each of which costs two.
    """
    out = np.zeros((3, len(x[1])), np.int64)
    todo = np.flatnonzero((x[2] > 0) & (y[2] > 0))
    for chunk in np.split(todo, range(4096, len(todo), 4096)):
        while len(chunk):
            i, j, _ = out[:, chunk]
            a = _padded(x[0], x[1][chunk] + step * i, x[2][chunk] - i, step, -1)
            b = _padded(y[0], y[1][chunk] + step * j, y[2][chunk] - j, step, -2)
            best = np.zeros(len(chunk), np.int64)
            for shift in range(-3, 4):
                p, q = max(shift, 0), max(-shift, 0)
                n = min(len(a) - p, len(b) - q)
                if n > 0:
                    total = np.cumsum(np.where(a[p : p + n] == b[q : q + n], np.int16(1), np.int16(-2)), 0, dtype=np.int16)
                    k = np.argmax(total, 0)
                    top = total[k, np.arange(len(chunk))].astype(np.int64)
                    value = top - 2 * abs(shift)
                    key = value
                    for field in (3 - abs(shift), p + k + 1, q + k + 1, (top + 2 * (k + 1)) // 3):
                        key = key << 10 | field
                    best = np.maximum(best, np.where(value > 0, key, 0))
            chunk, best = chunk[best > 0], best[best > 0]
            out[:, chunk] += [best >> 20 & 1023, best >> 10 & 1023, best & 1023]
    return out


def _commons(x: Runs, y: Runs) -> np.ndarray:
    """Lengths of the longest common subsequences of gaps."""
    out = np.zeros(len(x[1]), np.int64)
    todo = np.flatnonzero((x[2] > 0) & (y[2] > 0))
    todo = todo[np.argsort(np.maximum(x[2], y[2])[todo], kind="stable")]
    for chunk in np.split(todo, range(4096, len(todo), 4096)):
        a, b = (_padded(z[0], z[1][chunk], z[2][chunk], 1, none) for z, none in ((x, -1), (y, -2)))
        row = np.zeros((len(b) + 1, len(chunk)), np.int16)
        for w in a:
            hit = np.maximum(row[1:], row[:-1] + (b == w))
            np.maximum.accumulate(hit, 0, out=row[1:])
        out[chunk] = row[-1]
    return out


def _shared(x: Runs, y: Runs) -> np.ndarray:
    """How many words of runs occur in the other ones."""
    out = np.zeros(len(x[1]), np.int64)
    for chunk in np.split(np.arange(len(out)), range(4096, len(out), 4096)):
        a, b = (_padded(z[0], z[1][chunk], z[2][chunk], 1, none) for z, none in ((x, -1), (y, -2)))
        hit = np.zeros(a.shape, bool)
        for w in b:
            hit |= a == w
        out[chunk] = hit.sum(0)
    return out


def _filled(found: tuple[int, int, int, int, int], before: tuple, behind: tuple, identity: float, min_words: int) -> tuple[int, int, int, int, int]:
    """A part moved out, word against word, to equal words that make it `min_words` long, if it still reaches `identity`; of several the one with most equal words for its length.

    before and behind are the words of both documents from the part's ends outwards.
    """
    start, end, ref_start, ref_end, equal = found
    if end - start >= min_words:
        return found
    steps, gains = [], []
    for x, y in (before, behind):
        n = min(len(x), len(y))
        at = np.flatnonzero(x[:n] == y[:n])
        steps.append(np.concatenate([[0], at + 1]))
        gains.append(np.arange(len(at) + 1))
    moved, agree = steps[0][:, None] + steps[1], equal + gains[0][:, None] + gains[1]
    most = max(end - start, ref_end - ref_start) + moved
    short = (end - start + moved < min_words) | (agree < identity * most)
    if short.all():
        return found
    i, j = np.unravel_index(np.argmax(np.where(short, -1.0, agree / most)), short.shape)
    left, right = int(steps[0][i]), int(steps[1][j])
    return start - left, end + right, ref_start - left, ref_end + right, int(agree[i, j])


def _passing_parts(parts: np.ndarray, of: np.ndarray, x: Runs, y: Runs, identity: float, min_words: int) -> list[np.ndarray]:
    """Columns chain, start, end, start in ref, end in ref, equal words of the parts of chains that reach `identity`.

    Fragment i is parts[i] and in chain of[i]; runs i + of[i] and i + of[i] + 1 of x and y are the words before and after it.
    A chain that fails is cut at the gap that lacks most equal words, and so on; a single fragment passes at the latest
    without what alignment adds at its ends. Single fragments need CHAIN_WORDS equal words with what alignment adds.
    Parts of under `min_words` words are moved out to that length where their words allow it.
    """
    pick = lambda z, at: (z[0], z[1][at], z[2][at])
    back = lambda z, at: (z[0], z[1][at] + z[2][at] - 1, z[2][at])
    number = np.arange(len(of))
    before = number + of
    first = np.flatnonzero(np.diff(of, prepend=-1) != 0)
    last = np.concatenate([first[1:], [len(of)]]) - 1
    lone = first[(first == last) & (parts[first, 2] < CHAIN_WORDS)]  # not aligned where too few words occur on both sides
    reached = parts[lone, 2] + sum(_shared(pick(x, before[lone] + i), pick(y, before[lone] + i)) for i in (0, 1))
    hopeless = np.zeros(len(of), bool)
    hopeless[lone[reached < CHAIN_WORDS]] = True
    common, lack = np.zeros(len(of), np.int64), np.full(len(of), -np.inf)
    inner = np.setdiff1d(number, last)
    common[inner] = _commons(pick(x, before[inner] + 1), pick(y, before[inner] + 1))
    lack[inner] = identity * np.maximum(x[2], y[2])[before[inner] + 1] - common[inner]
    words, agreed = (np.concatenate([[0], np.cumsum(c)]) for c in (parts[:, 2], common))
    out: list[list[np.ndarray]] = []
    lo, hi = first[~hopeless[first]], last[~hopeless[first]]
    while len(lo):
        left = _extensions(back(x, before[lo]), back(y, before[lo]), -1)
        right = _extensions(pick(x, before[hi] + 1), pick(y, before[hi] + 1), 1)
        equal = words[hi + 1] - words[lo] + agreed[hi] - agreed[lo]
        best, used = np.full((5, len(lo)), -1), np.zeros((2, len(lo)), np.int64)
        for p, q in ((1, 1), (1, 0), (0, 1), (0, 0)):
            way = np.stack([parts[lo, 0] - p * left[0], parts[hi, 0] + parts[hi, 2] + q * right[0], parts[lo, 1] - p * left[1], parts[hi, 1] + parts[hi, 2] + q * right[1], equal + p * left[2] + q * right[2]])
            good = (way[4] >= identity * np.maximum(way[1] - way[0], way[3] - way[2])) & ((best[4] < 0) | (way[1] - way[0] > best[1] - best[0]))
            best[:, good], used[:, good] = way[:, good], np.array([[p], [q]])
        found = best[4] >= 0
        short = np.flatnonzero(found & (best[1] - best[0] < min_words))
        ends = []
        for side, moved, step in ((0, left, -1), (1, right, 1)):
            at = before[hi[short]] + 1 if side else before[lo[short]]
            gone = used[side, short] * moved[:2, short]
            ends.append([(z[0], begin + step * n, size - n) for (z, n) in zip((x, y), gone, strict=True) for _, begin, size in [(pick if side else back)(z, at)]])
        room = sum((a[: len(b)] == b[: len(a)]).sum(0) for (v, w), step in zip(ends, (-1, 1), strict=True) for a, b in [(_padded(*v, step, -1), _padded(*w, step, -2))])
        for k in np.flatnonzero(best[4, short] + room >= identity * min_words):
            outwards = [tuple(z[0][z[1][k] + step * np.arange(z[2][k])] for z in pair) for pair, step in zip(ends, (-1, 1), strict=True)]
            best[:, short[k]] = _filled(tuple(best[:, short[k]].tolist()), *outwards, identity, min_words)
        keep = found & ((lo < hi) | (best[4] >= CHAIN_WORDS))
        out.append([of[lo[keep]], *best[:, keep]])
        fail = np.flatnonzero(~found & (lo < hi))
        cut = np.array([i + int(np.argmax(lack[i:j])) for i, j in zip(lo[fail], hi[fail], strict=True)], np.int64)
        lo, hi = np.concatenate([lo[fail], cut + 1]), np.concatenate([cut, hi[fail]])
    return [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 6


def _passing(regions: list[tuple], identity: float, min_words: int = 0) -> list[tuple[int, int, int, int, int]]:
    """(start, end, start in ref, end in ref, equal words) of the parts of one chain that reach `identity`, from its regions (part, a, b, ra, rb, words, x, y)."""
    parts = np.array([(a - w, ra - w, w) for _, a, _, ra, _, w, _, _ in regions[1:]], np.int64)
    sizes = [np.array([len(r[i]) for r in regions], np.int64) for i in (6, 7)]
    x, y = ((np.concatenate([r[i] for r in regions]).astype(np.int64), np.cumsum(n) - n, n) for i, n in zip((6, 7), sizes, strict=True))
    return sorted(zip(*(c.tolist() for c in _passing_parts(parts, np.zeros(len(parts), np.int64), x, y, identity, min_words)[1:]), strict=True))


def _regions(parts: np.ndarray, number: np.ndarray, side: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin and size of the runs before, between and after the fragments of each chain, which of them are last ones) in x (side 0) or y (side 1); the last ones may reach beyond the document."""
    last = np.cumsum(number) - 1
    first = last - number + 1
    reach = np.where((number > 1) | (parts[first, 2] >= CHAIN_WORDS), REACH, LONE_REACH)
    begin, size = np.zeros((2, len(parts) + len(number)), np.int64)
    before = np.arange(len(parts)) + np.repeat(np.arange(len(number)), number)
    ends = parts[:, side] + parts[:, 2]
    begin[before[1:]] = ends[:-1]
    begin[before[first]] = np.maximum(0, parts[first, side] - reach)
    size[before] = parts[:, side] - begin[before]
    begin[before[last] + 1], size[before[last] + 1] = ends[last], reach
    return begin, size, before[last] + 1


def _with_words(batches: Iterator[pa.RecordBatch], side: int) -> Iterator[tuple]:
    """(chains, their fragments, how many each has, word hashes of 32 bits of documents, begins and sizes of each chain's runs in them, how many runs each has), of rows that come sorted by owner, its documents first; the owner is x (side 0) or y (side 1).

    A document is a row without parts; of several with one owner the first, which is longest, counts, and chains that lie behind its end don't.
    """
    kept, kept_words = None, np.zeros(0, np.int64)
    for batch in batches:
        owner, is_doc = batch.column("owner").to_numpy(), batch.column("parts").is_null().to_numpy(zero_copy_only=False)
        docs = np.flatnonzero(is_doc)
        docs = docs[np.diff(owner[docs], prepend=owner[docs[:1]] - 1) != 0]
        docs = docs[owner[docs] != kept] if kept is not None else docs
        flat, sizes = [kept_words], [np.array([len(kept_words)])]
        for _, _, raw, at in blocks(batch.column("text").take(pa.array(docs))):
            hashes, word_at, _, _ = word_hashes(raw, at)
            flat.append(hashes.astype(np.uint32).astype(np.int64))
            sizes.append(np.diff(word_at))
        words, length = np.concatenate(flat), np.concatenate(sizes)
        place = np.cumsum(length) - length
        rows = np.flatnonzero(~is_doc)
        doc = np.searchsorted(docs, rows)  # 0 is the document kept
        if len(docs):
            kept, kept_words = int(owner[docs[-1]]), words[place[-1] :]
        if not len(rows):
            continue
        own = batch.take(pa.array(rows))
        parts, number = _values(own.column("parts"), np.int32)
        parts, number = parts.reshape(-1, 3), number // 3
        last = np.cumsum(number) - 1
        within = parts[last, side] + parts[last, 2] <= length[doc]
        if not within.all():
            own, doc, parts, number = own.filter(pa.array(within)), doc[within], parts[np.repeat(within, number)], number[within]
        if not len(doc):
            continue
        begin, size, last = _regions(parts, number, side)
        size[last] = np.minimum(size[last], length[doc] - begin[last])
        yield own, parts, number, words, begin + np.repeat(place[doc], number + 1), size


def _ref_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chains (owner, other, main, parts, words) with the words of the ref around and between their fragments; from then on the document owns them."""
    for rows, _, number, words, begin, size in _with_words(batches, 1):
        near = words[runs_at(begin, size)].astype(np.uint32)
        yield pa.RecordBatch.from_arrays([rows.column("other"), rows.column("owner"), rows.column("main"), rows.column("parts"), _binary(near, np.add.reduceat(size, np.cumsum(number + 1) - number - 1))], ["owner", "other", "main", "parts", "words"])


def _aligned(identity: float, min_words: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The parts of each chain that reach `identity`."""
    for rows, parts, number, words, begin, size in _with_words(batches, 0):
        ref_words, total = _values(rows.column("words"), np.uint32)
        _, ref_size, last = _regions(parts, number, 1)
        ref_size[last] += total - np.add.reduceat(ref_size, last - number)  # a document may end within reach
        of = np.repeat(np.arange(len(number)), number)
        chain, *found = _passing_parts(parts, of, (words, begin, size), (ref_words, np.cumsum(ref_size) - ref_size, ref_size), identity, min_words)
        at = pa.array(chain)
        yield pa.RecordBatch.from_arrays([rows.column("owner").take(at), rows.column("other").take(at), *(pa.array(c) for c in found), rows.column("main").take(at)], ["doc_id", "ref_id", "start", "end", "ref_start", "ref_end", "equal_words", "main"])


def _with_owners(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The chains (owner, other, main, parts, ..), sorted by owner, behind the documents that own them."""
    both = docs.filter("text is not null").select(F.col("doc_id").alias("owner"), "text").unionByName(rows, allowMissingColumns=True)
    return both.repartition("owner").sortWithinPartitions("owner", F.col("parts").isNotNull(), F.desc(F.length("text")), "text")


@tidy
def repeated_passages(docs: DataFrame, min_words: int = 30, identity: float = 0.8) -> DataFrame:
    """(doc_id, start, end, ref_id, ref_start, ref_end, equal_words): passages of `docs` (doc_id, text) that repeat an earlier one.

    Word positions count from 0, `end` is behind the last word; words are compared without the case of A-Z. A row is
    one aligned chain, or a part of one that fails as a whole: at least the share `identity` of its words agree, and it lies in a stretch of at least
    `min_words` words of its document that such chains cover without a break of more than SEED words, so a passage put
    together from several sources is found too. ref is the place of an earlier occurrence in order of doc_id and
    position, maybe in the same document. Null, empty and shorter texts give no rows; a repeated row with the same
    doc_id is the same document, aligned by the longest of its texts if they differ; a null doc_id takes no part; extra columns are ignored.
    """
    source = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    hits = matches(seed_table(source)).repartition("doc_id").sortWithinPartitions("doc_id")
    found = stored_alone(hits.mapInArrow(_chained, "doc_id long, ref_id long, main boolean, parts binary"), "chains")
    met = _with_owners(source, found.select(F.col("ref_id").alias("owner"), F.col("doc_id").alias("other"), "main", "parts"))
    met = met.mapInArrow(_ref_words, "owner long, other long, main boolean, parts binary, words binary")
    aligned = _with_owners(source, met).mapInArrow(partial(_aligned, identity, min_words), "doc_id long, ref_id long, start long, end long, ref_start long, ref_end long, equal_words long, main boolean")
    good = aligned.filter(F.col("equal_words") >= F.lit(identity) * F.greatest(F.col("end") - F.col("start"), F.col("ref_end") - F.col("ref_start")))
    good = good.filter("ref_id <> doc_id or ref_start < start")  # ends may meet on the passage itself
    # a row of a short fragment, or without a seed's earliest place, stays where it tells of more words than the others that begin no later
    inner = Window.partitionBy("doc_id").orderBy("start", F.desc("end"), F.desc("main"), "ref_id", "ref_start", F.desc("equal_words"), "ref_end").rowsBetween(Window.unboundedPreceding, -1)
    good = good.withColumn("within", F.max("end").over(inner)).filter("main or within is null or end > within")
    ahead = Window.partitionBy("doc_id").orderBy("start", "end", "ref_id", "ref_start")
    reach = F.max("end").over(ahead.rowsBetween(Window.unboundedPreceding, -1))
    stretch = good.withColumn("fresh", F.coalesce(F.col("start") > reach + SEED, F.lit(True)).cast("int")).withColumn("stretch", F.sum("fresh").over(ahead))
    whole = Window.partitionBy("doc_id", "stretch")
    long = stretch.withColumn("long", F.max("end").over(whole) - F.min("start").over(whole) >= min_words).filter("long")
    return long.select("doc_id", "start", "end", "ref_id", "ref_start", "ref_end", "equal_words")
