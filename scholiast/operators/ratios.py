"""Pairs of texts whose ratio of matched characters reaches a bound, over blocks of texts in numpy (MTH-05).

Three bounds from above stand before the ratio, each over far fewer pairs: the common characters without their
order, by one product of matrices a tile; the longest common subsequence, 64 characters of a text in one number; the best ratio that a text has so far.
"""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import numpy as np

#: Features of a text in the product, rows and columns of a tile, pairs whose common subsequences are sought together.
FEATURES, TILE, CHUNK = 160, (256, 4096), 1 << 14
#: Words of 64 characters up to which common subsequences of many pairs are sought together.
WORDS = 2
#: Characters up to which the standard library is faster than rows of numpy.
SHORT = 300
#: What rounding to six places and 32-bit sums can add.
SLACK = 1e-5
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
_CLASSES = 39  # a-z, 0-9, space, all others, none
_CLASS = np.full(256, 37, np.int64)
_CLASS[[*b"abcdefghijklmnopqrstuvwxyz0123456789 "]] = np.arange(37)


def matched_characters(a: str, b: str) -> int:
    """Characters in the longest common run, the earliest in a and then in b, and in those left and right of it, and so on (MTH-05)."""
    x, y = (np.frombuffer(t.encode("utf-32-le"), np.uint32) for t in (a, b))
    total, open_ = 0, [(0, len(x), 0, len(y))]
    while open_:
        i, j, k, m = open_.pop()
        if i >= j or k >= m:
            continue
        # runs that end at each place of y, row by row of x
        best, at, run = 0, (0, 0), np.zeros(m - k + 1, np.int32)
        for p in range(i, j):
            run[1:] = np.where(y[k:m] == x[p], run[:-1] + 1, 0)
            q = int(run.argmax())
            if run[q] > best:
                best, at = int(run[q]), (p + 1 - int(run[q]), k + q - int(run[q]))
            elif best and run[q] == best and p + 1 - best == at[0] and k + q - best < at[1]:
                at = (at[0], k + q - best)
        if best:
            total += best
            open_ += [(i, at[0], k, at[1]), (at[0] + best, j, at[1] + best, m)]
    return total


def ratio(a: str, b: str) -> float:
    """Twice the matched characters over the characters of both; 1 for two empty texts."""
    if not a and not b:
        return 1.0
    if len(a) + len(b) > SHORT:
        return 2 * matched_characters(a, b) / (len(a) + len(b))
    return difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()


class Texts:
    """Texts in order of length: their classes of characters, end to end, and how many of each class a text has."""

    def __init__(self, texts: list[str]):
        self.texts = sorted(texts, key=len)
        codes = np.frombuffer("".join(self.texts).encode("utf-32-le"), np.uint32)
        self.classes = np.where(codes < 128, _CLASS[np.minimum(codes, 255)], 37)
        self.size = np.array([len(t) for t in self.texts], np.int64)
        self.at = np.cumsum(self.size) - self.size
        row = np.repeat(np.arange(len(self.texts)), self.size)
        self.counts = np.bincount(row * _CLASSES + self.classes, minlength=len(self.texts) * _CLASSES).reshape(-1, _CLASSES)
        self.place = np.arange(len(self.classes)) - self.at[row]
        self.row = row

    def masks(self, words: int) -> list[np.ndarray]:
        """For every text and class the places of its first characters that have it, as bits of so many words of 64."""
        out = []
        for word in range(words):
            part, own = np.zeros(len(self.texts) * _CLASSES, np.uint64), self.place // 64 == word
            np.bitwise_or.at(part, self.row[own] * _CLASSES + self.classes[own], np.uint64(1) << (self.place[own] % 64).astype(np.uint64))
            out.append(part)
        return out

    def padded(self, words: int) -> np.ndarray:
        """The first classes of every text, those after its end none."""
        out = np.full((len(self.texts), 64 * words), _CLASSES - 1, np.uint8)
        early = self.place < 64 * words
        out[self.row[early], self.place[early]] = self.classes[early]
        return out


def _features(left: Texts, right: Texts, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns whose product isn't negative where two texts can have enough common characters.

    A feature is 'more than l characters of class k'; two texts have as many of these in common as characters, less what a text has beyond
    the most frequent features, which is added on the left. Two more stand for the characters needed.
    """
    most = int(min(left.counts.max(initial=0), 512))
    often = np.array([(left.counts > level).sum(0) for level in range(most)]).reshape(-1)
    kept = np.argsort(-often, kind="stable")[:FEATURES]
    kept = kept[often[kept] > 0]
    # levels of a class are kept from the lowest on, as higher ones are rarer
    cap = np.zeros(_CLASSES, np.int64)
    np.maximum.at(cap, kept % _CLASSES, kept // _CLASSES + 1)
    level, kind = kept // _CLASSES, kept % _CLASSES
    need = (least - SLACK) / 2
    beyond = np.maximum(left.counts - cap, 0).sum(1)
    one = lambda n: np.ones((n, 1))
    x = np.hstack([left.counts[:, kind] > level, (beyond - need * left.size)[:, None], one(len(left.size))])
    y = np.hstack([right.counts[:, kind] > level, one(len(right.size)), (-need * right.size)[:, None]])
    return np.ascontiguousarray(x, np.float32), np.ascontiguousarray(y.T, np.float32)


def _subsequence(x: str, y: str) -> int:
    """Characters of the longest common subsequence."""
    masks: dict[str, int] = {}
    for i, c in enumerate(x):
        masks[c] = masks.get(c, 0) | 1 << i
    whole = (1 << len(x)) - 1
    v = whole
    for c in y:
        u = v & masks.get(c, 0)
        v = (v + u | v - u) & whole
    return len(x) - v.bit_count()


def _subsequences(left: Texts, right: Texts, masks: list[np.ndarray], padded: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """As many characters as the longest common subsequence of each pair has, or more where classes are coarser than characters."""
    out, words = np.empty(len(i), np.int64), np.maximum(1, -(-np.maximum(left.size[i], right.size[j]) // 64))
    for p in np.flatnonzero(words > WORDS):
        out[p] = _subsequence(left.texts[i[p]], right.texts[j[p]])
    for n in range(1, WORDS + 1):
        own = np.flatnonzero(words == n)
        if not len(own):
            continue
        of, kinds = i[own] * _CLASSES, np.ascontiguousarray(padded[j[own]].T)
        v = [np.full(len(own), _ALL) for _ in range(n)]
        for k in range(int(right.size[j[own]].max())):
            at, carry = of + kinds[k], None
            for w in range(n):
                u = v[w] & masks[w][at]
                total = v[w] + u
                over = total < u
                if carry is not None:
                    total += carry
                    over |= total < carry
                v[w], carry = total | (v[w] - u), over.astype(np.uint64) if w + 1 < n else None
        found = np.zeros(len(own), np.int64)
        for w in range(n):
            size = np.clip(left.size[i[own]] - 64 * w, 0, 64).astype(np.uint64)
            whole = np.where(size < 64, (np.uint64(1) << (size & np.uint64(63))) - np.uint64(1), _ALL)
            found += np.bitwise_count(~v[w] & whole)
        out[own] = found
    return out


def _candidates(left: Texts, right: Texts, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places of texts that are near in length and have enough common characters, some pairs at a time, a tile's rows after another's."""
    x, y = _features(left, right, least)
    shortest = (least - SLACK) / (2 - least + SLACK)
    for top in range(0, len(left.size), TILE[0]):
        end, held = min(top + TILE[0], len(left.size)), []
        low = int(np.searchsorted(right.size, left.size[top] * shortest - 1e-9, "left"))
        high = int(np.searchsorted(right.size, left.size[end - 1] / shortest + 1e-9, "right"))
        for first in range(low, high, TILE[1]):
            last = min(first + TILE[1], high)
            i, j = np.divmod(np.flatnonzero(x[top:end] @ y[:, first:last] >= -SLACK), last - first)
            i, j = i + top, j + first
            n, m = left.size[i], right.size[j]
            near = 2 * np.minimum(n, m) >= (least - SLACK) * (n + m)
            held.append((i[near], j[near]))
        if held:
            yield tuple(map(np.concatenate, zip(*held, strict=True)))


def close_pairs(xs: list[str], ys: list[str], least: float, best: bool) -> Iterator[tuple[str, str, float]]:
    """(x, y, ratio to six places) of all pairs whose ratio is `least` or more; of those of an x only the `best`, all equal ones of them."""
    left, right = Texts(xs), Texts(ys)
    masks, padded = left.masks(WORDS), right.padded(WORDS)
    for i, j in _candidates(left, right, least):
        common = [_subsequences(left, right, masks, padded, i[k : k + CHUNK], j[k : k + CHUNK]) for k in range(0, len(i), CHUNK)]
        size = left.size[i] + right.size[j]
        most = np.where(size > 0, 2 * np.concatenate([*common, np.zeros(0, np.int64)]) / np.maximum(1, size), 1.0)
        kept = np.flatnonzero(most >= least - SLACK)
        kept = kept[np.lexsort((-most[kept], i[kept]))]
        now, found, top = -1, [], least
        for p, q, bound in zip(i[kept].tolist(), j[kept].tolist(), most[kept].tolist(), strict=True):
            if p != now:
                yield from found
                now, found, top = p, [], least
            if bound < top - SLACK:
                continue
            score = round(ratio(left.texts[p], right.texts[q]), 6)
            if score < top:
                continue
            if best:
                if score > top:
                    found = []
                top = score
            found.append((left.texts[p], right.texts[q], score))
        yield from found
