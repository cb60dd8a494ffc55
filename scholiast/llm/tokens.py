"""Words of whole texts as 64-bit hashes, computed on Arrow buffers with numpy.

A word is a run of bytes other than 0x20 and 0x09-0x0D; A-Z count as a-z. Hashes are position
independent: a word's bytes, each replaced by a fixed random number, are summed with powers of an
odd base, so that a difference of prefix sums gives the hash of any run of bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
BLOCK_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _inverse(a: int) -> int:
    return pow(a, -1, 1 << 64)


_BASE = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_VALUE = mix(np.arange(1, 257, dtype=U64) * U64(0xD1342543DE82EF95))
_VALUE[ord("A") : ord("Z") + 1] = _VALUE[ord("a") : ord("z") + 1]


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n - 1), modulo 2**64."""
    out = np.full(n, U64(base % (1 << 64)), U64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


_cache: dict[int, np.ndarray] = {}


def cached_powers(base: int, n: int) -> np.ndarray:
    if base not in _cache or len(_cache[base]) < n:
        _cache[base] = powers(base, max(n, BLOCK_BYTES))
    return _cache[base][:n]


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and where each row begins; null is empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, at


def blocks(texts: pa.Array, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, where each row begins) for runs of rows of about `most` bytes; a longer text is whole in a block of its own."""
    raw, at = text_buffers(texts)
    first = 0
    while first < len(texts):
        end = max(first + 1, int(np.searchsorted(at, at[first] + most, "right")) - 1)
        end = min(end, len(texts))
        yield first, end, raw[at[first] : at[end]], at[first : end + 1] - at[first]
        first = end


def spans(raw: np.ndarray, at: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte and end byte of each word, index of the first word of each row plus the total) where `gap` marks the bytes between words."""
    n = len(raw)
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    edge[1:n] |= gap[: max(0, n - 1)]
    starts = np.flatnonzero(edge[:n] & ~gap)
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    edge[:n] |= gap
    ends = np.flatnonzero(edge[1:] & ~gap) + 1
    return starts, ends, np.searchsorted(starts, at)


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the bytes of each span, A-Z counting as a-z."""
    sums = np.zeros(len(raw) + 1, U64)
    np.cumsum(_VALUE[raw] * cached_powers(_BASE, len(raw)), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * cached_powers(_inverse(_BASE), len(raw) + 1)[starts])


def word_strings(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, gap: np.ndarray) -> pa.Array:
    """The words as strings, given that they are all bytes that are no gap."""
    offsets = np.concatenate([np.zeros(1, np.int64), np.cumsum(ends - starts)])
    return pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw[~gap].tobytes())])


def white(raw: np.ndarray) -> np.ndarray:
    """Which bytes are 0x20 or 0x09-0x0D."""
    return _SPACE[raw]


def runs_at(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers begins[0], begins[0] + 1, ... of each of some runs, one run after another."""
    ends = np.cumsum(sizes)
    return np.repeat(begins - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def word_hashes(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, index of the first word of each row plus the total, first byte and end byte of each word)."""
    n = len(raw)
    if not n:
        none = np.zeros(0, np.int64)
        return np.zeros(0, U64), np.zeros(len(at), np.int64), none, none
    gap = _SPACE[raw]
    edge = np.zeros(n + 1, bool)
    edge[at[at <= n]] = True
    edge[1:n] |= gap[: n - 1]
    starts = np.flatnonzero(edge[:n] & ~gap)
    edge = np.zeros(n + 1, bool)
    edge[at[at <= n]] = True
    edge[:n] |= gap
    ends = np.flatnonzero(edge[1:] & ~gap) + 1
    sums = np.zeros(n + 1, U64)
    np.cumsum(_VALUE[raw] * cached_powers(_BASE, n), out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * cached_powers(_inverse(_BASE), n)[starts])
    return hashes, np.searchsorted(starts, at), starts, ends


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words at each position; runs over row ends are the caller's to drop."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = words[:n].copy()
    for j in range(1, k):
        out *= U64(0xC2B2AE3D27D4EB4F)
        out += words[j : j + n]
    return mix(out)


def sequence_hash(words: np.ndarray, seed: int = 0) -> int:
    """Hash of a whole sequence of words."""
    x = (words * cached_powers(0x9FB21C651E98DF25 + 2 * seed, len(words))).sum(dtype=U64) + U64(len(words))
    return int(mix(np.array([x], U64))[0])


def shingle_set(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct k-word shingles of one document; of fewer words, the whole sequence is the only one."""
    if len(words) >= k:
        return np.unique(grams(words, k))
    return np.array([sequence_hash(words)], U64) if len(words) else np.zeros(0, U64)


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return x.view(np.int64)
