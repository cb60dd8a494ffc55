"""Maximal periodic runs of words, found on a grammar of the texts.

A run is a stretch of consecutive words with smallest period q (words q apart are equal) of `times` periods and
`least` words at least, which no neighbouring word extends. The texts of a block share one grammar: Re-Pair
replaces the most frequent pair of neighbouring symbols by a new one as long as a pair occurs twice. In each
round every occurrence is replaced whose pair is more frequent than the pairs that it overlaps, which is what
replacing one pair after another comes to where pairs don't touch, and takes rounds by the logarithm of the
repeats. What is left of a text, in which nothing repeats, is halved again and again, each half of halves being
a symbol that occurs once.

A run lies within the text of some smallest symbol of the derivation and crosses the boundary between that
symbol's two parts. So for each symbol, however often it occurs, the runs that cross its boundary are
computed once, at its first occurrence: at least half of a run's four periods stand on one side, so words one period
apart agree next to the boundary, which leaves few periods to be tested by hashes of stretches. Runs are carried to
all places where the derivation has their symbol. There a run may go on beyond its symbol, and then the larger symbol around it
has found it whole: intervals of one period that lie in another one are dropped. Every run is compared
word by word at the end; a false hash makes the block be searched again with another base.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholiast.llm.tokens import blocks, runs_at, spans, white, word_strings

LEAST, TIMES = 6, 4
_P = np.int64((1 << 31) - 1)
#: Period tests of symbols that are made at once.
_AT_ONCE = 1 << 21


@dataclass
class Grammar:
    """Symbols under `terminals` are words; symbol terminals + r is left[r] followed by right[r], has size[r] words and occurs at first[r]. The texts are what `top` derives, symbol by symbol at words `at`, in rows `row`."""

    terminals: int
    left: np.ndarray
    right: np.ndarray
    size: np.ndarray
    first: np.ndarray
    top: np.ndarray
    at: np.ndarray
    row: np.ndarray


def re_pair(words: np.ndarray, terminals: int, row_at: np.ndarray) -> Grammar:
    """A grammar of rows of word numbers; row r has words row_at[r]..row_at[r + 1] - 1, and no symbol reaches over its end."""
    symbols = words.astype(np.int64)
    row = np.repeat(np.arange(len(row_at) - 1), np.diff(row_at))
    at, size = np.arange(len(symbols)), np.ones(len(symbols), np.int64)
    # pairs that were alone at the last count stay so until a neighbour is replaced
    live = np.concatenate([row[1:] == row[:-1], np.zeros(min(1, len(row)), bool)])
    rules: list[tuple[np.ndarray, ...]] = []
    known = terminals
    while True:
        open_at = np.flatnonzero(live)
        keys = (symbols[open_at] << 32) | symbols[np.minimum(open_at + 1, len(symbols) - 1)] if len(open_at) else np.zeros(0, np.int64)
        pairs, number, counts = np.unique(keys, return_inverse=True, return_counts=True)
        if not np.any(counts > 1):
            break
        rank = np.empty(len(pairs), np.int64)  # 0 is the most frequent pair
        rank[np.argsort(-counts, kind="stable")] = np.arange(len(pairs))
        often = counts[number] > 1
        live[open_at[~often]] = False
        here, number = open_at[often], number[often]
        order = np.full(len(symbols) + 2, np.int64(len(pairs)))  # of the pair at each place, with one more on both ends
        order[here + 1] = rank[number]
        mine, before, after = order[here + 1], order[here], order[here + 2]
        # a pair that overlaps itself is taken at every second place
        begins = np.flatnonzero((here != np.concatenate([[-2], here[:-1]]) + 1) | (mine != np.concatenate([[-1], mine[:-1]])))
        odd = (np.arange(len(here)) - np.repeat(begins, np.diff(np.append(begins, len(here))))) % 2 == 1
        taken = ~odd & ((before > mine) | (before == mine)) & ((after > mine) | (after == mine))
        here, number = here[taken], number[taken]
        new, first, number = np.unique(number, return_index=True, return_inverse=True)
        sizes = size[here] + size[here + 1]
        rules.append(((pairs[new] >> 32), pairs[new] & 0xFFFFFFFF, sizes[first], at[here[first]]))
        symbols[here], size[here] = known + number, sizes
        known += len(new)
        live[here], live[np.maximum(here - 1, 0)] = True, True
        stays = np.ones(len(symbols), bool)
        stays[here + 1] = False
        symbols, at, row, size, live = symbols[stays], at[stays], row[stays], size[stays], live[stays]
        live[np.flatnonzero(row[1:] != row[:-1])] = False
        live[-1:] = False
    parts = [np.concatenate(x) for x in zip(*rules, strict=True)] if rules else [np.zeros(0, np.int64)] * 4
    return Grammar(terminals, *parts, symbols, at, row)


class Stretches:
    """Compares stretches of words by hashes modulo a prime; equal stretches always agree."""

    def __init__(self, words: np.ndarray, base: int):
        n = len(words)
        powers = np.ones(1, np.int64)
        while len(powers) <= n:
            powers = np.concatenate([powers, powers * pow(base, len(powers), int(_P)) % _P])
        self.powers = powers[: n + 1]
        values = (words.astype(np.int64) * 1_000_003 + 12_345) % _P
        self.sums = np.concatenate([np.zeros(1, np.int64), np.cumsum(values * self.powers[:n] % _P)])

    def same(self, x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether the n words at x and at y > x agree."""
        return (self.sums[x + n] - self.sums[x]) % _P * self.powers[y - x] % _P == (self.sums[y + n] - self.sums[y]) % _P

    def _longest(self, agrees, most: np.ndarray) -> np.ndarray:
        low, high = np.zeros_like(most), most.copy()
        while np.any(low < high):
            middle = (low + high + 1) // 2
            fits = agrees(middle)
            low, high = np.where(fits, middle, low), np.where(fits, high, middle - 1)
        return low

    def forward(self, x: np.ndarray, y: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many words from x and from y on agree, `most` at most."""
        return self._longest(lambda n: self.same(x, y, n), most)

    def backward(self, x: np.ndarray, y: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many words before x and before y agree."""
        return self._longest(lambda n: self.same(x - n, y - n, n), most)


def crossing(words: np.ndarray, known: Stretches, begin: np.ndarray, middle: np.ndarray, end: np.ndarray, least: int, times: int) -> tuple[np.ndarray, ...]:
    """(window, start, end, period) of the runs within each window begin..end - 1 that have words on both sides of `middle`."""
    out = []
    most = np.minimum((end - begin) // times, np.maximum(middle - begin, end - middle) // 2)
    cuts = np.searchsorted(np.cumsum(most), np.arange(0, int(most.sum()) + 1, _AT_ONCE)[1:], "right").tolist()
    for first, last in zip([0, *cuts], [*cuts, len(begin)], strict=True):
        window = np.repeat(np.arange(first, last), most[first:last])
        q = runs_at(np.ones(last - first, np.int64), most[first:last])
        b, m, e = begin[window], middle[window], end[window]
        # the two words at the boundary agree with those one period to the right, or to the left, or both: two runs can meet here
        right = (m + 2 * q <= e) & (words[m - 1] == words[np.minimum(m - 1 + q, len(words) - 1)])
        right &= words[m] == words[np.minimum(m + q, len(words) - 1)]
        left = (m - 2 * q >= b) & (words[m] == words[m - np.minimum(q, m)])
        left &= words[m - 1] == words[np.maximum(m - 1 - q, 0)]
        some = np.concatenate([np.flatnonzero(right), np.flatnonzero(left)])
        x = np.concatenate([m[right], (m - 2 * q)[left]])
        window, q, m = window[some], q[some], m[some]
        # and so do the words of one whole period next to it
        whole = known.same(x, x + q, q)
        window, q, m, x = window[whole], q[whole], m[whole], np.maximum(x, m - q)[whole]
        b, e = begin[window], end[window]
        starts, ends = x - known.backward(x, x + q, x - b), x + q + known.forward(x, x + q, e - x - q)
        good = (starts < m) & (ends > m) & (ends - starts >= np.maximum(least, times * q))
        out.append((window[good], starts[good], ends[good], q[good]))
    window, starts, ends, q = (np.concatenate(x) for x in zip(*out, strict=True))
    # multiples of a period have the same ends
    order = np.lexsort((q, ends, starts, window))
    window, starts, ends, q = window[order], starts[order], ends[order], q[order]
    fresh = np.ones(len(q), bool)
    fresh[1:] = (window[1:] != window[:-1]) | (starts[1:] != starts[:-1]) | (ends[1:] != ends[:-1])
    return window[fresh], starts[fresh], ends[fresh], q[fresh]


def _halves(grammar: Grammar, row_at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(begin, middle, end) of what is left of the texts, halved: neighbouring symbols, then neighbouring pairs of them, and so on."""
    starts, row = grammar.at, grammar.row
    while len(starts):
        ends = np.append(starts[1:], row_at[-1])
        ends = np.minimum(ends, row_at[row + 1])
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        mates = np.flatnonzero((rank[:-1] % 2 == 0) & (row[1:] == row[:-1]))
        if not len(mates):
            return
        yield starts[mates], starts[mates + 1], ends[mates + 1]
        starts, row = starts[rank % 2 == 0], row[rank % 2 == 0]


def _carried(grammar: Grammar, of: np.ndarray, starts: np.ndarray, ends: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, ...]:
    """The runs of rules `of` at every place where the derivation has their symbol."""
    n = len(grammar.left)
    first_run = np.searchsorted(of, np.arange(n + 1))
    holds = first_run[1:] > first_run[:-1]
    left, right = grammar.left - grammar.terminals, grammar.right - grammar.terminals
    for _ in range(n):  # which rules have one of them somewhere below; deeper ones have smaller numbers
        below = holds | ((left >= 0) & holds[np.maximum(left, 0)]) | ((right >= 0) & holds[np.maximum(right, 0)])
        if np.array_equal(below, holds):
            break
        holds = below
    out = []
    rule, at = grammar.top - grammar.terminals, grammar.at
    while True:
        some = (rule >= 0) & holds[np.maximum(rule, 0)] if n else np.zeros(len(rule), bool)
        rule, at = rule[some], at[some]
        if not len(rule):
            break
        many = first_run[rule + 1] - first_run[rule]
        which = runs_at(first_run[rule], many)
        moved = np.repeat(at - grammar.first[rule], many)
        out.append((starts[which] + moved, ends[which] + moved, q[which]))
        inner = grammar.left[rule]
        inner = np.where(inner >= grammar.terminals, grammar.size[np.maximum(inner - grammar.terminals, 0)], 1)
        rule, at = np.concatenate([left[rule], right[rule]]), np.concatenate([at, at + inner])
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3


def runs_of(words: np.ndarray, terminals: int, row_at: np.ndarray, least: int = LEAST, times: int = TIMES) -> tuple[np.ndarray, ...]:
    """(row, start, end, period) of all runs of rows of word numbers, by row, start and period; starts and ends count the block's words."""
    if times < 4:
        raise ValueError("a run must have four periods at least")
    grammar = re_pair(words, terminals, row_at)
    base = 914_237
    while True:
        known = Stretches(words, base)
        inner = grammar.left
        inner = np.where(inner >= terminals, grammar.size[np.maximum(inner - terminals, 0)], 1)
        found = [_carried(grammar, *crossing(words, known, grammar.first, grammar.first + inner, grammar.first + grammar.size, least, times))]
        found += [crossing(words, known, *windows, least, times)[1:] for windows in _halves(grammar, row_at)]
        starts, ends, q = (np.concatenate(x) for x in zip(*found, strict=True))
        row = np.searchsorted(row_at, starts, "right") - 1
        order = np.lexsort((-ends, starts, q, row))
        row, starts, ends, q = row[order], starts[order], ends[order], q[order]
        group = np.cumsum(np.concatenate([[0], (row[1:] != row[:-1]) | (q[1:] != q[:-1])])) if len(q) else q
        reach = np.maximum.accumulate(ends + group * (len(words) + 1)) - group * (len(words) + 1)
        whole = np.ones(len(q), bool)
        whole[1:] = (group[1:] != group[:-1]) | (ends[1:] > reach[:-1])
        row, starts, ends, q = row[whole], starts[whole], ends[whole], q[whole]
        x = runs_at(starts, ends - starts - q)
        if np.array_equal(words[x], words[x + np.repeat(q, ends - starts - q)]):
            order = np.lexsort((q, starts, row))
            return row[order], starts[order], ends[order], q[order]
        base = base * 48_271 % int(_P)


def _texts(strings: pa.Array, kept: np.ndarray, row_at: np.ndarray) -> pa.Array:
    """The kept words of each row, joined by spaces."""
    before = np.concatenate([np.zeros(1, np.int64), np.cumsum(kept)])[row_at].astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(before), strings.filter(pa.array(kept)).cast(pa.string()))
    return pc.binary_join(lists, " ")


def word_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """(doc_id, n_words, runs, collapsed): for every row its runs (start, length, period; by start, then period) and its text less what repeats.

    Words are `[^\\x20\\x09-\\x0D]+` of the whole text, numbered from 0, and equal only if all their bytes are. `collapsed` joins
    by one space the words that no run contains after its first period. Null and empty texts have no words, no runs and an empty
    `collapsed`. Rows are treated one by one whatever their doc_id (made a long; null stays null), and other columns aren't looked at.
    Rows stay in their partitions: nothing is shuffled. A text is searched in one piece, in some 200 bytes of memory a word.
    """
    names = ["doc_id", "n_words", "runs", "collapsed"]
    kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, raw, at in blocks(batch.column("text")):
                gap = white(raw)
                begins, ends, row_at = spans(raw, at, gap)
                strings = word_strings(raw, begins, ends, gap)
                coded = strings.dictionary_encode()
                row, starts, stops, q = runs_of(coded.indices.to_numpy().astype(np.int64), len(coded.dictionary), row_at, least, times)
                depth = np.zeros(len(strings) + 1, np.int64)
                np.add.at(depth, starts + q, 1)
                np.add.at(depth, stops, -1)
                offsets = np.searchsorted(row, np.arange(end - first + 1)).astype(np.int32)
                fields = [pa.array(x) for x in (starts - row_at[row], stops - starts, q)]
                runs = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(fields, fields=list(kind)))
                texts = _texts(strings, np.cumsum(depth)[:-1] == 0, row_at)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, end - first), pa.array(np.diff(row_at)), runs, texts], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
