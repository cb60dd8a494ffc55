"""Runs of words: the grammar, the runs and the digests against plain versions."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from scholiast.llm.queries import op12_word_runs
from scholiast.llm.word_runs import re_pair, runs_of, word_runs
from tests.llm.helpers import frame


def plain_runs(x, least=6, times=4):
    """(start, length, period) by comparing all words q apart, for every q."""
    out, n = [], len(x)
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and x[j] == x[j + q]:
                j += 1
            end = j + q
            if j > i and end - i >= max(least, times * q) and not any(q % d == 0 and x[i : end - d] == x[i + d : end] for d in range(1, q)):
                out.append((i, end - i, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_digest(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
    runs = plain_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    sha = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{s},{length},{q}\n" for s, length, q in runs), " ".join(w for i, w in enumerate(words) if i not in gone))]
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], *sha)


def some_words(r):
    k, x = r.choice([1, 2, 2, 3, 5, 50]), []
    for _ in range(r.randrange(6)):
        if r.random() < 0.3:
            x += [r.randrange(k) for _ in range(r.randrange(30))]
        else:
            period = [r.randrange(k) for _ in range(r.randrange(1, 9))]
            x += (period * 9)[: r.randrange(1, 8 * len(period) + 1)]
        if r.random() < 0.2:
            x = x * r.randrange(1, 4)
    return x[:300]


@pytest.mark.parametrize("seed", range(8))
def test_runs_equal_comparing_all_words(seed):
    r = random.Random(seed)
    for _ in range(40):
        rows = [some_words(r) for _ in range(r.randrange(1, 8))]
        at = np.concatenate([[0], np.cumsum([len(x) for x in rows])]).astype(np.int64)
        words = np.array(sum(rows, []), np.int64)
        least, times = r.choice([(6, 4), (4, 4), (10, 5)])
        got = [(int(i), int(s - at[i]), int(e - s), int(q)) for i, s, e, q in zip(*runs_of(words, 60, at, least, times), strict=True)]
        assert got == [(i, *run) for i, x in enumerate(rows) for run in plain_runs(x, least, times)]


def test_fibonacci_and_thue_morse_words():
    fib, morse = [0, 1], [0]
    for _ in range(8):
        fib = fib + fib[: len(fib) * 5 // 8]
        morse = morse + [1 - x for x in morse]
    for x in (fib, morse, morse * 5, [0] * 500, [0, 1] * 100 + [0, 0, 1] * 40):
        got = [(int(s), int(e - s), int(q)) for _, s, e, q in zip(*runs_of(np.array(x, np.int64), 2, np.array([0, len(x)])), strict=True)]
        assert got == plain_runs(x)


def test_grammar_derives_the_words_and_nothing_in_it_repeats():
    r = random.Random(9)
    rows = [some_words(r) for _ in range(200)]
    at = np.concatenate([[0], np.cumsum([len(x) for x in rows])]).astype(np.int64)
    words = np.array(sum(rows, []), np.int64)
    g = re_pair(words, 60, at)
    known = {}

    def derived(s):
        if s < 60:
            return [s]
        if s not in known:
            known[s] = derived(int(g.left[s - 60])) + derived(int(g.right[s - 60]))
        return known[s]

    assert [w for s in g.top for w in derived(int(s))] == words.tolist()
    for i, (first, size) in enumerate(zip(g.first, g.size, strict=True)):
        assert derived(60 + i) == words[first : first + size].tolist()
    pairs = [p for p, a, b in zip(zip(g.top[:-1], g.top[1:], strict=True), g.row[:-1], g.row[1:], strict=True) if a == b]
    assert max(pairs.count(p) for p in set(pairs)) <= 2 and len(g.top) < len(words) / 2


def test_whole_table_equals_plain_digests(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("n_chars < 12000")
    short = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    got = {r.doc_id: tuple(r) for r in op12_word_runs(spark, "/root/testdata/sf0.001").collect()}
    assert len(short) > 150 and len(got) == 200 and sum(g[1] > 0 for g in got.values()) > 5
    for doc_id, text in short.items():
        assert got[doc_id] == plain_digest(doc_id, text)


def test_odd_rows(spark, tmp_path):
    r = random.Random(3)
    texts = [None, "", " \t\n", "a", "a a a a a", "a a a a a a", "A a " * 9, "x y\x0bz " * 5, "é é\x85é " * 4, "  " * 8, "ab a b " * 3, " ".join(["no"] * 30_000)]
    texts += [" ".join(f"w{x}" for x in some_words(r)) for _ in range(60)]
    rows = [(i - 20, t) for i, t in enumerate(texts)] + [(None, "one two " * 6), (None, None), (7, "p q " * 5), (7, "p q " * 5)]
    docs = frame(spark, rows).selectExpr("*", "'mine' AS runs", "1 AS collapsed", "2 AS n_words", "3 AS start")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(repr, map(tuple, op12_word_runs(spark, str(tmp_path)).collect())))
    plain = [plain_digest(i, t) if len(t or "") < 80_000 else None for i, t in rows]
    missing = [g for g in got if g not in set(map(repr, plain))]
    assert len(got) == len(rows) and len(missing) == 1 and "30000, 1, 30000000" in missing[0]
    assert [tuple(x) for x in word_runs(docs.filter("doc_id is null and text is not null")).select("n_words", "collapsed").collect()] == [(12, "one two")]


def test_empty_table(spark):
    assert word_runs(frame(spark, [])).collect() == []
