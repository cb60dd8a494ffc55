"""Collocations: phrases, cuts and ranks against a plain count, with stripes cut into cells and spread over buckets."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from scholiast.llm import collocations as C
from scholiast.llm.queries import op13_collocations
from scholiast.llm.tokens import U64

ODD = ["a-b c_d", "é É é", "x\x0by\x0cz", "no break", "tab\there", "A.b;c:d!e?f,g", " . . ", "don't", "naïve  naïve", "日本 語"]


def plain(rows, least=10, inside=50, top=2000):
    f, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in (1, 2, 3):
                for i in range(len(words) - k + 1):
                    key = (lang, tuple(words[i : i + k]))
                    f[key] = f.get(key, 0) + 1
    candidates = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= least}
    longest = {}
    for (lang, w), a in candidates.items():
        if len(w) == 3:
            for inner in (w[:2], w[1:]):
                longest[lang, inner] = max(a, longest.get((lang, inner), 0))
    out = []
    for lang in n:
        mine = []
        for (where, w), a in candidates.items():
            if where != lang or (len(w) == 2 and 100 * longest.get((lang, w), 0) >= inside * a):
                continue
            score, _, left, right = min((1_000_000 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
            mine.append((-score, -a, " ".join(w).encode(), left, right))
        out += [(lang, i, p.decode(), -a, left, right, n[lang], -score) for i, (score, a, p, left, right) in enumerate(sorted(mine)[:top], 1)]
    return sorted(out)


def rows_of(n, seed):
    r = random.Random(seed)
    names = ["the", "The", "of", "cat", "sat", *(f"w{i}" for i in range(12)), *ODD]
    out = []
    for _ in range(n):
        words = [r.choice(names[:6] if r.random() < 0.5 else names) for _ in range(r.randrange(40))]
        out.append((r.choice(["en", "en", "fr", None, ""]), "".join(w + r.choice([" ", " ", " ", "  ", ", ", "\n", ". "]) for w in words)))
    return [*out, ("en", None), (None, None), ("de", ""), ("de", " .,"), ("xx", "one two " * 30), ("yy", "one two three. " * 10), ("yy", "one two. " * 9)]


def table(spark, rows):
    return spark.createDataFrame([(i, lang, text, "x", i, 2, "w") for i, (lang, text) in enumerate(rows)], "doc_id long, lang string, text string, phrase string, a long, rank int, w1 string").repartition(3)


def found(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize(("least", "inside", "top"), [(10, 50, 2000), (3, 80, 7), (10, 20, 40)])
def test_equals_a_plain_count(spark, least, inside, top):
    rows = rows_of(250, least)
    expected = plain(rows, least, inside, top)
    assert len(expected) > 20 and found(C.collocations(table(spark, rows), least, inside, top)) == expected


def test_small_blocks_buckets_and_cells_give_the_same(spark, monkeypatch):
    rows = rows_of(250, 5)
    for name, value in (("FLUSH_WORDS", 300), ("BUCKET_WORDS", 100), ("CELL_WORDS", 40)):
        monkeypatch.setattr(C, name, value)
    assert found(C.collocations(table(spark, rows))) == plain(rows)


def test_whole_table_equals_a_plain_count(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("lang", "text").collect()
    assert found(op13_collocations(spark, "/root/testdata/sf0.001")) == plain([(r.lang, r.text) for r in docs])


def test_counts_beyond_64_bit_products(spark):
    """Frequencies of 4,000,000,000 and more, from packed stripes that were counted elsewhere."""
    hot = C.Hot([])
    many = np.array([4_000_000_000] * 3, np.int64)
    w = np.array([5, 9, 5], U64), np.array([9, 0, 9], U64), np.array([0, 0, 9], U64)
    row = C._packed("en", (*w, many), hot, 1).to_pylist()[0]
    packed = spark.createDataFrame([tuple(row.values())] * 3, "lang string, bucket long, w1 binary, n1 binary, w2 binary, n2 binary, w3 binary, c binary")
    got = {(r.k, r.w1, r.w2, r.w3): (r.a, r.m) for r in C.merged(packed, hot, 10).collect()}
    big = 12_000_000_000
    assert got == {(1, 5, 0, 0): (2 * big, 0), (1, 9, 0, 0): (big, 0), (2, 5, 9, 0): (2 * big, big), (3, 5, 9, 9): (big, 0)}
    score = "(1000000 * CAST(a AS DECIMAL(19)) * CAST(a AS DECIMAL(19))) div (CAST(b AS DECIMAL(19)) * CAST(b AS DECIMAL(19)))"
    a, b = 2_999_999_999_999, 3_000_000_000_001
    assert spark.createDataFrame([(a, b)], "a long, b long").selectExpr(score).first()[0] == 1_000_000 * a * a // (b * b)


def test_many_distinct_words_are_summed_by_sorting():
    r = np.random.default_rng(1)
    codes = np.arange(1, (1 << 21) + 2, dtype=U64) * U64(7)
    ranks = tuple(np.concatenate([x := r.integers(0, len(codes), 1 << 18), x[:1000]]) for _ in range(3))
    got = C.summed(codes, ranks, None)
    expected = Counter(zip(*(codes[x].tolist() for x in ranks), strict=True))
    assert dict(zip(zip(*(x.tolist() for x in got[:3]), strict=True), got[3].tolist(), strict=True)) == expected


def test_empty_table(spark):
    assert found(C.collocations(table(spark, []))) == [] and found(C.collocations(table(spark, [("en", None)]))) == []
