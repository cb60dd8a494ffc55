"""The stored index against plain BM25 and plain phrase counts over all texts."""

import math
import random
import re
from collections import Counter
from pathlib import Path

import pytest

from scholiast.operators import lexical
from scholiast.operators.lexical import LexicalIndex

WORDS = ["nano", "bubble", "water", "the", "of", "é", "a_b", "x1", *(f"w{i}" for i in range(30))]


def texts(n, seed):
    r = random.Random(seed)
    return [(i, " ".join(r.choice(WORDS[:8] if r.random() < 0.5 else WORDS) + r.choice(["", ",", ".", "-Z"]) for _ in range(int(r.paretovariate(1)) * 3 % 200))) for i in range(n)]


def tokens(text):
    return re.findall(r"[^\W]+", (text or "").lower())


def plain_search(docs, queries, k):
    words = {i: tokens(t) for i, t in docs}
    mean = sum(map(len, words.values())) / len(words)
    df = Counter(w for ws in words.values() for w in set(ws))
    out = {}
    for q, query in queries:
        scores = {}
        for i, ws in words.items():
            tf = Counter(ws)
            parts = [math.log(1 + (len(words) - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * len(ws) / mean)) for w in set(tokens(query)) if tf[w]]
            if parts:
                scores[i] = round(sum(parts), 6)
        out[q] = sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:k]
    return out


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    docs = [*texts(300, 1), (900, None), (901, ""), (902, "the"), (903, "the of " * 50)]
    path = tmp_path_factory.mktemp("index")
    empty = LexicalIndex(spark, str(path), "doc_id")
    df = lambda rows: spark.createDataFrame(rows, "doc_id long, body string, n int, len int, token string").repartition(3)
    wide = lambda rows: df([(i, t, 1, 2, "x") for i, t in rows])
    first = empty.insert(wide(docs[:120]), "body", cells=8, slice_docs=16)
    before = {p: p.stat().st_mtime_ns for p in Path(path).rglob("*batch=0*/*.parquet")} | {p: p.stat().st_mtime_ns for p in Path(path).rglob("*batch=0*/*/*.parquet")}
    again = first.insert(wide([*docs, (5, "other text of a known key"), (None, "no key")]), "body", slice_docs=16)
    assert len(before) > 3 and all(p.stat().st_mtime_ns == t for p, t in before.items())
    return docs, again, path


QUERIES = [(1, "nano bubble"), (2, "the of the"), (3, "nothing here"), (4, ""), (5, "W3 w4, w5 é a_b"), (6, " ".join(WORDS))]


@pytest.mark.parametrize("k", [1, 7, 400])
@pytest.mark.parametrize("named", [1000, 3])
def test_search_equals_scoring_all(spark, built, monkeypatch, k, named):
    docs, index, _ = built
    monkeypatch.setattr(lexical, "NAMED", named)
    got = {q: [] for q, _ in QUERIES}
    for r in sorted(index.search(spark.createDataFrame(QUERIES, "query_id int, query string"), k).collect(), key=lambda r: r.rank):
        got[r.query_id].append((r.doc_id, r.score))
        assert r.rank == len(got[r.query_id])
    expected = plain_search(docs, QUERIES, k)
    for q in got:
        assert [i for i, _ in got[q]] == [i for i, _ in expected[q]] and all(abs(a[1] - b[1]) < 2e-6 for a, b in zip(got[q], expected[q], strict=True))


def test_slices_that_cannot_reach_the_best_are_left_out(spark, tmp_path):
    docs = [(i, "rare " * 20 if i < 4 else "rare " + "filler " * 60) for i in range(640)]
    index = LexicalIndex(spark, str(tmp_path), "doc_id").insert(spark.createDataFrame(docs, "doc_id long, t string").coalesce(1), "t", cells=2, slice_docs=16)
    found = index.search(spark.createDataFrame([(1, "rare")], "query_id int, query string"), 3)
    assert [r.doc_id for r in sorted(found.collect(), key=lambda r: r.rank)] == [0, 1, 2]
    unpacked = found._jdf.queryExecution().executedPlan()
    assert index.postings().filter("token = 'rare'").count() == 40

    def generated(plan):
        """Rows that explodes have made, by the final plan."""
        names, todo = [], [plan]
        while todo:
            p = todo.pop()
            if p.nodeName() == "AdaptiveSparkPlan":
                p = p.executedPlan()
            if "QueryStage" in p.nodeName():
                p = p.plan()
            if p.nodeName() == "Generate":
                names.append(p.metrics().apply("numOutputRows").value())
            todo += [p.children().apply(i) for i in range(p.children().size())]
        return names

    assert 16 <= min(generated(unpacked)) and max(generated(unpacked)) <= 16 * lexical.LEADING  # of 640 documents


def test_phrases_equal_counting_in_all_texts(spark, built):
    docs, index, _ = built
    queries = [(1, "the of"), (2, "nano"), (3, "of the of the"), (4, "w1 w2"), (5, "bubble é a_b"), (6, "zzz the"), (7, ""), (8, "z the")]
    got = {(r.query_id, r.doc_id): r.n for r in index.phrases(spark.createDataFrame(queries, "query_id int, query string")).collect()}
    expected = {}
    for q, query in queries:
        want = tokens(query)
        for i, t in docs:
            ws = tokens(t)
            n = sum(ws[j : j + len(want)] == want for j in range(len(ws) - len(want) + 1)) if want else 0
            if n:
                expected[q, i] = n
    assert got == expected and len({q for q, _ in got}) >= 5


def test_unfinished_insertions_and_empty_ones_do_not_count(spark, built, tmp_path):
    docs, index, path = built
    assert index.documents().count() == len(docs) and index.insert(spark.createDataFrame([], "doc_id long, body string"), "body").documents().count() == len(docs)
    spark.read.parquet(f"{path}/postings/batch=0").write.partitionBy("cell").parquet(f"{path}/postings/batch=77")
    fresh = LexicalIndex(spark, str(path), "doc_id")
    assert fresh.documents().count() == len(docs)
    q = spark.createDataFrame([(1, "nano")], "query_id int, query string")
    assert LexicalIndex(spark, str(tmp_path / "none"), "doc_id").search(q, 3).count() == 0
    assert fresh.holding(q).count() == sum("nano" in tokens(t) for _, t in docs)
