import math
import random
import zlib

import numpy as np
import pytest

import scholiast.llm.ann as ann
import scholiast.llm.html_text as ht
import scholiast.llm.lm_score as lm
import scholiast.llm.mixing as mx
from tests.llm.helpers import frame, sample, words


def test_levels_and_filter():
    counts = np.array([1, 2, 3, 4, 5, 6, 100, 10**9])
    levels = lm.levels_of(counts, np.arange(8))
    assert (lm._LOW[levels - 1] < counts).all() and (lm._LOW[levels + 1] > counts).all()
    assert lm._LOW[levels[:4]].tolist() == [1, 2, 3, 4]
    drawn = lm._LOW[lm.levels_of(np.full(40000, 10), np.arange(40000))]
    assert set(drawn) == {8.0, 12.0} and abs(drawn.mean() - 10) < 0.05  # the count is the expected value
    keys = np.arange(1, 20001, dtype=np.uint64) * np.uint64(7919)
    stored = (np.arange(20000) % 4 + 1).astype(np.uint8)
    f = lm.Filter({0: lm.Filter.part(keys, stored)}, 6)
    found = f.levels(keys)
    assert (found >= stored).all() and (found > stored).mean() < 0.05
    assert (f.levels(keys + np.uint64(1)) > 0).mean() < 0.05


@pytest.mark.parametrize("order", [2, 3])
def test_lm_scores(spark, order):
    rows = [(i, sample(40 + i, i % 9)) for i in range(60)] + [(900, None), (901, ""), (902, sample(30000, 4)), (903, "Été ÉTÉ"), (903, "Été ÉTÉ"), (None, "x")]
    got = lm.lm_scores(frame(spark, rows), order).collect()
    other = lm.lm_scores(frame(spark, rows), order, most_mb=0).collect()
    key = lambda r: (str(r.doc_id), r.n_tokens)
    for a, b in zip(sorted(got, key=key), sorted(other, key=key), strict=True):
        assert a[:5] == b[:5] and math.isclose(a.base_score, b.base_score) and math.isclose(a.score, b.score)
    counts = {}
    for i, t in rows:
        if i is not None and zlib.crc32(str(i).encode()) % 10:
            for w in [*words(t), "\n"]:
                counts[w] = counts.get(w, 0) + 1
    total, distinct = sum(counts.values()), len(counts)
    base = lambda t: sum(math.log10((counts.get(w, 0) + 0.1) / (total + 0.1 * (distinct + 1))) for w in [*words(t), "\n"])
    assert len(got) == len(rows) and {r.train_tokens for r in got} == {total}
    texts = dict(rows)
    for r in got:
        assert math.isclose(r.base_score, base(texts[r.doc_id]), rel_tol=1e-9)
        assert r.n_tokens == len(words(texts[r.doc_id])) + 1
        assert r.n_known == sum(w in counts for w in [*words(texts[r.doc_id]), "\n"])
        assert r.score <= 0 and r.score >= r.base_score - 0.7
        assert r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 10 == 0)


def test_lm_empty_table(spark):
    assert lm.lm_scores(frame(spark, [])).count() == 0


def test_mixing_meets_targets(spark):
    r = random.Random(1)
    rows = [(i, sample(int(10 ** r.uniform(0.3, 3)), i)) for i in range(300)] + [(900, None), (901, ""), (902, "a b"), (902, "a b"), (None, "c")]
    docs = frame(spark, rows)
    docs = docs.selectExpr("doc_id", "text", "case when doc_id % 5 = 0 then null when doc_id % 5 = 1 then 'Z' when doc_id % 5 = 2 then 'a' else 'é' end as source", "size", "rank")
    got = mx.mix_sources(docs).collect()
    assert len(got) == len(rows)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mx.mix_sources(docs).collect()), key=str)
    sizes = {}
    for x in got:
        sizes[x.source] = sizes.get(x.source, 0) + x["size"]
        assert 0 <= x.taken <= 2 * x["size"] and x.taken == x.copies * x["size"]
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s)))}
    left, targets = 1.5 * sum(sizes.values()), dict.fromkeys(sizes, 0.0)
    while left > 1e-6:
        open_ = [s for s in sizes if targets[s] < 2 * sizes[s] - 1e-9]
        share, total = left, sum(weights[s] for s in open_)
        left = 0.0
        for s in open_:
            targets[s] += share * weights[s] / total
            left += max(0.0, targets[s] - 2 * sizes[s])
            targets[s] = min(targets[s], 2 * sizes[s])
    for s in sizes:
        own = [x for x in got if x.source == s]
        assert all(x.source_size == sizes[s] and math.isclose(x.target, targets[s], rel_tol=1e-9) for x in own)
        assert abs(sum(x.taken for x in own) - targets[s]) <= max(12, 0.01 * targets[s])
    taken = mx.mixed(docs)
    assert taken.columns == [*docs.columns, "copies"] and taken.filter("copies < 1").count() == 0


def test_mixing_empty_and_wordless_tables(spark):
    assert mx.mix_sources(frame(spark, [])).count() == 0
    got = mx.mix_sources(frame(spark, [(1, ""), (2, None)])).collect()
    assert [r.taken for r in got] == [0, 0] and [r.target for r in got] == [0.0, 0.0]
    assert mx.mix_sources(frame(spark, [(1, "one word")])).first().taken in (2, 4)


def test_nearest_recall_ties_and_unusable_vectors(spark):
    r = np.random.default_rng(4)
    x = r.standard_normal((1500, 16))
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    rows += [(2000 + i, x[100].tolist(), 1) for i in range(40)]
    rows += [(3000, None, 1), (3100, [0.0] * 16, 1), (3200, [float("nan")] * 16, 1), (3300, [None] + [1.0] * 15, 1), (3400, [float("inf")] * 16, 1), (None, x[3].tolist(), 1), (3500, [], 1)]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")).collect()
    use = {i: np.array(v) for i, v, _ in rows[:1540]}
    ids = np.array(sorted(use))
    m = np.array([use[i] for i in ids])
    hits = total = 0
    queries = [i for i in use if i % 100 == 0]
    assert {g.query_id for g in got} == set(queries)
    for i in queries:
        d = np.sqrt(((m - use[i]) ** 2).sum(1))
        order = [j for j in np.lexsort((ids, d)) if ids[j] != i][:10]
        mine = sorted((g for g in got if g.query_id == i), key=lambda g: g.rank)
        assert [g.rank for g in mine] == list(range(1, 11))
        assert all(math.isclose(g.score, d[np.searchsorted(ids, g.vec_id)], abs_tol=1e-9) for g in mine)
        hits, total = hits + len({g.vec_id for g in mine} & set(ids[order])), total + 10
    assert hits >= 0.95 * total
    assert [g.vec_id for g in sorted((g for g in got if g.query_id == 100), key=lambda g: g.rank)] == list(range(2000, 2010))


def test_short_lists_of_two_per_cent_and_batches(spark):
    """Recall where the short list is under 2 % of the vectors; cells and batches don't change the result."""
    r = np.random.default_rng(8)
    x = r.standard_normal((6000, 24)) + 2 * r.standard_normal((10, 24))[r.integers(0, 10, 6000)]
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").cache()
    found = ann.nearest(table).collect()
    hits = 0
    for i in range(0, 6000, 100):
        d = ((x - x[i]) ** 2).sum(1)
        d[i] = np.inf
        hits += len(set(np.argsort(d, kind="stable")[:10]) & {g.vec_id for g in found if g.query_id == i})
    assert ann.SHORTLIST < 0.02 * len(x) and hits >= 0.95 * 600
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    again = ann.nearest(table.repartition(5)).collect()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted(map(tuple, found)) == sorted(map(tuple, again))


def test_nearest_is_exact_on_rows_that_codes_tell_little_about(spark):
    """Rows far from zero, narrow clusters, heavy tails, grids full of ties and copies of one id, in several slices."""
    r = np.random.default_rng(11)
    n = 9000
    kinds = {
        "far": 1e4 + 0.1 * r.standard_normal((n, 8)),
        "narrow": r.standard_normal((5, 24))[r.integers(0, 5, n)] + 1e-3 * r.standard_normal((n, 24)),
        "heavy": r.standard_cauchy((n, 12)),
        "grid": r.integers(0, 4, (n, 5)) + 0.5,
    }
    for kind, x in kinds.items():
        ids = np.concatenate([np.arange(n), np.zeros(30, int)])
        x = np.concatenate([x, np.tile(x[0], (30, 1))])  # 31 rows of one id and vector: none is a candidate of its own query
        table = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")
        found = sorted((g.query_id, g["rank"], g.vec_id, g.score) for g in ann.nearest(table).collect())
        want = []
        for i in range(0, n, 100):
            d = np.sqrt(np.cumsum((x - x[i]) ** 2, 1)[:, -1])
            order = [j for j in np.lexsort((ids, d)) if ids[j] != i][:10]
            want += [(i, rank, int(ids[j]), float(d[j])) for rank, j in enumerate(order, 1)]
        assert found == want, kind


def test_vectors_of_several_lengths(spark):
    r = np.random.default_rng(3)
    rows = [(i, r.standard_normal(4).tolist()) for i in range(1, 90)] + [(0, [1.0, 2.0]), (100, [2.0, 1.0]), (200, r.standard_normal(4).tolist()), (101, [1.0, 1.0])]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    near = lambda q: [x.vec_id for x in sorted((x for x in got if x.query_id == q), key=lambda x: x.rank)]
    assert near(0) == [101, 100] and near(100) == [101, 0] and len(near(200)) == 10 and set(near(200)) < set(range(1, 90))


def test_nearest_small_and_empty_tables(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.0])], "vec_id long, embedding array<double>")
    assert [tuple(x)[:3] for x in ann.nearest(few).orderBy("rank").collect()] == [(0, 1, 2), (0, 2, 1)]
    assert ann.nearest(few.limit(0)).count() == 0


def test_html_blocks():
    page = "<!-- x --><body>a &amp; b<br>c<p>d <b>e</b>f<p>g<script>var t='</p>';</script>h<div title='a > b'>i&nbsp; j</div><li>k<li>l < m"
    assert [b.text for b in ht.leaf_blocks(page)] == ["a & b c", "d ef", "gh", "i j", "k", "l < m"]
    assert ht.leaf_blocks("") == [] and ht.leaf_blocks("<p><div></div>") == []
    assert len(ht.leaf_blocks("<" * 50000 + "<p>" * 50 + "x" * 200000)) >= 1


def test_html_field_on_unseen_layouts(spark):
    text = sample(2000, 3).split()
    rows = [(i, f"u{i}", f"<html><body><nav><a>{text[i]}</a></nav><article><h1>{text[i]} title</h1><p>{' '.join(text[i : i + 30])}.</p></article><footer>&copy; {text[i]}</footer></body></html>", 1) for i in range(60)]
    rows += [(900, "u", None, 1), (901, "u", "", 1), (902, None, "<p>", 1), (0, "u0", rows[0][2], 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")
    got = ht.main_text(pages).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    assert all(by[i].text == f"{text[i]} title\n\n{' '.join(text[i : i + 30])}." for i in range(60))
    assert all(r.n_chars == len(r.text) for r in got) and by[900].text == by[901].text == by[902].text == ""
    field = ht.train(pages)
    right = total = 0
    for seed in range(5000, 5200):
        blocks = ht.leaf_blocks(ht.laid_out(text, seed))
        found = field.labels(ht.features(blocks), ht.steps(blocks))
        right += sum(f == int(b.label == "1") for f, b in zip(found, blocks, strict=True))
        total += len(blocks)
    assert right >= 0.97 * total
    assert ht.main_text(pages.limit(0)).count() == 0
