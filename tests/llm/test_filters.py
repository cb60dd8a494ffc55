import math

import numpy as np
import pyarrow as pa

import scholiast.llm.decontaminate as dc
import scholiast.llm.line_dedup as ld
import scholiast.llm.quality as q
from scholiast.llm.tokens import blocks, text_buffers, word_hashes
from tests.llm.helpers import frame, sample, words


def hashed(text):
    (_, _, raw, at), *_ = blocks(pa.array([text]))
    return word_hashes(raw, at)[0]


def test_words_are_those_of_the_pattern():
    texts = ["Ab cD e\x0bf", "", None, "  x ", "É é", "end\n"]
    (_, _, raw, at), *_ = blocks(pa.array(texts))
    h, doc_at, _, _ = word_hashes(raw, at)
    assert np.diff(doc_at).tolist() == [len(words(t)) for t in texts]
    assert hashed("AB x ab")[0] == hashed("AB x ab")[2] and hashed("É é")[0] != hashed("É é")[1]


def test_tiles_cover_reordered_pieces():
    item, doc = hashed("a b c d e f g h i j"), hashed("x f g h i j y a b c d e z")
    assert dc.tiles(item, doc, 4) == [(5, 0, 7), (5, 5, 1)]
    assert dc.tiles(item, hashed("a b c"), 4) == []


def plain_tiles(item, doc, least):
    free_i, free_d, out = [True] * len(item), [True] * len(doc), []
    while True:
        best = (0, 0, 0)
        for p in range(len(item)):
            for t in range(len(doc)):
                n = 0
                while p + n < len(item) and t + n < len(doc) and item[p + n] == doc[t + n] and free_i[p + n] and free_d[t + n]:
                    n += 1
                if n > best[0]:
                    best = (n, p, t)
        if best[0] < least:
            return out
        n, p, t = best
        free_i[p : p + n] = [False] * n
        free_d[t : t + n] = [False] * n
        out.append(best)


def test_tiles_equal_plain_greedy_tiling():
    for seed in range(30):
        a, b = sample(25, seed, 4), sample(60, seed + 1000, 4)
        assert dc.tiles(hashed(a), hashed(b), 3) == plain_tiles(words(a), words(b), 3)


def test_seeds_that_all_items_share_are_met_in_parts(spark, monkeypatch):
    common = "the same four words"
    items = [f"{common} {sample(6, 500 + i, 10**6)} {common}" for i in range(60)] + [common, "one two", None, ""]
    docs = [(i, f"{sample(20, i)} {' '.join(items[j] for j in range(i, i + 3))} {common} {common}") for i in range(8)] + [(20, " ".join(items[j] for j in range(60))), (21, common), (22, "one two"), (23, None)]
    table = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    want = set()
    for i, text in docs:
        for j, item in enumerate(items):
            n = len(words(item))
            found = plain_tiles(words(item), words(text), min(4, n)) if n and words(text) else []
            if found and sum(t[0] for t in found) >= 0.5 * n:
                want.add((i, j, sum(t[0] for t in found)))
    for most in (1 << 20, 50, 1):
        monkeypatch.setattr(dc, "MEETINGS", most)
        got = {(r.doc_id, r.item_id, r.n_words) for r in dc.contaminated(frame(spark, docs).coalesce(1), table).collect()}
        assert got == want


def test_contaminated_documents(spark, monkeypatch):
    items = [(1, sample(30, 1)), (2, sample(3, 2)), (3, None), (4, ""), (1, sample(30, 1))]
    table = spark.createDataFrame([(*x, 9) for x in items], "item_id long, text string, doc_id int")
    one = sample(30, 1).split()
    docs = [(1, sample(200, 50) + " " + sample(30, 1).upper() + " " + sample(20000, 51)), (2, " ".join(one[15:] + ["zz"] + one[:15])), (3, sample(100, 52)), (4, None), (5, ""), (6, "q " + sample(3, 2)), (None, sample(30, 1))]
    got = dc.contaminated(frame(spark, docs), table).collect()
    assert sorted({(r.doc_id or 0, r.item_id) for r in got}) == [(0, 1), (1, 1), (2, 1), (6, 2)]
    assert sorted(r.doc_id or 0 for r in dc.drop_contaminated(frame(spark, docs), table).collect()) == [0, 3, 4, 5]
    monkeypatch.setattr(dc, "SHARD_WORDS", 20)
    assert sorted(map(tuple, dc.contaminated(frame(spark, docs), table).collect()), key=str) == sorted(map(tuple, got), key=str)
    assert dc.contaminated(frame(spark, []), table).count() == 0
    assert dc.contaminated(frame(spark, docs), table.limit(0)).count() == 0


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_lines_equal_brute_force(spark):
    base = [sample(14, i, 40).split() for i in range(5)]
    lines, k = [], 0
    for b in base:
        for variant in (b, b, [*b[:3], "new", *b[4:]], [*b[:7], *b[8:]], [*b, "tail"], ["head", *b], [*b[:2], "p", *b[3:9], "q", *b[10:]], b[:9], [*b[:4], "n", *b[5:9]]):
            lines.append((k // 4, " ".join(variant)))
            k += 1
    docs = {}
    for d, x in lines:
        docs.setdefault(d, []).append(x)
    rows = [(d, "\n".join(["", *x, " "])) for d, x in docs.items()] + [(900, None), (901, ""), (902, "\n\n"), (903, "one line"), (904, "One  line\r")]
    seen, want = [], {}
    for d, text in sorted(rows):
        kept = []
        for x in (text or "").split("\n"):
            w = words(x)
            same = any(w == v or (len(w) >= 10 and len(v) >= 10 and edit_distance(w, v) <= 1) for v in seen)
            if not w or not same:
                kept.append(x)
            if w:
                seen.append(w)
        want[d] = None if text is None else "\n".join(kept)
    got = {r.doc_id: r for r in ld.dedup_lines(frame(spark, rows)).collect()}
    assert {d: r.text for d, r in got.items()} == want
    assert got[904].n_kept == 0 and got[904].n_lines == 1
    left = {r.doc_id for r in ld.drop_repeated_lines(frame(spark, rows)).collect()}
    assert left == {d for d, r in got.items() if r.n_kept or not r.n_lines}
    assert ld.drop_repeated_lines(frame(spark, rows)).columns == frame(spark, rows).columns


def test_lines_of_repeated_rows_null_ids_and_empty_tables(spark):
    rows = [(1, "a b"), (1, "a b"), (None, "a b"), (2, "a b\nc d")]
    got = [(r.doc_id, r.text) for r in ld.dedup_lines(frame(spark, rows)).collect()]
    assert sorted(got, key=str) == [(1, "a b"), (1, "a b"), (2, "c d"), (None, "a b")]
    assert ld.dedup_lines(frame(spark, [])).count() == 0


def test_quality_gradient_is_right():
    (_, _, raw, at), *_ = blocks(pa.array([sample(150, 1), "A B! c", "", sample(70, 2)]))
    x, m = q.bags(raw, at), q.Model()
    label, weight = np.array([1, 0, 1, 0]), np.ones(4)

    def loss():
        y = m.forward(x)[0]
        return float(-np.mean(label * np.log(y) + (1 - label) * np.log(1 - y)))

    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    g = m.gradient(x, label, weight)
    for name, at_ in (("v", (1, 2)), ("u", (3, 4)), ("w", (2,)), ("out", (5,)), ("rate", (0, 3)), ("bias", (4,)), ("word", (int(x.words[3]), 2)), ("shape", (int(x.shapes[0]), 1))):
        m.p[name][at_] += 1e-3
        up = loss()
        m.p[name][at_] -= 2e-3
        down = loss()
        m.p[name][at_] += 1e-3
        assert abs((up - down) / 2e-3 - g[name][at_]) < 1e-3 * max(1, abs(g[name][at_]) * 10), name


def test_quality_scores_equal_a_plain_forward_pass():
    """One document, passage and word at a time."""
    texts = ["", "one", *(sample(n, n) + " Ünd 12 A-B!" for n in (5, 63, 64, 65, 700))]
    bags = q.bags(*text_buffers(pa.array(texts)))
    model = q.Model(3)
    p = {k: v.astype(np.float64) for k, v in model.p.items()}
    for i, got in enumerate(model.scores(bags)):
        hidden, gates = [], []
        for j in range(bags.passage_at[i], bags.passage_at[i + 1]):
            a, b = bags.word_at[j], bags.word_at[j + 1]
            x = bags.rates[j] @ p["rate"] + p["bias"]
            if b > a:
                x = x + sum(p["word"][w] for w in bags.words[a:b]) / (b - a) + sum(p["shape"][w] for w in bags.shapes[a:b]) / (b - a)
            h = np.tanh(x)
            hidden.append(h)
            gates.append(float(sum(p["w"][g] * math.tanh(h @ p["v"][:, g]) / (1 + math.exp(-(h @ p["u"][:, g]))) for g in range(q.GATE))))
        e = np.exp(gates)
        z = sum(w * h for w, h in zip(e / e.sum(), hidden, strict=True))
        assert math.isclose(got, 1 / (1 + math.exp(-(z @ p["out"] + p["at"][0]))), rel_tol=1e-4)
        assert len(hidden) == max(1, -(-len(words(texts[i])) // q.PASSAGE))


def test_quality_sample_takes_four_bytes_a_word():
    """The driver holds the whole sample as bags; wide numbers give the same weights."""
    texts = [sample(20 + 30 * i, i) for i in range(12)] + ["", "A1! b"]
    (_, _, raw, at), *_ = blocks(pa.array(texts))
    small = q.bags(raw, at)
    assert small.words.nbytes + small.shapes.nbytes == 4 * sum(len(words(t)) for t in texts)
    wide = q.Bags(small.words.astype(np.int64), small.shapes.astype(np.int64), small.rates, small.word_at, small.passage_at)
    label = np.arange(len(texts)) % 2
    a, b = (q.Model().fit(x, label, rounds=2).p for x in (small, wide))
    assert all((a[k] == b[k]).all() for k in a)


def test_quality_sample_is_bounded(spark):
    docs = frame(spark, [(i, sample(50, i) if i % 2 else sample(4000, i)) for i in range(60)] + [(7, "again")])
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    model = q.train(docs, labels, per_class=10, most_mb=0.03)
    assert isinstance(model, q.Model) and q.score_quality(docs, model).count() == 61


def test_quality_learns_and_covers_edge_cases(spark):
    good = [(i, sample(80 + i % 50, i)) for i in range(120)]
    bad = [(200 + i, sample(60, i).upper().replace(" ", "!! ")) for i in range(60)]
    rows = good + bad + [(900, None), (901, ""), (None, sample(30, 5)), (902, sample(50000, 6))]
    docs = frame(spark, rows)
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in bad] + [(None, 1, 0), (3, None, 0), (5555, 1, 0)], "doc_id long, quality int, toxic int")
    model = q.train(docs, labels)
    got = {r.doc_id: r for r in q.score_quality(docs, model).collect()}
    assert len(got) == len(rows)
    held = [(i, y) for part, y in ((good, 1), (bad, 0)) for i, _ in part if got[i].held_out]
    assert len(held) > 20 and sum(got[i].predicted == y for i, y in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    assert q.keep_good(docs, labels).count() == sum(r.predicted for r in got.values())
    assert {r.score for r in q.score_quality(docs, q.train(docs, labels.filter("quality = 1"))).collect()} != set()
    assert q.score_quality(frame(spark, []), model).count() == 0
    assert q.keep_good(frame(spark, []), labels).count() == 0
