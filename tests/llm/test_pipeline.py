"""The pipeline against a plain version of each of its stages, on tables with every planted case."""

import pytest

import corpus_pipeline
from scholiast.llm import quality as q
from scholiast.llm.store import stored
from tests.llm.helpers import sample, words
from tests.llm.test_filters import edit_distance, plain_tiles
from tests.llm.test_near_dedup import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    rows = {i: "\n".join([sample(30, i), sample(25, 1000 + i), "shared line of some words"]) for i in range(60)}
    rows[10] = rows[9].replace("w1", "w2", 1)
    rows[20] = rows[20] + "\n" + sample(30, 7777).upper()
    rows[30] = rows[30] + " extra tail"
    rows[31] = rows[30]
    for i in range(100, 130):
        rows[i] = sample(60, i).upper().replace(" ", "!! ")
    rows |= {200: None, 201: "", 202: "\n \n"}
    docs = [(i, t, "en", f"s{i % 3}" if i % 7 else None, len(t or "")) for i, t in rows.items()]
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{at}/documents.parquet")
    labels = [(i, 1, 0) for i in range(60)] + [(i, 0, 0) for i in range(100, 130)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, sample(30, 7777)), (2, sample(30, 8888))], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "line_dedup", "near_dedup", "decontaminate", "mixing"]
    before = {r.doc_id: r.text for r in docs.collect()}
    model = q.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    good = {r.doc_id for r in q.score_quality(docs, model).collect() if r.predicted}
    after = []
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, folder), "stage")
        after.append({r.doc_id: r for r in docs.collect()})
    assert {i: r.text for i, r in after[0].items()} == {i: before[i] for i in good}
    assert not set(range(100, 130)) & good and set(range(60)) <= good

    seen, want = [], {}
    for i in sorted(good):
        left = []
        for line in (before[i] or "").split("\n"):
            w = words(line)
            if not w or not any(w == v or (min(len(w), len(v)) >= 10 and edit_distance(w, v) <= 1) for v in seen):
                left.append(line)
            if w:
                seen.append(w)
        if any(map(words, left)) or not words(before[i]):
            want[i] = None if before[i] is None else "\n".join(left)
    assert {i: r.text for i, r in after[1].items()} == want
    assert all(r.n_chars == len(r.text) for r in after[1].values() if r.text is not None)

    part = brute(list(want.items()))
    kept = {i for i, c in part.items() if i == c}
    assert set(after[2]) == kept
    items = [words(sample(30, 7777)), words(sample(30, 8888))]
    clean = {i for i in kept if all(2 * sum(t[0] for t in plain_tiles(x, words(want[i]), 4)) < len(x) for x in items)}
    assert set(after[3]) == clean and 20 not in clean
    mix = after[4]
    assert set(mix) <= clean and all(1 <= r.copies <= 2 for r in mix.values())
    size = {i: len(words(want[i])) for i in clean}
    taken = sum(r.copies * size[i] for i, r in mix.items())
    assert abs(taken - 1.5 * sum(size.values())) <= 0.05 * sum(size.values())
    for stage in after[:4]:
        assert not stage or list(next(iter(stage.values())).asDict()) == [c.split()[0] for c in SCHEMA.split(", ")]


def test_run_equals_its_stages(spark, folder):
    got = {(r.doc_id, r.copies) for r in corpus_pipeline.run(spark, folder).collect()}
    assert got == {(r.doc_id, r.copies) for r in corpus_pipeline.run(spark, folder).collect()} and got


def test_near_dedup_stage_links_from_080_on(spark, folder):
    base = sample(104, 4242, 10**6).split()
    near, far = list(base), list(base)
    for at in (10, 50):
        near[at] = "other"
    for at in (10, 30, 50):
        far[at] = "another"
    docs = spark.createDataFrame([(1, " ".join(base), "en", "s", 1), (2, " ".join(near), "en", "s", 1), (3, " ".join(far), "en", "s", 1)], SCHEMA)
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, folder).collect()} == {1, 3}


def test_stages_on_edge_rows_and_clashing_names(spark, folder):
    """Nulls, repeated rows, a very long text and columns whose names the stages use themselves."""
    names = "copies _id _key _gone_id _numbers _n_lines _n_kept _kept_id n_lines rank size rate kept component_id".split()
    long = "\n".join(sample(40, 9000 + i, 10**6) for i in range(1500))
    texts = [(1, sample(30, 1)), (1, sample(30, 1)), (2, sample(30, 1)), (3, None), (None, sample(30, 5)), (4, ""), (5, long), (6, " ".join(["word"] * 7))]
    docs = spark.createDataFrame([(i, t, "en", None if i == 2 else "s", len(t or ""), *range(len(names))) for i, t in texts], SCHEMA + "".join(f", {n} int" for n in names))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        rows = out.collect()
        if name != "mixing":
            assert out.columns == docs.columns
            assert all([r[n] for n in names] == list(range(len(names))) for r in rows)
        kept = sorted((r.doc_id or -1) for r in rows)
        if name == "line_dedup":
            assert kept == [-1, 1, 1, 3, 4, 5, 6] and next(r for r in rows if r.doc_id == 5).text == long
        if name == "near_dedup":
            assert kept == [-1, 1, 1, 3, 4, 5, 6]
        if name == "decontaminate":
            assert kept == [-1, 1, 1, 2, 3, 4, 5, 6]
        if name == "mixing":
            assert set(kept) <= {-1, 1, 2, 5, 6} and all(r.copies in (1, 2) and r.rank == names.index("rank") for r in rows)


def test_stages_on_empty_tables(spark, folder):
    empty = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder).count() == 0
