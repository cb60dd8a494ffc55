"""Queries against their DuckDB oracles on texts and keys that the test tables don't hold."""

import difflib
import random
import time

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from scholiast.llm import lm_score
from scholiast.operators import matching as M
from scholiast.operators import retrieval as R


@pytest.fixture
def compared(spark, tmp_path):
    """Compares a query with its oracle over a table of documents with the given texts, or over given tables (SQL of their rows)."""

    def of(name, texts=(), **tables):
        c = duckdb.connect()
        c.execute("create table documents (doc_id bigint, text varchar, lang varchar, source varchar, n_chars bigint)")
        for i, t in enumerate(texts):
            c.execute("insert into documents values (?, ?, 'en', ?, ?)", [i, t, f"src{i % 4}", len(t or "")])
        for table, rows in tables.items():
            c.execute(f"create table {table} as {rows}")
        for table in ("documents", *tables):
            c.execute(f"copy {table} to '{tmp_path}/{table}.parquet' (format parquet)")
        df = __spark_entry__.QUERIES[name](spark, str(tmp_path))
        columns = sorted(df.columns)
        mine = sorted(repr(tuple(r[x] for x in columns)) for r in df.collect())
        theirs = c.sql(__spark_entry__.ORACLES[name])
        at = [theirs.columns.index(x) for x in columns]
        assert mine == sorted(repr(tuple(r[i] for i in at)) for r in theirs.fetchall())

    return of


def test_ris_titles_keep_blanks(compared):
    compared("ris_read", ["a token =", "= x", "#", "tail\n", "", None, "a  b", "one two three four five six seven = nine"])


ODD = ["", " ", "#", "a {b} c", "\nlead", "tail \n", "a\x0bb c", "a\x1cb", "a\u2003b c", None, "a = # b", "TY  - x"]


def test_bibtex_of_odd_titles_is_read(compared):
    compared("bibtex_read", ODD)


def test_bibtex_of_odd_titles_is_written(compared):
    compared("bibtex_written", ODD)


def test_abstracts_of_long_texts_in_time(compared):
    began = time.monotonic()
    compared("works_fetched", ["", None, "one", " a b a ", "a\x0bb c a", *["w" + " the word of a" * n for n in (1, 3, 5000, 9000)] * 20])
    assert time.monotonic() - began < 40  # 87 s when the words were cut again for each of them


def test_crowds_of_equal_titles_meet_once(spark):
    """A title of very many records and files is compared as one; before, each pair of copies was moved, many times."""
    copies = spark.range(20000).select(F.col("id").alias("a"), F.concat(F.lit("bubbles in turbulent water flows"), F.when(F.col("id") % 2 == 1, " x").otherwise("")).alias("text"))
    began = time.monotonic()
    got = M.alike(copies, copies.filter("a % 2 = 0").withColumnRenamed("a", "b"), 0.84, best=True)
    assert got.groupBy("b", "score").count().orderBy("score").collect() == [(0, round(64 / 66, 6), 10000), (0, 1.0, 10000)]
    assert time.monotonic() - began < 60


def test_long_and_odd_texts_equal_all_pairs(spark):
    r = random.Random(4)
    texts = ["".join(r.choice("abé 1") for _ in range(n)) for n in (1, 2, 63, 64, 65, 66, 127, 128, 129, 140, 320) for _ in range(4)]
    left = [(i, "".join(c for c in r.choice(texts) if r.random() > 0.05) or "a") for i in range(40)]
    df = lambda rows, key: spark.createDataFrame(rows, f"{key} long, text string")
    ratio = lambda a, b: round(difflib.SequenceMatcher(None, a, b, autojunk=False).ratio(), 6)
    expected = {(i, j): ratio(x, y) for i, x in left for j, y in enumerate(texts) if ratio(x, y) >= 0.84}
    assert {(x.a, x.b): x.score for x in M.alike(df(left, "a"), df([*enumerate(texts)], "b"), 0.84).collect()} == expected
    best = {i: max((s, -j) for (k, j), s in expected.items() if k == i) for i in {i for i, _ in expected}}
    assert {x.a: (x.score, -x.b) for x in M.alike(df(left, "a"), df([*enumerate(texts)], "b"), 0.84, best=True).collect()} == best


def test_pairs_of_shingles_move_no_sets(spark, compared, monkeypatch):
    """Only postings and the sets of candidates are stored; before, all sets were, and every shingle was moved with its text."""
    stored, store = [], M.cut_lineage

    def noted(df):
        stored.append(out := store(df))
        return out

    monkeypatch.setattr(M, "cut_lineage", noted)
    r = random.Random(3)
    words = lambda n: [r.choice("abcdefghijklmnop") + str(r.randrange(40)) for _ in range(n)]
    texts, licence = ["", None, "one two", "One, two!", "a b c d e f g h"], " ".join(words(12))
    for i in range(120):
        w = words(r.randrange(8, 60))
        texts += [" ".join([*w, licence]), " ".join([*w[: len(w) - i % 6], licence])]
    compared("neardup_pairs", texts)
    posted = [x for x in stored if "g" in x.columns]
    assert [x.count() for x in stored if "s" in x.columns][0] < len(texts) - 5
    assert posted and posted[0].count() < 0.4 * sum(max(1, len((t or "").split()) - 7) for t in texts) + 2 * len(texts)


def test_entities_of_one_place_are_the_first(compared):
    part = "select i as p_partkey, 'B' || i % 3 as p_brand, 'T' || i as p_type from range(60) t(i)"
    compared("entities", part=part, lineitem="select (i * 7) % 60 as l_partkey, i % 5 as l_suppkey, 1 as l_orderkey, i % 2 as l_linenumber from range(300) t(i)")


def test_nearest_equals_all_pairs(spark):
    """Rows on a grid, full of equal scores, others narrow, without length, of other lengths or with nulls."""
    r = random.Random(6)
    rows = [(i, [float(r.randrange(-2, 3)) for _ in range(4)]) for i in range(400)] + [(400 + i, [1.0 + r.random() * 1e-4, 1.0, 1.0, 1.0]) for i in range(300)]
    rows += [(700, [0.0] * 4), (701, None), (702, [1.0]), (703, [1.0, None, 2.0, 3.0]), (704, [float("nan")] * 4), (705, [1.0, 1.0, 1.0, 1.0])]
    v = spark.createDataFrame(rows, "id long, v array<float>").repartition(3)
    asked = v.filter("id in (0, 7, 33, 405, 600, 705)").select(F.col("id").alias("query_id"), F.col("v").alias("query_vector"))
    for queries in (asked, v.filter("id in (5, 700, 703)").select(F.col("id").alias("query_id"), F.col("v").alias("query_vector"))):
        got = sorted(map(str, R.nearest(v, "id", "v", queries, 10).collect()))
        assert got == sorted(map(str, R.top(R.knn(v, "id", "v", queries).filter("id <> query_id"), "id", 10).collect())) and got
    plan = R.nearest(v, "id", "v", asked, 10)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan


@pytest.mark.parametrize("size", [10**9, 10**10])
def test_blocks_grow_with_the_buckets_they_ask(size):
    """At least 500 bytes of text for a question to a bucket; 64 at 10 GB when every block had a megabyte."""
    bits = lm_score.bucket_bits(size)
    questions = size / lm_score.block_bytes(bits) * 2 * (1 << bits)
    assert size / questions >= 500
