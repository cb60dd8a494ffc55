"""Literal fixtures: nulls, ties, empty input and the edge cases that the test tables lack."""

import difflib
import random
import re

import pytest
from pyspark.sql import functions as F

from scholiast.functions import text as T
from scholiast.functions.chunking import pieces
from scholiast.operators import graph as G
from scholiast.operators import matching as M
from scholiast.operators import recommend as R
from scholiast.operators import retrieval as RT
from scholiast.operators import style as S
from scholiast.operators import tracker as K
from scholiast.sources import bibliography as B
from scholiast.streaming import ingest as I


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in values.items()) or "x int"
    return spark.createDataFrame([tuple(values.values()) or (1,)], schema).select(column.alias("out")).first()["out"]


@pytest.mark.parametrize(("text", "want"), [("", []), (None, []), ("  \n ", []), ("a" * 3200, ["a" * 3200])])
def test_short_texts_are_one_chunk(text, want):
    assert pieces(text) == want


def test_chunk_boundaries():
    assert [len(x) for x in pieces("a" * 3201)] == [3200, 601]
    blank = "a" * 1500 + "\n\n" + "b" * 3000
    assert pieces(blank)[0] == "a" * 1500 and pieces(blank)[1:] == ["a" * 598, "b" * 3000]
    sentence = "a" * 2000 + ". " + "b" * 3000
    assert pieces(sentence)[0] == "a" * 2000 + "."
    early = "a" * 100 + "\n\n" + "b" * 5000
    assert pieces(early)[0] == "a" * 100 and pieces(early)[1].startswith("b")


def test_fusion_keeps_first_arm_on_ties(spark):
    arm = lambda ids: spark.createDataFrame([(1, i, r) for r, i in enumerate(ids, 1)], "query_id int, id string, rank int")
    got = [r.id for r in RT.fuse([arm(["a", "b"]), arm(["c", "b"])], "id").orderBy("rank").collect()]
    assert got == ["b", "a", "c"]
    assert [r.id for r in RT.fuse([arm([]), arm(["c"])], "id").collect()] == ["c"]


def plain_diversify(groups, cap=2, least=6, k=8):
    kept, over, seen = [], [], {}
    for i, g in enumerate(groups):
        seen[g] = seen.get(g, 0) + 1
        (kept if seen[g] <= cap else over).append(i)
    while over and len(kept) < least:
        kept.append(over.pop(0))
    return kept[:k]


@pytest.mark.parametrize("groups", ["aaaaaaaaaa", "ab", "aabbccddee", "abababababcd", "a", "aaab"])
def test_diversify_equals_the_procedure(spark, groups):
    rows = spark.createDataFrame([(1, i, g, i + 1) for i, g in enumerate(groups)], "query_id int, id int, g string, rank int")
    got = [r.id for r in RT.diversify(rows, "g", "id").orderBy("place").collect()]
    assert got == plain_diversify(groups)


def test_normalisation(spark):
    c = F.col
    assert one(spark, T.doi_key(c("d")), d="https://doi.org/10.1/X.") == "10.1/x"
    assert one(spark, T.doi_key(c("d")), d="") is None and one(spark, T.doi_key(c("d")), d=None) is None
    assert one(spark, T.dois(c("t")), t="see 10.1234/ab.c, and 10.1234/ab.c; 10.5555/Z).") == ["10.1234/ab.c", "10.5555/Z"]
    assert one(spark, T.first_year(c("t")), t="in 1899 or 1999 and 2001") == 1999 and one(spark, T.first_year(c("t")), t="x12004") is None
    assert one(spark, T.family_name(c("a")), a="Doe, Jane; Roe, R") == "doe" and one(spark, T.family_name(c("a")), a="Jane van Doe and X") == "doe"
    assert one(spark, T.citation_key(c("a"), c("y"), c("t")), a="Doe, J", y=2020, t="The role of bubbles in water flow") == "doe2020rolebubbleswater"
    assert one(spark, T.slug(c("t"), 5, "-"), t="--A b!c d") == "a-b-c"
    assert one(spark, T.strip_tags(c("t")), t="<p>a &amp;lt; b</p>\n<i>c</i>") == "a &lt; b c"
    assert one(spark, T.preview(c("t"), 3), t="abcd") == "abc…" and one(spark, T.preview(c("t"), 4), t="abcd") == "abcd"
    assert one(spark, T.ascii_fold(c("t")), t="Élan  Vital—x ﬁne № 5") == "elan vitalx fine no 5"
    assert one(spark, T.clean_authors(c("a")), a='["A. B1", "C†"]') == "A. B; C" and one(spark, T.clean_authors(c("a")), a="Unknown") == ""


def test_citations(spark):
    numbers = lambda t, n: one(spark, T.cited_numbers(F.col("t"), F.lit(n)), t=t)
    assert numbers("a [1,3] b [2-4] c [2–4] [9] [ref] [web:3] [a1]", 5) == [1, 2, 3, 4]
    assert numbers("none", 5) == [] and numbers("[7]", 5) == []
    line = T.reference_line(F.lit(2), F.lit("Doe"), F.lit(""), F.lit(2020), F.lit("10.1/x"))
    assert one(spark, line) == "[2] Doe. untitled. 2020. https://doi.org/10.1/x"
    assert one(spark, T.strip_model_references(F.col("t")), t="One two three four.\nReferences\n[1] A") == "One two three four."
    assert one(spark, T.strip_model_references(F.col("t")), t="a\nReferences\n" + "b " * 50) == "a\nReferences\n" + "b " * 50
    assert one(spark, T.without_thoughts(F.col("t")), t="<think>x</think>One") == "One"


def test_title_predicates(spark):
    bad = lambda t: one(spark, T.is_placeholder_title(F.col("t"), F.lit("123"), F.lit("/p/12.pdf")), t=t)
    assert bad("123") and bad("12") and bad("paper_12") and bad("x.pdf") and bad("") and bad(None)
    assert not bad("312 things") and not bad("A real title")
    assert one(spark, T.is_junk_title(F.col("t")), t="Cover") and one(spark, T.is_junk_title(F.col("t")), t="View Article Online") and not one(spark, T.is_junk_title(F.col("t")), t="A real title")
    assert one(spark, T.is_garbled(F.col("t")), t="/a114 ❈❍" * 20) and not one(spark, T.is_garbled(F.col("t")), t="❈" * 79)


def test_exclusive_quantiles(spark):
    for values, want in (([5], 5.0), ([1, 2], 1.5), ([1, 2, 3, 4], 2.5), ([1, 2, 3, 4, 5, 6, 7], 4.0)):
        arr = F.array(*[F.lit(v) for v in values])
        assert one(spark, S.exclusive_quantile(arr, 1, 2)) == want
    import statistics

    data = [3, 1, 8, 2, 9, 4, 7]
    arr = F.array(*[F.lit(v) for v in sorted(data)])
    assert [one(spark, S.exclusive_quantile(arr, i, 4)) for i in (1, 2, 3)] == statistics.quantiles(data, n=4)


def test_transitions_are_a_fold(spark):
    legal = {"draft": ["sent"], "sent": ["accepted", "rejected"]}
    moves = [(1, 1, "accepted"), (1, 2, "sent"), (1, 3, "draft"), (1, 4, "accepted"), (1, 5, "sent"), (2, 1, None), (2, 2, "sent")]
    got = K.accepted_moves(spark.createDataFrame(moves, "id int, ts int, state string"), "id", "state", ["ts"], "draft", legal).collect()
    state, want = {}, {}
    for i, t, s in moves:
        now = state.get(i, "draft")
        ok = s in legal.get(now, [])
        want[i, t] = (now, s, ok)
        state[i] = s if ok else now
    assert {(r.id, r.ts): (r.from_state, r.to_state, r.accepted) for r in got} == want


def test_policy_order_nulls_and_exclusion(spark):
    p = R.Policy(excluded=["x"], need_open=True, floor=2.0, allowed=["low"], blocked_publishers=["ACME"])
    rows = [("closed", False, 9.0, "a"), ("unknown", None, 9.0, "a"), ("low", True, 1.0, "a"), ("poor", True, 1.0, "a"), ("nofactor", True, None, "a"), ("bad", True, 5.0, "Acme"), ("x", True, 5.0, "a"), ("nopub", True, 5.0, None)]
    v = spark.createDataFrame(rows, "venue string, is_open boolean, factor double, publisher string")
    got = {r.venue: r.reason for r in v.filter(~p.excludes(F.col("venue"))).select("venue", p.reason(F.col("venue"), F.col("is_open"), F.col("factor"), F.col("publisher")).alias("reason")).collect()}
    assert got == {"closed": "not open access", "unknown": "not open access", "low": None, "poor": "impact factor below floor", "nofactor": None, "bad": "publisher blocked", "nopub": None}
    assert one(spark, R.rationale(F.lit(0.8), F.lit(0.6), F.lit(0), F.lit(1))) == "Strong abstract match (score 0.80); technique terminology overlap; prior rejection — review rejection notes."
    assert one(spark, R.rationale(F.lit(0.1), F.lit(0.0), F.lit(0), F.lit(0))) == "Moderate topical overlap across recent articles."


def test_graph_expansion_and_components(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "c"), ("c", "d"), ("x", "y"), ("a", "b")], "source_id string, target_id string")
    seeds = spark.createDataFrame([("a",)], "id string")
    for hops, want in ((0, {"a": 0}), (1, {"a": 0, "b": 1}), (2, {"a": 0, "b": 1, "c": 2})):
        assert {r.id: r.hop for r in G.expand(e, seeds, hops).collect()} == want
    pairs = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 90), (7, 7)], "a long, b long")
    got = {r.id: r.component for r in G.components(pairs).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 90: 90, 100: 90}
    assert G.components(pairs.limit(0)).count() == 0


def test_near_duplicate_plan_equals_brute_force(spark):
    import random

    r, docs = random.Random(3), []
    base = [[f"w{r.randrange(500)}" for _ in range(80)] for _ in range(4)]
    for i in range(24):
        w = list(base[i % 4])
        for _ in range(i // 8):
            w[r.randrange(80)] = f"z{r.randrange(9999)}"
        docs.append((i, " ".join(w)))
    docs += [(100, "Short text"), (101, "short  TEXT!"), (102, "a b c d e f g"), (103, "")]
    got = {x.doc_id: x for x in M.near_duplicate_plan(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text").collect()}
    key = {i: " ".join(re.sub("[^a-z0-9]+", " ", t.lower()).split()) for i, t in docs}
    sets = {}
    for i, c in key.items():
        w = c.split(" ")
        sets[i] = {" ".join(w[j : j + 8]) for j in range(max(1, len(w) - 7))}
    root = {i: i for i, _ in docs}

    def find(x):
        return x if root[x] == x else find(root[x])

    for a, _ in docs:
        for b, _ in docs:
            near = len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8 and min(len(key[a]), len(key[b])) >= 0.6 * max(len(key[a]), len(key[b]))
            if a < b and (key[a] == key[b] or near):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    assert {i: x.component for i, x in got.items()} == {i: find(i) for i in got}
    assert sum(x.keep for x in got.values()) == len({find(i) for i in got})


def test_fuzzy_match(spark):
    r = spark.createDataFrame([(1, "Bubbles in turbulent water flows", None), (2, "x", "https://doi.org/10.1/A"), (3, "Bubles in turbulent water flow", None), (4, None, None), (5, "Nothing like it", None)], "record_id int, title string, doi string")
    c = spark.createDataFrame([(10, "Bubbles in turbulent water flows", ""), (11, "Other", "10.1/a"), (12, "Particles in laminar oil", None)], "catalog_id int, title string, doi string")
    got = {x.record_id: x for x in M.fuzzy_match(r, c).collect()}
    assert (got[1].catalog_id, got[1].score, got[1].status) == (10, 1.0, "matched")
    assert (got[2].catalog_id, got[2].status) == (11, "matched")
    ratio = difflib.SequenceMatcher(None, "bubles in turbulent water flow", "bubbles in turbulent water flows").ratio()
    assert abs(got[3].score - ratio) < 1e-6 and got[3].status == ("matched" if ratio >= 0.96 else "review")
    assert got[4].status == got[5].status == "review" and got[4].catalog_id is got[5].catalog_id is None


def test_memberships_and_ids(spark):
    m = spark.createDataFrame([("p1", "f")], "paper_id string, folder string")
    known = spark.createDataFrame([("p1",), ("p2",)], "paper_id string")
    assert K.assign_all_or_nothing(m, spark.createDataFrame([("p1", "g"), ("missing", "g")], m.schema), known, "paper_id").collect() == m.collect()
    assert sorted(map(tuple, K.assign_all_or_nothing(m, spark.createDataFrame([("p1", "g"), ("p2", "g")], m.schema), known, "paper_id").collect())) == [("p1", "g"), ("p2", "g")]
    with pytest.raises(ValueError):
        K.reordered(known, spark.createDataFrame([("p1", 1)], "paper_id string, sort_order int"), "paper_id")
    ids = K.numbered_ids(spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "base string, k int"), "base", "k").orderBy("k").collect()
    assert [r.id for r in ids] == ["a", "a_2", "b"]


def test_bibliography_readers(spark, tmp_path):
    (tmp_path / "a.bib").write_text('@article{k1,\n title = {A {Nested} title},\n author = "Doe, J and Roe, R", year = 2020, number = {3}\n}\n@comment{x}\n@book{k2, title={B}}\n')
    got = {r.external_key: r for r in B.read_bibtex(spark, str(tmp_path / "a.bib")).collect()}
    assert (got["k1"].title, got["k1"].authors, got["k1"].year, got["k1"].issue) == ("A Nested title", "Doe, J; Roe, R", 2020, "3") and got["k2"].year is None
    (tmp_path / "a.ris").write_text("TY  - JOUR\nAU  - Doe, J\nAU  - Roe, R\nT1  - Title\nY1  - 2019/01\nSP  - 1\nEP  - 9\nER  - \nTY  - JOUR\nTI  - Two\nER  - \n")
    ris = {r.title: r for r in B.read_references(spark, str(tmp_path / "a.ris")).collect()}
    assert (ris["Title"].authors, ris["Title"].year, ris["Title"].pages) == ("Doe, J; Roe, R", 2019, "1-9") and ris["Two"].authors is None
    (tmp_path / "a.json").write_text('{"items": [{"id": "x", "title": "T", "author": [{"family": "Doe", "given": "J"}], "issued": {"date-parts": [["2018"]]}, "DOI": "10.1/Z"}, {"id": "y"}]}')
    csl = {r.external_key: r for r in B.read_references(spark, str(tmp_path / "a.json")).collect()}
    assert (csl["x"].authors, csl["x"].year, csl["x"].doi) == ("J Doe", 2018, "10.1/Z") and csl["y"].year is None
    both = B.merged_sources([B.read_csl(spark, str(tmp_path / "a.json")), B.read_csl(spark, str(tmp_path / "a.json"))])
    assert both.count() == 1
    text = B.to_bibtex(B.read_csl(spark, str(tmp_path / "a.json")).filter("external_key = 'x'")).first().value
    assert text.startswith("@article{x,\n  title = {T}") and B.bibtex_entries(text)[0]["doi"] == "10.1/Z"
    (tmp_path / "n.md").write_text("---\ntitle: Hello\ntag: a\n---\n# Head\nbody")
    (tmp_path / "m.md").write_text("# Head\nbody")
    notes = {r.file: r for r in B.read_notes(spark, str(tmp_path / "*.md")).collect()}
    assert notes["n.md"].title == "Hello" and notes["m.md"].title == "Head" and notes["n.md"].body.startswith("# Head")
    assert B.cleaned(spark.createDataFrame([(" x ", "", 7)], "id string, title string, number int")).first()[:2] == ("x", None)


def test_files_feeds_and_inverted_index(spark, tmp_path):
    for name in ("a.PDF", "b.pdf", "._c.pdf", "d.txt"):
        (tmp_path / name).write_bytes(b"%PDF-1")
    parsed = spark.createDataFrame([("a",)], "paper_id string")
    assert [r.paper_id for r in B.new_files(spark, str(tmp_path), parsed).collect()] == ["b"]
    items = spark.createDataFrame([("<b>T</b>", "<p>x</p>", "https://doi.org/10.1000/q", None), (None, None, "", "10.1/z")], "title string, description string, link string, identifier string")
    assert [tuple(r) for r in B.feed_items(items).collect()] == [("10.1000/q", "T", "x")]
    index = F.create_map(F.lit("b"), F.array(F.lit(1)), F.lit("a"), F.array(F.lit(0), F.lit(2)))
    assert one(spark, B.text_of_inverted_index(index)) == "a b a"


def test_ingest_takes_each_file_once(spark, tmp_path):
    src, out, mark = (str(tmp_path / n) for n in ("src", "out", "mark"))
    spark.range(5).coalesce(1).write.parquet(src)
    stream = lambda: spark.readStream.schema("id long").parquet(src)
    for _ in range(2):
        I.ingest_available(stream(), lambda b: b, out, mark)
    assert spark.read.parquet(out).count() == 5
    spark.range(5, 8).coalesce(1).write.mode("append").parquet(src)
    I.ingest_available(stream(), lambda b: b, out, mark)
    assert spark.read.parquet(out).count() == 8


def test_many_neighbourhoods_equal_one_at_a_time(spark):
    r = random.Random(4)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(70)]
    seeds = [(f"q{q}", r.randrange(60)) for q in range(130) for _ in range(r.randrange(1, 4))]
    near = {i: {b for a, b in edges if a == i} | {a for a, b in edges if b == i} for i in range(60)}
    e, s = spark.createDataFrame(edges, "source_id long, target_id long"), spark.createDataFrame(seeds, "query_id string, id long")
    expected = {}
    for q in {q for q, _ in seeds}:
        found = {i: 0 for p, i in seeds if p == q}
        for hop in (1, 2, 3):
            for i in [x for i, h in found.items() if h == hop - 1 for x in near[i]]:
                found.setdefault(i, hop)
        expected |= {(q, i): h for i, h in found.items()}
    assert {(x.query_id, x.id): x.hop for x in G.expand_many(e, s, 3).collect()} == expected


def test_numbers_follow_the_order_over_ranges(spark):
    rows = spark.range(0, 5000, 1, 7).withColumn("k", F.xxhash64("id"))
    got = sorted((x.n, x.k) for x in G.numbered(rows, ["k"], "n").collect())
    assert [n for n, _ in got] == list(range(1, 5001)) and [k for _, k in got] == sorted(k for _, k in got)


def test_queries_beyond_the_broadcast_meet_in_cells(spark):
    from scholiast.operators import retrieval as R

    r = random.Random(2)
    v = spark.createDataFrame([(i, [r.random() for _ in range(4)]) for i in range(60)], "id int, v array<double>")
    q = v.filter("id % 5 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("query_vector"))
    few, many = (sorted(map(tuple, R.knn(v, "id", "v", q, most).collect())) for most in (100, 5))
    assert few == many and len(few) == 60 * 12


def test_budget_skips_and_goes_on(spark):
    rows = spark.createDataFrame([("k", 1, 60), ("k", 2, 50), ("k", 3, 40), ("k", 4, None)], "key string, place int, size int")
    assert sorted(r.place for r in S.first_fitting(rows.filter("size is not null"), "key", "place", "size", 100).collect()) == [1, 3]


def test_merge_and_replace(spark):
    t = spark.createDataFrame([(1, "", "x"), (2, "b", None)], "k int, a string, b string")
    s = spark.createDataFrame([(1, "A", "Y"), (3, "C", None)], "k int, a string, b string")
    assert sorted(map(tuple, M.merge_fill_empty(t, s, "k", ["a", "b"]).collect())) == [(1, "A", "x"), (2, "b", None), (3, "C", None)]
    assert sorted(map(tuple, M.snapshot_replace(t, s, "k").collect()), key=str) == [(1, "A", "Y"), (2, "b", None), (3, "C", None)]
