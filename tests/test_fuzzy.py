"""Fuzzy joins against all pairs, with the ratio of the standard library."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from scholiast.operators import matching as M


def messy(text, r, n):
    w = list(text)
    for _ in range(n):
        i = r.randrange(len(w))
        w[i : i + 1] = [[], ["x"], ["q", w[i]], [w[i], " "]][r.randrange(4)]
    return "".join(w) or "a"


def titles(seed, n):
    r = random.Random(seed)
    words = ["bubble", "water", "surface", "nano", "flow", "study", "on", "the", "of", "charge", "ion", "gas", "layer"]
    return [" ".join(r.choice(words) for _ in range(r.randrange(1, 9))) for _ in range(n)]


def ratio(a, b):
    return difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()


def test_matched_characters_equal_the_standard_ratio():
    r = random.Random(1)
    for a in titles(2, 150):
        b = messy(a, r, r.randrange(9)) if r.random() < 0.7 else r.choice(titles(3, 5))
        assert abs(2 * M.matched_characters(a, b) / (len(a) + len(b)) - ratio(a, b)) < 1e-9


def test_fuzzy_match_equals_all_pairs(spark):
    r = random.Random(5)
    catalog = [(i, t, f"10.1/{i}" if i % 7 == 0 else None) for i, t in enumerate(titles(6, 120))]
    records = [(i, messy(r.choice(catalog)[1], r, r.randrange(7)), f"https://doi.org/10.1/{r.randrange(120)}." if i % 9 == 0 else None) for i in range(80)] + [(900, None, None), (901, "", None)]
    fold = lambda t: " ".join((t or "").split())
    got = {x.record_id: x for x in M.fuzzy_match(spark.createDataFrame(records, "record_id long, title string, doi string"), spark.createDataFrame(catalog, "catalog_id long, title string, doi string")).collect()}
    dois = {d: i for i, _, d in reversed(catalog) if d}
    for i, title, doi in records:
        known = dois.get((doi or "").replace("https://doi.org/", "").rstrip("."))
        if known is not None:
            assert (got[i].catalog_id, got[i].score, got[i].status) == (known, 1.0, "matched")
            continue
        best = max(((round(ratio(fold(title), fold(t)), 6), -j) for j, t, _ in catalog), default=(0, 0)) if fold(title) else (0, 0)
        if best[0] >= 0.84:
            assert (got[i].catalog_id, got[i].score) == (-best[1], best[0]) and got[i].status == ("matched" if best[0] >= 0.96 else "review")
        else:
            assert (got[i].catalog_id, got[i].score, got[i].status) == (None, 0.0, "review")


@pytest.mark.parametrize("least", [0.84, 0.86, 0.95])
def test_short_titles_equal_all_pairs(spark, least):
    """Texts of 1 to 20 characters, those without any common pair of neighbours too."""
    r = random.Random(11)
    texts = ["".join(r.choice("abcde ") for _ in range(n)).strip() or "a" for n in range(1, 21) for _ in range(6)]
    left = [(i, messy(t, r, r.randrange(min(3, len(t))))) for i, t in enumerate(r.choices(texts, k=120))]
    right = [*enumerate(texts)]
    df = lambda rows, key: spark.createDataFrame(rows, f"{key} long, text string")
    got = {(x.a, x.b): x.score for x in M.alike(df(left, "a"), df(right, "b"), least).collect()}
    expected = {(i, j): round(ratio(x, y), 6) for i, x in left for j, y in right if round(ratio(x, y), 6) >= least}
    assert got == expected and any(min(len(left[i][1]), len(texts[j])) < 5 for i, j in got)


def test_no_cartesian_product(spark):
    left = spark.createDataFrame([(1, "ab")], "a long, text string")
    plan = M.alike(left, left.withColumnRenamed("a", "b"), 0.84)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_metadata_match_equals_all_pairs(spark):
    r = random.Random(8)
    records = [(i, t, f"/old/f{i}.pdf" if i % 6 == 0 else None) for i, t in enumerate(titles(9, 60))]
    files = [(i, f"f{r.randrange(60)}" if i % 4 == 0 else messy(r.choice(records)[1], r, 2).replace(" ", "_"), messy(r.choice(records)[1], r, r.randrange(6)) if i % 3 else "") for i in range(60)]
    got = {x.file_id: x for x in M.metadata_match(spark.createDataFrame(files, "file_id long, stem string, title string"), spark.createDataFrame(records, "record_id long, title string, path string")).collect()}
    fold = lambda t: " ".join("".join(c if c.isalnum() else " " for c in (t or "").lower()).split())
    for i, stem, title in files:
        best = (0.0, 0)
        for j, t, path in records:
            score = 1.0 if path and fold(path[5:-4]) == fold(stem) else 0.0
            score = max(score, round(ratio(fold(title), fold(t)), 6) if fold(title) and fold(t) else 0.0, round(ratio(fold(stem), fold(t)), 6) * 0.94 if fold(stem) and fold(t) else 0.0)
            best = max(best, (score, -j))
        if best[0] >= 0.86:
            assert got[i].record_id == -best[1] and abs(got[i].score - best[0]) < 1e-5
        else:
            assert i not in got


def test_names_of_a_sentence(spark):
    from scholiast.functions import models as Mo

    text = "We met Ann Lee and the Group of Bo in May at last. Then Ann Lee and ANN LEE went home with Bo again today. " + "more words " * 5
    found = Mo.named_entities(spark.createDataFrame([(1, text), (2, "Ann Lee is short here")], "id int, t string"), "id", "t")
    assert {(x.sentence, x.name) for x in found.collect()} == {(0, "Ann Lee"), (0, "Group"), (0, "Bo"), (0, "May"), (1, "ANN LEE"), (1, "Bo")}
    pairs = Mo.co_occurrences(found, "id").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).collect()
    assert len(pairs) == 7
    said = spark.createDataFrame([(1, "We saw Ann Lee and Bo there at noon. Then Cy watching Dee Fox was seen walking with Bo again. " + "x" * 60)], "id int, t string")
    named = Mo.verb_relations(Mo.named_entities(said, "id", "t"), said, "id", "t")
    assert {(x.a, x.b, x.relation) for x in named.collect()} == {("Bo", "Cy", "watching"), ("Bo", "Dee Fox", "watching"), ("Cy", "Dee Fox", "watching")}
