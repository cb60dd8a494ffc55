"""Citations, links, sections and model boundaries on literal texts."""

import numpy as np
from pyspark.sql import functions as F

from scholiast.functions import citations as C
from scholiast.functions import models as M


def one(spark, column, text="x"):
    return spark.createDataFrame([(text,)], "t string").select(column.alias("out")).first()["out"]


def test_citation_checks(spark):
    assert one(spark, C.invalid_citations("t", F.lit(5)), "[1,3] [9] [2–7] [ref] [web:3] [0]") == ["0", "2–7", "9"]
    assert one(spark, C.tokens_cited("t"), "see @a_1 and @b, x@c.d, @a_1 .@e") == ["a_1", "b"]
    assert one(spark, C.slugs_linked("t"), "[[one]] [[two|Two]] [x](three.md) [[one]]") == ["one", "two", "three"]
    got = one(spark, C.mentions("t"), "@[A](mention:task:1) @[B](mention:task:1) @[C](mention:paper:1)")
    assert [tuple(x) for x in got] == [("task", "1", "A"), ("paper", "1", "C")]
    known = F.create_map(F.lit("a"), F.lit(2))
    assert one(spark, C.renumbered("t", known), "@a @b x@a") == "[2] @b x@a"
    titles = F.create_map(F.lit("one"), F.lit("Part one"))
    assert one(spark, C.flattened("t", titles), "[[one]] [[two]] [[one|here]] [text](slug.md)") == "Part one two here slug"


def test_sections_and_blocks(spark):
    assert one(spark, C.section_of(F.lit("03-results"), F.col("t")), "Discussion") == "results"
    assert one(spark, C.section_of(F.lit("x"), F.col("t")), "y") is None
    assert one(spark, C.section_of(F.lit("results-and_discussion"), F.col("t")), "y") == "results"
    assert one(spark, C.trimmed_block("t", 10), "abcdefg\nhijk") == "abcdefg\n…" and one(spark, C.trimmed_block("t", 10), "ab\ncdefghijk") == "ab\ncdefghi\n…"
    assert one(spark, C.trimmed_block("t", 10), "abc\n---\n") == "abc"
    assert one(spark, C.without_exemplars("t"), 'a\n> "quoted"\nb') == "a\n\nb"
    assert one(spark, C.bullets("t"), "- short\n* this one is long enough\n1. so is this one, surely") == ["this one is long enough", "so is this one, surely"]


def test_backlinks_numbers_and_references(spark):
    files = spark.createDataFrame([("p", 1, "a", "[[b]] @k2 @k1"), ("p", 2, "b", "[x](a.md) [[b]] @k1 @k3"), ("q", 1, "b", "[[a]]")], "project string, ord int, slug string, text string")
    assert sorted(map(tuple, C.backlinks(files, "project", "slug", "text").collect())) == [("p", "a", "b"), ("p", "b", "a")]
    assert {(r.key, r.number) for r in C.project_numbers(files, "project", "ord", "text").collect()} == {("k2", 1), ("k1", 2), ("k3", 3)}
    cited = spark.createDataFrame([(1, 2, "x"), (1, 1, "y")], "k int, number int, paper_id string")
    papers = spark.createDataFrame([("x", "A", "T", 2020, None), ("y", None, "U", None, "10.1/z")], "paper_id string, authors string, title string, year int, doi string")
    assert C.references_block(cited, papers, "k").first().block == "\n\n## References\n\n[1] U. https://doi.org/10.1/z\n\n[2] A. T. 2020."


def test_rectangles(spark):
    rects = lambda *r: F.array(*[F.struct(*[F.lit(float(v)).alias(n) for v, n in zip(x, ("x", "y", "width", "height"), strict=True)]) for x in r])
    assert len(one(spark, C.valid_rects(rects((0, 0, 0.5, 0.5), (0, 0, 0, 1))))) == 1
    assert len(one(spark, C.valid_rects(rects((0.9, 0, 0.5, 0.5))))) == 1
    assert one(spark, C.valid_rects(rects((0.9, 0, 1.5, 0.5)))) is None


def test_models(spark):
    rows = spark.createDataFrame([(1, "a b"), (2, None), (3, "b a")], "id int, text string")
    got = {r.id: np.array(r.embedding) for r in M.embedded(rows, "text", M.hashed_embedder(8), batch=2).collect()}
    assert np.allclose(got[1], got[3]) and not got[2].any() and abs(np.linalg.norm(got[1]) - 1) < 1e-6
    t = spark.createDataFrame([(1, None, None), (2, [1.0], None), (3, [1.0], "old"), (4, [1.0], "new")], "id int, v array<double>, m string")
    assert {r.id for r in M.stale(t, "v", "m", "new").collect()} == {1, 3}
    names = spark.createDataFrame([("b:1",), ("a:2",), ("c-x",)], "name string")
    asked = spark.createDataFrame([(1, "a:1"), (2, "z"), (3, "b:1"), (4, None)], "asked int, pinned string")
    got = lambda known, preferences: {r.asked: r.model for r in M.resolved_models(asked, known, preferences).collect()}
    assert got(names, []) == {1: "a:2", 2: "a:2", 3: "b:1", 4: "a:2"} and got(names, ["q", "x"]) == {1: "a:2", 2: "c-x", 3: "b:1", 4: "c-x"}
    assert got(names.limit(0), ["x"]) == {}
    items = spark.createDataFrame([(1, 1, "heading", "Intro", 1), (1, 2, "text", "one", 1), (1, 3, "page_footer", "9", 1), (1, 4, "text", "two", 2), (1, 5, "heading", "References", 3), (1, 6, "text", "[1] A", 3)], "k int, pos int, kind string, text string, page int")
    r = M.parsed_sections(items, "k").first()
    assert [tuple(s) for s in r.sections] == [("Intro", "one\ntwo", 1, 2)] and r.references_raw == "[1] A"
