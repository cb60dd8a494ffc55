"""Library paging, folders, moves, links and record fields on literal rows."""

import datetime

from pyspark.sql import functions as F

from scholiast.operators import library as L
from scholiast.operators import matching as M
from scholiast.operators import stores as S


def papers(spark):
    return spark.createDataFrame([(f"paper-{i}", f"Paper {i:02d}", "Researcher", 2025, f"{i}.pdf") for i in range(35)], "paper_id string, title string, authors string, year int, source_pdf string")


def test_paging_search_and_folders(spark):
    none = spark.createDataFrame([], "paper_id string, folder_id string")
    assert L.page(L.listing(papers(spark), none), 2).count() == 5
    assert [r.paper_id for r in L.listing(papers(spark), none, "PAPER 34").collect()] == ["paper-34"]
    assert L.listing(papers(spark).limit(0), none).count() == 0
    member = spark.createDataFrame([("paper-1", "r"), ("paper-2", "r")], "paper_id string, folder_id string")
    assert L.listing(papers(spark), member, folder="r").count() == 2
    assert L.listing(papers(spark), member, folder="unfiled").count() == 33
    assert L.listing(papers(spark), member).count() == 35


def test_moves(spark):
    day = datetime.date(2020, 1, 1)
    tasks = spark.createDataFrame([(1, None, "todo", None), (2, day, "done", day), (3, day, "done", day), (4, day, "todo", None)], "id int, due_date date, status string, completed_at date")
    moves = spark.createDataFrame([(1, False, None, "done"), (2, False, None, "doing"), (3, True, None, "done"), (4, True, datetime.date(2022, 2, 2), None)], "id int, dated boolean, date date, column string")
    now = F.lit("2021-01-01").cast("date")
    got = {r.id: (r.due_date, r.status, r.completed_at) for r in S.moved_tasks(tasks, moves, now).collect()}
    assert got == {1: (None, "done", datetime.date(2021, 1, 1)), 2: (day, "in_progress", None), 3: (None, "done", day), 4: (datetime.date(2022, 2, 2), "todo", None)}


def test_membership_totals(spark):
    member = spark.createDataFrame([("paper-1", "r"), ("paper-2", "r"), ("gone", "r")], "paper_id string, folder_id string")
    folders = spark.createDataFrame([("r",), ("empty",)], "folder_id string")
    assert {r.name: r.n for r in L.totals(papers(spark), member, folders).collect()} == {"total": 35, "total_all": 35, "unfiled": 33, "r": 2, "empty": 0}


def test_links_keys_and_stems(spark):
    old = spark.createDataFrame([(1, 1, "cites", "a", 1)], "manuscript_id int, paper_id int, link_type string, note string, created_at int")
    new = spark.createDataFrame([(1, 1, "cites", "b", 2), (1, 1, "extends", "c", 2), (1, 2, "bogus", "d", 2), (1, 9, "cites", "e", 2)], old.schema)
    known = spark.createDataFrame([(1, 1)], "manuscript_id int, paper_id int"), spark.createDataFrame([(1, "T", "A", 2000), (2, "U", "B", 2001)], "paper_id int, title string, authors string, year int")
    after = L.upsert_links(old, new, *known)
    assert sorted(tuple(r) for r in after.collect()) == [(1, 1, "cites", "b", 1), (1, 1, "extends", "c", 2)]
    assert {r.title for r in L.linked_papers(after, known[1]).collect()} == {"T"}
    records = spark.createDataFrame([(1, "Doe, J", 2020, "The bubbles"), (2, "Doe, K", 2020, "Bubbles"), (3, None, None, None)], "id int, authors string, year int, title string")
    assert [r.citation_key for r in L.with_unique_keys(records, "id").orderBy("id").collect()][:2] == ["doe2020bubbles", "doe2020bubbles2"]
    entries = spark.createDataFrame([(1, "a/12.pdf"), (2, "312.pdf"), (3, "b/12.pdf")], "ord int, filename string")
    assert {(r.stem, r.ord) for r in L.last_per_stem(entries, "ord").collect()} == {("12", 3), ("312", 2)}


def test_works_issn_and_attachments(spark):
    works = spark.createDataFrame([("10.1/A", "article", "<i>T</i>", [("Doe", "J"), ("Roe", None)], None, 2019, 2018), ("10.1/a.s001", "article", "S", [], 2020, None, None), ("10.1/b", "component", "C", [], 2020, None, None)], "doi string, type string, title string, authors array<struct<family:string,given:string>>, print_year int, online_year int, issued_year int")
    assert [tuple(r) for r in L.filtered_works(works).collect()] == [("10.1/a", "T", "Doe, J; Roe", 2019)]
    j = spark.createDataFrame([([("electronic", "e"), ("print", "p")], ["x"]), ([], ["x"]), ([], [])], "issn_type array<struct<type:string,value:string>>, issn array<string>")
    assert [r.i for r in j.select(L.issn_of(F.struct("issn_type", "issn")).alias("i")).collect()] == ["p", "x", None]
    files = spark.createDataFrame([("a.PNG", b"\x01"), ("b.txt", b"hello"), ("c.txt", b"x" * 20)], "name string, content binary")
    got = {r.name: (r.kind, r.value) for r in L.attachment_text(files, most_bytes=10, most_chars=3).collect()}
    assert got == {"a.PNG": ("image", "AQ=="), "b.txt": ("text", "hel")}


def test_index_tables(spark):
    chunks = spark.createDataFrame([("1", "a b a"), ("2", "c")], "chunk_id string, text string")
    new, posts = L.index_tables(chunks, chunks.filter("chunk_id = '2'"))
    assert new.count() == 1 and {(r.token, r.tf) for r in posts.collect()} == {("a", 2), ("b", 1)}


def test_title_reconciliation_on_the_literal_cases(spark):
    kind = "paper_id string, title string, title_original string, doi string, source_pdf string"
    source = "paper_id string, doi string, file string, title string"
    paper = spark.createDataFrame([("123", "123", None, "10.123/test", "/papers/123.pdf")], kind)
    card = spark.createDataFrame([("123", None, None, "A true title")], source)
    fixed = M.reconciled_titles(paper, card)
    assert [tuple(r) for r in fixed.collect()] == [("123", "A true title", "123", "10.123/test", "/papers/123.pdf", True)]
    assert M.reconciled_titles(fixed.drop("changed"), card).filter("changed").count() == 0  # a second run changes nothing
    curated = spark.createDataFrame([("123", "User corrected title", None, None, "/papers/123.pdf")], kind)
    assert M.reconciled_titles(curated, card).filter("changed").count() == 0
    two = spark.createDataFrame([(None, None, "/a/123.pdf", "One long title"), (None, None, "/b/123.pdf", "Another long title")], source)
    assert M.reconciled_titles(paper, two).filter("changed").count() == 0
    other = spark.createDataFrame([(None, None, "/a/3123.pdf", "A title of another file")], source)
    assert M.reconciled_titles(paper, other).filter("changed").count() == 0
    by_doi = spark.createDataFrame([(None, "10.123/TEST", None, "Title by its DOI")], source)
    assert M.reconciled_titles(paper, by_doi).first().title == "Title by its DOI"


def test_notes_and_experiments_meet(spark):
    from scholiast.operators import mirror

    x = spark.createDataFrame([("a", " A\n name ", "text"), ("b", None, " "), ("c", "C", "row"), ("d", "D", "same"), ("e", "E", "old"), ("f", "F", "both row"), (None, "N", "x"), ("g", "G", None), ("h", "H", "fresh")], "id string, name string, notes_md string")
    note = lambda i, experiment, title, body: (f"experiment-{i}", experiment, None, "d0", title, body)
    n = spark.createDataFrame([note("b", "b", "B", "# B\n\nwas\n"), note("c", "c", "C", "was"), note("d", "d", "D", "\n# Other\nsame"), note("e", "e", "E", "# E\n\nnew from note\n\n"), note("f", "f", "F", "both note"), note("g", "g", "G", "edited"), note("z", "z", " Z  z ", "body"), note("y", None, "Y", "mine"), ("free", None, "x", None, "T", "B")], "note_id string, experiment string, folder string, date string, title string, body string")
    base = spark.createDataFrame([("b", "was"), ("c", "was"), ("d", "gone"), ("e", "old"), ("f", "was"), ("g", "was")], "id string, t string").selectExpr("id", "md5(t) AS digest")
    rows, notes, after, actions = mirror.mirrored(x, n, base, F.lit("now"))
    assert {r.id: r.action for r in actions.collect()} == {"a": "created", "b": "removed", "c": "to note", "d": "conflict", "e": "to experiment", "f": "conflict", "g": "conflict", "z": "unlinked", "y": "kept", "h": "created"}
    got = {r.note_id: r for r in notes.collect()}
    assert tuple(got["experiment-a"]) == ("experiment-a", "a", "experiments", "now", "A name", "# A name\n\ntext\n") and "experiment-b" not in got
    assert (got["experiment-c"].body, got["experiment-c"].date) == ("# C\n\nrow\n", "d0") and got["experiment-f"].body == "both note"
    assert (got["experiment-z"].title, got["experiment-z"].experiment, got["experiment-z"].body) == ("Z z (experiment deleted)", None, "body") and got["free"].folder == "x"
    assert {r.id: r.notes_md for r in rows.collect()}["e"] == "new from note"
    again = mirror.mirrored(rows, notes, after, F.lit("later"))
    assert {r.id: r.action for r in again[3].collect()} == {"a": "same", "c": "same", "d": "conflict", "e": "same", "f": "conflict", "g": "conflict", "z": "kept", "y": "kept", "h": "same"}
    key = lambda df: sorted(map(repr, df.collect()))
    assert key(again[0]) == key(rows) and {r.note_id: r.title for r in again[1].collect()} == {r.note_id: r.title for r in got.values()}
