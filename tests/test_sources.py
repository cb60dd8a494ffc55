"""Files, feeds and table functions."""

import datetime
import json
import pathlib
import uuid

import pytest
from pyspark.sql import functions as F

from scholiast.functions import citations as C
from scholiast.functions.tables import register
from scholiast.sources.feeds import read_feeds
from scholiast.sources.files import write_files
from scholiast.sources.paged import FolderService, read_service, stream_service
from scholiast.streaming.windows import append


def files_of(folder):
    return {p.name: p.read_text() for p in folder.iterdir() if not p.name.startswith((".", "_"))}


def test_files_are_written_whole_or_not_at_all(spark, tmp_path):
    rows = lambda x: spark.createDataFrame(x, "name string, text string")
    write_files(rows([("a.md", "é\n"), ("b/../c.txt", None), (".hidden", "x")]), str(tmp_path))
    assert files_of(tmp_path) == {"a.md": "é\n", "b_.._c.txt": "", "hidden": "x"}
    assert json.loads((tmp_path / "_files.json").read_text())[0] == {"name": "a.md", "bytes": 3}
    before = files_of(tmp_path)
    failing = rows([(f"n{i}", "x") for i in range(9)]).repartition(3).unionByName(rows([(None, "no name")]))
    for bad, why in ((failing, "needs a name"), (rows([("d", "1"), ("d", "2")]), "already"), (rows([("a.md", "new"), ("e", "1")]), "already")):
        with pytest.raises(Exception, match=why):
            write_files(bad, str(tmp_path))
        assert files_of(tmp_path) == before and not list(tmp_path.glob("_*-*"))
    write_files(rows([("a.md", "new")]), str(tmp_path), overwrite=True)
    assert files_of(tmp_path) == {"a.md": "new"}


def test_a_page_holds_its_text_safely(spark):
    text = 'a </script> "b" \\ é\n</SCRIPT>'
    page = spark.createDataFrame([('<T> & "x"', text), (None, None)], "t string, m string").select(C.as_page(F.col("t"), F.col("m"))).collect()
    source = page[0][0].split('id="source">')[1].split("</script>")[0]
    assert json.loads(source) == [text] and "<title>&lt;T&gt; &amp; &quot;x&quot;</title>" in page[0][0]
    assert "<title>Manuscript</title>" in page[1][0] and '"source">[""]<' in page[1][0]


def test_feeds_of_both_kinds(spark, tmp_path):
    (tmp_path / "a.xml").write_text('<rss><channel><title>Feed</title><item><title>A</title><link> http://x/1 </link><dc:identifier xmlns:dc="u">doi:10.1/A</dc:identifier><pubDate>Tue, 05 Mar 2024 10:00:00 GMT</pubDate></item><item><title>B</titel></item><item><guid isPermaLink="true">g</guid><description>D</description><pubDate>soon</pubDate></item></channel></rss>')
    (tmp_path / "b.xml").write_text('<feed xmlns="http://www.w3.org/2005/Atom"><title>F</title><entry><title>C</title><id>i</id><link rel="self" href="s"/><link rel="alternate" href="p"/><content>text</content><updated>2024-03-05T11:00:00+01:00</updated></entry></feed>')
    good, broken = read_feeds(spark, str(tmp_path))
    got = {(r.dialect, r.title, r.description, r.link, r.identifier, str(r.published)) for r in good.withColumn("published", F.unix_seconds("published")).collect()}
    assert got == {("rss", "A", None, "http://x/1", "doi:10.1/A", "1709632800"), ("rss", None, "D", None, "g", "None"), ("atom", "C", "text", "p", "i", "1709632800")}
    assert ["<title>B</titel>" in r.text for r in broken.collect()] == [True]


def test_table_functions_in_sql(spark):
    register(spark)
    docs = spark.createDataFrame([(1, "k", "One two three four. Five six seven eight no. 9 end", 5), (2, "k", None, 7), (3, "l", "x " * 40, 9), (4, "k", "z", 1)], "id int, key string, chunk string, size int")
    sql = lambda text: [tuple(r) for r in spark.sql(text, rows=docs).collect()]
    assert sorted(sql("SELECT id, number, sentence FROM sentences_of(TABLE({rows}), 'chunk', 2) WHERE id = 1")) == [(1, 0, "One two three four."), (1, 1, "Five six seven eight no. 9 end")]
    assert sorted(sql("SELECT id, position, _chunk FROM chunks(TABLE({rows}), 'chunk', 60, 20) WHERE id <> 1")) == [(3, 0, ("x " * 30).strip()), (3, 1, ("x " * 20).strip()), (4, 0, "z")]
    assert sorted(sql("SELECT id, used FROM first_within(TABLE({rows}) PARTITION BY key ORDER BY (id), 'size', 12)")) == [(1, 5), (2, 12), (3, 9)]
    with pytest.raises(Exception, match="must be a table"):
        sql("SELECT * FROM chunks('no', 'table')")


class Asked:
    """A service that notes what it was asked for, in files that tasks share."""

    def __init__(self, folder):
        self.folder = str(folder)

    def keys(self):
        return ["a", "b", "c"]

    def newest(self, key):
        return "2"

    def page(self, key, cursor, since):
        (pathlib.Path(self.folder) / f"{key}{cursor}{since}-{uuid.uuid4().hex}").touch()
        rows = [(datetime.date(2024, 1, 1 + i + 10 * int(cursor)), f"{key}{cursor}{i}") for i in range(3)] + [(None, "undated")]
        return rows, None if cursor == "1" else str(int(cursor) + 1)


def test_filters_reach_the_service(spark, tmp_path):
    works = read_service(spark, Asked(tmp_path), "name string")
    day = datetime.date(2024, 1, 11)
    got = works.filter(F.col("key").isin("a", "c") & (F.col("published") >= F.lit(day)) & (F.col("name") != "c11"))
    assert sorted(r.name for r in got.collect()) == ["a10", "a11", "a12", "c10", "c12"]
    assert {p.name.rsplit("-", 1)[0] for p in tmp_path.iterdir()} == {f"{k}{c}{day}" for k in "ac" for c in "01"}
    assert sorted(r.name for r in read_service(spark, Asked(tmp_path), "name string", most=2).filter("key = 'b'").collect()) == ["b00", "b01"]
    assert read_service(spark, Asked(tmp_path), "name string").filter("key = 'none'").count() == 0


def test_a_stream_goes_on_at_its_cursors(spark, tmp_path):
    service = FolderService(str(tmp_path / "pages"))
    run = lambda: append(stream_service(spark, service, "n int"), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    (tmp_path / "pages").mkdir()
    pages = {"k-0": [["2024-01-01", 1], [None, 2]], "k-1": [["2024-01-02", 3]], "m-0": []}
    for name, rows in pages.items():
        (tmp_path / "pages" / f"{name}.json").write_text(json.dumps(rows))
    run()
    run()
    for name, rows in {"k-2": [["2024-01-03", 4]], "m-1": [["2024-01-03", 5]], "n-0": [["2024-01-03", 6]]}.items():
        (tmp_path / "pages" / f"{name}.json").write_text(json.dumps(rows))
    run()
    assert sorted((r.key, r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("k", 1), ("k", 2), ("k", 3), ("k", 4), ("m", 5), ("n", 6)]
