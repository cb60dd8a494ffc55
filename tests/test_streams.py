"""Streams: thoughts held back over micro-batches, windows in append mode, late rows."""

import datetime
import random
import re

import pytest
from pyspark.sql import functions as F

from scholiast.streaming import sessions as S
from scholiast.streaming import windows as W

PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def at(seconds):
    return datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC) + datetime.timedelta(seconds=seconds)


def plain(text):
    return re.sub(r"(?s)<think>.*?(</think>|\Z)", "", text)


@pytest.mark.parametrize("seed", range(20))
def test_any_cut_shows_what_the_whole_text_shows(seed):
    r = random.Random(seed)
    parts = ["<think>", "</think>", "<th", "ink>", "</thi", "nk>", "<", ">", "/", "a", "b c\n", "<<think>", "</<think>", "think"]
    for _ in range(200):
        text = "".join(r.choice(parts) for _ in range(r.randrange(12)))
        cuts = sorted(r.randrange(len(text) + 1) for _ in range(r.randrange(8)))
        out, held = "", ""
        for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True):
            more, held = S.shown(held, text[a:b])
            out += more
            assert len(held) < len(S.OPEN) + len(S.CLOSE)
        assert out + ("" if held.startswith(S.OPEN) else held) == plain(text)


@pytest.fixture
def rocks(spark):
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, S.ROCKS_DB)
    yield
    spark.conf.set(PROVIDER, before)


def test_sessions_end_by_their_last_token_or_by_silence(spark, tmp_path, rocks):
    schema = "session string, n int, token string, last boolean, at timestamp"
    arrivals = [
        [("s", 1, "ink>no", None, at(1)), ("s", 0, "a <th", None, at(0)), ("quiet", 0, "so <thi", None, at(0)), ("open", 0, "x<think>y", False, at(2))],
        [("s", 2, None, None, at(3)), ("s", 3, "</think> b<", None, at(4)), ("open", 1, "z", None, at(4))],
        [("s", 4, "c", True, at(5)), ("s", 5, "again", None, at(6)), ("late", 0, "now", True, at(4000))],
        [("late", 1, "end", True, at(9000))],
    ]
    for rows in arrivals:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in").withWatermark("at", "10 seconds")
        W.append(S.without_thoughts(stream, 600_000), f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    got = {}
    for r in sorted(spark.read.parquet(f"{tmp_path}/out").collect(), key=lambda r: (r.session, r.n, r.ended)):
        got[r.session] = got.get(r.session, "") + r.text
    assert got == {"s": "a  b<c" + "again", "quiet": "so <thi", "open": "x", "late": "nowend"}


def test_closed_windows_take_nothing_and_late_rows_are_kept_apart(spark, tmp_path):
    hour = 3600
    arrivals = [[(1, "x", 1.0, at(0)), (2, "x", 2.0, at(5 * hour))], [(3, "x", 4.0, at(10)), (4, "x", 8.0, at(5 * hour + 9)), (5, "y", 1.0, at(9 * hour))], [(6, "y", 1.0, at(5 * hour)), (7, "x", 1.0, at(30 * hour))]]
    schema = "event_id int, event_type string, value double, at timestamp"
    for rows in arrivals:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = lambda: spark.readStream.schema(schema).parquet(f"{tmp_path}/in").withWatermark("at", "2 hours")
        W.append(W.tumbling(stream(), "1 hour"), f"{tmp_path}/out", f"{tmp_path}/c1")
        W.late_rows(stream(), "2 hours", F.window("at", "1 hour")["end"], f"{tmp_path}/late", f"{tmp_path}/c2")
    got = sorted((r.event_type, r.n, r.total) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [("x", 1, 1.0), ("x", 2, 10.0), ("y", 1, 1.0)]
    assert sorted(r.event_id for r in W.read_late(spark, f"{tmp_path}/late").collect()) == [3, 6]
