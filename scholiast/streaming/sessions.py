"""Answers as they are streamed: thought spans are held back over micro-batches (STM-04)."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle, TimerValues

OPEN, CLOSE = "<think>", "</think>"
_SPAN = re.compile(f"{OPEN}.*?{CLOSE}", re.DOTALL)
#: The state store that processors of this kind need; set it on the session that starts the stream.
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _begun(text: str, tag: str) -> str:
    """The longest end of a text with which `tag` begins without being whole."""
    return next((tag[:n] for n in range(len(tag) - 1, 0, -1) if text.endswith(tag[:n])), "")


def shown(held: str, more: str) -> tuple[str, str]:
    """(what can be shown, what is held back) after `more` text. Held back is the begin of a tag, or an open tag with the begin of a closing one; the rest of a thought is forgotten."""
    *before, last = _SPAN.split(held + more)
    visible, tag, thought = last.partition(OPEN)
    held = OPEN + _begun(thought, CLOSE) if tag else _begun(visible, OPEN)
    if held and not tag:
        visible = visible[: -len(held)]
    return "".join(before) + visible, held


class ThoughtFilter(StatefulProcessor):
    """Rows (session, n, token, last, ms) of a session to rows (session, n, ended, text) that may be shown.

    State is what is held back, less than two tags a session. A row with `last` ends the session: what is held and is no thought is
    shown, and the state goes. Otherwise a timer does the same once the watermark is `silence_ms` past the session's last row.
    """

    def __init__(self, silence_ms: int):
        self.silence_ms = silence_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "text string, n long")

    def _shown_at_end(self, held: str) -> str:
        return "" if held.startswith(OPEN) else held

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:  # noqa: N802, N803
        held, number = self.held.get() if self.held.exists() else ("", -1)
        out, done, latest = [], False, 0
        for row in sorted(rows, key=lambda r: r["n"]):
            text, held = shown("" if done else held, row["token"] or "")
            done, number, latest = bool(row["last"]), row["n"], max(latest, row["ms"])
            out.append(text + (self._shown_at_end(held) if done else ""))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if done:
            self.held.clear()
        else:
            self.held.update((held, number))
            self.handle.registerTimer(latest + self.silence_ms)
        if done or "".join(out):
            yield Row(session=key[0], n=number, ended=done, text="".join(out))

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: object) -> Iterator[Row]:  # noqa: N802, N803
        if self.held.exists():
            held, number = self.held.get()
            self.held.clear()
            if text := self._shown_at_end(held):
                yield Row(session=key[0], n=number, ended=True, text=text)

    def close(self) -> None:
        pass


def without_thoughts(tokens: DataFrame, silence_ms: int = 600_000) -> DataFrame:
    """(session, n, ended, text): the parts of each session that may be shown, as they come, from a stream of tokens (session, n, token, last, at) with a watermark on `at`.

    Spans from <think> to </think>, or to the session's end, go, tags split over tokens and micro-batches too. Tokens of a session must arrive in
    order of n; within a micro-batch any order does. n of a part is that of the last token that it was made from, and of equal ones that with
    `ended` comes last. A null token is an
    empty one. Tokens after a `last` one, or after the session's silence, begin a new text under the same session.
    """
    kind = dict(tokens.dtypes)["session"]
    rows = tokens.select("session", F.col("n").cast("long").alias("n"), "token", F.coalesce("last", F.lit(False)).alias("last"), F.unix_millis("at").alias("ms"), "at")
    return rows.groupBy("session").transformWithState(ThoughtFilter(silence_ms), f"session {kind}, n long, ended boolean, text string", "Append", "EventTime")
