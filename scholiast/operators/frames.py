"""Phrase frames: words, alternatives and slots that a sentence may be built on (STY-02)."""

from __future__ import annotations

import functools
import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholiast.operators.literals import Required

# fixed value: what stands for a slot
SLOT = r"\[[^\]]*\]|\.\.\.|…|~?\b[A-Z]\b"
_TOKEN = re.compile(rf"(?P<slot>{SLOT})|(?P<space>\s+)|(?P<word>(?:(?!{SLOT})\S)+)")
_CHOICE = re.compile(r"(?P<either>[A-Za-z]*(?:/[A-Za-z]*)+)(?P<mark>[,.;:]?)")


@dataclass(frozen=True)
class Token:
    """A part of a frame: a slot, white space, or a word with the ways in which it can be spelt."""

    kind: str
    text: str

    @property
    def ways(self) -> list[str]:
        if self.kind == "word" and (m := _CHOICE.fullmatch(self.text)):
            return [x + m["mark"] for x in m["either"].split("/") if x] or [m["mark"]]
        return [self.text]

    @property
    def pattern(self) -> str:
        if self.kind == "space":
            return r"\s+"
        ways = [re.escape(w) for w in self.ways]
        return f"(?:{'|'.join(ways)})" if len(ways) > 1 else ways[0]


@dataclass(frozen=True)
class Frame:
    """A frame with the patterns of its literal parts and slots in turn (literal parts first and last), its letters outside slots, whether it opens a sentence, and spellings of which a match must have one."""

    text: str
    pieces: tuple[str, ...]
    literal: int
    opens: bool
    needs: tuple[str, ...]

    @property
    def regex(self) -> str:
        """Matches a whole sentence: what is before the frame, its pieces and what is behind, each a group."""
        return "(?is)" + ("^()" if self.opens else r"^(|.*?\b)") + "".join(f"({p})" for p in self.pieces) + "(.*)$"


def tokens_of(frame: str) -> list[Token]:
    return [Token(m.lastgroup, m.group()) for m in _TOKEN.finditer(frame)]


def frame_of(text: str) -> Frame | None:
    """The frame of a line of a phrase bank; None where it has more than one sentence or fewer than four letters outside slots."""
    said = text.strip()
    tokens = tokens_of(said[:-1] if said.endswith((".", ";", ":")) else said)
    for a, gap, b in zip(tokens, tokens[1:], tokens[2:], strict=False):
        if gap.kind == "space" and a.text[-1] in ".?!" and b.text[0].isascii() and b.text[0].isupper():
            return None
    pieces, literal, words = [""], 0, []
    for is_slot, group in itertools.groupby(tokens, lambda t: t.kind == "slot"):
        run = list(group)
        if is_slot:
            pieces += [x for _ in run for x in (".+?", "")]
        else:
            pieces[-1] = "".join(t.pattern for t in run)
            literal += len("".join(t.text for t in run).strip())
            words += [t for t in run if t.kind == "word"]
    if literal < 4:
        return None
    needs = max((w.ways for w in words), key=lambda ways: min(map(len, ways)))
    return Frame(text, tuple(pieces), literal, tokens[0].kind == "word" and tokens[0].text[0].isupper(), tuple(needs))


@functools.lru_cache(8)
def frames_of(texts: tuple[str, ...]) -> list[Frame]:
    """The usable frames, those with most literal text first, then those that open a sentence, then the first listed."""
    return sorted(filter(None, map(frame_of, texts)), key=lambda f: (-f.literal, not f.opens))


class Matcher:
    """Finds the best frame of a sentence: only frames are tried of which a needed word is there, so a bank's size hardly counts."""

    def __init__(self, frames: list[Frame]):
        self.frames, self.compiled = frames, [re.compile(f.regex) for f in frames]
        self.required = Required(tuple(f.needs for f in frames))

    def best(self, sentence: str) -> tuple[str, list[tuple[str, bool]]] | None:
        """(frame, [(part, whether a slot or outside the frame)])."""
        for i in self.required.possible(sentence):
            if m := self.compiled[i].match(sentence):
                last = len(m.groups()) - 1
                return self.frames[i].text, [(x, k in (0, last) or k % 2 == 0) for k, x in enumerate(m.groups()) if x]
        return None


@functools.lru_cache(8)
def matcher(texts: tuple[str, ...]) -> Matcher:
    return Matcher(frames_of(texts))


def match_frames(said: DataFrame, key: str, sentence: str, frames: list[str]) -> DataFrame:
    """(key, sentence, frame, parts): for every distinct sentence the matching frame with most literal text, then one that opens a sentence, then the first listed; parts are array<struct<text, slot>> that make up the sentence (STY-02). A null sentence matches nothing."""
    known = tuple(frames)
    kind = said.schema[key].dataType.simpleString()
    part = pa.struct([("text", pa.string()), ("slot", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = matcher(known)
        for batch in batches:
            found = [None if s is None else own.best(s) for s in batch.column(1).to_pylist()]
            rows = pa.array([i for i, f in enumerate(found) if f], pa.int64())
            hits = [f for f in found if f]
            parts = pa.array([[{"text": x, "slot": slot} for x, slot in f[1]] for f in hits], pa.list_(part))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array([f[0] for f in hits], pa.string()), parts], [key, sentence, "frame", "parts"])

    return said.select(key, sentence).distinct().mapInArrow(run, f"{key} {kind}, {sentence} string, frame string, parts array<struct<text: string, slot: boolean>>")
