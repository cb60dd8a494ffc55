"""Many patterns in one pass over a text: an Aho-Corasick automaton finds their literal parts, and a pattern is tried only where one of its own is met (STY-01, STY-02, STY-03, MTH-06)."""

from __future__ import annotations

import functools
import itertools
import re
from collections.abc import Iterator
from re import _constants as op
from re import _parser as parser

import ahocorasick

#: Beginnings of one pattern up to which classes and alternatives are spelt out, and letters of one.
MOST_WAYS, MOST_LETTERS = 64, 24
#: Letters that a case-insensitive pattern takes for one of ASCII, one character for one so that places stay.
_LOWER = {**{c: c + 32 for c in range(ord("A"), ord("Z") + 1)}, 0x17F: ord("s"), 0x212A: ord("k")}


def lowered(text: str) -> str:
    return text.translate(_LOWER)


def _ways(tree: parser.SubPattern) -> list[tuple[str, bool]]:
    """(letters, whether they are all of it) with which what a parsed pattern matches can begin; at most MOST_WAYS."""
    ways = [("", True)]
    for kind, value in tree:
        if kind is op.LITERAL:
            more = [(chr(value), True)]
        elif kind is op.IN and all(k is op.LITERAL for k, _ in value):
            more = [(chr(v), True) for _, v in value]
        elif kind is op.AT or kind in (op.ASSERT, op.ASSERT_NOT):
            continue
        elif kind is op.SUBPATTERN:
            more = _ways(value[-1])
        elif kind is op.BRANCH:
            more = [w for part in value[1] for w in _ways(part)]
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT) and value[0] == 0 and value[1] == 1:
            more = [("", True), *_ways(value[2])]
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT) and value[0] > 0:
            more = [(letters, False) for letters, _ in _ways(value[2])]
        else:
            more = [("", False)]
        joined = [(a + b, whole) for (a, going), (b, whole) in itertools.product(ways, more) if going] + [w for w in ways if not w[1]]
        if len(joined) > MOST_WAYS:
            return [(letters, False) for letters, _ in ways]
        ways = joined
        if not any(going for _, going in ways):
            break
    return ways


def beginnings(pattern: str) -> list[str]:
    """Lower-case strings of which one begins every match of a pattern; an empty one if that can't be told."""
    found = {lowered(letters.lower())[:MOST_LETTERS] for letters, _ in _ways(parser.parse(pattern, re.IGNORECASE))}
    return sorted(x for x in found if not any(x != y and x.startswith(y) for y in found))


class Patterns:
    """Counts the matches of several case-insensitive patterns, each as if it were searched for alone."""

    def __init__(self, patterns: tuple[str, ...]):
        self.compiled = [re.compile(p, re.IGNORECASE) for p in patterns]
        starts: dict[str, list[int]] = {}
        self.everywhere = []
        for i, p in enumerate(patterns):
            literals = beginnings(p)
            if "" in literals:
                self.everywhere.append(i)
                continue
            for literal in literals:
                starts.setdefault(literal, []).append(i)
        self.automaton = ahocorasick.Automaton()
        for literal, those in starts.items():
            self.automaton.add_word(literal, (len(literal) - 1, those))
        if starts:
            self.automaton.make_automaton()

    def counts(self, text: str) -> list[int]:
        out, ends = [0] * len(self.compiled), [0] * len(self.compiled)
        hits = [(end - back, those) for end, (back, those) in self.automaton.iter(lowered(text))] if len(self.automaton) else []
        hits.sort(key=lambda h: h[0])
        for at, those in hits:
            for i in those:
                if at >= ends[i] and (m := self.compiled[i].match(text, at)):
                    out[i] += 1
                    ends[i] = m.end()
        for i in self.everywhere:
            out[i] = sum(1 for _ in self.compiled[i].finditer(text))
        return out


@functools.lru_cache(8)
def patterns(known: tuple[str, ...]) -> Patterns:
    """One automaton a worker and list of patterns."""
    return Patterns(known)


class Required:
    """Which of many things can be in a text at all, by words of which each needs one."""

    def __init__(self, needs: tuple[tuple[str, ...], ...]):
        of: dict[str, list[int]] = {}
        self.always = [i for i, words in enumerate(needs) if not all(words)]
        for i, words in enumerate(needs):
            for word in words if all(words) else ():
                of.setdefault(lowered(word.lower()), []).append(i)
        self.automaton = ahocorasick.Automaton()
        for word, those in of.items():
            self.automaton.add_word(word, those)
        if of:
            self.automaton.make_automaton()

    def possible(self, text: str) -> Iterator[int]:
        """Their numbers, in order."""
        met = set(self.always)
        if len(self.automaton):
            for _, those in self.automaton.iter(lowered(text)):
                met.update(those)
        return iter(sorted(met))
