"""Patterns counted in one pass and frames, against each pattern alone."""

import random
import re

import pytest

from scholiast.operators import frames as Fr
from scholiast.operators import literals as L
from scholiast.operators import style as S

KNOWN = list(dict.fromkeys([p for _, p, _, _ in S.MARKERS] + [p for _, p in S.HARD] + list(S.EXTRA.values()) + [S.marker_pattern("the / of / and"), r"\d+", r"a[bc]?d|x{2,3}y", r"(ab)+c", r"[aeiou]x"]))
BANK = ["However, X show/shows that Y.", "X suggests Y.", "the X of the Y", "It was Z used; N", "Two A have been made. In the first, B", "in recent years X", "X, Y", "[refs] report ... of Z", "We/Our [n] see: X's", "~X is ..", "abc ;", "..."]


def a_text(r):
    words = ["however", "Thus", "we", "our", "was", "were", "used", "naïved", "not", "just", "but", "Fig.", "Table", "(2020)", "[3]", ";", "—", ", showing", ", highlighting", "the", "of", "and", "it", "is", "worth", "noting", "Ⅸ", "weſ", "thus-", "suggests", "12", "abcabc", "xxy", "ax", "studies show", "cutting-edge", "today's"]
    return "".join(r.choice(words) + r.choice([" ", " ", "", "\n", ". "]) for _ in range(r.randrange(60)))


@pytest.mark.parametrize("seed", range(10))
def test_one_pass_equals_each_pattern_alone(seed):
    r, own = random.Random(seed), L.patterns(tuple(KNOWN))
    assert sum("" in L.beginnings(p) for p in KNOWN) == 1  # only digits have no literal beginning
    for _ in range(100):
        text = a_text(r)
        assert own.counts(text) == [len(re.findall(f"(?i){p}", text)) if "(" not in p else sum(1 for _ in re.finditer(p, text, re.IGNORECASE)) for p in KNOWN]


def test_counts_of_no_patterns_and_null_texts(spark):
    docs = spark.createDataFrame([(1, None), (2, "However; however")], "k int, t string")
    assert [(r.k, r.c) for r in S.with_counts(docs, "t", [r"\bhowever\b", ";"], "c").orderBy("k").collect()] == [(1, [0, 0]), (2, [2, 1])]
    assert [r.c for r in S.with_counts(docs, "t", [], "c").collect()] == [[], []]


def test_frames_are_read_as_words_slots_and_choices():
    f = Fr.frame_of("However, X show/shows that Y.")
    assert f.opens and f.pieces == (r"However,\s+", ".+?", r"\s+(?:show|shows)\s+that\s+", ".+?", "") and f.literal == 8 + 15
    assert Fr.frame_of("Two A have been made. In the first, B") is None and Fr.frame_of("X, Y") is None and Fr.frame_of("...") is None
    assert not Fr.frame_of("X suggests Y.").opens and Fr.frame_of("X suggests Y").needs == ("suggests",)
    assert Fr.frame_of("We/Our [n] see: X's").pieces == (r"(?:We|Our)\s+", ".+?", r"\s+see:\s+", ".+?", "'s")


@pytest.mark.parametrize("seed", range(5))
def test_best_frame_equals_trying_all(seed):
    r = random.Random(seed)
    bank = [*BANK, *(f"X {a}/{b} {c} Y" for a, b, c in ((f"w{r.randrange(30)}", f"v{r.randrange(30)}", f"u{r.randrange(9)}") for _ in range(500)))]
    frames, own = Fr.frames_of(tuple(bank)), Fr.Matcher(Fr.frames_of(tuple(bank)))
    tried = 0
    for _ in range(300):
        s = " ".join(r.choice(["However,", "a", "show", "that", "suggests", "the", "of", "w1", "v2", "u3", f"w{r.randrange(30)}", f"u{r.randrange(9)}", "in recent years", "report"]) for _ in range(r.randrange(1, 12)))
        best = next((f.text for f in frames if re.match(f.regex, s)), None)
        got = own.best(s)
        assert (got and got[0]) == best and (not got or "".join(x for x, _ in got[1]) == s)
        tried += len(list(own.required.possible(s)))
    assert tried < 300 * 60  # of more than 500


def test_sentences_end_at_marks_but_not_at_abbreviations(spark):
    from scholiast.functions import text as T

    text = 'As et al. Smith say in Fig. 3 here. "Then it really ends." (Next one is e.g. Good today)?! 42 more words follow here. See No. 5 of "Ref." 7 and so on... But that is all'
    assert spark.createDataFrame([(text,)], "t string").select(T.sentences("t")).first()[0] == ["As et al. Smith say in Fig. 3 here.", '"Then it really ends.', "(Next one is e.g. Good today)?!", "42 more words follow here.", 'See No. 5 of "Ref." 7 and so on...', "But that is all"]
