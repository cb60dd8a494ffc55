import random

import pytest

import scholiast.llm.near_dedup as nd
from tests.llm.helpers import frame, sample, words


def brute(rows):
    sets = {}
    for i, t in rows:
        w = words(t)
        s = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
        sets.setdefault(i, []).append(s)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and any(x and y and 100 * len(x & y) >= 85 * len(x | y) for x in sets[a] for y in sets[b]):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}


def edited(text, r, n):
    w = text.split()
    for _ in range(n):
        w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
    return " ".join(w)


def rows():
    r, out = random.Random(3), []
    for g in range(12):
        base = sample(150, g)
        for k in range(9):
            out.append((g * 20 + k, edited(base, r, k % 4)))
    out += [(900, "a b"), (901, "A  b"), (902, "a b c"), (903, ""), (904, None), (905, " \t\n"), (906, sample(5, 77)), (907, sample(30000, 78)), (908, sample(30000, 78) + " end")]
    return out


def test_components_equal_brute_force(spark):
    data = rows()
    got = {r.doc_id: r for r in nd.near_duplicates(frame(spark, data)).collect()}
    want = brute(data)
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(r.kept == (r.component_id == i) for i, r in got.items())
    assert got[903].n_shingles == 0 and got[904].n_shingles == 0 and got[905].component_id == 905
    assert got[900].component_id == got[901].component_id == 900 and got[902].component_id == 902


def test_cut_regions_lose_no_component(spark, monkeypatch):
    monkeypatch.setattr(nd, "REGION", 3)
    data = rows()
    got = {r.doc_id: r.component_id for r in nd.near_duplicates(frame(spark, data)).collect()}
    assert got == brute(data)


def test_repeated_rows_shared_ids_and_null_ids(spark):
    a, b = sample(60, 1), sample(60, 2)
    data = [(1, a), (1, a), (2, a), (3, b), (4, a), (4, b), (None, a), (None, b)]
    got = nd.near_duplicates(frame(spark, data)).collect()
    assert len(got) == len(data)
    assert {r.component_id for r in got if r.doc_id is not None} == {1}
    assert all(r.component_id is None and r.kept for r in got if r.doc_id is None)
    kept = nd.drop_near_duplicates(frame(spark, data)).collect()
    assert sorted((r.doc_id or 0) for r in kept) == [0, 0, 1, 1]


def test_empty_table(spark):
    assert nd.near_duplicates(frame(spark, [])).count() == 0


def star(copies=200):
    r, base = random.Random(11), sample(400, 5, 10**6).split()
    out = [(0, " ".join(base))]
    for i in range(1, copies + 1):
        w = list(base)
        for at in r.sample(range(0, 400, 8), 5):
            w[at + 3] = f"y{r.randrange(10**9)}"
        out.append((i, " ".join(w)))
    return out


def test_star_of_many_copies_is_one_component(spark):
    data = star()
    r = random.Random(12)
    ids = r.sample(range(1000), len(data))
    data = [(ids[i], t) for i, t in data]
    got = {x.doc_id: x.component_id for x in nd.near_duplicates(frame(spark, data)).collect()}
    assert set(got.values()) == {min(ids)} and len(got) == 201


def test_star_in_a_region_of_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(nd, "REGION", 3)
    monkeypatch.setattr(nd, "FEW", 2)
    data = star(60) + [(i + 500, t) for i, t in rows()]
    got = {x.doc_id: x.component_id for x in nd.near_duplicates(frame(spark, data)).collect()}
    assert got == brute(data)


def crowd(strangers, pairs, seed=21):
    """Documents of one template: any two have a similarity of about 0.80, `pairs` planted pairs one of 0.853."""
    r = random.Random(seed)
    template = sample(116, seed, 10**6).split()
    out = []

    def page(tail):
        return " ".join([*template, *tail])

    for i in range(strangers):
        out.append((i, page([f"u{r.randrange(10**9)}" for _ in range(14)])))
    for i in range(pairs):
        tail = [f"u{r.randrange(10**9)}" for _ in range(4)]
        out.append((strangers + 2 * i, page([*tail, *[f"v{r.randrange(10**9)}" for _ in range(10)]])))
        out.append((strangers + 2 * i + 1, page([*tail, *[f"v{r.randrange(10**9)}" for _ in range(10)]])))
    return out


def test_pairs_in_a_crowd_are_found(spark):
    data = crowd(1500, 60)
    got = {x.doc_id: x.component_id for x in nd.near_duplicates(frame(spark, data)).collect()}
    want = {i: i - (i - 1500) % 2 if i >= 1500 else i for i, _ in data}
    sets = {i: {tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)} for i, t in data}
    near = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    assert near(0, 1) < 0.85 <= near(1500, 1501)
    assert sum(got[i] == want[i] for i in want) >= 0.999 * len(want)


@pytest.mark.parametrize("numerator", [80, 85])
def test_meetings_lose_no_linked_pair(spark, numerator):
    """Posted under rare shingles, every linked pair of different components meets."""
    r = random.Random(4)
    data = [(i, edited(sample(r.choice([8, 190, 200, 215]), i % 6), r, r.randrange(5))) for i in range(120)]
    sets = {i: {tuple(words(t)[j : j + 5]) for j in range(len(words(t)) - 4)} for i, t in data}
    linked = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= numerator * len(sets[a] | sets[b])}
    docs = frame(spark, data)
    nobody = spark.createDataFrame([], "id long, component long")
    met = {tuple(x) for x in nd.meetings(nd.postings(docs, 5, numerator), nobody, numerator, first=False).collect()}
    assert len(linked) > 20 and linked <= met and len(met) < len(sets) * (len(sets) - 1) / 4


def test_shingles_of_one_text_are_not_posted(spark):
    """Postings grow with what texts share, not with their words; none that could make a meeting goes."""
    data = crowd(200, 10) + [(1000 + i, sample(150, 1000 + i, 10**6)) for i in range(100)]
    posted = nd.postings(frame(spark, data), 5, 85).collect()
    own = sum(x.id >= 1000 for x in posted)
    assert own < 0.1 * 100 * 146  # one for each shingle and class of sizes before; now those whose counter another one shares
    met = nd.shared_postings(nd.postings(frame(spark, data), 5, 85)).collect()
    ids = {}
    for x in met:
        ids.setdefault((x.token, x.bucket), set()).add(x.id)
    assert ids and all(len(x) > 1 for x in ids.values())
    assert {tuple(sorted(x)) for x in ids.values()} >= {(200 + 2 * i, 201 + 2 * i) for i in range(10)}


def test_what_meets_the_components_is_shared(spark, monkeypatch):
    """Ids of components are joined to postings under which others stand, not to all postings."""
    seen = {}
    real = nd.meetings

    def spy(posted, *rest, **named):
        seen["n"], seen["keys"] = posted.count(), posted.select("token", "bucket").distinct().count()
        return real(posted, *rest, **named)

    monkeypatch.setattr(nd, "meetings", spy)
    data = crowd(150, 10)
    got = {x.doc_id: x.component_id for x in nd.near_duplicates(frame(spark, data)).collect()}
    assert sum(got[i] == i - (i - 150) % 2 for i in range(150, 170)) >= 19
    assert 2 * seen["keys"] <= seen["n"] < 10 * len(data)
