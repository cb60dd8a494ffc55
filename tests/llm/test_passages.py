import random
import time

import scholiast.llm.substring_dedup as sd
from tests.llm.helpers import frame, sample, words


def test_fenwick_keeps_prefix_maxima():
    r, tree, plain = random.Random(1), sd.Fenwick(50), {}
    for i in range(300):
        k = r.randrange(50)
        v = (r.random(), i)
        tree.put(k, v)
        plain[k] = max(plain.get(k, (0.0, -1)), v)
        q = r.randrange(50)
        assert tree.upto(q) == max([(0.0, -1), *(x for j, x in plain.items() if j <= q)])


def test_chains_equal_quadratic_chaining():
    r = random.Random(2)
    for _ in range(40):
        parts = sorted((r.randrange(120), r.randrange(120), r.randrange(6, 15)) for _ in range(12))
        best = [0.0] * 12
        for i in sorted(range(12), key=lambda i: parts[i][:2]):
            x, y, w = parts[i]
            options = [best[j] - sd.GAP_COST * (x - a - v + y - b - v) for j, (a, b, v) in enumerate(parts) if best[j] and a + v <= x and b + v <= y]
            gain = max([0.0, *options])
            best[i] = w + gain
        top = max(best)
        found = sd.chains(parts)
        assert sorted(f for c in found for f in c) == parts
        score = max(sum(w for _, _, w in c) - sd.GAP_COST * sum(b[0] - a[0] - a[2] + b[1] - a[1] - a[2] for a, b in zip(c, c[1:], strict=False)) for c in found)
        assert score <= top + 1e-9
        if all(x - a - v <= sd.MOST_GAP and y - b - v <= sd.MOST_GAP for a, b, v in parts for x, y, _ in parts if a + v <= x and b + v <= y):
            assert abs(score - top) < 1e-9


def test_planted_passages_are_found_and_clean_documents_left_alone(spark):
    passage, r = sample(60, 999, 10**6), random.Random(5)
    fuzzy = passage.split()
    fuzzy[25] = "other"
    del fuzzy[45]
    rows = [(i, sample(150, i, 10**6)) for i in range(30)]
    for i in (3, 9, 12):
        rows[i] = (i, rows[i][1] + " " + passage.upper() + " " + sample(40, 500 + i, 10**6))
    rows[20] = (20, sample(20, 700, 10**6) + " " + " ".join(fuzzy) + " " + sample(20, 701, 10**6))
    rows[25] = (25, rows[24][1])
    rows += [(900, None), (901, ""), (902, sample(30000, 60606, 10**6)), (None, passage), (25, rows[24][1])]
    r.shuffle(rows)
    got = sd.repeated_passages(frame(spark, rows)).collect()
    assert {x.doc_id for x in got} == {9, 12, 20, 25}
    for i in (9, 12):
        mine = [x for x in got if x.doc_id == i]
        assert [(x.start, x.end, x.ref_id, x.ref_start, x.ref_end, x.equal_words) for x in mine] == [(150, 210, 3, 150, 210, 60)]
    (x,) = [x for x in got if x.doc_id == 20]
    assert (x.start, x.end, x.ref_id, x.equal_words) == (20, 79, 3, 58)
    assert {(x.start, x.end) for x in got if x.doc_id == 25} == {(0, 150)}


def test_every_long_common_run_is_covered(spark):
    r, rows = random.Random(7), []
    pool = [sample(80, 100 + i, 10**5).split() for i in range(6)]
    for i in range(60):
        text = sample(r.randrange(5, 60), i, 10**5).split()
        if r.random() < 0.5:
            p = r.choice(pool)
            a = r.randrange(20)
            text += p[a : a + 55]
        rows.append((i, " ".join(text)))
    got = sd.repeated_passages(frame(spark, rows)).collect()
    covered = {}
    for x in got:
        covered.setdefault(x.doc_id, set()).update(range(x.start, x.end))
    seen = set()
    for i, t in rows:
        w = words(t)
        for j in range(len(w) - 49):
            if tuple(w[j : j + 50]) in seen:
                assert len(set(range(j, j + 50)) - covered.get(i, set())) < sd.SEED + sd.WINDOW
        seen |= {tuple(w[j : j + 50]) for j in range(len(w) - 49)}


def test_empty_table(spark):
    assert sd.repeated_passages(frame(spark, [])).count() == 0


def test_best_predecessor_is_within_the_longest_gap():
    r = random.Random(4)
    for _ in range(60):
        parts = sorted((r.randrange(600), r.randrange(600), r.randrange(6, 90)) for _ in range(40))
        best = [0.0] * 40
        for i in sorted(range(40), key=lambda i: parts[i][:2]):
            x, y, w = parts[i]
            near = [(j, x - a - v, y - b - v) for j, (a, b, v) in enumerate(parts) if 0 <= x - a - v <= sd.MOST_GAP and 0 <= y - b - v <= sd.MOST_GAP]
            best[i] = w + max([0.0, *(best[j] - sd.GAP_COST * (p + q) for j, p, q in near)])
        found = sd.chains(parts)
        score = max(sum(w for _, _, w in c) - sd.GAP_COST * sum(b[0] - a[0] - a[2] + b[1] - a[1] - a[2] for a, b in zip(c, c[1:], strict=False)) for c in found)
        assert abs(score - max(best)) < 1e-9
    lone = [(0, 0, 300), *((500 + 11 * i, 500 + 11 * i, 10) for i in range(5))]
    assert sorted(map(len, sd.chains(lone))) == [1, 5]


def test_exact_passage_survives_a_chain_that_fails(spark):
    exact, phrase = sample(52, 31, 10**6), sample(30, 34, 10**6)  # seeds of both lie in one chain
    rows = [(i, f"{sample(40, 40 + i, 10**6)} {exact} {sample(22, 50 + i, 10**6)} {phrase}") for i in (1, 2)]
    got = sd.repeated_passages(frame(spark, rows)).collect()
    assert [(x.doc_id, x.start, x.end, x.ref_id, x.equal_words) for x in sorted(got)] == [(2, 40, 92, 1, 52), (2, 114, 144, 1, 30)]


def test_failing_chain_is_cut_at_its_weakest_gap():
    u = lambda *v: sd.np.array(v, sd.U64)
    none, far, ref_far = u(), u(*range(100, 125)), u(*range(200, 225))
    regions = [(0, 40, 40, 40, 40, 0, none, none), (1, 92, 117, 92, 117, 52, far, ref_far), (2, 123, 123, 123, 123, 6, none, none)]
    assert sd._passing(regions, 0.8) == [(40, 92, 40, 92, 52)]
    regions[2] = (2, 137, 137, 137, 137, 20, none, none)
    assert sd._passing(regions, 0.8) == [(40, 92, 40, 92, 52), (117, 137, 117, 137, 20)]


def test_passages_that_meet_the_threshold_are_linked(spark):
    """Replaced words at rates up to what identity allows, and passages all of whose phrases occur earlier, apart, in few or in many documents."""
    r, rows, plants = random.Random(5), [], {}
    w = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]

    def plant(kind, passage, changed):
        i = 1 + len(rows)
        plants.setdefault(kind, []).append((i + 100000, i))
        rows.extend([(i, " ".join(w(40) + passage + w(40))), (i + 100000, " ".join(w(50) + changed + w(30)))])

    for n, rate in [(30, 0), (30, 0.1), (60, 0.1), (60, 0.2), (100, 0.2)]:
        for _ in range(40):
            passage = w(n)
            changed = passage[:]
            for j in r.sample(range(n), round(rate * n)):
                changed[j] = f"x{r.randrange(10**6)}"
            plant((n, rate), passage, changed)
    common = [w(8) for _ in range(20)]
    for k in range(20):
        few, many = [w(9) for _ in range(4)], sum((r.choice(common) for _ in range(4)), [])
        rows += [(-10 * k - z - 1, " ".join(w(30) + x + w(30))) for z, x in enumerate(few)]
        plant("few", sum(few, []), sum(few, []))
        plant("many", many, many)
    rows += [(-1000 - z, " ".join(w(30) + common[z % 20] + w(30))) for z in range(400)]
    found = {(x.doc_id, x.ref_id) for x in sd.repeated_passages(frame(spark, rows)).collect()}
    share = {kind: sum(p in found for p in pairs) / len(pairs) for kind, pairs in plants.items()}
    least = {(30, 0): 1, (30, 0.1): 0.7, (60, 0.1): 1, (60, 0.2): 0.95, (100, 0.2): 1, "few": 1, "many": 1}
    assert all(share[kind] >= least[kind] for kind in least), share


def test_places_do_not_depend_on_batches():
    r = random.Random(3)
    table = sorted((r.randrange(6) ** 2, r.randrange(12), r.randrange(4)) for _ in range(300))
    places = {}
    for seed, *place in dict.fromkeys(table):
        places.setdefault(seed, []).append(tuple(place))
    want = sorted((s, *p, *q) for s, own in places.items() for i, p in enumerate(own) for q in (own[:i] if i <= sd.PLACES else own[:1]))
    many = sorted((s, *p) for s, own in places.items() if len(own) > sd.PLACES + 1 for p in own)
    for size in (1, 2, 7, 64, 300):
        batches = [sd.pa.record_batch([sd.pa.array([x[c] for x in table[i : i + size]], sd.pa.int64()) for c in range(3)] + [sd.pa.array([1] * len(table[i : i + size]))], ["seed", "doc_id", "at", "ahead"]) for i in range(0, 300, size)]
        rows = [tuple(x.values()) for b in sd._places(iter(batches)) for x in b.to_pylist()]
        assert sorted((x[1], x[2], x[4], x[5]) for x in rows if x[4] is not None) == sorted(x[1:] for x in want)
        assert sorted(x[:3] for x in rows if x[4] is None) == many
        assert sum(x[6] for x in rows if x[4] is not None) == sum(len(own) - 1 for own in places.values())


def _extension(x, y):
    """Ungapped stretches with most equal less twice unequal words, one after another, over up to three words left out on one side."""
    i = j = equal = 0
    while True:
        best = (0, 0, 0, 0, 0)
        for shift in (0, 1, -1, 2, -2, 3, -3):
            a, b, total, same = i + max(shift, 0), j + max(-shift, 0), 0, 0
            tops = []
            for k in range(min(len(x) - a, len(y) - b)):
                same += x[a + k] == y[b + k]
                total = 3 * same - 2 * (k + 1)
                tops.append((total, -k, same))
            if tops:
                total, k, same = max(tops)
                best = max(best, (total - 2 * abs(shift), -abs(shift), a - k + 1, b - k + 1, same))
        if best[0] <= 0:
            return i, j, equal
        i, j, equal = best[2], best[3], equal + best[4]


def _common(x, y):
    row = [0] * (len(y) + 1)
    for w in x:
        new = [0]
        for k, z in enumerate(y):
            new.append(max(row[k] + (w == z), row[k + 1], new[k]))
        row = new
    return row[-1]


def _plain_passing(regions, identity, min_words):
    """One chain at a time, with a way of its own for ends, gaps and cuts."""
    flat = [(r[6].tolist(), r[7].tolist()) for r in regions]
    core = [(a - w, a, ra - w, ra, w) for _, a, _, ra, _, w, _, _ in regions[1:]]
    if len(core) == 1 and core[0][4] + sum(z in y for x, y in flat for z in x) < sd.CHAIN_WORDS:
        return []
    common = [_common(x, y) for x, y in flat[1:-1]]
    lack = [identity * max(len(x), len(y)) - c for (x, y), c in zip(flat[1:-1], common, strict=True)]
    out, todo = [], [(0, len(core) - 1)]
    while todo:
        i, j = todo.pop()
        left, right = _extension(flat[i][0][::-1], flat[i][1][::-1]), _extension(*flat[j + 1])
        equal, none = sum(c[4] for c in core[i : j + 1]) + sum(common[i:j]), (0, 0, 0)
        ways = [(core[i][0] - p[0], core[j][1] + q[0], core[i][2] - p[1], core[j][3] + q[1], equal + p[2] + q[2]) for p, q in ((left, right), (left, none), (none, right), (none, none))]
        good = [w for w in ways if w[4] >= identity * max(w[1] - w[0], w[3] - w[2])]
        if good:
            best = max(good, key=lambda w: w[1] - w[0])
            before = [sd.np.array(z[::-1][n:]) for z, n in zip(flat[i], (core[i][0] - best[0], core[i][2] - best[2]), strict=True)]
            behind = [sd.np.array(z[n:]) for z, n in zip(flat[j + 1], (best[1] - core[j][1], best[3] - core[j][3]), strict=True)]
            best = sd._filled(best, before, behind, identity, min_words)
            if i < j or best[4] >= sd.CHAIN_WORDS:
                out.append(best)
        elif i < j:
            cut = max(range(i, j), key=lambda g: lack[g])
            todo += [(cut + 1, j), (i, cut)]
    return sorted(out)


def test_alignment_of_many_chains_equals_one_at_a_time():
    r, number, chains = random.Random(8), 0, []
    for _ in range(1500):
        n, letters = r.choice([1, 1, 2, 3, 6]), r.choice([3, 8, 40])
        x, y = r.randrange(50, 90), r.randrange(50, 90)
        regions = []
        for i in range(n + 1):
            most = r.choice([0, 12, 44]) if i in (0, n) else r.choice([3, 15, 40])
            own = [r.randrange(letters) for _ in range(r.randrange(most + 1))]
            other = [z if r.random() < 0.7 else r.randrange(letters) for z in own if r.random() < 0.95][:most]
            if not i:
                own, other = own[::-1], other[::-1]
            w = r.choice([6, 7, 11, 13, 25]) if i else 0
            x, y = x + w, y + w
            regions.append((i, x, x + len(own), y, y + len(other), w, sd.np.array(own, sd.np.int64), sd.np.array(other, sd.np.int64)))
            if i:
                x, y = x + len(own), y + len(other)
        chains.append([(*c[:1], *(v for v in c[1:])) for c in regions])
    for identity, min_words in ((0.8, 30), (0.9, 20)):
        want = [_plain_passing(c, identity, min_words) for c in chains]
        assert [sd._passing(c, identity, min_words) for c in chains] == want
        number += sum(map(len, want))
    assert number > 1000


def test_spent_shuffles_and_tables_are_deleted(spark):
    """While the result is still lazy, no shuffle file of seeds or matches is left, and of the tables only the chains, which are small beside the texts."""
    files = lambda: [f for f in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n") if "/shuffle_" in f]
    docs = frame(spark, [(i, sample(300, i % 40, 10**6) + " " + sample(100, 1000 + i, 10**6)) for i in range(200)])
    old = set(files())
    out = sd.repeated_passages(docs)
    for _ in range(40):
        if not (left := set(files()) - old):
            break
        time.sleep(0.25)
    assert not left
    assert {f.rsplit("/", 2)[-2].partition("-")[0] for f in out.inputFiles()} <= {"chains"}
    assert out.select("doc_id").distinct().count() == 160


def test_rows_of_one_document_that_differ(spark):
    passage = sample(60, 77, 10**6)
    rows = [(1, sample(100, 1, 10**6) + " " + passage), (1, "b " * 3), (2, "a"), (2, sample(90, 2, 10**6) + " " + passage), (3, passage), (4, passage)]
    got = sd.repeated_passages(frame(spark, rows)).collect()
    assert {tuple(x) for x in got} == {(2, 90, 150, 1, 100, 160, 60), (3, 0, 60, 1, 100, 160, 60), (4, 0, 60, 1, 100, 160, 60)}
