import itertools

import scholiast.llm.chat as chat
from scholiast.llm.chat import ASSISTANT, COSTS, LEGAL, START, Repair, format_chats, role_of


def brute(roles):
    """Least cost over all ways to insert, merge and relabel, by exhaustive search."""
    merge, relabel, insert = COSTS
    least = {START: 0}
    for role in roles:
        for _ in range(3):
            for s, c in list(least.items()):
                for to in LEGAL[s]:
                    least[to] = min(least.get(to, 10**9), c + insert)
        new = {}
        for s, c in least.items():
            for to in range(1, 4):
                price = c + relabel * (to != role_of(role))
                if to in LEGAL[s]:
                    new[to] = min(new.get(to, 10**9), price)
                if to == s:
                    new[to] = min(new.get(to, 10**9), price + merge)
        least = new
    for _ in range(3):
        for s, c in list(least.items()):
            for to in LEGAL[s]:
                least[to] = min(least.get(to, 10**9), c + insert)
    return least[ASSISTANT]


def test_costs_equal_exhaustive_search(spark):
    cases = [c for n in (1, 2, 3, 4) for c in itertools.product(["system", "user", "assistant", None], repeat=n)]
    rows = [(i, t, r, f"t{t}") for i, c in enumerate(cases) for t, r in enumerate(c)]
    got = {r.conv_id: r for r in format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert len(got) == len(cases)
    for i, c in enumerate(cases):
        assert got[i].cost == brute(c), c
        said = [x.split("\n", 1)[0] for x in got[i].text.split("<|end|>\n")[:-1]]
        state = START
        for name in said:
            to = role_of(name.strip("<|>"))
            assert to in LEGAL[state], (c, said)
            state = to
        assert state == ASSISTANT
        assert all(f"t{t}" in got[i].text for t in range(len(c)))


def test_blocks_do_not_change_the_cost(spark):
    roles = ["user", "user", "assistant", "system", None, "assistant"] * 200
    rows = [(7, t, r, "x") for t, r in enumerate(roles)]
    got = format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).first()
    assert got.n_turns == len(roles)
    m = Repair()
    total = m.product([role_of(r) for r in roles])[START]
    assert got.cost == min(int(total[s]) + m.end[s][0] for s in range(1, 4))


def test_nulls_ties_repeats_and_extra_columns(spark):
    rows = [(None, 0, "user", None, 1), (None, None, "USER ", "first", 2), (1, 0, "user", "a <|end|>", 3), (1, 0, "user", "a <|end|>", 3)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, cost int")
    got = {r.conv_id: r for r in format_chats(table).collect()}
    assert got[1].n_merged == 1 and got[1].n_inserted == 1 and got[1].text.count("< |end|>") == 2
    assert got[None].text.startswith("<|user|>\nfirst\n<|end|>") or got[None].n_turns == 2
    assert format_chats(table.limit(0)).count() == 0


def test_repeated_and_missing_turn_numbers_fill_blocks(spark, monkeypatch):
    """Turns are numbered by place, so equal or null numbers of a conversation don't share one block."""
    monkeypatch.setattr(chat, "BLOCK", 8)
    rows = [(5, None, "user", f"n{i % 3}") for i in range(100)] + [(5, 3, "assistant", "same")] * 100 + [(None, 3, "user", "same")] * 50 + [(9, 1, "user", "long " * 200_000)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7)
    blocks = chat.repaired(table).collect()
    assert max(b.n_turns for b in blocks) <= 8 and sum(b.n_turns for b in blocks) == len(rows)
    got = {r.conv_id: r for r in format_chats(table).collect()}
    assert got[5].n_turns == 200 and got[5].n_merged == 198 and got[5].n_out == 2
    assert got[None].n_merged == 49 and got[9].text.count("long ") == 200_000
    numbers = [(r.conv_id, r.place, r.turn, r.text) for r in chat.numbered(table).collect()]
    by = sorted(x for x in numbers if x[0] == 5)
    assert [x[1] for x in by] == list(range(200)) and [x[3] for x in by[:100]] == sorted(f"n{i % 3}" for i in range(100))
