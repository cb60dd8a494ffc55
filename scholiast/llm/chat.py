"""Chat formatting by minimum-cost role repair.

A legal conversation is an optional system turn, then user and assistant in turn, ending with the
assistant. A dynamic program over that automaton chooses for every turn to keep it, merge it into the
turn before, give it another role, or put empty turns in front of it, at the least total cost; the
repaired sequence is then rendered. The step of a turn is a matrix of costs between automaton states, and
matrices of a run of turns multiply (min, +), so a very long conversation is cut into blocks: block
matrices give the states at the cuts, and each block is repaired on its own between them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from scholiast.llm.store import stored, tidy

#: Turns in one block.
BLOCK = 256
#: Costs of a merge, another role and an empty turn.
COSTS = (1, 4, 2)
ROLES = ("system", "user", "assistant")
START, SYSTEM, USER, ASSISTANT = range(4)
#: States that may follow each state.
LEGAL = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
OPEN, CLOSE = "<|{}|>\n", "<|end|>\n"
_FAR = 1 << 40


class Repair:
    """For each role and pair of states the cheapest way to take one turn: (cost, states of empty turns put in front, merged)."""

    def __init__(self, costs: tuple[int, int, int] = COSTS):
        merge, relabel, insert = costs
        self.insert = insert
        self.way: list[dict[tuple[int, int], tuple[int, tuple[int, ...], bool]]] = []
        fronts = {s: [(), *((a,) for a in LEGAL[s]), *((a, b) for a in LEGAL[s] for b in LEGAL[a])] for s in range(4)}
        for role in range(4):  # START stands for a role that is none of the three
            best: dict[tuple[int, int], tuple[int, tuple[int, ...], bool]] = {}
            for s in range(4):
                for front in fronts[s]:
                    at = front[-1] if front else s
                    for to in range(1, 4):
                        price = insert * len(front) + relabel * (to != role)
                        for merged in ([False] if to in LEGAL[at] else []) + ([True] if to == at else []):
                            found = (price + merge * merged, front, merged)
                            if (s, to) not in best or found < best[s, to]:
                                best[s, to] = found
            self.way.append(best)
        self.matrix = np.full((4, 4, 4), _FAR, np.int64)
        for role, best in enumerate(self.way):
            for (s, to), (price, _, _) in best.items():
                self.matrix[role, s, to] = price
        #: What ending costs in each state, and the empty turns it takes.
        self.end = {START: (0, ()), SYSTEM: (2 * insert, (USER, ASSISTANT)), USER: (insert, (ASSISTANT,)), ASSISTANT: (0, ())}

    def product(self, roles: list[int]) -> np.ndarray:
        total = np.full((4, 4), _FAR, np.int64)
        np.fill_diagonal(total, 0)
        for r in roles:
            total = np.minimum((total[:, :, None] + self.matrix[r][None]).min(1), _FAR)
        return total

    def path(self, roles: list[int], entry: int, leave: int) -> list[int]:
        """States after each turn on the cheapest way from `entry` to `leave`; ties to the lower state."""
        cost, back = [0 if s == entry else _FAR for s in range(4)], []
        for r in roles:
            m = self.matrix[r]
            step = [min(range(4), key=lambda s, to=to: (cost[s] + m[s, to], s)) for to in range(4)]
            back.append(step)
            cost = [min(_FAR, cost[step[to]] + int(m[step[to], to])) for to in range(4)]
        out = [leave]
        for step in reversed(back[1:]):
            out.append(step[out[-1]])
        return out[::-1]


def role_of(role: str | None) -> int:
    known = (role or "").strip().lower()
    return 1 + ROLES.index(known) if known in ROLES else START


def _groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], fields: tuple[str, ...]) -> Iterator[tuple[tuple, list[tuple]]]:
    """Runs of rows with equal keys."""
    now, held = None, []
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in (*keys, *fields)), strict=True):
            key = row[: len(keys)]
            if held and key != now:
                yield now, held
                held = []
            now = key
            held.append(row[len(keys) :])
    if held:
        yield now, held


def numbered(rows: DataFrame) -> DataFrame:
    """Adds `place`, the number from 0 of each of `rows` (conv_id, turn, role, text) in its conversation, in order of the other columns.

    Rows are dealt to tasks by ranges of that order, equal ones too, so that no task holds a long conversation. What a
    conversation has in earlier ranges is added to its numbers in a later one; that is one number a range at most.
    """
    order = ["conv_id", "turn", "role", "text", "_tie"]
    parted = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order).drop("_tie")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, now, n = TaskContext.get().partitionId(), (), 0
        for batch in batches:
            ids, nth = batch.column("conv_id").to_pylist(), np.empty(len(batch), np.int64)
            for i, conv in enumerate(ids):
                n = n + 1 if (conv,) == now else 0
                now, nth[i] = (conv,), n
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(batch), part, np.int32)), pa.array(nth)], [*batch.schema.names, "part", "nth"])

    kept = stored(parted.mapInArrow(run, StructType([*rows.schema.fields, StructField("part", IntegerType()), StructField("nth", LongType())])), "parts")
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = kept.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n")).select(F.col("conv_id").alias("c"), F.col("part").alias("p"), F.sum("n").over(before).alias("ahead")).filter("ahead > 0")
    met = kept.join(F.broadcast(ahead), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")), "left")
    return met.select(*rows.columns, (F.col("nth") + F.coalesce("ahead", F.lit(0))).alias("place"))


def repaired(turns: DataFrame, costs: tuple[int, int, int] = COSTS) -> DataFrame:
    """(conv_id, block, text, n_turns, n_out, n_merged, n_relabelled, n_inserted, cost): the rendered piece of each block of `turns` (conv_id, turn, role, text).

    Turns are taken in order of turn (null first), role and text; equal rows are turns of their own. Blocks are runs of
    BLOCK turns, however turns are numbered and however long their texts. Roles are compared without case and outer white space; any other, also null, must become one of the three. Null text is
    empty. Rows with a null conv_id are one conversation. "<|" in a text becomes "< |", so a text cannot forge a mark.
    """
    shared = turns.sparkSession.sparkContext.broadcast(Repair(costs))
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = stored(numbered(rows).select("*", F.floor(F.col("place") / BLOCK).alias("block")), "turns")
    dealt = lambda df: df.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "place")

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, numbers, found = [], [], []
        for (conv, block), held in _groups(batches, ("conv_id", "block"), ("role",)):
            ids.append(conv)
            numbers.append(block)
            found.append(shared.value.product([role_of(x[0]) for x in held]).ravel().tolist())
        yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(numbers, pa.int64()), pa.array(found, pa.list_(pa.int64()))], ["conv_id", "block", "matrix"])

    # Folds the block matrices of a conversation, 16 numbers a block, to the states at the cuts.
    def cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for (conv,), held in _groups(batches, ("conv_id",), ("block", "matrix")):
            cost, back = [0, _FAR, _FAR, _FAR], []
            for _, m in held:
                step = [min(range(4), key=lambda s, to=to: (cost[s] + m[4 * s + to], s)) for to in range(4)]  # noqa: B023
                back.append(step)
                cost = [min(_FAR, cost[step[to]] + m[4 * step[to] + to]) for to in range(4)]
            leave = min(range(1, 4), key=lambda s: (cost[s] + shared.value.end[s][0], -s))
            for i in range(len(held) - 1, -1, -1):
                entry = back[i][leave]
                out.append((conv, held[i][0], entry, leave, i == len(held) - 1))
                leave = entry
            if len(out) >= 4096:
                yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in out], schema=cut_schema)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in out], schema=cut_schema)

    names = ["conv_id", "block", "entry", "leave", "final"]
    cut_schema = pa.schema([("conv_id", pa.int64()), ("block", pa.int64()), ("entry", pa.int32()), ("leave", pa.int32()), ("final", pa.bool_())])

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, out = shared.value, []
        for (conv, block), held in _groups(batches, ("conv_id", "block"), ("role", "text", "entry", "leave", "final")):
            state, leave, final = held[0][2:]
            roles = [role_of(x[0]) for x in held]
            pieces: list[str] = []
            count = {"n_out": 0, "n_merged": 0, "n_relabelled": 0, "n_inserted": 0, "cost": 0}

            def opened(s: int, empty: bool) -> None:
                nonlocal state
                pieces.append((CLOSE if state else "") + OPEN.format(ROLES[s - 1]))  # noqa: B023
                count["n_out"] += 1  # noqa: B023
                count["n_inserted"] += empty  # noqa: B023
                state = s

            for (_, text, *_rest), role, to in zip(held, roles, plan.path(roles, state, leave), strict=True):
                price, front, merged = plan.way[role][state, to]
                count["cost"] += price
                for s in front:
                    opened(s, True)
                if merged:
                    pieces.append("\n")
                    count["n_merged"] += 1
                else:
                    opened(to, False)
                count["n_relabelled"] += to != role
                pieces.append(text.replace("<|", "< |"))
            if final:
                price, front = plan.end[state]
                count["cost"] += price
                for s in front:
                    opened(s, True)
                pieces.append(CLOSE)
            out.append({"conv_id": conv, "block": block, "text": "".join(pieces), "n_turns": len(held), **count})
            if len(out) >= 1024:
                yield pa.RecordBatch.from_pylist(out, schema=out_schema)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=out_schema)

    numbers = ["n_turns", "n_out", "n_merged", "n_relabelled", "n_inserted", "cost"]
    out_schema = pa.schema([("conv_id", pa.int64()), ("block", pa.int64()), ("text", pa.string()), *((n, pa.int64()) for n in numbers)])
    matrices = dealt(rows).mapInArrow(multiply, "conv_id long, block long, matrix array<long>")
    bounds = matrices.repartition("conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(cuts, "conv_id long, block long, entry int, leave int, final boolean")
    bounds = stored(bounds, "cuts").withColumnsRenamed({"conv_id": "c", "block": "b"})
    met = rows.join(bounds, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b"))).drop("c", "b")
    return dealt(met).mapInArrow(render, "conv_id long, block long, text string, " + ", ".join(f"{n} long" for n in numbers))


@tidy
def format_chats(turns: DataFrame, costs: tuple[int, int, int] = COSTS) -> DataFrame:
    """One row per conversation: conv_id, n_turns, n_out, n_merged, n_relabelled, n_inserted, cost, text (its blocks' pieces in order).

    Turns (conv_id, turn, role, text) are taken in order of turn, null first, then role and text. Null roles and roles that are none of
    the three must become one of them; null text is empty; rows with a null conv_id are one conversation; repeated rows are turns of
    their own. Of ways of equal cost the one through the lower states is taken, so equal tables give equal results. An empty
    table gives an empty one; extra columns are ignored.
    """
    numbers = ["n_turns", "n_out", "n_merged", "n_relabelled", "n_inserted", "cost"]
    pieces = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "text"))), lambda x: x["text"]), "")
    return repaired(turns, costs).groupBy("conv_id").agg(*[F.sum(n).alias(n) for n in numbers], pieces.alias("text"))
