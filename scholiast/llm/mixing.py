"""Mixing sources to target weights by entropy balancing.

Every document may be taken 0 to 2 times. Among all rates in that range that give each source its
target number of words, the ones nearest to "each document once" in (two-slot) entropy are
rate = 2 / (1 + exp(-tilt * size)): exponentially tilted odds with one multiplier a source. The
multipliers are the solution of the convex dual, found by Newton steps whose gradient and Hessian
are sums over a histogram of sizes. Sums are exact decimals or integers, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholiast.llm.store import free_names, stored, tidy

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
#: One document rate is counted in units of 1 / UNIT.
UNIT = 1 << 20
#: Documents in one piece of a source while rates are rounded.
PIECE = 4096


def ranked_sources(sources: DataFrame) -> DataFrame:
    """Adds `rank` (from 0) in code point order of `source`, null last, without sorting all sources in one task."""
    keyed = sources.withColumn("unknown", F.col("source").isNull())
    parts = stored(keyed.repartitionByRange("unknown", "source").withColumn("part", F.spark_partition_id()), "sources")
    sizes = parts.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    place = F.row_number().over(Window.partitionBy("part").orderBy("unknown", "source"))
    return parts.join(before, "part").withColumn("rank", F.col("before") + place - 1).drop("part", "before", "unknown")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, largest, weight, target) for `sizes` (source, size).

    Targets are weight * level, or `most` times the source's size where that is less; the level is
    such that they sum to share times all sizes. It is found by capping and resharing as long as a
    source is above its cap.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.max("size").alias("largest"))
    chosen = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    table = stored(ranked_sources(totals).withColumn("weight", chosen), "weights")
    total = float(table.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]) * share
    cap = F.col("source_size") * F.lit(most)
    level = 0.0
    while True:
        capped = cap < F.col("weight") * F.lit(level)
        full, free = table.agg(F.sum(F.when(capped, cap).otherwise(0.0)), F.sum(F.when(capped, 0.0).otherwise(F.col("weight")))).first()
        higher = (total - full) / free if free else level
        if higher <= level * (1 + 1e-13):
            break
        level = higher
    return table.withColumn("target", F.least(cap, F.col("weight") * F.lit(level))).drop("rank")


def _rate(tilt: Column, size: Column, scale: Column) -> Column:
    return F.lit(2.0) / (F.lit(1.0) + F.exp(-tilt * size / scale))


def tilts(sizes: DataFrame, targets: DataFrame, steps: int = 60, precision: float = 1e-9) -> DataFrame:
    """Adds `tilt` to `targets`: the multiplier at which the source's tilted rates sum to its target. Null where every document is taken twice or none has words.

    One step is one aggregation of the (source, size) histogram for all sources together. A step that
    leaves the interval known to hold the solution is replaced by bisection.
    """
    histogram = stored(sizes.filter("size > 0").groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "histogram")
    open_ = (F.col("source_size") > 0) & (F.col("target") < 2 * F.col("source_size"))
    state = targets.filter(open_).select("source", "source_size", "largest", "target", F.lit(0.0).alias("tilt"), F.lit(-1e6).alias("low"), F.lit(1e6).alias("high"), F.lit(False).alias("done"))
    state = stored(state, "tilts")
    exact = lambda x: F.sum(x.cast("decimal(38,9)")).cast("double")
    for _ in range(steps):
        rate = _rate(F.col("tilt"), F.col("size"), F.col("largest"))
        words = F.col("n") * F.col("size")
        # null-safe: the null source is a source like any other
        known = state.withColumnRenamed("source", "s")
        sums = histogram.join(known, F.col("source").eqNullSafe(F.col("s"))).groupBy("source").agg(exact(words * rate).alias("taken"), exact(words * rate * (2 - rate) / 2 * F.col("size") / F.col("largest")).alias("slope")).withColumnRenamed("source", "s")
        now = state.join(sums, F.col("source").eqNullSafe(F.col("s"))).drop("s")
        over = F.col("taken") > F.col("target")
        now = now.withColumn("done", F.abs(F.col("taken") - F.col("target")) <= precision * F.greatest(F.col("target"), F.lit(1.0)))
        now = now.withColumn("low", F.when(over, F.col("low")).otherwise(F.col("tilt"))).withColumn("high", F.when(over, F.col("tilt")).otherwise(F.col("high")))
        # Newton on the log odds of the share taken of all slots, which are nearly linear in the tilt
        slots = 2.0 * F.col("source_size")
        has, asks = F.col("taken") / slots, F.col("target") / slots
        steep = F.try_divide(F.col("slope") / slots, has * (1 - has))
        newton = F.when(steep > 0, F.col("tilt") + F.try_divide(F.log(asks / (1 - asks)) - F.log(F.try_divide(has, 1 - has)), steep))
        inside = (newton > F.col("low")) & (newton < F.col("high"))
        step = F.when(F.col("done"), F.col("tilt")).when(inside, newton).otherwise((F.col("low") + F.col("high")) / 2)
        state = stored(now.select("source", "source_size", "largest", "target", step.alias("tilt"), "low", "high", "done"), "tilts")
        if state.filter(~F.col("done")).isEmpty():
            break
    found = state.select(F.col("source").alias("s"), "tilt")
    return targets.join(found, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")


def _rounded(rows: DataFrame) -> DataFrame:
    """Adds `copies` (0 to 2) and a unique place (source, bin, piece, nth) to rows (source, size, key, doc_id, rate).

    Systematic rounding: along an order in which neighbours have about the same size, running sums of
    the rates' fractions are rounded, so what a source takes misses its target by a few documents at most.
    """
    rows = rows.withColumn("units", F.floor(F.col("rate") * UNIT).cast("long"))
    rows = rows.withColumn("fraction", F.col("units") % UNIT).withColumn("bin", F.floor(F.log2(F.col("size") + 1.0) * 8).cast("int"))
    in_bin = rows.groupBy(F.col("source").alias("s"), F.col("bin").alias("b")).agg(F.ceil(F.count(F.lit(1)) / PIECE).alias("pieces"))
    rows = rows.join(in_bin, F.col("source").eqNullSafe(F.col("s")) & (F.col("bin") == F.col("b"))).drop("s", "b")
    rows = stored(rows.withColumn("piece", F.pmod("key", "pieces").cast("int")).drop("pieces"), "rates")
    sums = rows.groupBy("source", "bin", "piece").agg(F.sum("fraction").alias("sum"))
    ahead = Window.partitionBy("source").orderBy("bin", "piece").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("s"), F.col("bin").alias("b"), F.col("piece").alias("p"), F.coalesce(F.sum("sum").over(ahead), F.lit(0)).alias("ahead"))
    order = Window.partitionBy("source", "bin", "piece").orderBy("size", "key", "doc_id")
    rows = rows.withColumn("nth", F.row_number().over(order)).withColumn("upto", F.sum("fraction").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.join(sums, F.col("source").eqNullSafe(F.col("s")) & (F.col("bin") == F.col("b")) & (F.col("piece") == F.col("p"))).drop("s", "b", "p")
    half = F.lit(UNIT // 2)
    steps = F.floor((F.col("ahead") + F.col("upto") + half) / UNIT) - F.floor((F.col("ahead") + F.col("upto") - F.col("fraction") + half) / UNIT)
    return rows.withColumn("copies", (F.floor(F.col("units") / UNIT) + steps).cast("int")).drop("units", "fraction", "ahead", "upto")


def _nearer(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """One copy more or less of the one document in each source whose size is nearest to what is missing, where that brings it nearer to its target."""
    taken = rows.groupBy(F.col("source").alias("s")).agg(F.sum(F.col("copies") * F.col("size")).alias("taken"))
    gap = taken.join(targets.select("source", "target"), F.col("s").eqNullSafe(F.col("source"))).select("s", (F.col("target") - F.col("taken")).alias("gap"))
    asked = rows.join(gap, F.col("source").eqNullSafe(F.col("s"))).filter((F.col("size") > 0) & F.when(F.col("gap") > 0, F.col("copies") < 2).otherwise(F.col("copies") > 0))
    left = F.abs(F.abs(F.col("gap")) - F.col("size"))
    best = asked.filter(left < F.abs(F.col("gap"))).groupBy("source").agg(F.min(F.struct(left.alias("left"), "key", "doc_id", "bin", "piece", "nth", F.signum("gap").cast("int").alias("change"))).alias("best"))
    best = best.select(F.col("source").alias("s"), F.col("best.bin").alias("b"), F.col("best.piece").alias("p"), F.col("best.nth").alias("t"), "best.change")
    same = F.col("source").eqNullSafe(F.col("s")) & (F.col("bin") == F.col("b")) & (F.col("piece") == F.col("p")) & (F.col("nth") == F.col("t"))
    return rows.join(best, same, "left").withColumn("copies", F.col("copies") + F.coalesce("change", F.lit(0))).drop("s", "b", "p", "t", "change")


@tidy
def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, corrections: int = 3) -> DataFrame:
    """One row per row of `docs` (doc_id, text, source): doc_id, source, key, size, source_size, target, rate, copies, taken.

    size counts words; null text has none. Sources in code point order, null last, weigh `weights` in
    turn and share `share` times all words, each at most twice its own. copies is 0, 1 or 2 and taken is
    copies * size. A document without words is never taken. Equal rows get copies of their own. `key` is a
    hash of doc_id and text. Extra columns are ignored; an empty table gives an empty one.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), F.xxhash64(F.col("doc_id").cast("long"), text).alias("key"))
    rows = stored(rows, "sizes")
    targets = stored(tilts(rows, source_targets(rows, weights, share)), "targets")
    of = targets.select(F.col("source").alias("s"), "source_size", "target", "largest", "tilt")
    rate = F.when(F.col("size") == 0, 0.0).when(F.col("tilt").isNull(), 2.0).otherwise(_rate(F.col("tilt"), F.col("size"), F.col("largest")))
    rated = rows.join(of, F.col("source").eqNullSafe(F.col("s"))).withColumn("rate", rate).drop("s", "largest", "tilt")
    out = stored(_rounded(rated), "copies")
    for _ in range(corrections):
        out = stored(_nearer(out, targets), "copies")
    return out.select("doc_id", "source", "key", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5) -> DataFrame:
    """The rows of `docs` that the mix takes, with their number of `copies`. Rows that agree in doc_id and text get the largest number that one of them has."""
    own, key = free_names(docs, "_id", "_key")
    copies = mix_sources(docs, weights, share).filter("copies > 0").groupBy(F.col("doc_id").alias(own), F.col("key").alias(key)).agg(F.max("copies").alias("copies"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(own)) & (F.xxhash64(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit(""))) == F.col(key))
    return docs.drop("copies").join(copies, same).drop(own, key)
