"""Near-duplicate documents by a MinHash LSH forest.

Each distinct shingle set gets a signature of 64 minima. A tree of the forest is a sorted order of
the signatures, each tree reading them from another position on, so that 16 trees begin with 16
disjoint runs of four minima. Within a tree a set's candidates are the neighbours in sorted order,
those that share the longest prefix. A region (equal prefix of four minima) that holds many sets is
cut at a depth of eight, then twelve minima, and its members are also compared with the first
members of every shallower region, so that a cut loses no connection and no task holds a whole hot
region. Candidates that agree in far fewer minima than the threshold asks for are left out; all
others are confirmed on the full sets before they link anything.

Neighbours and first members are only the quick part. In a crowd, such as pages of one template that are almost
similar enough, they see few of a set's region. So the depth adapts once more: in regions that still hold several
components sets are compared with all others where these are few; else with the one nearest to the region's commonest minima, which links edited copies
of one original; then the region is split by the shingles that are rare among such sets, in which linked sets
must meet (see `postings`). That last search is exact for all sets that share a region, and its
work grows with the sets that meet, not with the crowd.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scholiast.llm.graph import components
from scholiast.llm.store import broadcast_if_small, free_names, stored, tidy
from scholiast.llm.tokens import U64, blocks, grams, mix, sequence_hash, shingle_set, word_hashes

MINIMA = 64
TREES = 16
#: Minima of which a prefix consists at the three depths of a region.
DEPTHS = (4, 8, 12)
#: Sets in a region above which it is cut at the next depth, and into pieces at the last.
REGION = 512
#: Neighbours before a set in sorted order, and first members of a cut region, that are its candidates.
NEIGHBOURS = 3
ANCHORS = 1
#: Sets of a region up to which all of them are compared with each other.
FEW = 32
#: Counters that say how common shingles are among sets of crowded regions.
CELLS = 1 << 20
#: Children that one task holds with their parent while links are confirmed.
CELL = 64

_A = mix(np.arange(1, MINIMA + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)
_B = mix(np.arange(1001, 1001 + MINIMA, dtype=U64) * U64(0x9E3779B97F4A7C15))


def signatures(k: int, texts: pa.Array) -> Iterator[pa.RecordBatch]:
    """(n_shingles, two halves of the set's hash, signature of MINIMA big-endian 16-bit numbers) for each text."""
    for first, end, raw, at in blocks(texts):
        words, word_at, _, _ = word_hashes(raw, at)
        sets = []
        for a, b in zip(word_at[:-1], word_at[1:], strict=True):
            if b - a >= k:
                s = grams(words[a:b], k)
                s.sort()
                keep = np.empty(len(s), bool)
                keep[0] = True
                np.not_equal(s[1:], s[:-1], out=keep[1:])
                sets.append(s[keep])
            else:
                sets.append(shingle_set(words[a:b], k))
        sizes = np.array([len(s) for s in sets], np.int64)
        full = np.flatnonzero(sizes)
        least = np.zeros((end - first, MINIMA), ">u2")
        keys = np.zeros((end - first, 2), np.int64)
        if len(full):
            flat = np.concatenate([sets[i] for i in full])
            starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
            hashed = np.empty_like(flat)
            for j in range(MINIMA):
                np.multiply(flat, _A[j], out=hashed)
                np.bitwise_xor(hashed, _B[j], out=hashed)
                np.right_shift(hashed, U64(8), out=hashed)  # of 64-bit products the low bits are the least mixed
                low = np.minimum.reduceat(hashed, starts)
                least[full, j] = (mix(low) >> U64(48)).astype(np.uint16)
            for i in full:
                keys[i] = [np.uint64(sequence_hash(sets[i], s)).astype(np.int64) for s in (1, 2)]
        yield pa.record_batch([pa.array(sizes), pa.array(keys[:, 0].copy()), pa.array(keys[:, 1].copy()), pa.array([x.tobytes() if n else None for x, n in zip(least, sizes, strict=True)], pa.binary())], ["n_shingles", "key1", "key2", "signature"])


def shingle_table(docs: DataFrame, k: int = 5) -> DataFrame:
    """(doc_id, n_shingles, key1, key2, signature): one row for each row of `docs`; null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for out in signatures(k, batch.column("text")):
                yield pa.record_batch([batch.column("doc_id").slice(at, len(out)), *out.columns], ["doc_id", *out.schema.names])
                at += len(out)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_shingles long, key1 long, key2 long, signature binary")


def candidates(sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b, agree), a < b: pairs of ids of `sets` (id, n, signature) near each other in some tree; agree is the number of equal minima."""
    width = 2 * DEPTHS[-1]
    entries = sets.select("id", "n", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"), F.concat("signature", "signature").alias("twice"))
    entries = entries.select("id", "n", "tree", F.expr(f"substring(twice, {2 * DEPTHS[0]} * tree + 1, {width})").alias("order"))
    for depth in DEPTHS:
        entries = entries.withColumn(f"r{depth}", F.xxhash64("tree", F.expr(f"substring(order, 1, {2 * depth})")))
    d4, d8, d12 = (f"r{d}" for d in DEPTHS)
    over = lambda df, region: broadcast_if_small(stored(df.groupBy(region).count().filter(F.col("count") > REGION).select(region, F.ceil(F.col("count") / REGION).alias("pieces")), "regions"))
    by_order = Window.partitionBy("region", "piece").orderBy("order", "id")
    near = F.array(*[F.struct(F.lag("id", i).over(by_order).alias("id"), F.lag("n", i).over(by_order).alias("n")) for i in range(1, NEIGHBOURS + 1)])
    # large regions are few: less than one in REGION of the entries
    wide = over(entries, d4)
    whole = entries.join(wide, d4, "left_anti").select("id", "n", "order", F.col(d4).alias("region"), F.lit(0).alias("piece"))
    cut = stored(entries.join(wide, d4, "left_semi").select("id", "n", "order", d4, d8, d12), "cut")
    deeper = over(cut, d8).select(d8, F.lit(True).alias("deeper"))
    # a region that is still large at the last depth is dealt over so many pieces that each keeps to the size of a region; anchors join them
    piece = F.when(F.col("deeper"), F.coalesce(F.pmod(F.xxhash64("id"), F.col("pieces")), F.lit(0))).otherwise(F.lit(0)).cast("int")
    deep = cut.join(deeper, d8, "left").join(over(cut, d12), d12, "left").select("id", "n", "order", F.when(F.col("deeper"), F.col(d12)).otherwise(F.col(d8)).alias("region"), piece.alias("piece"))
    pairs = whole.unionByName(deep).select("id", "n", near.alias("near")).select("id", "n", F.explode(F.filter("near", lambda x: x["id"].isNotNull())).alias("o")).select("id", "n", F.col("o.id").alias("other"), F.col("o.n").alias("m"))
    for region in (d4, d8, d12):
        first = Window.partitionBy(region).orderBy("order", "id")
        anchors = cut.select(region, F.col("id").alias("other"), F.col("n").alias("m"), F.row_number().over(first).alias("rank")).filter(F.col("rank") <= ANCHORS)
        pairs = pairs.unionByName(cut.select(region, "id", "n").join(anchors.select(region, "other", "m"), region).select("id", "n", "other", "m"))
    pairs = pairs.filter((F.col("other") != F.col("id")) & (F.least("n", "m") >= F.lit(similarity) * F.greatest("n", "m")))
    pairs = pairs.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()
    return likely(pairs, sets, similarity)


def likely(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b, agree): the pairs of ids of `sets` (id, signature) that agree in enough minima to be linked."""
    of = lambda end: sets.select(F.col("id").alias(end), F.col("signature").alias(f"{end}_signature"))

    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                x, y = (np.frombuffer(b"".join(batch.column(f"{end}_signature").to_pylist()), np.uint16).reshape(-1, MINIMA) for end in "ab")
                yield pa.record_batch([batch.column("a"), batch.column("b"), pa.array((x == y).sum(1).astype(np.int32))], ["a", "b", "agree"])

    joined = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "a_signature", "b_signature")
    return joined.mapInArrow(agree, "a long, b long, agree int").filter(F.col("agree") >= _enough(similarity))


def _enough(similarity: float) -> float:
    """Equal minima four standard deviations and a half below what a pair at the threshold agrees in."""
    return MINIMA * similarity - 4.5 * (MINIMA * similarity * (1 - similarity)) ** 0.5


def consensus(regions: DataFrame, most: int = 64) -> DataFrame:
    """(region, common): for each region of `regions` (id, signature, region) the commonest minima, place by place, among `most` members of smallest hash."""
    few = Window.partitionBy("region").orderBy(F.xxhash64("id"), "id")
    lists = regions.withColumn("_n", F.row_number().over(few)).filter(F.col("_n") <= most).groupBy("region").agg(F.collect_list("signature").alias("list"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for members in batch.column("list"):
                x = np.sort(np.frombuffer(b"".join(s.as_buffer() for s in members.values), ">u2").reshape(-1, MINIMA), 0)
                same = np.zeros(x.shape, np.int32)  # how often a value has occurred up to each place of the sorted column
                for i in range(1, len(x)):
                    same[i] = np.where(x[i] == x[i - 1], same[i - 1] + 1, 0)
                out.append(x[same.argmax(0), np.arange(MINIMA)].astype(">u2").tobytes())
            yield pa.record_batch([batch.column("region"), pa.array(out, pa.binary())], ["region", "common"])

    return lists.mapInArrow(run, "region long, common binary")


def crowded(seated: DataFrame, similarity: float) -> DataFrame:
    """(id, n, component, signature, region, size): the members of regions in which sets of different components may not have been compared.

    A region is a run of minima at a fixed place, as short as lets a pair at the threshold share one with near certainty.
    Sets (id, n, component, signature) of one component, and small regions that neighbours cover, are left out.
    """
    depth = DEPTHS[0] if similarity >= 0.85 else DEPTHS[0] - 1
    covered = NEIGHBOURS + 1 if depth == DEPTHS[0] else 1
    entries = seated.select("id", "component", F.explode(F.sequence(F.lit(0), F.lit(MINIMA // depth - 1))).alias("tree"), "signature")
    entries = entries.select("id", "component", F.xxhash64("tree", F.expr(f"substring(signature, {2 * depth} * tree + 1, {2 * depth})")).alias("region"))
    sizes = entries.groupBy("region").agg(F.count(F.lit(1)).alias("size"), F.min("component").alias("low"), F.max("component").alias("high"))
    mixed = stored(sizes.filter((F.col("size") > covered) & (F.col("low") != F.col("high"))).select("region", "size"), "mixed")
    inside = stored(entries.select("id", "region").join(broadcast_if_small(mixed), "region"), "inside")
    return inside.join(seated, "id")


def fellows(inside: DataFrame, numerator: int) -> DataFrame:
    """(a, b): the pairs of different components in regions of at most FEW members (id, n, component, signature, region) that agree in enough minima."""
    enough = _enough(numerator / 100)
    lists = inside.groupBy("region").agg(F.collect_list(F.struct("id", "n", "component", "signature")).alias("list"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            column = batch.column("list")
            at, members = column.offsets.to_numpy() - column.offsets[0].as_py(), column.flatten()
            ids, n, of = (members.field(c).to_numpy() for c in ("id", "n", "component"))
            x = np.frombuffer(b"".join(s.as_buffer() for s in members.field("signature")), np.uint16).reshape(-1, MINIMA)
            for first in range(0, len(batch), 64):  # some regions at a time, as each can make a pair of any two of its members
                parts = []
                for k, m in zip(at[first : first + 64], at[first + 1 : first + 65], strict=False):
                    fit = (of[k:m, None] < of[None, k:m]) & (100 * np.minimum(n[k:m, None], n[None, k:m]) >= numerator * np.maximum(n[k:m, None], n[None, k:m]))
                    i, j = np.nonzero(fit)
                    good = (x[k + i] == x[k + j]).sum(1) >= enough
                    parts.append(np.sort(np.stack([ids[k + i[good]], ids[k + j[good]]], 1), 1))
                pairs = np.unique(np.concatenate(parts), axis=0)
                yield pa.record_batch([pa.array(pairs[:, 0].copy(), pa.int64()), pa.array(pairs[:, 1].copy(), pa.int64())], ["a", "b"])

    return lists.select("list").mapInArrow(run, "a long, b long").distinct()


def centres(inside: DataFrame, numerator: int) -> DataFrame:
    """(a, b): each member of a region (id, n, component, signature, region) with the member nearest to the region's commonest minima.

    A group of edited copies has its original, or a copy near it, as centre; one comparison links each copy.
    """
    common = stored(consensus(inside), "consensus")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, MINIMA) for c in ("signature", "common"))
                yield pa.record_batch([*(batch.column(c) for c in ("region", "id", "n", "component")), pa.array((x == y).sum(1).astype(np.int32))], ["region", "id", "n", "component", "agree"])

    near = inside.join(broadcast_if_small(common), "region").select("region", "id", "n", "component", "signature", "common").mapInArrow(run, "region long, id long, n long, component long, agree int")
    near = stored(near, "near")
    best = near.groupBy("region").agg(F.max(F.struct("agree", F.negate("id").alias("id"), "n", "component")).alias("x"))
    best = best.select("region", F.negate("x.id").alias("other"), F.col("x.n").alias("m"), F.col("x.component").alias("theirs"))
    met = near.join(best, "region").filter((F.col("component") != F.col("theirs")) & (100 * F.least("n", "m") >= numerator * F.greatest("n", "m")))
    return met.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()


def rarity(texts: DataFrame, k: int) -> np.ndarray:
    """CELLS counters of shingles, each the number of `texts` (text) that have a shingle of that cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(CELLS, np.int64)
        for batch in batches:
            for first, end, raw, at in blocks(batch.column("text")):
                words, word_at, _, _ = word_hashes(raw, at)
                for i in range(end - first):
                    np.add.at(held, (shingle_set(words[word_at[i] : word_at[i + 1]], k) & U64(CELLS - 1)).astype(np.int64), 1)
        cells = np.flatnonzero(held)
        yield pa.record_batch([pa.array(cells), pa.array(held[cells])], ["cell", "n"])

    found = texts.select("text").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(CELLS, np.int64)
    out[found.column("cell").to_numpy()] = found.column("n").to_numpy()
    return out


def postings(texts: DataFrame, k: int, numerator: int) -> DataFrame:
    """(token, bucket, large, id, n, most): under which rare shingles each of `texts` (doc_id, text) has to be met.

    Of two linked sets, shingles ordered from rare to common, the first common one comes early in both: it leaves
    at least as many shingles behind as both must share. The smaller set is posted under its first shingles with its
    size, the larger one under some more, for each class of sizes that a partner met there may have; `most` is the
    largest size of such a partner. A shingle that a whole crowd has comes late, so unlinked sets don't meet there.
    Nobody is met under a shingle whose counter is 1, as no other text has it: it keeps its place in the order, but isn't posted.
    """
    counters = texts.sparkSession.sparkContext.broadcast(rarity(texts, k).astype(np.int32))
    total = 100 + numerator

    def classes(n: np.ndarray) -> np.ndarray:
        return np.floor(np.log(np.maximum(n, 1)) / np.log(1.05)).astype(np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counters.value
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            for first, end, raw, at in blocks(batch.column("text")):
                words, word_at, _, _ = word_hashes(raw, at)
                parts: list[tuple[np.ndarray, ...]] = []
                for i in range(first, end):
                    own = shingle_set(words[word_at[i - first] : word_at[i - first + 1]], k)
                    n = len(own)
                    if not n:
                        continue
                    held = count[(own & U64(CELLS - 1)).astype(np.int64)]
                    order = np.lexsort((own, held))
                    own, shared = own[order], held[order] > 1
                    left = n - np.arange(n)  # shingles from each place on
                    most = left * total // numerator - n
                    small = np.flatnonzero((most >= n) & shared)
                    least = -(-numerator * n // 100)
                    large = np.flatnonzero((np.minimum(most, n) >= least) & shared)
                    low, high = int(classes(np.array([least]))[0]), classes(np.minimum(most, n)[large])
                    times = high - low + 1
                    at_class = low + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                    token = np.concatenate([own[small], np.repeat(own[large], times)])
                    parts.append((token.view(np.int64), np.concatenate([np.repeat(classes(np.array([n])), len(small)), at_class]).astype(np.int32), np.arange(len(token)) >= len(small), np.full(len(token), ids[i]), np.full(len(token), n), np.concatenate([most[small], np.repeat(np.minimum(most, n)[large], times)])))
                if parts:
                    yield pa.record_batch([pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)], ["token", "bucket", "large", "id", "n", "most"])

    return texts.select("doc_id", "text").mapInArrow(run, "token long, bucket int, large boolean, id long, n long, most long")


def shared_postings(posted: DataFrame) -> DataFrame:
    """The postings under which a smaller and a larger set of different ids stand; the others can make no meeting, whatever the components are."""
    key = ["token", "bucket"]
    groups = posted.groupBy(*key).agg(F.min("id").alias("low"), F.max("id").alias("high"), F.min("large").alias("some_small"), F.max("large").alias("some_large"))
    return posted.join(groups.filter((F.col("low") != F.col("high")) & ~F.col("some_small") & F.col("some_large")).select(*key), key)


def meetings(posted: DataFrame, members: DataFrame, numerator: int, first: bool) -> DataFrame:
    """(a, b): sets of different components that meet under a rare shingle; with `first` only those of each posting with one partner of a kind."""
    seated = posted.join(members, "id", "left").withColumn("component", F.coalesce("component", "id"))
    key = ["token", "bucket"]
    groups = seated.groupBy(*key).agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min("large").alias("some_small"), F.max("large").alias("some_large"))
    mixed = groups.filter((F.col("low") != F.col("high")) & ~F.col("some_small") & F.col("some_large")).select(*key)
    open_ = stored(seated.join(mixed, key), "postings")
    side = lambda df, end: df.select(*key, F.col("id").alias(end), F.col("n").alias(f"n{end}"), F.col("most").alias(f"m{end}"), F.col("component").alias(f"c{end}"))
    small, large = open_.filter("not large"), open_.filter("large")
    fits = "x <> y and cx <> cy and nx <= ny and nx <= my and ny <= mx"
    if first:
        one = lambda df: df.groupBy(*key).agg(F.min_by(F.struct("id", "n", "most", "component"), F.xxhash64("id", "token")).alias("o")).select(*key, "o.*")
        met = side(one(small), "x").join(side(large, "y"), key).filter(fits).select("x", "y").unionByName(side(small, "x").join(side(one(large), "y"), key).filter(fits).select("x", "y"))
    else:
        met = side(small, "x").join(side(large, "y"), key).filter(fits).select("x", "y")
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def confirmed(docs: DataFrame, pairs: DataFrame, k: int, numerator: int) -> DataFrame:
    """The pairs (a, b) for which 100 * |A & B| >= numerator * |A | B| holds on the full shingle sets of the texts with those doc_ids.

    Texts go to cells of one parent and at most about CELL children, so a parent with very many children is spread over many tasks.
    """
    size = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("size"))
    cells = pairs.join(size, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("size") / CELL)).cast("int").alias("cell"))
    seats = cells.select(F.col("b").alias("doc_id"), "a", "cell", F.lit(1).alias("child")).unionByName(cells.select(F.col("a").alias("doc_id"), "a", "cell", F.lit(0).alias("child")).distinct())
    texts = docs.select("doc_id", "text").join(seats, "doc_id").select("doc_id", "a", "cell", "child", "text")
    dealt = texts.repartition("a", "cell").sortWithinPartitions("a", "cell", "child")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, parent = None, np.zeros(0, U64)
        for batch in batches:
            ids, heads, parts, kinds = (batch.column(c).to_pylist() for c in ("doc_id", "a", "cell", "child"))
            links: list[tuple[int, int]] = []
            row = 0
            for first, end, raw, at in blocks(batch.column("text")):
                words, word_at, _, _ = word_hashes(raw, at)
                for i in range(first, end):
                    own = shingle_set(words[word_at[i - first] : word_at[i - first + 1]], k)
                    if not kinds[i]:
                        cell, parent = (heads[i], parts[i]), own
                    elif cell == (heads[i], parts[i]) and len(own):
                        at_parent = np.minimum(np.searchsorted(parent, own), len(parent) - 1)
                        both = int((parent[at_parent] == own).sum()) if len(parent) else 0
                        if 100 * both >= numerator * (len(own) + len(parent) - both):
                            links.append((heads[i], ids[i]))
                row = end
            assert row == len(batch)
            yield pa.record_batch([pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], ["a", "b"])

    return dealt.mapInArrow(run, "a long, b long").distinct()


def grown(members: DataFrame, proved: DataFrame) -> DataFrame:
    """(id, component): the components of `members` joined by the pairs `proved` (a, b)."""
    return stored(components(members.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(proved)), "members")


@tidy
def near_duplicates(docs: DataFrame, k: int = 5, numerator: int = 85) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Two documents are linked if their sets of k-word shingles have 100 * intersection >= numerator * union;
    component_id is the smallest doc_id that links reach. Null and empty texts, and texts without words,
    have no shingles and stay alone; texts of fewer than k words are one shingle, so only equal ones link.
    Rows with one doc_id are one document: their links are shared. A null doc_id is a document of its own
    with a null component_id and is kept. Extra columns of `docs` are ignored; an empty table gives an empty one.
    """
    shingled = stored(shingle_table(docs, k), "shingles")
    rows = shingled.filter("doc_id is not null and n_shingles > 0")
    classes = rows.groupBy("key1", "key2", "n_shingles").agg(F.min("doc_id").alias("id"), F.min("signature").alias("signature"))
    classes = stored(classes, "classes")
    sets = classes.groupBy("id").agg(F.max(F.struct("n_shingles", "signature")).alias("s")).select("id", F.col("s.n_shingles").alias("n"), "s.signature")
    sets = stored(sets, "sets")
    open_pairs = stored(candidates(sets, numerator / 100), "pairs")
    tried = open_pairs.select("a", "b")
    # documents with one id are one: their classes' smallest ids are linked
    key = ["key1", "key2", "n_shingles"]
    twice = rows.groupBy("doc_id").agg(F.min(F.struct(*key)).alias("x"), F.max(F.struct(*key)).alias("y")).filter("x <> y").select("doc_id")
    same = rows.join(twice, "doc_id", "left_semi").select("doc_id", *key).distinct().join(classes.drop("signature"), key)
    members = stored(components(same.select(F.col("id").alias("a"), F.col("doc_id").alias("b"))), "members")
    ends = open_pairs.select(F.col("a").alias("id")).unionByName(open_pairs.select(F.col("b").alias("id"))).distinct()
    # the texts that candidates have, moved once; candidates grow with the collection, so their ids are never broadcast
    texts = stored(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(ends.withColumnRenamed("id", "doc_id").hint("merge"), "doc_id", "left_semi"), "texts")
    # First each set with its most similar smaller candidate, then all pairs between components; what lies within
    # one needs no proof.
    for step in range(2):
        of_a, of_b = (members.select(F.col("id").alias(end), F.col("component").alias(f"c{end}")) for end in "ab")
        left = open_pairs.join(of_a, "a", "left").join(of_b, "b", "left").select("a", "b", "agree", F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb")).filter("ca <> cb")
        if step == 0:
            best = Window.partitionBy("b").orderBy(F.desc("agree"), "a")
            now = left.withColumn("rank", F.row_number().over(best)).filter("rank = 1")
        else:
            now = left
        now = stored(now.select("a", "b"), "asked")
        if now.isEmpty():
            break
        proved = stored(confirmed(texts, now, k, numerator), "proved")
        open_pairs = open_pairs.join(now, ["a", "b"], "left_anti")
        members = grown(members, proved)
    # Then what crowds hide. Components only grow, so the crowd is found once and its texts move once.
    seated = stored(sets.join(members, "id", "left").select("id", "n", F.coalesce("component", "id").alias("component"), "signature"), "seated")
    inside = stored(crowded(seated, numerator / 100), "inside")
    whole = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))

    def prove(asked: DataFrame, known: DataFrame | None = None) -> None:
        """Confirms the pairs that have not been tried, on the texts of `known` or of their own ends."""
        nonlocal members, tried
        now = stored(likely(asked.join(tried, ["a", "b"], "left_anti"), sets, numerator / 100).select("a", "b"), "asked")
        if now.isEmpty():
            return
        if known is None:
            need = stored(now.select(F.col("a").alias("doc_id")).unionByName(now.select(F.col("b").alias("doc_id"))).distinct(), "need")
            known = whole.join(need.hint("merge"), "doc_id", "left_semi")
        members = grown(members, stored(confirmed(known, now, k, numerator), "proved"))
        tried = tried.unionByName(now)

    near = fellows(inside.filter(F.col("size") <= FEW), numerator)
    inside = inside.filter(F.col("size") > FEW)
    crowd = stored(inside.select("id").distinct(), "crowd")
    if crowd.isEmpty():
        prove(near)
    else:
        prove(near.unionByName(centres(inside, numerator)).distinct())
        texts = stored(whole.join(crowd.withColumnRenamed("id", "doc_id").hint("merge"), "doc_id", "left_semi"), "texts")
        posted = stored(shared_postings(stored(postings(texts, k, numerator), "posted")), "shared")
        prove(meetings(posted, members, numerator, first=True), texts)
        prove(meetings(posted, members, numerator, first=False), texts)
    of_class = classes.join(members, "id", "left").select("key1", "key2", "n_shingles", F.coalesce("component", "id").alias("component_id"))
    out = shingled.select("doc_id", "n_shingles", "key1", "key2").join(of_class, ["key1", "key2", "n_shingles"], "left")
    out = out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.when(F.col("doc_id").isNotNull(), F.col("component_id"))).otherwise(F.col("doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, k: int = 5, numerator: int = 85) -> DataFrame:
    """The rows of `docs` whose document is the first of its group; of rows with one doc_id all stay together."""
    (own,) = free_names(docs, "_gone_id")
    gone = near_duplicates(docs, k, numerator).filter(~F.col("kept")).select(F.col("doc_id").alias(own)).distinct()
    return docs.join(gone, F.col("doc_id").cast("long") == F.col(own), "left_anti")
