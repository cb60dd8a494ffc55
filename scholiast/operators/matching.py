"""Record linkage, deduplication and merge operators over bibliographic records (DED, JOI-08 to JOI-10, MTH-04, MTH-05)."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholiast.functions import text as T
from scholiast.operators.graph import components, cut_lineage
from scholiast.operators.retrieval import broadcast_if_few
from scholiast.operators.ratios import close_pairs, matched_characters  # noqa: F401


#: Texts of a block, at least and at most, and cells that a comparison is cut into between these.
BLOCK_ROWS, CELLS = (1 << 11, 1 << 15), 64
#: Characters of equal texts that are taken as the best pair: no other pair's ratio rounds to 1 below that.
CERTAIN = 500_000


def alike(left: DataFrame, right: DataFrame, least: float, best: bool = False) -> DataFrame:
    """(a, b, score): pairs of left (a, text) and right (b, text) whose ratio, to six places, is `least` or more; of each a only the `best`, with the smallest b.

    Equal texts are one. Any two of the others can be alike, and no index keeps many apart at such bounds, so all are compared: blocks
    of the left ones meet blocks of the right ones cell by cell, where bounds from above leave few pairs for the ratio (`close_pairs`). A cell holds two
    blocks of texts and nothing else; work grows as left times right texts, what is moved as their sum times the blocks.
    """
    left, right = cut_lineage(left.select("a", "text").filter("text is not null")), cut_lineage(right.select("b", "text").filter("text is not null"))
    own, other = left.select("text").distinct(), right.select("text").distinct()
    if best:
        own = own.join(other.filter(F.char_length("text") < CERTAIN), "text", "left_anti")
    own, other = cut_lineage(own), cut_lineage(other)
    n, m = own.count(), other.count()
    rows = min(BLOCK_ROWS[1], max(BLOCK_ROWS[0], math.ceil(math.sqrt(n * m / CELLS))))
    down, across = max(1, -(-n // rows)), max(1, -(-m // rows))
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    block = lambda count: F.pmod(F.xxhash64("text"), F.lit(count)).cast("int")
    x = own.select(block(down).alias("i"), every(across).alias("j"), F.lit(0).alias("side"), "text")
    y = other.select(every(down).alias("i"), block(across).alias("j"), F.lit(1).alias("side"), "text")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sides = None, ([], [])

        def done() -> Iterator[pa.RecordBatch]:
            found, part = close_pairs(*sides, least, best), []
            while part := list(itertools.islice(found, 1 << 13)):
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*part, strict=True), (pa.string(), pa.string(), pa.float64()), strict=True)], ["x", "y", "score"])

        for batch in batches:
            for i, j, side, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now != (i, j):
                    if now:
                        yield from done()
                    now, sides = (i, j), ([], [])
                sides[side].append(text)
        if now:
            yield from done()

    # more parts than cells, so that few share one
    cells = x.unionByName(y).repartition(min(4 * down * across, 10_000), "i", "j").sortWithinPartitions("i", "j", "side")
    met = cells.mapInArrow(compare, "x string, y string, score double")
    if not best:
        return met.join(left.withColumnRenamed("text", "x"), "x").join(right.withColumnRenamed("text", "y"), "y").select("a", "b", "score")
    first = right.groupBy("text").agg(F.min("b").alias("b"))
    near = met.join(first.withColumnRenamed("text", "y"), "y").groupBy("x").agg(F.min_by(F.struct("b", "score"), F.struct(-F.col("score"), "b")).alias("z")).select(F.col("x").alias("text"), "z.*")
    same = first.filter(F.char_length("text") < CERTAIN).select("text", "b", F.lit(1.0).alias("score"))
    return left.join(near.unionByName(same.join(left, "text", "left_semi")), "text").select("a", "b", "score")


def fuzzy_match(records: DataFrame, catalog: DataFrame, matched: float = 0.96, review: float = 0.84) -> DataFrame:
    """(record_id, catalog_id, score, status) for records (record_id, title, doi) against a catalog (catalog_id, title, doi) (JOI-08, DED-05).

    An equal DOI is a match of score 1, with the smallest id. Else the title with the highest ratio decides, the smaller id of equal ones: `matched`, or
    `review` below. Records without a match are for review too, with no entry and a score of 0.
    """
    r = records.withColumn("text", T.ascii_fold("title")).withColumn("rdoi", T.doi_key("doi"))
    c = catalog.withColumn("text", T.ascii_fold("title")).withColumn("cdoi", T.doi_key("doi"))
    by_doi = r.join(c.select("catalog_id", "cdoi"), r.rdoi == c.cdoi).groupBy("record_id").agg(F.min("catalog_id").alias("catalog_id")).withColumn("score", F.lit(1.0))
    left = r.join(by_doi, "record_id", "left_anti").filter("text <> ''").select(F.col("record_id").alias("a"), "text")
    near = alike(left, c.filter("text <> ''").select(F.col("catalog_id").alias("b"), "text"), review, best=True)
    best = near.groupBy("a").agg(F.max_by(F.struct("b", "score"), F.struct("score", F.negate("b"))).alias("x")).select(F.col("a").alias("record_id"), F.col("x.b").alias("catalog_id"), "x.score")
    found = r.select("record_id").join(by_doi.unionByName(best), "record_id", "left")
    status = F.when(F.col("score") >= matched, "matched").otherwise("review")
    return found.select("record_id", "catalog_id", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce(status, F.lit("review")).alias("status"))


def metadata_match(files: DataFrame, records: DataFrame, least: float = 0.86, by_stem: float = 0.94) -> DataFrame:
    """(file_id, record_id, score) of files (file_id, stem, title) that have a record (record_id, title, path): an equal file stem counts 1, else the ratio of the titles, or of the stem and the title times `by_stem`; the best of `least` or more, the smaller id of equal ones (JOI-09)."""
    f = files.withColumn("s", T.ascii_fold("stem")).withColumn("t", T.ascii_fold(F.coalesce("title", F.lit(""))))
    r = records.withColumn("t", T.ascii_fold(F.coalesce("title", F.lit("")))).withColumn("p", T.ascii_fold(F.regexp_replace(F.regexp_replace("path", "^.*/", ""), r"(?<=.)\.[^.]*$", "")))
    titles = r.filter("t <> ''").select(F.col("record_id").alias("b"), F.col("t").alias("text"))
    same = f.join(r.filter("p <> ''").select("record_id", F.col("p").alias("s")), "s").select("file_id", "record_id", F.lit(1.0).alias("score"))
    by_title = alike(f.filter("t <> ''").select(F.col("file_id").alias("a"), F.col("t").alias("text")), titles, least, best=True)
    named = alike(f.filter("s <> ''").select(F.col("file_id").alias("a"), F.col("s").alias("text")), titles, least / by_stem, best=True).withColumn("score", F.col("score") * by_stem)
    both = same.unionByName(by_title.unionByName(named).select(F.col("a").alias("file_id"), F.col("b").alias("record_id"), "score")).filter(F.col("score") >= least)
    return both.groupBy("file_id").agg(F.max_by(F.struct("record_id", F.round("score", 6).alias("score")), F.struct("score", F.negate("record_id"))).alias("x")).select("file_id", "x.record_id", "x.score")


def tier(score: Column, shared: Column) -> Column:
    """AUTO, REVIEW or SKIP for an overlap coefficient and a number of shared words (DED-10)."""
    return F.when((score >= 0.85) & (shared >= 5), "AUTO").when((score >= 0.6) & (shared >= 3), "REVIEW").otherwise("SKIP")


def overlaps(left: DataFrame, left_key: str, left_words: str, right: DataFrame, right_key: str, right_words: str) -> DataFrame:
    """(left key, right key, shared, score, tier) of rows that share a word, from arrays of distinct words: score is the overlap coefficient (MTH-04).

    Rows meet by word in a join with map-side counts, so rows without a common word never meet. A word of very many rows on both sides makes many pairs; leave such words out of the arrays.
    """
    x = left.select(left_key, F.size(left_words).alias("na"), F.explode(left_words).alias("t"))
    y = right.select(right_key, F.size(right_words).alias("nb"), F.explode(right_words).alias("t"))
    n = x.join(y, "t").groupBy(left_key, right_key, "na", "nb").agg(F.count(F.lit(1)).alias("shared"))
    scored = n.withColumn("score", F.round(F.col("shared") / F.greatest(F.lit(1), F.least("na", "nb")), 6))
    return scored.select(left_key, right_key, "shared", "score", tier(F.col("score"), F.col("shared")).alias("tier"))


def proposals(papers: DataFrame, offers: DataFrame) -> DataFrame:
    """The best offer (paper_id, n, new_title, ...) for each of `papers` (paper_id, title): largest overlap, the first of equal ones, with shared, score and tier (DED-10)."""
    plain = T.unescaped(F.regexp_replace("new_title", "<[^>]+>", ""))
    met = offers.withColumn("new_title", F.trim(F.regexp_replace(plain, r"\s{2,}", " "))).join(papers, "paper_id")
    a, b = T.title_tokens("title"), T.title_tokens("new_title")
    shared, least = F.size(F.array_intersect(a, b)), F.least(F.size(a), F.size(b))
    scored = met.withColumn("shared", shared).withColumn("score", F.when(least > 0, F.round(F.col("shared") / least, 6)).otherwise(0.0))
    kept = [c for c in offers.columns if c != "paper_id"]
    best = scored.groupBy("paper_id").agg(F.max_by(F.struct(*kept, "shared", "score"), F.struct("score", F.negate("n"))).alias("o")).select("paper_id", "o.*")
    return best.withColumn("tier", tier(F.col("score"), F.col("shared")))


def reconciled_titles(papers: DataFrame, records: DataFrame) -> DataFrame:
    """Papers (paper_id, title, title_original, doi, source_pdf) whose placeholder titles take the title of `records` (paper_id, doi, file, title), with `changed` (JOI-10, DED-09).

    A record belongs to a paper by equal id, normalised DOI or file name: three equi-joins, united. All usable titles found must be
    one after normalisation, else the paper stays as it is; a title that is no placeholder is never changed, so a second run changes nothing.
    """
    name = lambda c: F.nullif(F.regexp_replace(c, "^.*/", ""), F.lit(""))
    open_ = papers.filter(T.is_placeholder_title("title", "paper_id", "source_pdf")).select("paper_id", "source_pdf", F.nullif(T.title_key("doi"), F.lit("")).alias("d"), name("source_pdf").alias("f"))
    said = records.select(F.col("paper_id").alias("record"), F.nullif(T.title_key("doi"), F.lit("")).alias("d"), name("file").alias("f"), F.trim("title").alias("found"))
    ways = [open_.join(said.select(F.col("record").alias("paper_id"), "found"), "paper_id"), open_.join(said.select("d", "found"), "d"), open_.join(said.select("f", "found"), "f")]
    met = None
    for i, way in enumerate(ways):
        part = way.select("paper_id", "source_pdf", "found", F.lit(i).alias("way"))
        met = part if met is None else met.unionByName(part)
    usable = met.filter(T.is_usable_title("found", "paper_id", "source_pdf"))
    one = usable.groupBy("paper_id").agg(F.min_by("found", F.struct("way", "found")).alias("new"), F.count_distinct(T.title_key("found")).alias("n")).filter("n = 1").drop("n")
    out = papers.join(one, "paper_id", "left").withColumn("changed", F.col("new").isNotNull())
    original = F.when(F.col("changed"), F.coalesce(F.nullif("title_original", F.lit("")), "title")).otherwise(F.col("title_original"))
    return out.select(*[original.alias(c) if c == "title_original" else F.coalesce("new", "title").alias(c) if c == "title" else F.col(c) for c in papers.columns], "changed")


def best_per_doi(papers: DataFrame, doi: str, chunks: str, key: str) -> DataFrame:
    """(doi, key): of the papers with one DOI the one with most chunks, then the smallest key; no DOI, no group (DED-03)."""
    return papers.filter(F.coalesce(F.col(doi), F.lit("")) != "").groupBy(doi).agg(F.max_by(key, F.struct(chunks, F.negate(key))).alias(key))


def inserted_once(articles: DataFrame, order: str) -> DataFrame:
    """Articles (doi, journal, title, ...), the first of a DOI, and of those without one the first of a journal and title (DED-04)."""
    dated = F.coalesce(F.col("doi"), F.lit("")) != ""
    known = F.when(dated, F.struct("doi", F.lit(None).cast("string").alias("journal"), F.lit(None).cast("string").alias("title"))).otherwise(F.struct(F.lit(None).cast("string").alias("doi"), "journal", "title"))
    return articles.groupBy(known.alias("_key")).agg(F.min_by(F.struct(*articles.columns), order).alias("a")).select("a.*")


def first_per_key(rows: DataFrame, key: list[Column | str], order: list[Column | str]) -> DataFrame:
    """One row per key, the first in `order` (DED-01, DED-03, DED-04, SRC-09, SRC-23)."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_n = 1").drop("_n")


#: One text in so many is counted for the order of shingles, from so many of these on a shingle is common, and so many common ones are kept.
COUNTED, COMMON, MOST_COMMON = 32, 4, 1_000_000
#: Bytes of a table that is dealt out before its shingles are made, as a small file may be one task's.
SMALL_BYTES = 1 << 28
#: Rows of keys up to which they are broadcast.
FEW_KEYS = 2_000_000


def shingle_pairs(docs: DataFrame, key: str, text: str, k: int = 8, least: float = 0.7, length_ratio: float = 0.6) -> DataFrame:
    """(a, b, jaccard): pairs of distinct texts with at least `least` of their k-word shingles in common (JOI-07, MTH-03, ARR-02).

    Equal contents are one text, represented by the smallest key. In one order of all shingles, the first n - ceil(least * n) + 1 of a text are
    posted, at least one of which two such texts share; any order gives the same pairs. Here common shingles come last, as far as a part of the texts
    shows them, the others by their hash, so that neither counts of all shingles nor the sets are moved. Places in the order
    bound what two texts can share; only the sets of those whose posted shingles leave it open are made again and compared.
    """
    least_ = least - 1e-6  # what rounding can add
    keyed = lambda rows: rows.select(F.col(key).alias("id"), T.content_key(text).alias("c")).filter("c is not null").withColumn("h", F.unhex(F.md5("c")))
    repeated = cut_lineage(keyed(docs).groupBy("h").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("h", "first"))
    repeated = broadcast_if_few(repeated, FEW_KEYS)

    def shingled(rows: DataFrame) -> DataFrame:
        base = rows.join(repeated, "h", "left").filter("first is null or id = first")
        # within the lambda the words would be cut again for every shingle
        return base.select("id", T.once(F.split("c", " "), lambda w: T.shingles(w, k)).alias("s"), F.char_length("c").alias("chars"))

    named = keyed(docs)
    if int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < SMALL_BYTES:
        named = named.repartition(2 * docs.sparkSession.sparkContext.defaultParallelism, "h")
    sets = shingled(named)
    counted = docs.filter(F.pmod(F.xxhash64(F.col(key)), F.lit(COUNTED)) == 0)
    seen = shingled(keyed(counted)).select(F.explode("s").alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= COMMON)
    rows = seen.orderBy(F.desc("n"), "g").limit(MOST_COMMON).toArrow()
    order = np.argsort(g := rows["g"].to_numpy(), kind="stable")
    common = docs.sparkSession.sparkContext.broadcast((g[order], rows["n"].to_numpy()[order]))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = common.value
        for batch in batches:
            lists = batch.column("s")
            cuts, values = lists.offsets.to_numpy(), lists.values.to_numpy()
            parts = []
            for first, end in itertools.pairwise(cuts.tolist()):
                own = values[first:end]
                at = np.minimum(np.searchsorted(known, own), max(0, len(known) - 1))
                often = np.where(known[at] == own, counts[at], 0) if len(known) else np.zeros(len(own), np.int64)
                parts.append(own[np.lexsort((own, often))[: len(own) - math.ceil(len(own) * least_) + 1]])
            sizes = [len(x) for x in parts]
            row = pa.array(np.repeat(np.arange(len(parts)), sizes))
            place = np.concatenate([np.arange(n, dtype=np.int32) for n in sizes] or [np.zeros(0, np.int32)])
            whole = pa.array(np.diff(cuts).astype(np.int32))
            posted = pa.array(np.concatenate([*parts, np.zeros(0, np.int64)]))
            yield pa.record_batch([batch.column("id").take(row), whole.take(row), batch.column("chars").take(row), pa.array(place), posted], ["id", "n", "chars", "p", "g"])

    posts = cut_lineage(sets.mapInArrow(post, f"id {docs.schema[key].dataType.simpleString()}, n int, chars int, p int, g long"))
    left, right = (posts.select(F.col("id").alias(i), *[F.col(c).alias(f"{c}_{i}") for c in ("n", "chars", "p")], "g") for i in "ab")
    need = (F.col("n_a") + F.col("n_b")) * (least_ / (1 + least_))
    rest = lambda p_a, p_b: F.least(F.col("n_a") - p_a, F.col("n_b") - p_b)
    fit = (F.least("chars_a", "chars_b") >= length_ratio * F.greatest("chars_a", "chars_b")) & (F.least("n_a", "n_b") >= least_ * F.greatest("n_a", "n_b")) & (F.least("p_a", "p_b") + rest(F.col("p_a"), F.col("p_b")) >= need)
    shared = left.join(right, "g").filter("a < b").filter(fit).groupBy("a", "b", "n_a", "n_b").agg(F.count(F.lit(1)).alias("c"), F.max("p_a").alias("l_a"), F.max("p_b").alias("l_b"))
    pairs = cut_lineage(shared.filter(F.col("c") + rest(F.col("l_a"), F.col("l_b")) - 1 >= need).select("a", "b"))
    ids = cut_lineage(pairs.select(F.explode(F.array("a", "b")).alias(key)).distinct())
    asked = cut_lineage(shingled(keyed(docs.join(broadcast_if_few(ids, FEW_KEYS), key, "left_semi"))).select("id", "s").distinct())
    met = pairs.join(asked.select(F.col("id").alias("a"), F.col("s").alias("x")), "a").join(asked.select(F.col("id").alias("b"), F.col("s").alias("y")), "b")
    both = F.size(F.array_intersect("x", "y"))
    near = met.select("a", "b", F.round(both / (F.size("x") + F.size("y") - both), 6).alias("jaccard"))
    return near.filter(F.col("jaccard") >= least)


def near_duplicate_plan(docs: DataFrame, key: str, text: str, cluster: float = 0.8, review: float = 0.7) -> DataFrame:
    """(key, component, keep, review): clusters of equal contents and of texts alike by `cluster` or more, the longest of each to keep, and whether a text has a pair in the review band (DED-02)."""
    pairs = cut_lineage(shingle_pairs(docs, key, text, least=review))
    same = docs.select(F.col(key).alias("id"), T.content_hash(text).alias("h"))
    first = same.groupBy("h").agg(F.min("id").alias("first"))
    copies = same.join(first, "h").filter("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b"))
    member = components(copies.unionByName(pairs.filter(F.col("jaccard") >= cluster).select("a", "b")))
    band = pairs.filter(F.col("jaccard") < cluster).select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("review", F.lit(True))
    whole = docs.select(F.col(key).alias("id"), F.char_length(text).alias("size")).join(member, "id", "left").withColumn("component", F.coalesce("component", "id"))
    best = whole.groupBy("component").agg(F.max_by("id", F.struct("size", -F.col("id"))).alias("best"))
    out = whole.join(best, "component").join(band, "id", "left")
    return out.select(F.col("id").alias(key), "component", (F.col("id") == F.col("best")).alias("keep"), F.coalesce("review", F.lit(False)).alias("review"))


def merge_fill_empty(target: DataFrame, source: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Target rows whose empty columns take the source's values, and source rows of new keys (DED-06, DED-07, DED-08, RET-08)."""
    src = source.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    filled = target.join(src, key, "left").select(key, *[F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(f"_{c}")).alias(c) for c in columns])
    return filled.unionByName(source.join(target, key, "left_anti").select(key, *columns))


def snapshot_replace(table: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """All rows of the keys in `new` are replaced by its rows (DML-04)."""
    return table.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def applied_proposals(papers: DataFrame, proposals: DataFrame, tiers: list[str]) -> DataFrame:
    """Papers (paper_id, title, title_original, doi, year, authors) with the proposals (paper_id, new_title, doi, year, authors, tier) of some tiers (DED-15)."""
    taken = proposals.filter(F.col("tier").isin(tiers) & F.col("new_title").isNotNull()).select("paper_id", F.col("new_title").alias("_title"), F.col("doi").alias("_doi"), F.col("year").alias("_year"), F.col("authors").alias("_authors"))
    met = papers.join(taken, "paper_id", "left")
    new = F.col("_title").isNotNull()
    return met.select("paper_id", F.coalesce("_title", "title").alias("title"), F.when(new, F.coalesce("title_original", "title")).otherwise(F.col("title_original")).alias("title_original"), F.when(new, F.col("_doi")).otherwise(F.col("doi")).alias("doi"), F.coalesce("_year", "year").alias("year"), F.coalesce(F.nullif("_authors", F.lit("")), "authors").alias("authors"))
