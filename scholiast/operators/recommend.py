"""Venue recommendation: policy gates, dense and lexical venue scores, ranking (REC, FLT-12)."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholiast.operators.graph import numbered
from scholiast.operators.retrieval import cosine

K1, B, EPSILON = 1.5, 0.75, 0.25


@dataclass
class Policy:
    """Rules on venues; the first broken one is the reason (FLT-12)."""

    excluded: list[str] = field(default_factory=list)
    need_open: bool = False
    floor: float | None = None
    allowed: list[str] = field(default_factory=list)
    blocked_publishers: list[str] = field(default_factory=list)

    def excludes(self, venue: Column) -> Column:
        return venue.isin(self.excluded) if self.excluded else F.lit(False)

    def reason(self, venue: Column, is_open: Column, factor: Column, publisher: Column) -> Column:
        """Null where all rules hold. A null impact factor passes the floor, as do allow-listed venues."""
        below = F.lit(self.floor is not None) & ~(venue.isin(self.allowed) if self.allowed else F.lit(False)) & F.coalesce(factor < (self.floor or 0.0), F.lit(False))
        blocked = F.lower(publisher).isin([p.lower() for p in self.blocked_publishers]) if self.blocked_publishers else F.lit(False)
        return F.when(F.lit(self.need_open) & ~F.coalesce(is_open, F.lit(False)), "not open access").when(below, "impact factor below floor").when(F.coalesce(blocked, F.lit(False)), "publisher blocked")


def recent(articles: DataFrame, group: str, order: str, key: str, most: int = 500) -> DataFrame:
    """The newest `most` articles with an abstract of each venue (REC-01): articles has abstract and `order`, the larger the newer; ties to the smaller key."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(order), key))
    return articles.filter(F.coalesce("abstract", F.lit("")) != "").withColumn("_n", place).filter(F.col("_n") <= most).drop("_n")


def article_words() -> Column:
    """White-space tokens of title, abstract, keywords and topics in lower case (REC-01)."""
    said = F.concat_ws(" ", F.coalesce("title", F.lit("")), "abstract", F.array_join("keywords", " "), F.array_join("topics", " "))
    return F.filter(F.split(F.lower(said), r"\s+"), lambda w: w != "")


def okapi(articles: DataFrame, group: str, key: str, words: str, asked: list[str]) -> DataFrame:
    """(group, key, score): Okapi BM25 of every article within its group for the tokens asked (REC-01).

    idf is ln((N - df + .5) / (df + .5)); a negative one becomes EPSILON times the group's mean idf over all of its words.
    """
    sized = articles.select(group, key, F.col(words).alias("w"), F.size(words).alias("len"))
    stats = sized.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("mean"))
    df = sized.select(group, F.explode(F.array_distinct("w")).alias("t")).groupBy(group, "t").agg(F.count(F.lit(1)).alias("df"))
    idf = df.join(stats, group).withColumn("raw", F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    floor = idf.groupBy(group).agg((F.avg("raw") * EPSILON).alias("floor"))
    wanted = idf.filter(F.col("t").isin(asked)).join(floor, group).select(group, "t", F.when(F.col("raw") < 0, F.col("floor")).otherwise(F.col("raw")).alias("idf"))
    hits = sized.select(group, key, "len", F.explode(F.filter("w", lambda x: x.isin(asked))).alias("t")).groupBy(group, key, "len", "t").agg(F.count(F.lit(1)).alias("tf"))
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("mean")))
    found = hits.join(wanted, [group, "t"]).join(stats, group).groupBy(group, key).agg(F.sum(part).alias("s"))
    return articles.select(group, key).join(found, [group, key], "left").select(group, key, F.round(F.coalesce("s", F.lit(0.0)), 6).alias("score"))


def top_mean(scored: DataFrame, group: str, key: str, most: int = 25) -> DataFrame:
    """(group, mean, deviation, best): of the `most` highest scores of each group (REC-02, AGG-10, AGG-11)."""
    ranked = scored.withColumn("n", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("score"), key))).filter(F.col("n") <= most)
    return ranked.groupBy(group).agg(F.avg("score").alias("mean"), F.when(F.count(F.lit(1)) > 1, F.stddev_pop("score")).otherwise(0.0).alias("deviation"), F.max("score").alias("best"))


def dense_scores(articles: DataFrame, group: str, key: str, vector: str, asked: DataFrame) -> DataFrame:
    """(group, key, score): cosine of every article with the one asked vector, a one-row table."""
    return articles.crossJoin(F.broadcast(asked)).select(group, key, F.round(cosine(F.col(vector), F.col("query_vector")), 6).alias("score"))


def top_mean_over_best(scored: DataFrame, group: str, key: str, most: int = 25) -> DataFrame:
    """(group, lexical): mean of the `most` highest scores over the highest, 0 where that is 0 (REC-01, AGG-11)."""
    return top_mean(scored, group, key, most).select(group, F.coalesce(F.col("mean") / F.nullif(F.col("best"), F.lit(0.0)), F.lit(0.0)).alias("lexical"))


def history(submissions: DataFrame, venue: str, manuscript: str) -> DataFrame:
    """(venue, prior, accepted, rejected) of the submissions (venue, manuscript_id, state) of other manuscripts (AGG-13)."""
    other = submissions.filter(F.col("manuscript_id") != manuscript)
    return other.groupBy(venue).agg(F.count(F.lit(1)).alias("prior"), F.count_if(F.col("state") == "accepted").alias("accepted"), F.count_if(F.contains("state", F.lit("rejected"))).alias("rejected"))


def rationale(dense: Column, lexical: Column, accepted: Column, rejected: Column) -> Column:
    """One sentence of what speaks for a venue, its first letter large and the others small (REC-04)."""
    parts = F.concat_ws(
        "; ",
        F.when(dense >= 0.7, F.format_string("strong abstract match (score %.2f)", dense)),
        F.when(lexical >= 0.5, "technique terminology overlap"),
        F.when(accepted > 0, "prior acceptance at this venue"),
        F.when(rejected > 0, "prior rejection — review rejection notes"),
    )
    said = F.coalesce(F.nullif(parts, F.lit("")), F.lit("moderate topical overlap across recent articles"))
    return F.concat(F.upper(F.left(said, F.lit(1))), F.lower(F.substr(said, F.lit(2))), F.lit("."))


def recommend(dense: DataFrame, claim: DataFrame, lexical: DataFrame, past: DataFrame, venues: DataFrame, policy: Policy, group: str, most: int) -> DataFrame:
    """(group, rank, score, dense, lexical, claim, dispersion, reason, rationale) (REC-03, REC-04, MTH-02).

    Venues that pass the policy in order of score, the first `most`; then all that fail, in order of arrival (venues has `arrival`), with rank running on and a
    score of 0. Excluded venues are left out. dense and claim are (group, mean, deviation), lexical (group, lexical), past (group, accepted, rejected). The
    score is half the abstract's similarity, a quarter each of words and claim, less half the deviation.
    """
    gated = venues.filter(~policy.excludes(F.col(group))).withColumn("reason", policy.reason(F.col(group), F.col("is_open"), F.col("factor"), F.col("publisher")))
    met = gated.join(dense.select(group, F.col("mean").alias("_d"), F.col("deviation").alias("_s")), group, "left").join(claim.select(group, F.col("mean").alias("_c")), group, "left").join(lexical, group, "left").join(past.select(group, "accepted", "rejected"), group, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    spread = -0.5 * zero("_s")
    score = F.round(0.5 * zero("_d") + 0.25 * zero("lexical") + 0.25 * zero("_c") + spread, 4)
    ok = F.col("reason").isNull()
    shown = lambda x: F.when(ok, F.round(x, 4)).otherwise(0.0)
    said = F.when(ok, rationale(F.round(zero("_d"), 4), F.round(zero("lexical"), 4), F.coalesce("accepted", F.lit(0)), F.coalesce("rejected", F.lit(0)))).otherwise("")
    scored = met.select(group, "arrival", shown(score).alias("score"), shown(zero("_d")).alias("dense"), shown(zero("lexical")).alias("lexical"), shown(zero("_c")).alias("claim"), shown(spread).alias("dispersion"), "reason", said.alias("rationale"))
    passed = scored.filter("reason is null").orderBy(F.desc("score"), "arrival").limit(most)
    ranked = passed.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "arrival")))
    failed = numbered(scored.filter("reason is not null"), ["arrival"], "rank").crossJoin(F.broadcast(passed.agg(F.count(F.lit(1)).alias("_m")))).withColumn("rank", (F.col("rank") + F.col("_m")).cast("int")).drop("_m")
    return ranked.unionByName(failed).drop("arrival")


def enriched(recommended: DataFrame, nodes: DataFrame, edges: DataFrame, entities: DataFrame, memories: DataFrame, papers: DataFrame, chunks: DataFrame) -> DataFrame:
    """(part, place, name, value): the recommendations with graph counts, the first ten entities, the newest ten memories and totals (REC-05)."""
    n = F.count(F.lit(1)).cast("string").alias("value")
    zero = F.lit(0)
    count = lambda rows, part, name: rows.agg(n).select(F.lit(part).alias("part"), zero.alias("place"), F.lit(name).alias("name"), "value")
    out = recommended.select(F.lit("recommendation").alias("part"), F.col("rank").alias("place"), F.col("venue").alias("name"), F.col("score").cast("string").alias("value"))
    found = entities.filter("place <= 20")
    for part in (count(nodes, "graph", "nodes"), count(edges, "graph", "edges"), found.filter("place <= 10").select(F.lit("entity").alias("part"), "place", F.col("name").alias("name"), F.lit("").alias("value")), memories.filter("place <= 10").select(F.lit("memory").alias("part"), "place", F.col("memory_id").cast("string").alias("name"), F.col("content").alias("value")), count(papers, "total", "papers"), count(chunks, "total", "chunks"), count(memories.filter("place <= 10"), "total", "memories"), count(found, "total", "entities")):
        out = out.unionByName(part)
    return out


def pushed(projects: DataFrame, files: DataFrame, manuscripts: DataFrame) -> DataFrame:
    """Manuscripts (id, title, abstract, principal_claim, techniques) after projects (project_id, slug, title, principal_claim, techniques, manuscript_id) are pushed (REC-06).

    The abstract is the file named so, else the first in order that is not blank; a project without one is not pushed. A missing claim is the abstract's first
    sentence, or if that is very short its first 200 characters. A project linked to a manuscript that is there updates it; others make one.
    """
    body = F.regexp_replace("body", r"^\s+|\s+$", "")
    ranked = files.withColumn("_t", body).withColumn("_first", F.row_number().over(Window.partitionBy("project_id").orderBy("sort_order", "slug")))
    named = F.col("slug") == "abstract"
    picked = ranked.filter((named | (F.col("_first") == 1)) & (F.col("_t") != "")).groupBy("project_id").agg(F.min_by("_t", F.when(named, 0).otherwise(1)).alias("abstract"))
    met = projects.drop("abstract").join(picked, "project_id")
    first = F.regexp_replace(F.split_part("abstract", F.lit(". "), F.lit(1)), r"\.+$", "")
    claim = F.coalesce(F.nullif(F.trim(F.coalesce("principal_claim", F.lit(""))), F.lit("")), F.when(F.char_length(first) > 8, F.concat(first, F.lit("."))).otherwise(F.left("abstract", F.lit(200))))
    skills = F.filter(F.transform(F.split(F.coalesce("techniques", F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    there = manuscripts.select(F.col("id").alias("manuscript_id"), F.lit(True).alias("_there"))
    new = met.join(there, "manuscript_id", "left").select(F.when(F.col("_there"), F.col("manuscript_id")).otherwise(F.concat(F.lit("wp."), "slug")).alias("id"), "title", "abstract", claim.alias("principal_claim"), skills.alias("techniques"))
    return manuscripts.join(new.select("id"), "id", "left_anti").unionByName(new)
