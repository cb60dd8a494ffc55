"""Property graph as tables: entities, relations, neighbourhoods, subsets, components (GRF)."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share; a temporary one in local mode where that is unset."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-shared-")
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def path_exists(spark: SparkSession, path: str) -> bool:
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(there)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Writes an intermediate result to the shared folder and reads it back."""
    path = f"{shared_folder(df.sparkSession)}/graph-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def entities(mentions: DataFrame) -> DataFrame:
    """(name_key, name, type, paper_ids, chunk_count) from mentions (name, type, paper_id, ord): the trimmed lower-case name is the key, the first mention gives name and type, every mention counts (GRF-01)."""
    key = F.lower(F.trim("name"))
    return mentions.groupBy(key.alias("name_key")).agg(F.min_by("name", "ord").alias("name"), F.min_by("type", "ord").alias("type"), F.array_sort(F.collect_set("paper_id")).alias("paper_ids"), F.count(F.lit(1)).alias("chunk_count"))


def relations(found: DataFrame) -> DataFrame:
    """(source_id, target_id, relation, weight, paper_id) from occurrences (source_id, target_id, relation, paper_id, ord): weight counts them, the first one's paper stays (GRF-02)."""
    return found.groupBy("source_id", "target_id", "relation").agg(F.count(F.lit(1)).alias("weight"), F.min_by("paper_id", "ord").alias("paper_id"))


def expand(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """(id, hop): seeds (id) and all nodes within `hops` undirected steps of one, with the least number of steps (GRF-04)."""
    both = edges.select("source_id", "target_id").unionByName(edges.select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"))).distinct()
    seen = seeds.select("id", F.lit(0).alias("hop")).distinct()
    last = seen
    for hop in range(1, hops + 1):
        new = both.join(last.select(F.col("id").alias("source_id")), "source_id", "left_semi").select(F.col("target_id").alias("id")).distinct().join(seen, "id", "left_anti").withColumn("hop", F.lit(hop))
        last = cut_lineage(new)
        seen = seen.unionByName(last)
    return seen


def expand_many(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """(query_id, id, hop): for each query of seeds (query_id, id) its seeds and all nodes within `hops` undirected steps of one, with the least number of steps (GRF-04, RET-09).

    Queries are numbered, and 62 of them share a row of a node as bits of a long: a hop is one join of the newest bits with the edges and one OR for each
    node, whatever the number of queries. Bits that a node has had are masked, so only new ones go on.
    """
    both = cut_lineage(edges.select("source_id", "target_id").unionByName(edges.select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"))).filter("source_id <> target_id").distinct())
    numbers = cut_lineage(numbered(seeds.select("query_id").distinct(), ["query_id"], "_q").withColumn("_q", F.col("_q") - 1))
    bit = F.expr("shiftleft(1L, CAST(_q % 62 AS INT))")
    last = seeds.join(numbers, "query_id").groupBy("id", F.expr("_q div 62").alias("block")).agg(F.bit_or(bit).alias("bits"))
    found, seen = last.withColumn("hop", F.lit(0)), last
    for hop in range(1, hops + 1):
        met = both.join(last.withColumnRenamed("id", "source_id"), "source_id").groupBy(F.col("target_id").alias("id"), "block").agg(F.bit_or("bits").alias("bits"))
        had = seen.withColumnRenamed("bits", "had")
        new = met.join(had, ["id", "block"], "left").withColumn("bits", F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("had", F.lit(0).cast("long"))))).filter("bits <> 0").drop("had")
        last = cut_lineage(new)
        seen = seen.unionByName(last).groupBy("id", "block").agg(F.bit_or("bits").alias("bits"))
        found = found.unionByName(last.withColumn("hop", F.lit(hop)))
    each = found.select("id", "hop", "block", F.explode(F.filter(F.transform(F.sequence(F.lit(0), F.lit(61)), lambda i: F.when(F.expr("bits").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), i)) != 0, i)), lambda i: i.isNotNull())).alias("i"))
    return each.withColumn("_q", F.col("block") * 62 + F.col("i")).join(numbers, "_q").select("query_id", "id", "hop")


def numbered(rows: DataFrame, order: list[str | Column], name: str) -> DataFrame:
    """The rows with their number from 1 in an order, without ever meeting in one task: they are sorted over ranges, and each range begins behind the sizes of those before it."""
    placed = cut_lineage(rows.orderBy(*order).withColumn("_m", F.monotonically_increasing_id()))
    sizes = placed.groupBy(F.expr("shiftright(_m, 33)").alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_b", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_p", "_b")
    met = placed.withColumn("_p", F.expr("shiftright(_m, 33)")).join(before, "_p")
    return met.withColumn(name, F.expr("_b + (_m & 8589934591L) + 1")).drop("_m", "_p", "_b")


def subset(nodes: DataFrame, edges: DataFrame, most_nodes: int = 300, most_edges: int = 500) -> tuple[DataFrame, DataFrame]:
    """The nodes (id, chunk_count) with most mentions, and the heaviest edges with both ends among them (GRF-06)."""
    top = nodes.orderBy(F.desc("chunk_count"), "id").limit(most_nodes)
    ids = top.select("id")
    kept = edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    return top, kept.orderBy(F.desc("weight"), "source_id", "target_id").limit(most_edges)


def remove_paper(links: DataFrame, found: DataFrame, papers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links and occurrences without those of some papers (paper_id); entities and relations follow from what is left (GRF-08)."""
    return links.join(papers, "paper_id", "left_anti"), found.join(papers, "paper_id", "left_anti")


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id that undirected edges (a, b) reach, for every end of one (GRF-13).

    Each round takes the least label among neighbours, then that label's own label, so labels travel
    by doubling steps. A round is cut from its lineage by a written table.
    """
    both = cut_lineage(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut_lineage(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("component")))
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), F.col("component").alias("c")), "b").groupBy(F.col("a").alias("id")).agg(F.min("c").alias("c"))
        better = labels.join(near, "id", "left").select("id", F.least("component", F.coalesce("c", "component")).alias("component"))
        roots = better.select(F.col("id").alias("component"), F.col("component").alias("root"))
        new = cut_lineage(better.join(roots, "component", "left").select("id", F.least("component", F.coalesce("root", "component")).alias("component")))
        changed = new.join(labels.withColumnRenamed("component", "old"), "id").filter("component <> old").limit(1).count()
        labels = new
        if not changed:
            return labels


def citation_edges(papers: DataFrame, order: str) -> DataFrame:
    """(source_id, target_id, relation, weight): every paper (title, references_raw) cites each DOI in its references; nodes are lower-case names (GRF-11)."""
    from scholiast.functions.text import dois

    cited = papers.select(F.lower(F.trim("title")).alias("source_id"), F.explode(dois("references_raw")).alias("doi"))
    return cited.groupBy("source_id", F.lower("doi").alias("target_id")).agg(F.count(F.lit(1)).alias("weight")).select("source_id", "target_id", F.lit("Cites").alias("relation"), "weight")


def stats(tables: dict[str, DataFrame], meta: DataFrame) -> DataFrame:
    """(name, value): row counts and what is noted about the graph (GRF-07)."""
    out = meta.select("name", "value")
    for name, rows in tables.items():
        out = out.unionByName(rows.agg(F.count(F.lit(1)).cast("string").alias("value")).select(F.lit(name).alias("name"), "value"))
    return out


def entity_cards(edges: DataFrame, links: DataFrame, chunks: DataFrame, chunk: str, most: int, snippet: int) -> DataFrame:
    """(id, neighbours, place, chunk, links, snippet): of every entity the number of its neighbours and its `most` chunks with most links (GRF-12)."""
    both = edges.select(F.col("source_id").alias("id"), F.col("target_id").alias("other")).unionByName(edges.select(F.col("target_id").alias("id"), F.col("source_id").alias("other"))).filter("id <> other").distinct()
    near = both.groupBy("id").agg(F.count(F.lit(1)).alias("neighbours"))
    counted = links.groupBy("id", chunk).agg(F.count(F.lit(1)).alias("links"))
    best = counted.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("links"), chunk))).filter(F.col("place") <= most)
    return best.join(near, "id").join(chunks, chunk).select("id", "neighbours", "place", chunk, "links", F.left("text", F.lit(snippet)).alias("snippet"))
