"""Joins of records, edges and events that carry the engine's temporal and graph semantics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F


def asof_backward(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, take: list[str]) -> DataFrame:
    """Each left row with the columns ``take`` of the latest right row of its group at or before it; unmatched dropped.

    One shuffle by the group: both sides are sorted together and the last right row is carried forward. Of right rows
    of equal time the greatest ``take`` counts. Null groups or times match nothing.
    """
    l = left.where(" AND ".join(f"`{c}` IS NOT NULL" for c in [*by, left_time])).select(*[F.col(c).alias(f"__b{i}") for i, c in enumerate(by)], F.col(left_time).alias("__t"), F.lit(1).alias("__k"), F.struct(*left.columns).alias("__l"), F.lit(None).cast(right.select(F.struct(*take)).schema[0].dataType).alias("__r"))  # noqa: E741
    r = right.where(" AND ".join(f"`{c}` IS NOT NULL" for c in [*by, right_time])).select(*[F.col(c).alias(f"__b{i}") for i, c in enumerate(by)], F.col(right_time).alias("__t"), F.lit(0).alias("__k"), F.lit(None).cast(left.select(F.struct(*left.columns)).schema[0].dataType).alias("__l"), F.struct(*take).alias("__r"))
    w = W.partitionBy(*[f"__b{i}" for i in range(len(by))]).orderBy("__t", "__k", "__r").rowsBetween(W.unboundedPreceding, W.currentRow)
    both = l.unionByName(r).withColumn("__m", F.last("__r", ignorenulls=True).over(w))
    return both.where("__k = 1 AND __m IS NOT NULL").select("__l.*", *[F.col(f"__m.{c}").alias(f"r_{c}") for c in take])


def both_ways(edges: DataFrame) -> DataFrame:
    """(node, other, edge_type, weight): each edge from either end; a loop once."""
    out = edges.select(F.col("src").alias("node"), F.col("dst").alias("other"), "edge_type", "weight")
    return out.union(edges.where("src <> dst").select("dst", "src", "edge_type", "weight"))


def incident(ids: DataFrame, edges: DataFrame, k: int, kinds: list[str] | None = None) -> DataFrame:
    """The k strongest edges of each node of ``ids`` (column node): by weight, then neighbour, then type."""
    e = both_ways(edges if kinds is None else edges.where(F.col("edge_type").isin(kinds)))
    w = W.partitionBy("node").orderBy(F.desc("weight"), "other", "edge_type")
    return e.join(ids.select("node").distinct(), "node", "left_semi").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def validity(records: DataFrame, edges: DataFrame, kind: str = "contradicts") -> DataFrame:
    """(id, valid_from, valid_to): a record holds until the earliest strictly later target of its contradicting edges."""
    dst = records.select(F.col("id").alias("dst"), F.col("made").alias("other_made"))
    ends = edges.where(F.col("edge_type") == kind).select("src", "dst").distinct().join(dst, "dst").join(records.select(F.col("id").alias("src"), "made"), "src").where("other_made > made").groupBy("src").agg(F.min("other_made").alias("valid_to"))
    return records.select("id", F.col("made").alias("valid_from")).join(ends.withColumnRenamed("src", "id"), "id", "left")


def two_hops(seeds: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    """(seed, node, hop): neighbours of neighbours, the k strongest of each node, without what was seen before."""
    nb = both_ways(edges).groupBy("node", "other").agg(F.max("weight").alias("weight"))
    top = nb.withColumn("r", F.row_number().over(W.partitionBy("node").orderBy(F.desc("weight"), "other"))).where(F.col("r") <= k).select("node", "other")
    first = seeds.select(F.col("node").alias("seed")).distinct().join(top.withColumnRenamed("node", "seed"), "seed").where("other <> seed").select("seed", F.col("other").alias("node"))
    second = first.join(top, "node").where("other <> seed").select("seed", F.col("other").alias("node")).distinct().join(first, ["seed", "node"], "left_anti")
    return first.withColumn("hop", F.lit(1)).union(second.withColumn("hop", F.lit(2)))


def anti_hits(hits: DataFrame, edges: DataFrame, most: int = 3, kind: str = "contradicts") -> DataFrame:
    """Contradicting neighbours of ranked hits (node, rank), in order of the hit, without the hits, ``most`` of them."""
    e = both_ways(edges.where(F.col("edge_type") == kind)).join(hits, "node").join(hits.select(F.col("node").alias("other")), "other", "left_anti")
    first = e.groupBy("other").agg(F.min("rank").alias("of_rank"))
    return first.orderBy("of_rank", "other").limit(most)


def supersede_chain(records: DataFrame, edges: DataFrame, hops: int = 8, kind: str = "contradicts") -> DataFrame:
    """(id, current, hops): follow the least corrector of each record, ``hops`` steps at most."""
    nxt = edges.where(F.col("edge_type") == kind).where("src <> dst").groupBy("src").agg(F.min("dst").alias("nxt"))
    now = records.select("id", F.col("id").alias("current"), F.lit(0).alias("hops")).join(nxt.select(F.col("src").alias("id")), "id", "left_semi")
    for _ in range(hops):
        step = now.join(nxt.withColumnRenamed("src", "current"), "current", "left")
        now = step.select("id", F.coalesce("nxt", "current").alias("current"), (F.col("hops") + F.col("nxt").isNotNull().cast("int")).alias("hops"))
    return now
