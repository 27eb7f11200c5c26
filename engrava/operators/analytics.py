"""Event and tag analytics: sequences, sessions, co-occurrence, drift, ranks, budgets."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from engrava.storage import materialize


def follow_pairs(events: DataFrame, by: str, order: list[str], kind: str, at: str) -> DataFrame:
    """(a, b, n, n_sessions, first_at, last_at): what directly follows what within a session, with its support."""
    nxt = F.lead(kind).over(W.partitionBy(by).orderBy(*order))
    nxt_at = F.lead(at).over(W.partitionBy(by).orderBy(*order))
    p = events.select(F.col(by).alias("s"), F.col(kind).alias("a"), nxt.alias("b"), nxt_at.alias("t")).where("a is not null and b is not null")
    return p.groupBy("a", "b").agg(F.count("*").alias("n"), F.countDistinct("s").alias("n_sessions"), F.min("t").alias("first_at"), F.max("t").alias("last_at"))


def tag_pairs(tags: DataFrame, key: str, tag: str, skip: list[str]) -> DataFrame:
    """(a, b, n, confidence, status) of unordered tags that records carry together, bookkeeping prefixes aside.

    Pairs are made within a record, whose tags are few; a record's tags are a set.
    """
    use = tags.where(~F.substring_index(tag, ":", 1).isin(skip)).select(F.col(key).alias("k"), F.col(tag).alias("t")).distinct()
    n = use.toDF("k", "a").join(use.toDF("k", "b"), "k").where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"))
    c = F.least(F.lit(1.0), F.col("n") / 10)
    return n.withColumn("confidence", F.round(c, 6)).withColumn("status", F.when(c >= 0.5, "auto").otherwise("pending"))


def average_rank_percentile(df: DataFrame, value: str, group: list[str] | None = None) -> DataFrame:
    """``percentile`` in 0..1 with the average rank for ties; 0 for a single row. Per group, or over distinct values.

    Over the whole table only the distinct values and their counts are ordered, not the rows.
    """
    keys = [*(group or []), value]
    counts = df.groupBy(*keys).agg(F.count("*").alias("__c"))
    w = W.partitionBy(*(group or [])).orderBy(value) if group else W.orderBy(value)
    n = F.sum("__c").over(W.partitionBy(*(group or []))) if group else F.sum("__c").over(W.partitionBy())
    below = F.sum("__c").over(w) - F.col("__c")
    p = counts.select(*keys, F.when(n > 1, (below + (F.col("__c") - 1) / 2) / (n - 1)).otherwise(F.lit(0.0)).alias("percentile"))
    return df.join(p, keys, "left")


def budget_packed(hits: DataFrame, group: str, rank: str, cost: str, budget: int, most: int = 50) -> DataFrame:
    """Hits in order of rank while their running cost fits the budget; it stops at the first that doesn't, but one
    hit is always kept, and never more than ``most``."""
    w = W.partitionBy(group).orderBy(rank)
    few = hits.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)  # cut before the sums, map-side
    run = few.withColumn("running", F.sum(cost).over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    stop = F.min(F.when((F.col("running") > budget) & (F.col("place") > 1), F.col("place"))).over(W.partitionBy(group))
    return run.withColumn("__stop", stop).where(F.col("__stop").isNull() | (F.col("place") < F.col("__stop"))).drop("__stop")


def first_share(df: DataFrame, share: float, *order: Column) -> DataFrame:
    """The first ceil(share * rows) rows in the given order, one at least; the order must have no ties.

    Rows are sorted by ranges; only the number of rows of each range is summed up, and each range keeps what falls to it.
    """
    rows = df.withColumn("__n", F.lit(1)).repartitionByRange(*order).sortWithinPartitions(*order)
    rows = materialize(rows.withColumn("__part", F.spark_partition_id()), "ranges")
    sizes = dict(rows.groupBy("__part").count().collect())  # a row for each range
    left, take = max(1, math.ceil(share * sum(sizes.values()))), []
    for part in sorted(sizes):
        take.append((part, min(left, sizes[part])))
        left -= take[-1][1]
    most = df.sparkSession.createDataFrame(take or [(0, 0)], "__part int, __most long")
    kept = rows.join(F.broadcast(most.where("__most > 0")), "__part").withColumn("__r", F.row_number().over(W.partitionBy("__part").orderBy(*order)))
    return kept.where("__r <= __most").select(*df.columns)


def entropy(df: DataFrame, group: str, value: str) -> DataFrame:
    """(group, entropy): Shannon entropy of positive values, divided by log2 of their number; 0 for fewer than two."""
    p = df.where(F.col(value) > 0).groupBy(group).agg(F.sum(value).alias("s"), F.count("*").alias("n"), F.sum(F.col(value) * F.log2(value)).alias("x"))
    h = F.log2("s") - F.col("x") / F.col("s")
    return p.select(group, F.when(F.col("n") > 1, h / F.log2("n")).otherwise(F.lit(0.0)).alias("entropy"))


def drifting(values: DataFrame, group: str, order: str, value: str, cycles: int) -> DataFrame:
    """(group, rises, alert): over the last ``cycles`` values, whether all but one or so of the steps go up."""
    w = W.partitionBy(group).orderBy(F.desc(order))
    last = values.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= cycles)
    step = last.withColumn("__up", (F.col(value) > F.lead(value).over(w)).cast("int"))
    return step.groupBy(group).agg(F.coalesce(F.sum("__up"), F.lit(0)).alias("rises"), (F.count("*") >= cycles).alias("__full")).select(group, "rises", (F.col("__full") & (F.col("rises") >= max(1, cycles - 2))).alias("alert"))


def time_bucket(at: Column, now: Column) -> Column:
    """today, yesterday, week, month or older, by calendar days."""
    d = F.datediff(now, at)
    return F.when(d <= 0, "today").when(d == 1, "yesterday").when(d < 7, "week").when(d < 30, "month").otherwise("older")


def cooldown(events: DataFrame, by: str, order: list[str], turn: str, gap: int, most: int) -> DataFrame:
    """Questions that may be asked: at least ``gap`` turns after the question before, ``most`` per session."""
    w = W.partitionBy(by).orderBy(*order)
    spaced = events.withColumn("__d", F.col(turn) - F.lag(turn).over(w)).where(F.col("__d").isNull() | (F.col("__d") >= gap))
    return spaced.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= most).drop("__d", "__n")


def consensus(proposals: DataFrame, by: str, at_seconds: str, window: int = 86400, least: int = 3) -> DataFrame:
    """Proposals backed by at least ``least`` of the same key within the window up to then (itself included)."""
    w = W.partitionBy(by).orderBy(at_seconds).rangeBetween(-window, W.currentRow)
    return proposals.withColumn("votes", F.count("*").over(w)).where(F.col("votes") >= least)
