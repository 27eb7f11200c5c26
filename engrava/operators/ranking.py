"""Rank fusion, fused scores, temporal adjustments of served hits."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

RRF_K = 60


def rrf(lanes: list[DataFrame], key: str, score: str, base: int = 0, depth: int = 100) -> DataFrame:
    """Reciprocal rank fusion: the sum over lanes of 1 / (60 + rank), ranks from ``base``; best first by score, then key."""

    def ranked(lane: DataFrame) -> DataFrame:
        top = lane.orderBy(F.desc(score), key).limit(depth)
        return top.select(key, (1.0 / (RRF_K + base + F.row_number().over(W.orderBy(F.desc(score), key)) - 1)).alias("part"))

    return reduce(DataFrame.unionByName, map(ranked, lanes)).groupBy(key).agg(F.sum("part").alias("rrf"))


def two_lanes(lexical: DataFrame, semantic: DataFrame, key: str, score: str, cos: str, k: int) -> DataFrame:
    """(key, score, cos, rrf, lane): the k best of two lanes of k rows each by the sum of 1 / (60 + rank), ranks from 0;
    then by score, by cos and by key. lane names the one that has the row, or both."""
    ranked = lambda lane, by, r: lane.orderBy(F.desc(by), key).limit(k).withColumn(r, F.row_number().over(W.orderBy(F.desc(by), key)) - 1)
    both = ranked(lexical, score, "__a").join(ranked(semantic, cos, "__b"), key, "full_outer")
    part = lambda r: F.coalesce(1.0 / (RRF_K + F.col(r)), F.lit(0.0))
    lane = F.when(F.col("__b").isNull(), "lexical").when(F.col("__a").isNull(), "semantic").otherwise("both")
    hits = both.select(key, score, cos, (part("__a") + part("__b")).alias("rrf"), lane.alias("lane"))
    return hits.orderBy(F.desc("rrf"), F.desc(F.coalesce(score, F.lit(0.0))), F.desc(F.coalesce(cos, F.lit(0.0))), key).limit(k)


def recalled(records: DataFrame, cue: str | None, at: Column | None, k: int = 10) -> DataFrame:
    """The k records that recall gives. With a cue the most similar (``cos``, then vec_label) of those alive now, or as
    of ``at``: created by then and not yet tombstoned; without a cue the newest of those; with neither none."""
    from engrava.functions.instants import blank, parse_instant

    if cue is None and at is None:
        return records.limit(0)
    made, gone = parse_instant(F.col("created_at")), parse_instant(F.col("tombstoned_at"))
    there = blank(F.col("tombstoned_at")) if at is None else (made <= at) & (gone.isNull() | (gone > at))
    return records.where(there).orderBy(F.desc("cos") if cue is not None else F.desc(made), "vec_label").limit(k)


def fused(cos: Column, anchor: Column, degree: Column, max_degree: Column, age_days: Column, stability: Column, valence: Column, trigram: Column, whole_cue: Column, lexical_rank: Column | None = None, w_cos: float = 1.0, w_degree: float = 0.1) -> Column:
    """The fused relevance of a candidate from its signals."""
    base = w_cos * cos + 0.3 * anchor + F.when(max_degree > 0, w_degree * F.log1p(degree) / F.log1p(max_degree)).otherwise(0.0) - 0.05 * F.least(F.lit(1.0), F.greatest(F.lit(0.0), age_days / 30))
    s = base + (1 - F.least(F.lit(1.0), F.coalesce(stability, F.lit(0.5)))) * 0.1
    s = s * F.when(valence > 0, 1 + valence).otherwise(1.0)
    s = s * F.when(trigram > 0.3, 2.0).otherwise(1.0) * F.when(whole_cue, 3.0).otherwise(1.0)
    return s if lexical_rank is None else s + F.when(lexical_rank.isNotNull(), 0.35 / (1 + lexical_rank)).otherwise(0.0)


def fused_full(s: dict[str, Column], w_cos: float = 1.0, w_degree: float = 0.1, w_spread: float = 0.0, mode_bias: float = 0.1, w_struct: float = 0.0) -> Column:
    """The fused relevance with every term, of the signals named below; a null signal adds nothing.

    cos, anchor, degree, max_degree, age_days, stability, valence, trigram, whole_cue; lexical_rank from 0, null where the
    lexical lane has no such row; seed, the cosine of the seed that reaches the candidate, times 0.6 for each hop;
    community and max_community, scores of its community and of the best; structural, a similarity in 0..1; damp, what
    counts of degree and community where cosines are all alike (``damped``).
    """
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    base = w_cos * s["cos"] + 0.3 * zero(s["anchor"]) + F.when(s["max_degree"] > 0, w_degree * s["damp"] * F.log1p(zero(s["degree"])) / F.log1p(s["max_degree"])).otherwise(0.0)
    base = base - 0.05 * F.least(F.lit(1.0), F.greatest(F.lit(0.0), zero(s["age_days"]) / 30)) + w_spread * zero(s["seed"])
    base = base + mode_bias * s["damp"] * s["cos"] * F.when(s["max_community"] > 0, F.greatest(F.lit(0.0), zero(s["community"]) / s["max_community"])).otherwise(0.0)
    if w_struct > 0:
        base = (1 - w_struct) * base + w_struct * zero(s["structural"])
    out = base + (1 - F.least(F.lit(1.0), F.coalesce(s["stability"], F.lit(0.5)))) * 0.1
    out = out * F.when(s["valence"] > 0, 1 + s["valence"]).otherwise(1.0) * F.when(s["trigram"] > 0.3, 2.0).otherwise(1.0) * F.when(s["whole_cue"], 3.0).otherwise(1.0)
    return out + F.when(s["lexical_rank"].isNotNull(), 0.35 / (1 + s["lexical_rank"])).otherwise(0.0)


def damped(spread: Column, full: float = 0.02) -> Column:
    """How much of the structural weights counts where cosines are all alike."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), spread / full))


def tier_boost(tier: Column, salience: Column, rank: Column) -> Column:
    """Multiplier of semantic tiers and of salience."""
    lift = F.when(tier == "semantic", 1.05 + F.when(salience.isin("notable", "critical"), 0.5).otherwise(0.0)).otherwise(1.0)
    return lift * (1 + 0.05 * rank)


def stale_down(score: Column, valid_to: Column, now: Column, historical: bool = False) -> Column:
    return score if historical else F.when(valid_to < now, score * 0.5).otherwise(score)


def supersede_capped(hits: DataFrame, group: str, corrector: DataFrame, margin: float = 1e-4, top: int = 10) -> DataFrame:
    """Served hits (group, id, score; at most some fifty per group) where a superseded hit stays below its best
    corrector among the ``top``; repeated until nothing changes. corrector holds (id, by)."""
    c = corrector.groupBy("id").agg(F.collect_set("by").alias("by"))
    rows = hits.join(c, "id", "left").select(group, "id", "score", "by")

    def cap(pdf: pd.DataFrame) -> pd.DataFrame:
        score = dict(zip(pdf["id"], pdf["score"]))
        by = {i: [x for x in (b if b is not None else []) if x in score and x != i] for i, b in zip(pdf["id"], pdf["by"])}
        for _ in range(len(pdf)):
            head = set(sorted(score, key=lambda i: (-score[i], i))[:top])
            new = {i: min([s, *([max(score[x] for x in by[i] if x in head) - margin] if any(x in head for x in by[i]) else [])]) for i, s in score.items()}
            if new == score:
                break
            score = new
        return pd.DataFrame({group: pdf[group], "id": pdf["id"], "score": pdf["id"].map(score)})

    kinds = dict(hits.dtypes)
    return rows.groupBy(group).applyInPandas(cap, f"{group} {kinds[group]}, id {kinds['id']}, score double")


def community_gate(hits: DataFrame, community: str, cos: str, k: int = 3) -> DataFrame:
    """The k communities with the greatest member cosine."""
    return hits.where(F.col(community).isNotNull()).groupBy(community).agg(F.max(cos).alias("best")).orderBy(F.desc("best"), community).limit(k)


def claim_verdict(newest_days: Column, contradicted: Column, n_evidence: Column) -> Column:
    return F.when(contradicted, "CONTRADICTED").when(n_evidence == 0, "NO_EVIDENCE").when(newest_days >= 7, "UNCONFIRMED").otherwise("CURRENT")


def packed(hits: DataFrame, group: str, score: str, boost: Column, cost: str, served: DataFrame, key: str, floor: float, budget: int, most: int = 10) -> DataFrame:
    """A pack to offer unasked: hits above a floor that weren't served before, in boosted order but with their raw
    score, until the budget is full."""
    from engrava.operators.analytics import budget_packed

    fresh = hits.where(F.col(score) >= floor).join(served.select(key).distinct(), key, "left_anti")
    order = F.row_number().over(W.partitionBy(group).orderBy(F.desc(F.col(score) * boost), key))
    return budget_packed(fresh.withColumn("rank", order), group, "rank", cost, budget, most)


def reclaimed(hits: DataFrame, markers: DataFrame, group: str, rank: str, cost: str, budget: int, share: float = 0.25) -> DataFrame:
    """Markers may take up to ``share`` of the budget, in their order; hits fill what is left, lowest ranks go first."""
    w = lambda: W.partitionBy(group).orderBy(rank).rowsBetween(W.unboundedPreceding, W.currentRow)
    m = markers.withColumn("run", F.sum(cost).over(w())).where(F.col("run") <= budget * share)
    used = m.groupBy(group).agg(F.max("run").alias("used"))
    h = hits.withColumn("run", F.sum(cost).over(w())).join(used, group, "left").where(F.col("run") <= budget - F.coalesce("used", F.lit(0)))
    return h.select(*hits.columns, F.lit(False).alias("marker")).unionByName(m.select(*hits.columns, F.lit(True).alias("marker")))


def adaptive(activity: float, low: tuple[int, int, float] = (400, 1, 0.6), high: tuple[int, int, float] = (1600, 2, 0.3)) -> tuple[int, int, float]:
    """(token budget, hops, threshold) between a quiet and a busy state."""
    a = min(1.0, max(0.0, activity))
    return round(low[0] + a * (high[0] - low[0])), round(low[1] + a * (high[1] - low[1])), low[2] + a * (high[2] - low[2])
