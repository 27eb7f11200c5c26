"""Graph measures over undirected edges (a, b), a < b, each once. Iterations write their state to the shared folder."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from engrava.operators.components import connected_components
from engrava.operators.skew import lookup_join
from engrava.storage import discard, materialize


def simple(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(a, b): distinct unordered pairs without loops and nulls."""
    return edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col(src) != F.col(dst))).select(F.least(src, dst).alias("a"), F.greatest(src, dst).alias("b")).distinct()


def arcs(g: DataFrame) -> DataFrame:
    return g.select(F.col("a").alias("u"), F.col("b").alias("v")).union(g.select("b", "a"))


def degrees(g: DataFrame) -> DataFrame:
    return arcs(g).groupBy(F.col("u").alias("node")).agg(F.count("*").alias("degree"))


def triangles(g: DataFrame) -> DataFrame:
    """(node, n): triangles at each node. Edges point to the end of greater degree, so no hub has many successors."""
    d = degrees(g)
    e = g.join(d.toDF("a", "da"), "a").join(d.toDF("b", "db"), "b")
    first = (F.col("da") < F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("a") < F.col("b")))
    o = e.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("x"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("y"))
    wedges = o.toDF("x", "y").join(o.toDF("x", "z"), "x").where("y < z")
    t = wedges.join(g.toDF("y", "z"), ["y", "z"])
    return t.select(F.explode(F.array("x", "y", "z")).alias("node")).groupBy("node").agg(F.count("*").alias("n"))


def clustering(g: DataFrame) -> DataFrame:
    """(node, degree, c): 2T / (d(d-1)), 0 for nodes of degree below 2."""
    c = F.when(F.col("degree") > 1, 2 * F.coalesce("n", F.lit(0)) / (F.col("degree") * (F.col("degree") - 1))).otherwise(F.lit(0.0))
    return degrees(g).join(triangles(g), "node", "left").select("node", "degree", c.alias("c"))


def distances(g: DataFrame, sources: DataFrame, most: int | None = None) -> DataFrame:
    """(source, node, d): breadth-first from every source, a join per level, to exhaustion or up to a distance of ``most``."""
    e = materialize(arcs(g), "arcs")
    seen = materialize(sources.select(F.col("node").alias("source"), "node", F.lit(0).alias("d")), "bfs")
    for level in range(1, most + 1) if most is not None else itertools.count(1):
        step = seen.where(F.col("d") == level - 1).join(e.withColumnRenamed("u", "node"), "node").select("source", F.col("v").alias("node")).distinct()
        new = materialize(step.join(seen, ["source", "node"], "left_anti").withColumn("d", F.lit(level)).select("source", "node", "d"), "bfs")
        if not new.limit(1).count():
            break
        seen = seen.union(new)
    return seen


def landmarks(g: DataFrame, k: int) -> DataFrame:
    """The k nodes of highest degree."""
    return degrees(g).orderBy(F.desc("degree"), "node").limit(k).select("node")


def mean_path_length(dist: DataFrame) -> DataFrame:
    return dist.where("d > 0").agg(F.avg("d").alias("apsl"), F.count("*").alias("n_pairs"))


def harmonic(dist: DataFrame) -> DataFrame:
    """(node, harmonic): the sum of 1/d to the sources."""
    return dist.where("d > 0").groupBy("node").agg(F.sum(1 / F.col("d")).alias("harmonic"))


def betweenness(g: DataFrame, sources: DataFrame, n_nodes: int) -> DataFrame:
    """(node, score): Brandes from the given sources, scaled to all nodes: paths are counted level by level outwards,
    dependencies summed level by level back."""
    dist = materialize(distances(g, sources), "dist")
    e = arcs(g)
    top = dist.agg(F.max("d")).first()[0] or 0
    n_sources = sources.count()
    levels = [dist.where("d = 0").select("source", "node", F.lit(1.0).alias("sigma"))]
    for level in range(1, top + 1):
        now = dist.where(F.col("d") == level).select("source", "node")
        s = levels[-1].join(e.withColumnRenamed("u", "node"), "node").select("source", F.col("v").alias("node"), "sigma").join(now, ["source", "node"]).groupBy("source", "node").agg(F.sum("sigma").alias("sigma"))
        levels.append(materialize(s, "sigma"))
    below, parts = None, []
    for level in range(top, 0, -1):
        here = levels[level].join(below, ["source", "node"], "left") if below is not None else levels[level].withColumn("delta", F.lit(0.0))
        here = materialize(here.select("source", "node", "sigma", F.coalesce("delta", F.lit(0.0)).alias("delta")), "delta")
        parts.append(here.select("node", "delta"))
        share = here.select("source", F.col("node").alias("v"), ((1 + F.col("delta")) / F.col("sigma")).alias("share")).join(e, "v").select("source", F.col("u").alias("node"), "share")
        below = share.join(levels[level - 1], ["source", "node"]).groupBy("source", "node").agg(F.sum(F.col("share") * F.col("sigma")).alias("delta"))
    if not parts:
        return degrees(g).select("node", F.lit(0.0).alias("score"))
    total = parts[0]
    for p in parts[1:]:
        total = total.union(p)
    scale = n_nodes / max(1, n_sources) / max(1, (n_nodes - 1) * (n_nodes - 2))
    return degrees(g).select("node").join(total.groupBy("node").agg((F.sum("delta") * scale).alias("score")), "node", "left").select("node", F.coalesce("score", F.lit(0.0)).alias("score"))


def propagated_communities(g: DataFrame, rounds: int = 8) -> DataFrame:
    """(node, community): label propagation in half steps (nodes move only in alternate rounds by a hash of node and
    round, so that labels don't swap for ever); ties go to the least label; a node keeps a label as good as the best."""
    e = materialize(arcs(g), "arcs")
    labels = materialize(e.select(F.col("u").alias("node")).distinct().select("node", F.col("node").alias("community")), "labels")
    for r in range(rounds):
        votes = e.join(labels.toDF("v", "community"), "v").groupBy("u", "community").agg(F.count("*").alias("n"))
        best = votes.groupBy("u").agg(F.max(F.struct("n", (F.lit(0)).alias("z"))).alias("m")).select(F.col("u"), F.col("m.n").alias("n"))
        pick = votes.join(best, ["u", "n"]).groupBy("u").agg(F.min("community").alias("new"), F.collect_set("community").alias("all"))
        stay = F.array_contains("all", F.col("community")) | (F.pmod(F.xxhash64("node", F.lit(r)), F.lit(2)) == 0)
        new = materialize(labels.join(pick.withColumnRenamed("u", "node"), "node").select("node", F.when(stay, F.col("community")).otherwise(F.col("new")).alias("community")), "labels")
        labels, old = new, labels
        discard(old)
    return labels


def components(g: DataFrame) -> DataFrame:
    """(node, component): the least node of each component, for nodes of any kind that has an order. Ids are given to
    all nodes and written once, so they don't change under way."""
    g = materialize(g, "g")
    ids = materialize(arcs(g).select(F.col("u").alias("node")).distinct().select("node", F.monotonically_increasing_id().alias("id")), "ids")
    e = g.join(ids.toDF("a", "x"), "a").join(ids.toDF("b", "y"), "b")
    c = materialize(connected_components(e, "x", "y").toDF("id", "root").join(ids, "id"), "cc")
    return lookup_join(c, c.groupBy("root").agg(F.min("node").alias("component")), ["root"], "inner").select("node", "component")


def bounded_clusters(g: DataFrame, least: int = 3, most: int = 200) -> DataFrame:
    """(node, component, n) of BIGINT edges: components of at least ``least`` nodes. One of more than ``most`` nodes is
    split by communities, whose connected parts stand for it; a part is not split again, whatever its size."""
    c = materialize(connected_components(g, "a", "b"), "cc")
    sized = lambda x: lookup_join(x, x.groupBy("component").agg(F.count("*").alias("n")), ["component"], "inner").select("node", "component", "n")
    all_of = materialize(sized(c), "cc")
    giant = materialize(g.join(all_of.where(F.col("n") > most).select(F.col("node").alias("a")), "a", "left_semi").select("a", "b"), "giant")
    l = propagated_communities(giant)  # noqa: E741
    inside = giant.join(l.toDF("a", "ca"), "a").join(l.toDF("b", "cb"), "b").where("ca = cb")
    parts = sized(materialize(connected_components(inside, "a", "b"), "cc"))
    return all_of.where(F.col("n") <= most).union(parts).where(F.col("n") >= least)


def modularity(g: DataFrame, labels: DataFrame, gamma: float = 1.0) -> DataFrame:
    """One row q: the sum over communities of inside / m - gamma (degree sum / 2m)^2; unlabelled nodes are left out."""
    e = g.join(labels.toDF("a", "ca"), "a").join(labels.toDF("b", "cb"), "b")
    m = e.agg(F.count("*").alias("m"), F.count_if(F.col("ca") == F.col("cb")).alias("inside"))  # one row
    squares = e.select(F.explode(F.array("ca", "cb")).alias("c")).groupBy("c").agg(F.count("*").alias("s")).agg(F.sum(F.col("s") * F.col("s")).alias("squares"))  # whole numbers, so their order doesn't matter
    return m.join(squares).select((F.col("inside") / F.col("m") - gamma * (F.col("squares") / (4 * F.col("m") * F.col("m")))).alias("q"))


def rich_club(g: DataFrame, quantile: float = 0.9) -> DataFrame:
    """One row (k, n_rich, phi): density among nodes of degree above the quantile."""
    d = degrees(g)
    k = d.agg(F.percentile("degree", F.lit(quantile)).cast("int").alias("k"))  # one row
    rich = d.join(F.broadcast(k)).where("degree > k").select("node")
    n = rich.agg(F.count("*").alias("n_rich"))
    e = g.join(rich.toDF("a"), "a", "left_semi").join(rich.toDF("b"), "b", "left_semi").agg(F.count("*").alias("e"))
    return k.join(n).join(e).select("k", "n_rich", F.when(F.col("n_rich") > 1, 2 * F.col("e") / (F.col("n_rich") * (F.col("n_rich") - 1))).otherwise(F.lit(0.0)).alias("phi"))


def random_like(g: DataFrame, seed: int) -> DataFrame:
    """A random graph with about as many nodes and edges: each edge's ends are drawn anew among the nodes' ranks."""
    n = degrees(g).count()
    pick = lambda salt: F.pmod(F.xxhash64("a", "b", F.lit(seed), F.lit(salt)), F.lit(max(1, n)))
    return simple(g.select(pick(1).alias("src"), pick(2).alias("dst")))


def regime(n: Column, sigma: Column) -> Column:
    return F.when(n < 200, "insufficient_data").when(sigma < 1, "developmental").when(sigma < 3, "mid_life_drift").otherwise("healthy")


def lineage(old: DataFrame, new: DataFrame) -> DataFrame:
    """(community, ancestor, overlap): for each new community the old one it shares most nodes with."""
    n = old.toDF("node", "o").join(new.toDF("node", "n"), "node").groupBy("n", "o").agg(F.count("*").alias("c"))
    return n.groupBy(F.col("n").alias("community")).agg(F.max(F.struct("c", "o")).alias("m")).select("community", F.col("m.o").alias("ancestor"), F.col("m.c").alias("overlap"))


def lineage_events(old: DataFrame, new: DataFrame, least: float = 0.2) -> DataFrame:
    """(event, community, n_parts): split - an old community of which several new ones each have a share of ``least`` of
    its members; merge - a new one in which several old ones each make up as much."""
    k = old.toDF("node", "o").join(new.toDF("node", "n"), "node").groupBy("o", "n").agg(F.count("*").alias("k"))

    def parted(side: str, event: str) -> DataFrame:
        whole = k.groupBy(side).agg(F.sum("k").alias("whole"))
        parts = k.join(whole, side).where(F.col("k") / F.col("whole") >= least).groupBy(side).agg(F.count("*").alias("n_parts")).where("n_parts > 1")
        return parts.select(F.lit(event).alias("event"), F.col(side).alias("community"), "n_parts")

    return parted("o", "split").union(parted("n", "merge"))


def age_penalty(made: Column, now: Column, days: float = 30.0) -> Column:
    """0 for what is new (or has no date, or one to come) up to 1 from ``days`` on."""
    return F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.unix_micros(now) - F.unix_micros(made)) / 86400e6 / days)), F.lit(0.0))
