"""Communities by the Leiden scheme: nodes move, communities are refined from single nodes, refined ones become nodes.

One kernel holds the whole graph, so it is for graphs of up to ``most`` edges, and more is an error: the communities of a
larger graph are found by label propagation (``graphs.propagated_communities``). The resolutions that are tried run in
tasks of their own.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from engrava.operators.components import forest
from engrava.operators.paths import _table
from engrava.storage import materialize

# Resolutions, the modularity below which there is no structure, the share of single nodes that is too
# high, sizes below which all nodes are one community, at once or if modularity is low, and levels.
GAMMAS = (0.5, 0.75, 1.0, 1.5, 2.0)
FLOOR, SINGLES, SMALL, MEDIUM, LEVELS = 0.1338, 0.30, 200, 500, 5


def move_gain(to_target: Column, to_own: Column, degree: Column, target_total: Column, own_total: Column, two_m: Column, gamma: float = 1.0) -> Column:
    """What a node's move to a community changes, in weight: links to it less links to its own, and the resolution's price
    of the difference in degree sums (its own counts without the node)."""
    return to_target - to_own - gamma * degree * (target_total - (own_total - degree)) / two_m


class _Level:
    """A weighted graph: neighbours of each node without itself, and its degree (its own loop included)."""

    def __init__(self, n: int, x: np.ndarray, y: np.ndarray, w: np.ndarray, degree: np.ndarray):
        u, v, ww = np.concatenate([x, y]), np.concatenate([y, x]), np.concatenate([w, w])
        order = np.argsort(u, kind="stable")
        cut = np.cumsum(np.bincount(u, minlength=n))[:-1]
        self.to, self.weight = [a.tolist() for a in np.split(v[order], cut)], [a.tolist() for a in np.split(ww[order], cut)]
        self.n, self.edges, self.degree = n, (x, y, w), degree


def _best(g: _Level, i: int, label: list, total: list, gamma: float, two_m: float, inside: list | None = None):
    """(community, gain over staying) of the best move of node i to a neighbour's community; ties to the smaller label."""
    links: dict[int, float] = {}
    for j, w in zip(g.to[i], g.weight[i]):
        if inside is None or inside[j] == inside[i]:
            links[label[j]] = links.get(label[j], 0.0) + w
    own, k = label[i], g.degree[i]
    stay = links.get(own, 0.0) - gamma * k * (total[own] - k) / two_m
    top, gain = own, 1e-9
    for c in sorted(links):
        if c != own and (x := links[c] - gamma * k * total[c] / two_m - stay) > gain:
            top, gain = c, x
    return top, gain


def _moved(g: _Level, label: list, gamma: float, two_m: float, rng) -> list:
    """Labels after nodes have moved for as long as one gains; a node is looked at again when a neighbour leaves its community."""
    total = np.bincount(label, weights=g.degree, minlength=g.n).tolist()
    queue = deque(rng.permutation(g.n).tolist())
    waits = [True] * g.n
    while queue:
        i = queue.popleft()
        waits[i] = False
        c, _ = _best(g, i, label, total, gamma, two_m)
        if c != label[i]:
            total[label[i]] -= g.degree[i]
            total[c] += g.degree[i]
            label[i] = c
            for j in g.to[i]:
                if label[j] != c and not waits[j]:
                    waits[j] = True
                    queue.append(j)
    return label


def _refined(g: _Level, label: list, gamma: float, two_m: float, rng) -> list:
    """Communities inside the given ones, from single nodes: one that is still alone joins the best inside its own."""
    part, total, size = list(range(g.n)), g.degree.tolist(), [1] * g.n
    for i in rng.permutation(g.n).tolist():
        if size[part[i]] == 1:
            c, _ = _best(g, i, part, total, gamma, two_m, label)
            if c != part[i]:
                total[part[i]] -= g.degree[i]
                size[part[i]] -= 1
                total[c] += g.degree[i]
                size[c] += 1
                part[i] = c
    return part


def connected_parts(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Labels by which each community is connected: the least node of its connected part."""
    out = np.arange(len(label))
    same = label[x] == label[y]
    if same.any():
        nodes, root = forest(x[same], y[same])
        out[nodes] = root
    return out


def quality(label: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray, gamma: float = 1.0) -> float:
    """The sum over communities of inside / m - gamma (degree sum / 2m)^2."""
    m = w.sum()
    if not m:
        return 0.0
    _, c = np.unique(label, return_inverse=True)
    total = np.bincount(c[x], weights=w, minlength=c.max() + 1) + np.bincount(c[y], weights=w, minlength=c.max() + 1)
    return float(w[c[x] == c[y]].sum() / m - gamma * ((total / (2 * m)) ** 2).sum())


def communities(n: int, x: np.ndarray, y: np.ndarray, w: np.ndarray, gamma: float, seed: int = 42, levels: int = LEVELS) -> np.ndarray:
    """A community of each node 0..n-1 of a graph of different edges without loops; each is connected."""
    degree = np.bincount(x, weights=w, minlength=n) + np.bincount(y, weights=w, minlength=n)
    g, two_m = _Level(n, x, y, w, degree), float(degree.sum())
    node, label, rng = np.arange(n), list(range(n)), np.random.default_rng(seed)
    for _ in range(levels if two_m else 0):
        label = _moved(g, label, gamma, two_m, rng)
        label = connected_parts(np.array(label), *g.edges[:2]).tolist()
        part = np.array(_refined(g, label, gamma, two_m, rng))
        names, small = np.unique(part, return_inverse=True)
        if len(names) == g.n:
            break
        node = small[node]
        a, b = small[g.edges[0]], small[g.edges[1]]
        apart = a != b
        lo, hi = np.minimum(a, b)[apart], np.maximum(a, b)[apart]
        pair, inv = np.unique(lo * len(names) + hi, return_inverse=True)
        weight = np.bincount(inv, weights=g.edges[2][apart], minlength=len(pair))
        owner = np.zeros(len(names), np.int64)
        owner[small] = label
        _, owner = np.unique(owner, return_inverse=True)
        g = _Level(len(names), pair // len(names), pair % len(names), weight, np.bincount(small, weights=g.degree, minlength=len(names)))
        label = owner.tolist()
    return connected_parts(np.array(label)[node], x, y)


def chosen(found: list[tuple[float, float, float]]) -> float:
    """The resolution of (gamma, quality, share of single nodes): best by quality less half the share, among those that
    have structure and few single nodes, else among those with structure, else of all; ties to the smaller."""
    score = lambda f: (f[1] - 0.5 * f[2], -f[0])
    good = [f for f in found if f[1] >= FLOOR and f[2] < SINGLES]
    return max(good or [f for f in found if f[1] >= FLOOR] or found, key=score)[0]


def leiden(g: DataFrame, gammas: tuple[float, ...] = GAMMAS, seed: int = 42, most: int = 20_000_000) -> DataFrame:
    """(node, community) of a graph of edges (a, b) and, if there is one, weight: the least node of the community.

    Edges with a null, negative or non-finite weight, and loops, are left out; repeated ones add up. The result depends on the edges and
    the seed only, not on their order. Fewer than 200 nodes, or fewer than 500 without clear structure, are one
    community. No edges: no rows.
    """
    weight = F.col("weight").cast("double") if "weight" in g.columns else F.lit(1.0)
    e = g.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), weight.alias("w")).where("a <> b and w >= 0 and w < double('infinity')")
    e = materialize(e.groupBy("a", "b").agg(F.sum("w").alias("w")), "edges")
    rows = e.count()
    if rows > most:
        raise ValueError(f"{rows} edges are more than one task is to hold: use propagated_communities")
    kind, spark, path = e.schema["a"].dataType.simpleString(), e.sparkSession, e._engrava_path
    if not rows:
        return spark.createDataFrame([], f"node {kind}, community {kind}")

    def run(batches):
        t = _table(path, ["a", "b", "w"]).combine_chunks()
        names, at = np.unique(np.concatenate([t["a"].to_numpy(zero_copy_only=False), t["b"].to_numpy(zero_copy_only=False)]), return_inverse=True)
        x, y, w = at[: len(t)], at[len(t) :], t["w"].to_numpy()
        order = np.lexsort((y, x))
        x, y, w = x[order], y[order], w[order]
        for batch in batches:
            for gamma in batch.column(0).to_pylist():
                label = communities(len(names), x, y, w, gamma, seed)
                share = float((np.unique(label, return_counts=True)[1] == 1).sum()) / len(names)
                plain = quality(label, x, y, w)
                cells = [gamma, quality(label, x, y, w, gamma), share, plain]
                yield pa.RecordBatch.from_arrays([*[pa.array(np.full(len(names), c)) for c in cells], *[pa.array(v.tolist(), t.schema.field("a").type) for v in (names, names[label])]], names=["gamma", "q", "share", "plain", "node", "community"])

    tried = spark.createDataFrame([(float(x),) for x in gammas], "gamma double").repartitionByRange(len(gammas), "gamma")
    out = materialize(tried.mapInArrow(run, f"gamma double, q double, share double, plain double, node {kind}, community {kind}"), "leiden")
    found = out.groupBy("gamma").agg(F.first("q"), F.first("share"), F.first("plain"), F.count("*")).collect()  # a row a resolution
    gamma = chosen([tuple(r[:3]) for r in found])
    plain, n = next((r[3], r[4]) for r in found if r[0] == gamma)
    best = out.where(F.col("gamma") == gamma).select("node", "community")
    if n < SMALL or (n < MEDIUM and plain < FLOOR):
        return best.select("node", F.lit(best.agg(F.min("node")).first()[0]).cast(kind).alias("community"))
    return best
