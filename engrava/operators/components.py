"""Connected components of an undirected graph given as edges."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from engrava.operators.skew import lookup_join
from engrava.storage import discard, materialize


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the given edges, and the smallest node joined to each through them (vectorised hooking and jumping)."""
    nodes, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inv[: len(a)], inv[len(a) :]
    root = np.arange(len(nodes))
    while len(x):
        low = np.minimum(root[x], root[y])
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
        left = root[x] != root[y]
        x, y = x[left], y[left]
    return nodes, nodes[root]


def _contract(batches):
    """Each partition's edges as a forest of stars: at most one edge a node, whatever came in; a loop only of a node that
    has no other edge here."""
    a, b = np.empty(0, np.int64), np.empty(0, np.int64)
    for batch in batches:
        a, b = np.concatenate([a, batch.column(0).to_numpy()]), np.concatenate([b, batch.column(1).to_numpy()])
        if len(a) > 1 << 20:
            a, b = forest(a, b)  # roots come as loops
    if len(a):
        n, r = forest(a, b)
        keep = (n != r) | ~np.isin(n, r[n != r])
        yield pa.RecordBatch.from_arrays([pa.array(n[keep]), pa.array(r[keep])], names=["u", "v"])


def _state(df: DataFrame) -> tuple:
    return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def connected_components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node of each component, for every node that has an edge.

    edges holds pairs of BIGINT; direction, repeats, loops and extra columns don't matter; pairs with a null are no
    edges. Each partition first contracts its own edges into stars, then large-star and small-star steps alternate
    until nothing changes, each round written to the shared folder. Hubs are joined by ``lookup_join``; minima are
    taken with map-side partial aggregation. No edges: no rows.
    """
    e = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u is not null and v is not null")
    first = materialize(e.mapInArrow(_contract, "u long, v long"), "cc")  # the edges are read this once
    loops, now = first.where("u = v").select(F.col("u").alias("node")).distinct(), first.where("u <> v")
    state = _state(now)
    for _ in range(max_rounds):
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = lookup_join(both.where("v > u"), least, ["u"], "inner").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialize(large, "cc")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = lookup_join(large, least, ["u"], "inner")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        new = materialize(small.mapInArrow(_contract, "u long, v long").where("u <> v"), "cc")
        discard(large)
        if now is not first:  # its loops are still needed
            discard(now)
        now, before, state = new, state, _state(new)
        if state == before:
            break
    else:
        raise RuntimeError("connected components did not settle")
    members = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = members.select(F.col("component").alias("node"), "component").distinct()
    alone = loops.join(members.select("node").union(roots.select("node")), "node", "left_anti").select("node", F.col("node").alias("component"))
    return members.union(roots).union(alone)
