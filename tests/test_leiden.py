"""Communities: a published small graph, planted groups, and the quality that moves add up to."""

import numpy as np
from pyspark.sql import functions as F

from engrava.operators.leiden import chosen, communities, connected_parts, leiden, move_gain, quality

#: Zachary's karate club: the later members each one knows.
KARATE = {0: [1, 2, 3, 4, 5, 6, 7, 8, 10, 11, 12, 13, 17, 19, 21, 31], 1: [2, 3, 7, 13, 17, 19, 21, 30], 2: [3, 7, 8, 9, 13, 27, 28, 32], 3: [7, 12, 13], 4: [6, 10], 5: [6, 10, 16], 6: [16], 8: [30, 32, 33], 9: [33], 13: [33], 14: [32, 33], 15: [32, 33], 18: [32, 33], 19: [33], 20: [32, 33], 22: [32, 33], 23: [25, 27, 29, 32, 33], 24: [25, 27, 31], 25: [31], 26: [29, 33], 27: [33], 28: [31, 33], 29: [32, 33], 30: [32, 33], 31: [32, 33], 32: [33]}


def arrays(edges):
    x, y = np.array(edges).T
    return x, y, np.ones(len(x))


def test_karate_club_reaches_its_best_modularity():
    x, y, w = arrays([(a, b) for a, bs in KARATE.items() for b in bs])
    assert len(x) == 78
    q = [quality(communities(34, x, y, w, 1.0, seed), x, y, w) for seed in range(5)]
    assert max(q) > 0.4197 and min(q) > 0.40  # the optimum is 0.4198


def planted(n=600, groups=6, seed=3):
    rng = np.random.default_rng(seed)
    own = rng.integers(0, groups, n)
    a, b = np.triu_indices(n, 1)
    keep = rng.random(len(a)) < np.where(own[a] == own[b], 0.12, 0.004)
    return own, list(zip(a[keep].tolist(), b[keep].tolist()))


def test_planted_groups_are_found_and_connected(spark):
    own, edges = planted()
    df = spark.createDataFrame([(f"n{a:03}", f"n{b:03}") for a, b in edges], "a string, b string")
    got = {r.node: r.community for r in leiden(df.repartition(5)).collect()}
    groups = {}
    for node, c in got.items():
        groups.setdefault(c, []).append(own[int(node[1:])])
    assert len(groups) == 6 and sum(max(g.count(k) for k in set(g)) for g in groups.values()) >= 0.98 * len(got)
    assert all(c == min(n for n, k in got.items() if k == c) for c in groups)
    assert got == {r.node: r.community for r in leiden(df.union(df.selectExpr("a", "a")).repartition(2)).collect()}  # loops and order don't matter
    label = communities(600, *arrays(edges), 1.0)
    assert (connected_parts(label, *arrays(edges)[:2]) == label).all()


def test_small_graphs_are_one_community_and_empty_ones_none(spark):
    df = spark.createDataFrame([(1, 2, 1.0), (3, 4, 2.0), (5, 6, None), (7, 8, float("nan")), (8, 9, -1.0)], "a int, b int, weight double")
    assert sorted(tuple(r) for r in leiden(df).collect()) == [(i, 1) for i in range(1, 5)]
    assert leiden(df.limit(0)).count() == 0


def test_choice_of_the_resolution():
    assert chosen([(0.5, 0.4, 0.0), (1.0, 0.5, 0.1), (2.0, 0.9, 0.5)]) == 1.0
    assert chosen([(0.5, 0.2, 0.4), (1.0, 0.05, 0.0)]) == 0.5 and chosen([(0.5, 0.01, 0.0), (1.0, 0.1, 0.0)]) == 1.0


def test_a_move_changes_the_quality_by_its_gain(spark):
    x, y, w = arrays([(a, b) for a, bs in KARATE.items() for b in bs])
    label = np.arange(34) % 3
    before, after = label.copy(), label.copy()
    after[5] = 0
    degree = np.bincount(x, minlength=34) + np.bincount(y, minlength=34)
    near = np.concatenate([y[x == 5], x[y == 5]])
    total = np.bincount(label, weights=degree)
    cells = [float((before[near] == 0).sum()), float((before[near] == label[5]).sum()), float(degree[5]), total[0], total[label[5]], 156.0]
    gain = spark.range(1).select(move_gain(*[F.lit(float(c)) for c in cells], 1.5)).first()[0]
    assert abs(2 * gain / 156 - (quality(after, x, y, w, 1.5) - quality(before, x, y, w, 1.5))) < 1e-12
