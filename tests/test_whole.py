"""Queries that do the whole job, on small tables against brute force."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from engrava.operators import graphs as gr, pairs, paths
from engrava.plans import composed, graphed, joined


def union_find(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {x: find(x) for x in list(root)}


def tables(spark, folder, records, edges):
    spark.createDataFrame(records, "id string, vec_label long, tier string, tombstoned_at string").write.parquet(f"{folder}/records.parquet")
    spark.createDataFrame(edges, "src string, dst string, edge_type string, weight double").write.parquet(f"{folder}/edges.parquet")
    return str(folder)


def clusters(rows):
    by = defaultdict(set)
    for r in rows:
        by[r.component].add(r.node)
    assert all(r.n == len(by[r.component]) for r in rows)
    return sorted(map(sorted, by.values()))


def test_consolidation_clusters_take_all_connective_kinds(spark, tmp_path):
    rng = random.Random(5)
    kinds = ["hebbian", "pattern_separation_seed", "hebbian_cluster_replay", "consolidated_from", "entity_shared"]
    records = [(f"r{i}", i, "semantic" if i % 11 == 0 else "episodic", "2026-01-01" if i % 13 == 0 else " " if i % 3 else None) for i in range(300)]
    edges = [(f"r{rng.randrange(300)}", rng.choice(["{R%d}", " r%d", "r%d"]) % rng.randrange(310), rng.choice(kinds), rng.choice([0.04, 0.05, 0.9, -0.3, float("nan"), None])) for _ in range(500)]
    edges += [("r1", "r1", "hebbian", 0.9), ("r1", "r2", "hebbian", float("nan"))]
    good = {f"r{i}": i for i, (_, _, tier, gone) in enumerate(records) if tier == "episodic" and not (gone or "").strip()}
    pairs = [(good[a], good[b]) for a, b, k, w in ((a, b.strip().strip("{}").lower(), k, w) for a, b, k, w in edges) if k in kinds[:3] and w is not None and w >= 0.05 and a != b and a in good and b in good]
    size = Counter((root := union_find(pairs)).values())
    want = defaultdict(list)
    for x, r in root.items():
        if size[r] >= 3:
            want[r].append(x)
    assert 1 < len(want) and max(size.values()) <= 200
    assert clusters(graphed.graph_consolidation_clusters_whole(spark, tables(spark, tmp_path, records, edges)).collect()) == sorted(map(sorted, want.values()))


def test_giant_component_is_split(spark):
    """Thirty cliques of eight in a chain: 240 nodes, so communities; two cliques alone stay whole."""
    clique = lambda k, n: [(k * 8 + i, k * 8 + j) for i in range(n) for j in range(i)]
    edges = [e for k in range(30) for e in clique(k, 8)] + [(k * 8, k * 8 + 9) for k in range(29)] + clique(100, 3) + clique(200, 2)
    got = clusters(gr.bounded_clusters(gr.simple(spark.createDataFrame(edges, "src long, dst long"))).collect())
    assert [800, 801, 802] in got and not any(1600 in c for c in got)
    assert len(got) > 10 and max(map(len, got)) < 200
    assert all(len(set(union_find([e for e in edges if set(e) <= set(c)]).values())) == 1 for c in got)
    assert sum(map(len, got)) == len({x for c in got for x in c}) > 200


def test_components_take_the_whole_graph(spark, tmp_path):
    rng = random.Random(7)
    kinds = ["hebbian", "entity_shared", "contradicts", "temporal_next"]
    edges = [(f"r{rng.randrange(200)}", f"r{rng.randrange(200)}", rng.choice(kinds), 0.5) for _ in range(180)] + [("hub", f"h{i}", "hebbian", 0.1) for i in range(50)] + [("h3", "unknown", "contradicts", 0.2)]
    d = tables(spark, tmp_path, [("hub", 1, "episodic", None)], edges)
    want = union_find([(a, b) for a, b, k, _ in edges if k != "temporal_next" and a != b])
    got = {r.node: r.component for r in graphed.graph_components_whole(spark, d).collect()}
    assert got == want and got["unknown"] == "h0"


def brute(edges):
    """Per source: distances, and counts of shortest paths."""
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    dist, count = {}, {}
    for s in near:
        d, c, front = {s: 0}, Counter({s: 1}), [s]
        while front:
            new = {w for v in front for w in near[v] if w not in d}
            for w in new:
                d[w] = d[front[0]] + 1
            for v in front:
                for w in near[v] & new:
                    c[w] += c[v]
            front = list(new)
        dist[s], count[s] = d, c
    return dist, count


@pytest.fixture(scope="module")
def winding(spark, tmp_path_factory):
    """A tail of twelve nodes on a random part, and a pair apart."""
    rng = random.Random(11)
    edges = [(f"t{i:02}", f"t{i + 1:02}") for i in range(11)] + [("t11", "r00"), ("p", "q")] + [(f"r{a:02}", f"r{b:02}") for a, b in (rng.sample(range(70), 2) for _ in range(110))]
    return tables(spark, tmp_path_factory.mktemp("winding"), [("p", 1, "episodic", None)], [(a, b, "hebbian", 0.5) for a, b in edges]), brute(edges)


def test_paths_reach_all_nodes(spark, winding, monkeypatch):
    monkeypatch.setattr(paths, "WORDS", 1)  # two blocks of sources
    d, (dist, count) = winding
    got = {(r.source, r.node): r.d for r in graphed.graph_distances_whole(spark, d).collect()}
    assert got == {(s, n): k for s, of in dist.items() for n, k in of.items()} and max(got.values()) > 12
    h = {r.node: r.harmonic for r in graphed.graph_harmonic_whole(spark, d).collect()}
    assert h == {s: pytest.approx(sum(1 / k for k in of.values() if k), abs=1e-6) for s, of in dist.items()}
    largest = [k for of in dist.values() if len(of) == max(map(len, dist.values())) for k in of.values() if k]
    r = graphed.graph_mean_path_length(spark, d).first()
    assert r.n_pairs == len(largest) and r.apsl == pytest.approx(sum(largest) / len(largest))
    n = len(dist)
    want = {v: sum(count[s][v] * count[v][t] / count[s][t] for s in dist if s != v and v in dist[s] for t in dist[s] if t not in (s, v) and dist[s][v] + dist[v][t] == dist[s][t]) / ((n - 1) * (n - 2)) for v in dist}
    assert {r.node: r.score for r in graphed.graph_betweenness(spark, d).collect()} == {v: pytest.approx(x) for v, x in want.items()}
    assert paths.EXACT == 4096 and paths.SOURCES == 512


@pytest.mark.parametrize(("most", "levels", "of"), [(32, 24, 1), (1, 3, 5)])
def test_reach_without_leaves_in_shared_bits(monkeypatch, most, levels, of):
    """A hub with leaves, chains, a star, pairs and many alike components: sums of all shares are those of all nodes."""
    monkeypatch.setattr(paths, "MOST", most)
    monkeypatch.setattr(paths, "LEVELS", levels)
    rng = random.Random(12)
    edges = {(0, k) for k in range(1, 90)} | {(k, k + 1) for k in range(80, 130)} | {tuple(sorted(rng.sample(range(60, 400), 2))) for _ in range(420)} | {(500, 501), (502, 503), (600, 601), (600, 602)}
    edges |= {(1000 + 4 * k + i, 1000 + 4 * k + j) for k in range(50) for i, j in ((0, 1), (1, 2), (2, 3), (0, 3))}
    ends = sorted({x for e in edges for x in e})
    x, y = np.searchsorted(ends, np.array(sorted(edges)).T)
    h, n, total = (sum(z) for z in zip(*(paths.reached(x, y, len(ends), k, of) for k in range(of)), strict=True))
    dist, _ = brute(edges)
    for i, s in enumerate(ends):
        near = [d for d in dist[s].values() if d]
        assert (n[i], total[i]) == (len(near), sum(near)) and h[i] == pytest.approx(sum(1 / d for d in near))


def test_reach_of_many_small_components_searches_once(monkeypatch):
    """10,000 rings of four with a leaf each: 40,000 nodes to search from, in two words, for nodes with and without a leaf."""
    searched, search = [], paths.Part.search
    monkeypatch.setattr(paths.Part, "search", lambda self, begin, end: (searched.append(end - begin), search(self, begin, end))[1])
    r = 5 * np.arange(10000)
    x, y = np.concatenate([r, r + 1, r + 2, r, r]), np.concatenate([r + 1, r + 2, r + 3, r + 3, r + 4])
    h, n, total = paths.reached(x, y, 50000, 0, 1)
    assert sum(searched) == 2 and set(n) == {4}
    assert np.allclose(h.reshape(-1, 5), [3.5, 3.0, 17 / 6, 3.0, 1 + 2 / 2 + 1 / 3]) and (total.reshape(-1, 5) == [5, 6, 7, 6, 8]).all()


def test_hubness_and_opposites_take_all_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(pairs, "BLOCK", 60)
    rng = np.random.default_rng(3)
    x = rng.standard_normal((200, 8))
    x[150:190] = x[:40] + 0.05 * rng.standard_normal((40, 8))
    x[190:199] = x[190] + 0.2 * rng.standard_normal((9, 8))
    label = [i % 2 for i in range(150)] + [(i + i // 7) % 2 for i in range(40)] + [2] * 9 + [3]
    spark.createDataFrame([(i, [float(v) for v in x[i]], label[i]) for i in range(200)], "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    c = u @ u.T
    got = {(r.a, r.b) for r in joined.join_similar_opposites_whole(spark, str(tmp_path)).collect()}
    assert got == {(i, j) for i in range(200) for j in range(i + 1, 200) if label[i] != label[j] and c[i, j] >= 0.97} and any(b > 60 for _, b in got)
    for r in graphed.graph_hubness_whole(spark, str(tmp_path)).collect():
        of = [i for i in range(200) if label[i] == r.label]
        s = c[np.ix_(of, of)].copy()
        np.fill_diagonal(s, 0.0)
        mean = s.sum() / (len(of) * (len(of) - 1)) if len(of) > 1 else 0.0
        assert (r.size, r.mean_cos, r.max_cos, r.is_hub) == (len(of), pytest.approx(mean, abs=1e-6), pytest.approx(s.max(), abs=1e-6), mean > 0.85)


def test_near_links_miss_no_pair(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(pairs, "BLOCK", 50)
    rng = np.random.default_rng(4)
    x = np.repeat(rng.standard_normal((20, 64)), 10, axis=0) + rng.uniform(0.1, 0.8, (200, 1)) * rng.standard_normal((200, 64))
    tier = ["episodic" if i % 3 else "semantic" for i in range(200)]
    rows = [(i, tier[i], [float(v) for v in x[i]]) for i in range(200)] + [(200, "episodic", None), (201, "episodic", [0.0] * 64), (202, "episodic", [float("nan")] * 64)]
    spark.createDataFrame(rows, "vec_label long, tier string, embedding array<double>").write.parquet(f"{tmp_path}/records.parquet")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    c, want = u @ u.T, {}
    for i in range(200):
        hits = sorted((-c[i, j], j) for j in range(200) if j != i and tier[j] == tier[i] and c[i, j] >= 0.70)[:8]
        skip = bool(hits) and -hits[0][0] >= 0.92
        want |= {(i, j): "skip" if skip else "link" for _, j in (hits[:1] if skip else hits)}
    assert {"skip", "link"} == set(want.values())
    assert {(r.a, r.b): r.action for r in composed.join_near_links_whole(spark, str(tmp_path)).collect()} == want
