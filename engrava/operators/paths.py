"""Shortest paths over undirected edges (a, b), to exhaustion, from blocks of sources. Each Python worker holds the whole
graph as two arrays (16 bytes an edge), and its nodes' names where it needs them; blocks of sources are spread over the workers."""

from __future__ import annotations

from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from engrava.operators.graphs import arcs, landmarks
from engrava.storage import materialize

#: Betweenness and distances start from all nodes of a graph of up to EXACT nodes, above from the SOURCES of highest degree.
EXACT, SOURCES = 4096, 512
#: ``reach``: words of 64 sources that are worth a task; most words searched from at once, and words that a table of them has;
#: neighbours looked up at once; levels that are counted before they are summed up.
WORDS, MOST, TABLE, ROOM, LEVELS = 16, 32, 3 << 22, 2048, 24


def _table(path: str, columns: list[str]) -> pa.Table:
    from pyarrow import dataset, fs

    system, where = (fs.LocalFileSystem(), unquote(urlparse(path).path)) if path.startswith(("file:", "/")) else fs.FileSystem.from_uri(path)
    return dataset.dataset(where, filesystem=system, format="parquet").to_table(columns)


def _graph(e_path: str, n_path: str) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """indptr, indices, the nodes' names and ids; each node has an edge, so no row is empty."""
    t = _table(n_path, ["id", "node"]).combine_chunks().sort_by("id")
    ids = t["id"].to_numpy()
    e = _table(e_path, ["x", "y"])
    x, y = np.searchsorted(ids, e["x"].to_numpy()), np.searchsorted(ids, e["y"].to_numpy())
    u, v = np.concatenate([x, y]), np.concatenate([y, x])
    order = np.argsort(u, kind="stable")
    return np.concatenate([[0], np.cumsum(np.bincount(u, minlength=len(ids)))]), v[order], t["node"].combine_chunks(), ids


def components(x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """Each node's component: its least node."""
    root = np.arange(n)
    while True:
        a, b = root[x], root[y]
        apart = a != b
        if not apart.any():
            return root
        x, y, a, b = x[apart], y[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (up := root[root]).tobytes() != root.tobytes():
            root = up


def neighbours(rows: np.ndarray, near: np.ndarray, first: np.ndarray, degree: np.ndarray) -> np.ndarray:
    """Those of all the rows, row by row."""
    size = degree[rows]
    ends = np.cumsum(size)
    return near[np.arange(ends[-1]) + np.repeat(first[rows] - ends + size, size)]


def outward(near: np.ndarray, first: np.ndarray, degree: np.ndarray, component: np.ndarray) -> np.ndarray:
    """Each node's place when every component is walked breadth-first from its node of highest degree."""
    by, at, done = np.lexsort((-degree, component)), np.full(len(degree), -1), 0
    front = by[np.unique(component[by], return_index=True)[1]]
    while len(front):
        at[front] = done + np.arange(len(front))
        done += len(front)
        v = neighbours(front, near, first, degree)
        v = v[at[v] < 0]
        front = v[np.sort(np.unique(v, return_index=True)[1])]
    return at


class Part:
    """Components of about one size, without leaves, laid out for breadth-first searches from words of 64 sources, a bit each.

    Components don't meet, so their sources share bits. All sources of a block of words have equally many leaves. A look at a
    neighbour costs a miss of the cache for one word as for many, so a block has many, if that leaves ``tasks`` enough to do.
    Rows and sources are in breadth-first order: neighbours are looked up more or less in turn, and the sources of a block are
    about equally far from most rows, so that a row changes at few levels."""

    def __init__(self, x: np.ndarray, y: np.ndarray, component: np.ndarray, leaves: np.ndarray, tasks: int):
        u, v, n = np.concatenate([x, y]), np.concatenate([y, x]), len(component)
        degree = np.bincount(u, minlength=n)
        power = 1 << np.maximum(np.frexp(degree - 1)[1] - 1, 0)  # widths 1 to 4, 6, 8, 12, 16, ...: few, so that rows of one width are many
        width = np.where(degree <= 4, degree, np.where(degree <= power + power // 2, power + power // 2, 2 * power))
        order = np.argsort(u, kind="stable")
        at = outward(v[order], np.cumsum(degree) - degree, degree, component)
        self.node = np.lexsort((at, width))
        place = np.empty(n, np.int64)
        place[self.node] = np.arange(n)
        self.near, self.degree, width = place[v[np.argsort(place[u], kind="stable")]], degree[self.node], width[self.node]
        self.first = np.cumsum(self.degree) - self.degree
        self.chunks, a = [], 0  # (first row, last, neighbours of each: those of nodes of lower degree come again, which does no harm)
        while a < n:
            b = min(a + max(1, ROOM // width[a]), int(np.searchsorted(width, width[a], "right")))
            self.chunks.append((a, b, self.near[self.first[a:b] + np.arange(width[a])[:, None] % self.degree[a:b]]))
            a = b
        self.bounds = [a for a, _, _ in self.chunks] + [n]
        self.component, self.arcs = np.unique(component[self.node], return_inverse=True)[1], len(u)

        weight = leaves[self.node]
        order = np.lexsort((at[self.node], self.component, weight))
        w, c = weight[order], self.component[order]
        starts = np.flatnonzero(np.concatenate([[True], (w[1:] != w[:-1]) | (c[1:] != c[:-1])]))
        sizes = np.diff(np.append(starts, n))
        kinds, kind = np.unique(w, return_inverse=True)
        most = np.zeros(len(kinds), np.int64)
        np.maximum.at(most, kind[starts], sizes)
        words = -(-most // 64)
        slot = (np.cumsum(words) - words)[kind] * 64 + np.arange(n) - np.repeat(starts, sizes)
        by = np.argsort(slot, kind="stable")
        self.rows, self.word, self.bits = order[by], slot[by] // 64, np.uint64(1) << (slot[by] % 64).astype(np.uint64)
        step, ends = max(1, min(MOST, TABLE // n, int(words.sum()) // (4 * tasks))), np.cumsum(words)
        self.blocks = [(k, min(int(end), k + step), int(w)) for w, size, end in zip(kinds, words, ends) for k in range(int(end - size), int(end), step)]  # (first word, last, leaves)

    def search(self, begin: int, end: int):
        """From the sources of words begin..end-1, per level d = 1, 2, ...: (rows or all, how many are d away from each of them).

        Rows are looked up where few are active or few have sources to come, else all are gone through."""
        n, (a, b) = len(self.component), np.searchsorted(self.word, [begin, end])
        active, word, bits = self.rows[a:b], self.word[a:b] - begin, self.bits[a:b]
        own = np.zeros((int(self.component.max()) + 1, end - begin), np.uint64)
        np.bitwise_or.at(own, (self.component[active], word), bits)
        rest, todo = own[self.component], np.bitwise_count(own).sum(axis=1, dtype=np.int32)[self.component]  # sources that have yet to reach the row
        front, new, mark = np.zeros((n, end - begin), np.uint64), np.zeros((n, end - begin), np.uint64), np.zeros(n, bool)
        front[active, word] = bits
        rest[active, word] ^= bits
        todo[active] -= 1
        left, late, old, older = np.count_nonzero(todo), None, active, active  # late: the rows that have sources to come, when they are few; old: rows that front has, all if None
        while left:
            some = None
            if late is not None and (active is None or len(late) < 4 * len(active)):
                some = late = late[todo[late] > 0]
            elif active is not None:
                mark[neighbours(active, self.near, self.first, self.degree)] = True
                some = np.flatnonzero(mark)
                mark[some] = False
                some = some[todo[some] > 0]
            if some is None or len(some) > 3 * n // 4:
                some, count = None, np.empty(n, np.uint16)
                for a, b, near in self.chunks:
                    got = np.bitwise_or.reduce(front.take(near, axis=0, mode="clip"), axis=0, out=new[a:b])
                    got &= rest[a:b]
                    rest[a:b] ^= got
                    count[a:b] = np.bitwise_count(got).sum(axis=1, dtype=np.uint16)
                todo -= count
                yield slice(None), count
                left, active = np.count_nonzero(todo), np.flatnonzero(count)
            else:
                new[slice(None) if older is None else older] = 0
                count, cuts = np.empty(len(some), np.uint16), np.searchsorted(some, self.bounds)
                for (first, _, near), a, b in zip(self.chunks, cuts, cuts[1:]):
                    if a < b:
                        rows = some[a:b]
                        was = rest[rows]
                        got = np.bitwise_or.reduce(front.take(near[:, rows - first], axis=0, mode="clip"), axis=0)
                        got &= was
                        new[rows], rest[rows] = got, was ^ got
                        count[a:b] = np.bitwise_count(got).sum(axis=1, dtype=np.uint16)
                todo[some] -= count
                yield some, count
                left -= np.count_nonzero(todo[some] == 0)
                active = some[count > 0]
            active = active if len(active) < n // 2 else None
            if late is None and left < n // 2:
                late = np.flatnonzero(todo)
            front, new, old, older = new, front, some, old


class Sums:
    """Per row, over the sources and their leaves: of 1/d, of 1/(d + 1), as the row's own leaves have it, and of d."""

    def __init__(self, n: int):
        self.near, self.far, self.total, self.counts, self.weight = np.zeros(n), np.zeros(n), np.zeros(n, np.int64), [], 0

    def _sum(self, d: int, rows, count: np.ndarray) -> None:
        w, count = self.weight, count.astype(np.int64)
        self.near[rows] += count * (1 / d + w / (d + 1))
        self.far[rows] += count * (1 / (d + 1) + w / (d + 2))
        self.total[rows] += count * (d + w * (d + 1))

    def settle(self, weight: int = 0) -> None:
        if weight != self.weight:
            for d, count in enumerate(self.counts, 1):
                self._sum(d, slice(None), count)
            self.counts, self.weight = [], weight

    def add(self, weight: int, found) -> None:
        self.settle(weight)
        for d, (rows, count) in enumerate(found, 1):
            if d > LEVELS:
                self._sum(d, rows, count)
                continue
            if d > len(self.counts):
                self.counts.append(np.zeros(len(self.near), np.uint32))
            self.counts[d - 1][rows] += count


def reached(x: np.ndarray, y: np.ndarray, n: int, share: int, of: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What a share of the sources adds to each node's sum of 1/d, count and sum of d over all nodes that it reaches.

    Leaves (nodes of degree 1) are neither searched from nor searched: theirs are the distances of their one neighbour, and 1."""
    degree = np.bincount(np.concatenate([x, y]), minlength=n)
    ends = degree[np.concatenate([x, y])] == 1
    leaf, parent = np.concatenate([x, y])[ends], np.concatenate([y, x])[ends]
    keep = (degree[parent] > 1) | (parent < leaf)
    leaf, parent = leaf[keep], parent[keep]
    leaves = np.bincount(parent, minlength=n)
    component = components(x, y, n)
    inner = np.ones(n, bool)
    inner[leaf] = False
    h, far, count, total = np.zeros(n), np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64)

    core = inner[x] & inner[y]
    x, y = x[core], y[core]
    size = np.bincount(component, minlength=n)
    group, used = np.frexp(size[component])[1], np.zeros(n, bool)
    used[x] = used[y] = True
    parts = []
    for g in np.unique(group[used]):
        nodes = np.flatnonzero(used & (group == g))
        e = group[x] == g
        p = Part(np.searchsorted(nodes, x[e]), np.searchsorted(nodes, y[e]), component[nodes], leaves[nodes], of)
        parts.append((nodes[p.node], p))
    cost = np.cumsum([p.arcs * (8 + end - begin) for _, p in parts for begin, end, _ in p.blocks])  # about
    mine = iter((np.append(0, cost[:-1]) * of // cost[-1] == share).tolist() if len(cost) else [])
    for nodes, p in parts:
        blocks = [k for k in p.blocks if next(mine)]
        if blocks:
            sums = Sums(len(nodes))
            for begin, end, weight in blocks:
                sums.add(weight, p.search(begin, end))
            sums.settle(-1)
            h[nodes], far[nodes], total[nodes] = sums.near, sums.far, sums.total
    if share == 0:  # what needs no search: a node's own leaves, and itself for them
        count = size[component] - 1
        h += leaves
        far += 1 + leaves / 2
        total += leaves
    h[leaf], total[leaf] = far[parent], total[parent] + count[parent]
    if share == 0:
        h[leaf] -= 0.5
        total[leaf] -= 1
    return h, count, total


def levels(indptr: np.ndarray, indices: np.ndarray, source: int) -> tuple[np.ndarray, list]:
    """Each node's distance from the source (-1: none), and per level the arcs that lead into it."""
    d, into, front = np.full(len(indptr) - 1, -1, np.int32), [], np.array([source])
    d[source] = 0
    while True:
        size = indptr[front + 1] - indptr[front]
        u = np.repeat(front, size)
        v = indices[np.arange(len(u)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(indptr[front], size)]
        new = d[v] < 0
        u, v = u[new], v[new]
        if not len(v):
            return d, into
        d[v] = len(into) + 1
        into.append((u, v))
        front = np.unique(v)


def dependencies(indptr: np.ndarray, indices: np.ndarray, source: int) -> np.ndarray:
    """Brandes: the share of the source's shortest paths that pass each node."""
    _, into = levels(indptr, indices, source)
    sigma, delta = np.zeros(len(indptr) - 1), np.zeros(len(indptr) - 1)
    sigma[source] = 1.0
    for u, v in into:
        np.add.at(sigma, v, sigma[u])
    for u, v in reversed(into):
        np.add.at(delta, u, sigma[u] / sigma[v] * (1 + delta[v]))
    delta[source] = 0.0
    return delta


class Graph:
    """A graph laid out for the kernels: numbered once and written to the shared folder."""

    def __init__(self, g: DataFrame):
        g = materialize(g, "g")
        self.g, self.spark = g, g.sparkSession
        self.ids = materialize(arcs(g).select(F.col("u").alias("node")).distinct().select("node", F.monotonically_increasing_id().alias("id")), "ids")
        e = materialize(g.join(self.ids.toDF("a", "x"), "a").join(self.ids.toDF("b", "y"), "b").select("x", "y"), "e")
        self.paths, self.n = (e._engrava_path, self.ids._engrava_path), self.ids.count()
        self.kind = self.ids.schema["node"].dataType.simpleString()

    def sources(self) -> DataFrame:
        """The ids that betweenness and distances start from."""
        return self.ids.select("id") if self.n <= EXACT else landmarks(self.g, SOURCES).join(self.ids, "node").select("id")

    def _run(self, sources: DataFrame, kernel, schema: str) -> DataFrame:
        paths = self.paths

        def run(batches):
            mine = [s for b in batches for s in b.column(0).to_pylist()]
            if mine:
                yield from kernel(mine, *_graph(*paths))

        return sources.repartition(2 * self.spark.sparkContext.defaultParallelism).mapInArrow(run, schema)

    def reach(self) -> DataFrame:
        """(node, harmonic, n, total) of every node: the sum of 1/d, the count and the sum of d over all nodes it reaches."""
        path, of = self.paths[0], max(1, min(-(-self.n // (64 * WORDS)), 2 * self.spark.sparkContext.defaultParallelism))

        def run(batches):
            for share in [s for b in batches for s in b.column(0).to_pylist()]:
                e = _table(path, ["x", "y"])
                ids, ends = np.unique(np.concatenate([e["x"].to_numpy(), e["y"].to_numpy()]), return_inverse=True)
                h, n, total = reached(ends[: len(e)], ends[len(e) :], len(ids), share, of)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(h), pa.array(n), pa.array(total)], names=["id", "harmonic", "n", "total"])

        parts = self.spark.range(0, of, 1, of).mapInArrow(run, "id long, harmonic double, n long, total long")
        return parts.groupBy("id").agg(*[F.sum(c).alias(c) for c in ("harmonic", "n", "total")]).join(self.ids, "id").select("node", "harmonic", "n", "total")

    def distances(self) -> DataFrame:
        """(source, node, d) from each source to all nodes it reaches."""

        def kernel(sources, indptr, indices, names, ids):
            for s in np.searchsorted(ids, np.array(sources)):
                d, _ = levels(indptr, indices, s)
                to = np.flatnonzero(d >= 0)
                yield pa.RecordBatch.from_arrays([names.take(pa.array(np.full(len(to), s))), names.take(pa.array(to)), pa.array(d[to])], names=["source", "node", "d"])

        return self._run(self.sources(), kernel, f"source {self.kind}, node {self.kind}, d int")

    def betweenness(self) -> DataFrame:
        """(node, score) of every node, scaled to all sources and to pairs of other nodes."""
        sources = self.sources()
        scale = self.n / max(1, min(self.n, sources.count())) / max(1, (self.n - 1) * (self.n - 2))

        def kernel(sources, indptr, indices, names, ids):
            total = np.zeros(len(ids))
            for s in np.searchsorted(ids, np.array(sources)):
                total += dependencies(indptr, indices, s)
            yield pa.RecordBatch.from_arrays([names, pa.array(total * scale)], names=["node", "score"])

        return self._run(sources, kernel, f"node {self.kind}, score double").groupBy("node").agg(F.sum("score").alias("score"))
