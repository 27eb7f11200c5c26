"""Clusters of mutually similar records: sign sets, exact Jaccard of all pairs, components, medoids - then mean directions."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from engrava.llm.kit import batch_of, deal, hot_blocks, mix, spread, vectors
from engrava.llm.similar import _near_codes, unit, usable
from engrava.operators.components import connected_components, forest
from engrava.operators.skew import lookup_join
from engrava.storage import discard, materialize, scratch

#: Hyperplanes; a vector's set holds one of two tokens for each, so two sets at an angle t have
#: Jaccard (1 - t/pi) / (1 + t/pi).
PLANES = 256
BANDS = 8
#: A band has one MinHash more for each growth of the table by this factor, two at FEW rows: so that the links of a
#: record stay few. (Of pairs at LINK or a little more, each further MinHash leaves 65 %.)
GROWTH, FEW = 1.7, 5_000
#: Jaccard from which two sets are linked: an angle of 42 degrees, five standard deviations from unrelated vectors.
LINK = 0.62
#: A component is loose if a member is less similar than this to its medoid.
LOOSE = 0.41
#: Entries of a bucket from which they are dealt to pairs of blocks; one id in PROBE is looked at to find such buckets.
BLOCK, PROBE = 4_000, 32
#: Bits in which two codes differ at a Jaccard of LINK.
MOST = math.floor(PLANES * (1 - LINK) / (1 + LINK) + 1e-9)
#: All pairs: the table is dealt to at most SIDES blocks of FEWEST rows or more, or to more so that none has many over
#: LARGEST rows; codes compared at once (TILE pairs, about, where few columns are left); and links handed on together.
SIDES, FEWEST, LARGEST = 11, 4_096, 1 << 20
TALL, WIDE, TILE, HANDED, BUFFER = 16, 4_096, 1 << 14, 1 << 16, 256
#: Groups that codes are told apart by, at most; bits from all other centres from which a code founds one; codes looked at
#: and rounds to find them; and codes whose pairs are tried, of which less than a share must be left for groups to be used.
GROUPS, FAR, FITTED, ROUNDS, TRIED, WORTH = 64, 110, 2_048, 2, 256, 0.3
#: Groups that the driver looks at together for the directions of clusters, and groups summed up in a task at once.
HEADS, HELD = 256, 20_000


def _planes(width: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((width, PLANES))


def band_rows(n: int) -> int:
    """MinHashes of a band."""
    return max(2, round(2 + math.log(max(n, 1) / FEW) / math.log(GROWTH)))


def _band_tokens(bits: np.ndarray, seed: int, rows: int) -> np.ndarray:
    """MinHash band keys. A hash orders all 2 * PLANES tokens at random; its minimum is the first that the set has."""
    rng, n = np.random.default_rng(seed), len(bits)
    keys = np.zeros((n, BANDS), np.uint64)
    for band in range(BANDS):
        acc = np.full(n, band + 1, np.uint64)
        for _ in range(rows):
            order = rng.permutation(2 * PLANES)
            plane, sign, first = order % PLANES, order >= PLANES, np.full(n, -1)
            at, todo = 0, np.arange(n)
            while len(todo):
                look = slice(at, at + 16)
                hit = bits[todo][:, plane[look]] == sign[look]
                has = hit.any(axis=1)
                first[todo[has]] = at + hit[has].argmax(axis=1)
                todo, at = todo[~has], at + 16
            with np.errstate(over="ignore"):
                acc = mix((acc + mix(first, 51)).view(np.int64), 52)
        keys[:, band] = acc
    return keys


def _codes(batches, width: int, seed: int):
    planes = _planes(width, seed)
    for b in batches:
        if b.num_rows:
            bits = vectors(b.column(1), width) @ planes >= 0
            code = np.packbits(bits, axis=1, bitorder="little").view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(code[:, i]) for i in range(4)]], names=["id", "c0", "c1", "c2", "c3"])


def _buckets(batches, seed: int, rows: int, hot: dict[int, int]):
    for b in batches:
        if not b.num_rows:
            continue
        ids = b.column(0).to_numpy()
        code = np.stack([b.column(i).to_numpy() for i in range(1, 5)], axis=1)
        bits = np.unpackbits(np.ascontiguousarray(code).view(np.uint8), axis=1, bitorder="little").astype(bool)
        key = _band_tokens(bits, seed + 1, rows).view(np.int64).ravel()
        key, row, side = deal(key, np.arange(len(key)), np.repeat(ids, BANDS), hot)
        row //= BANDS
        yield batch_of(key=key, tail=np.zeros(len(key), np.int32), id=ids[row], side=side.astype(np.int8), **{f"c{i}": code[row, i] for i in range(4)})


def _apart(x: str, y: str):
    """Bits in which two codes differ, of columns x0..x3 and y0..y3."""
    parts = [F.bit_count(F.col(f"{x}{i}").bitwiseXOR(F.col(f"{y}{i}"))) for i in range(4)]
    return parts[0] + parts[1] + parts[2] + parts[3]


def jaccard(apart):
    """Of two sets with one token for each plane that differ in so many planes."""
    return (PLANES - apart) / (PLANES + apart)


def _rows(code: list[np.ndarray], at) -> np.ndarray:
    """Codes at indices or a slice, a row of four words each."""
    return np.stack([w[at] for w in code], axis=1)


def _differ(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits in which each code of a (rows of four words) differs from each of b."""
    return sum(np.bitwise_count(a[:, w, None] ^ b[None, :, w]).astype(np.int16) for w in range(4))


def _majority(bits: np.ndarray) -> np.ndarray:
    return np.packbits(bits, axis=-1, bitorder="little").view(np.uint64)


def _pivots(code: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(centres, pivots) from a sample of the codes: majority codes of groups, and of each two groups g, h a code that is
    near to those of g and far from those of h; that of h, g is its complement. One group if they would rule out too little."""
    n = len(code[0])
    s = _rows(code, slice(None, None, max(1, n // FITTED)))
    at, far = [0], _differ(s, s[:1])[:, 0]
    while len(at) < min(GROUPS, math.isqrt(n) // 4) and far.max() > FAR:
        at.append(int(far.argmax()))
        far = np.minimum(far, _differ(s, s[at[-1:]])[:, 0])
    centres, k = s[at], len(at)
    bits = np.unpackbits(s.view(np.uint8), axis=1, bitorder="little").astype(np.float32)
    for _ in range(ROUNDS):
        member = (_differ(s, centres).argmin(axis=1) == np.arange(k)[:, None]).astype(np.float32)
        mean = member @ bits / np.maximum(member.sum(axis=1), 1)[:, None]
        centres = _majority(mean >= 0.5)
    g, h = np.triu_indices(k, 1)
    pivots = np.zeros((k, k, 4), np.uint64)
    pivots[g, h] = _majority(mean[g] > mean[h])
    pivots[h, g] = ~pivots[g, h]
    few = s[:: max(1, len(s) // TRIED)]
    own = _differ(few, centres).argmin(axis=1)
    x = np.bitwise_count(pivots[own] ^ few[:, None]).sum(axis=2, dtype=np.int16)[:, own]
    worth = ((own[:, None] == own) | (x + x.T >= PLANES - MOST)).mean() < WORTH
    return (centres, pivots) if worth else (centres[:1], pivots[:1, :1])


def _meeting(code: list[np.ndarray], cut: int):
    """(rows, columns, upto), together all pairs that ``_hits`` asks for but those that a pivot tells apart: the i-th row is
    to be compared with the columns before upto[i], which never rises, or with all if upto is None. Where rows are the
    columns, each pair counts once.

    Codes that differ in at most MOST bits differ from any third code in numbers of bits that are at most MOST apart. So
    x of group g and y of group h can be a pair only if x's bits from the pivot of g, h and y's from its complement are
    together PLANES - MOST or more. Whatever the groups and pivots are, no pair is lost."""
    centres, pivots = _pivots(code)
    near = np.concatenate([_differ(_rows(code, slice(i, i + WIDE)), centres).argmin(axis=1) for i in range(0, len(code[0]), WIDE)])
    groups, need = range(len(centres)), PLANES - MOST
    above = [np.flatnonzero(near[: cut or len(near)] == g) for g in groups]
    below = [cut + np.flatnonzero(near[cut:] == g) for g in groups] if cut else above
    for g in groups:
        for h in groups if cut else groups[g:]:
            rows, columns = above[g], below[h]
            if not len(rows) or not len(columns):
                continue
            if g == h:
                yield rows, columns, None
                continue
            x, y = _differ(_rows(code, rows), pivots[g, h, None])[:, 0], _differ(_rows(code, columns), pivots[h, g, None])[:, 0]
            i, j = np.flatnonzero(x >= need - y.max()), np.flatnonzero(y >= need - x.max())
            if len(i):
                i, j = i[np.argsort(-x[i], kind="stable")], j[np.argsort(-y[j], kind="stable")]
                yield rows[i], columns[j], np.searchsorted(-y[j], x[i] - need, "right")


def _close(x: list[np.ndarray], y: list[np.ndarray], room: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of codes of x and of y (their four words) that differ in at most MOST bits; room: buffers for all pairs."""
    tall, wide = len(x[0]), len(y[0])
    if tall > wide:  # long rows are faster
        return _close(y, x, room)[::-1]
    n = tall * wide
    xs, ds, es = (buffer[:n].reshape(tall, wide) for buffer in room[:3])
    before = np.setbufsize(BUFFER)  # at the usual size rows shorter than it are copied first
    for w in range(4):
        np.bitwise_xor(x[w][:, None], y[w][None, :], out=xs)
        np.bitwise_count(xs, out=es if w else ds)
        if w:
            np.add(ds, es, out=ds)
    np.setbufsize(before)
    ok = room[3][: -(-n // 8) * 8]
    np.less_equal(room[1][:n], MOST, out=ok[:n])
    ok[n:] = False
    eight = np.flatnonzero(ok.view(np.uint64))  # nearly all pairs end here
    at = (eight[:, None] * 8 + np.arange(8))[ok.reshape(-1, 8)[eight]]
    i, j = at // wide, at % wide
    real = np.bitwise_count(x[0][i] ^ y[0][j]) <= MOST  # 256 bits are 0 in a byte
    return i[real], j[real]


def _hits(code: list[np.ndarray], cut: int):
    """Index pairs of codes (their four words) that differ in at most MOST bits, about HANDED at a time: of rows before
    ``cut`` with rows from it on; all pairs, each once, if cut is 0."""
    held, have = [], 0
    room = [np.empty(TALL * WIDE, kind) for kind in (np.uint64, np.uint8, np.uint8, bool)]
    for rows, columns, upto in _meeting(code, cut):
        x, y = [w[rows] for w in code], [w[columns] for w in code]
        i = 0
        while i < len(rows) and (most := len(columns) if upto is None else int(upto[i])):
            tall = max(TALL, TILE // most)
            for j in range(0, most, WIDE):
                a, b = _close([w[i : i + tall] for w in x], [w[j : min(j + WIDE, most)] for w in y], room)
                a, b = a + i, b + j
                if rows is columns:
                    a, b = a[a < b], b[a < b]
                if len(a):
                    held.append((rows[a], columns[b]))
                    have += len(a)
                if have >= HANDED:
                    yield tuple(np.concatenate(z) for z in zip(*held, strict=True))
                    held, have = [], 0
            i += tall
    if have:
        yield tuple(np.concatenate(z) for z in zip(*held, strict=True))


def _met(t: pa.Table):
    """(rows in order of block, their ids, links as index pairs) of a table (p, q, side, id, c0..c3, ...) of two blocks."""
    t = t.combine_chunks()
    p, q, side = t.column("p")[0].as_py(), t.column("q")[0].as_py(), t.column("side").to_numpy()
    order = np.argsort(side, kind="stable")
    ids = t.column("id").to_numpy()[order]
    code = [np.ascontiguousarray(t.column(f"c{w}").to_numpy()[order]).view(np.uint64) for w in range(4)]
    cut = 0 if p == q else int((side == p).sum())
    links = _hits(code, cut) if p == q or 0 < cut < len(ids) else iter(())
    return order, ids, ((i[other], j[other]) for i, j in links for other in [ids[i] != ids[j]])


def _listed(t: pa.Table) -> pa.Table:
    """(a, b) of every link."""
    _, ids, links = _met(t)
    found = [(np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])) for i, j in links]
    a, b = (np.concatenate(z) for z in zip(*found, strict=True)) if found else (np.empty(0, np.int64), np.empty(0, np.int64))
    return pa.table({"a": a, "b": b})


def _stars(t: pa.Table) -> pa.Table:
    """(id, root, n) of every id that has links here: how many, and an id that they join it to, one of all it is joined to."""
    _, ids, links = _met(t)
    n, root = np.zeros(len(ids), np.int64), np.arange(len(ids))
    for i, j in links:
        n += np.bincount(i, minlength=len(ids)) + np.bincount(j, minlength=len(ids))
        apart = root[i] != root[j]
        if apart.any():
            nodes, low = forest(root[i[apart]], root[j[apart]])
            to = np.arange(len(ids))
            to[nodes] = low
            root = to[root]
    has = np.flatnonzero(n)
    return pa.table({"id": ids[has], "root": ids[root[has]], "n": n[has]})


def _highest(t: pa.Table) -> pa.Table:
    """(id, of_other, other) of every id that has links here: the one of highest degree that it is linked to, of equal ones
    the smallest, and that degree."""
    order, ids, links = _met(t)
    degree = t.column("degree").to_numpy()[order]
    ranked = np.lexsort((-ids, degree))
    rank, best = np.empty(len(ids), np.int64), np.full(len(ids), -1)
    rank[ranked] = np.arange(len(ids))
    for i, j in links:
        np.maximum.at(best, i, rank[j])
        np.maximum.at(best, j, rank[i])
    has = np.flatnonzero(best >= 0)
    top = ranked[best[has]]
    return pa.table({"id": ids[has], "of_other": degree[top], "other": ids[top]})


class MinHashClusters:
    """``wanted`` clusters of vectors by direction.

    1. Each vector is a set of 256 sign tokens. Two are linked if the exact Jaccard of their sets is ``LINK`` at least. Rows
       are dealt to blocks, and each pair of blocks is a task. All pairs are compared there but those that the triangle
       inequality rules out, so no link is missed; time still grows with the square of the rows. Links are summed up in
       the task and never listed.
    2. Links form connected components.
    3. A component is loose where a member is too far from its medoid, the id of highest degree. A loose one is split
       around its medoids - ids that are linked to none of higher degree: each id follows its links to ever higher
       degrees (equal ones: to the smaller id) until it ends at one. Ids too far from where they end are split again
       among themselves.
    4. From the largest group down, a group whose mean direction is not within ``belongs`` of an earlier one's founds a
       cluster, until there are as many as wanted; every group joins the nearest such direction, if within ``belongs``. A
       cluster's mean direction is that of the members of its groups. Each record, in a group or not, belongs to the
       nearest mean direction by cosine, ``belongs`` at least.

    No link, component or group is left out; the driver sees the founding groups, HEADS at a time, and one
    mean direction a cluster. Only usable vectors count (``width`` finite values, not all zero); others are in no cluster.
    Null ids take no part; an id is expected once. ``links`` are those that 8 MinHash bands find, a part of
    ``links_whole``; the clusters don't rest on them. Fewer groups than wanted: fewer clusters. Empty table: none.
    """

    def __init__(self, table: DataFrame, key: str, vector: str, wanted: int, width: int = 64, belongs: float = 0.5, seed: int = 17, extra: list[str] | None = None, block: int = BLOCK):
        self.width, self.wanted, self.belongs, self.seed, self.block = width, wanted, belongs, seed, block
        self.rows = table.where(F.col(key).isNotNull() & usable(vector, width)).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<float>").alias("v"), *(extra or []))
        self.spark = table.sparkSession

    def _coded(self) -> None:
        width, seed = self.width, self.seed
        self.codes = materialize(self.rows.select("id", "v").mapInArrow(lambda it: _codes(it, width, seed), "id long, c0 long, c1 long, c2 long, c3 long"), "codes")

    def _compared(self, nodes: DataFrame, read, schema: str) -> DataFrame:
        """What ``read`` makes of the links between nodes (id, c0..c3, more), a table of two blocks at a time."""
        n = nodes.count()
        blocks = max(1, min(SIDES, n // FEWEST), -(-n // LARGEST))
        r = nodes.withColumn("side", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        return r.select(F.least("side", "o").alias("p"), F.greatest("side", "o").alias("q"), "side", *nodes.columns).groupBy("p", "q").applyInArrow(read, schema)

    def links_whole(self) -> DataFrame:
        """(a, b), a < b: all pairs that are similar enough."""
        self._coded()
        return self._compared(self.codes, _listed, "a long, b long").distinct()

    def links(self) -> DataFrame:
        """(a, b), a < b: pairs that share a bucket and are similar enough: a part of ``links_whole``."""
        self._coded()
        seed, n = self.seed, self.codes.count()
        each = band_rows(n)
        schema = "key long, tail int, id long, side byte, c0 long, c1 long, c2 long, c3 long"
        probe = self.codes.where(F.pmod(F.xxhash64("id"), F.lit(PROBE)) == 0).mapInArrow(lambda it: _buckets(it, seed, each, {}), schema)
        hot = hot_blocks(probe, PROBE, self.block)
        index = self.codes.mapInArrow(lambda it: _buckets(it, seed, each, hot), schema)
        return spread(index, n * BANDS).sortWithinPartitions("key").mapInArrow(lambda it: _near_codes(it, MOST, 64, []), "a long, b long").distinct()

    def groups(self) -> DataFrame:
        """(id, grp): the components of every linked id, loose ones split around medoids."""
        self._coded()
        stars = materialize(self._compared(self.codes, _stars, "id long, root long, n long"), "stars")
        comp = connected_components(stars, "id", "root").toDF("id", "comp")
        degree = stars.groupBy("id").agg(F.sum("n").alias("degree"))
        ranked = materialize(comp.join(degree, "id").join(self.codes, "id"), "ranked")
        medoid = ranked.groupBy("comp").agg(F.max(F.struct("degree", (-F.col("id")).alias("i"), "c0", "c1", "c2", "c3")).alias("m")).select("comp", *[F.col(f"m.c{i}").alias(f"m{i}") for i in range(4)])
        loose = lookup_join(ranked, medoid, ["comp"], "inner").where(jaccard(_apart("c", "m")) < LOOSE).select("comp").distinct().withColumn("loose", F.lit(True))
        placed = materialize(lookup_join(ranked.select("id", "comp", "degree"), loose, ["comp"], "left"), "placed")
        done, todo = [placed.where("loose is null").select("id", F.col("comp").alias("grp"))], placed.where("loose").select("id", "degree")
        while todo.limit(1).count():
            if "degree" not in todo.columns:
                nodes = materialize(todo.join(self.codes, "id"), "nodes")
                degree = self._compared(nodes, _stars, "id long, root long, n long").groupBy("id").agg(F.sum("n").alias("degree"))
                todo = materialize(todo.join(degree, "id", "left"), "todo")
            top = lookup_join(self._tops(todo).join(self.codes, "id"), self.codes.toDF("grp", "m0", "m1", "m2", "m3"), ["grp"], "inner")
            judged = materialize(top.select("id", "grp", (jaccard(_apart("c", "m")) >= LOOSE).alias("fits")), "judged")
            done.append(judged.where("fits").select("id", "grp"))
            todo = judged.where("not fits").select("id")
        return reduce(DataFrame.union, done)

    def _tops(self, ids: DataFrame) -> DataFrame:
        """(id, grp): the medoid at which each of ids (id, degree among them) ends that follows its links to ever higher
        degrees; itself if it has none."""
        nodes = materialize(ids.where("degree is not null").join(self.codes, "id").select("id", "c0", "c1", "c2", "c3", "degree"), "nodes")
        above = self._compared(nodes, _highest, "id long, of_other long, other long").groupBy("id").agg(F.max(F.struct("of_other", (-F.col("other")).alias("i"))).alias("m"))
        higher = F.struct(F.col("m.of_other"), F.col("m.i")) > F.struct(F.col("degree"), -F.col("id"))
        up = materialize(ids.join(above, "id", "left").select("id", F.when(higher, -F.col("m.i")).otherwise(F.col("id")).alias("up")), "up")
        while True:
            further = materialize(lookup_join(up, up.toDF("up", "next"), ["up"], "inner").select("id", F.col("next").alias("up"), (F.col("next") != F.col("up")).alias("moved")), "up")
            discard(up)
            up, moved = further.select("id", "up"), further.where("moved").limit(1).count()
            if not moved:
                return up.toDF("id", "grp")

    def _sums(self, labelled: DataFrame) -> DataFrame:
        """(grp, n, s): number and sum of the unit vectors v, weighted by n, of each grp; partial sums in Arrow first."""
        width = self.width

        def sums(batches):
            total: dict[int, np.ndarray] = {}
            for b in batches:
                if not b.num_rows:
                    continue
                names, inv = np.unique(b.column(0).to_numpy(), return_inverse=True)
                s = np.zeros((len(names), width + 1))
                np.add.at(s, inv, np.concatenate([b.column(1).to_numpy()[:, None], vectors(b.column(2), width)], axis=1))
                for n, row in zip(names.tolist(), s):
                    total[n] = total[n] + row if n in total else row
                if len(total) > HELD:
                    yield out(total)
                    total = {}
            if total:
                yield out(total)

        def out(total):
            m = np.stack(list(total.values()))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * width), pa.array(m[:, 1:].ravel()))
            return pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(m[:, 0].astype(np.int64)), flat], names=["grp", "n", "s"])

        parts = labelled.mapInArrow(sums, "grp long, n long, s array<double>")
        return parts.groupBy("grp").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("s")[i]) for i in range(width)]).alias("s"))

    def directions(self) -> np.ndarray:
        """The clusters' mean directions, largest cluster first."""
        if getattr(self, "_found", None) is not None:
            return self._found
        with scratch(self.spark):
            self._found = self._directions()
        return self._found

    def _directions(self) -> np.ndarray:
        width, belongs = self.width, self.belongs

        def units(batches):
            for b in batches:
                if b.num_rows:
                    u = unit(vectors(b.column(1), width))
                    flat = pa.ListArray.from_arrays(pa.array(np.arange(len(u) + 1, dtype=np.int32) * width), pa.array(u.ravel()))
                    yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.ones(len(u), np.int64)), flat], names=["grp", "n", "v"])

        grouped = self.groups().join(self.rows.select("id", "v"), "id").select("grp", "v")
        means = materialize(self._sums(grouped.mapInArrow(units, "grp long, n long, v array<double>")), "means")
        founders = np.empty((0, width))
        while len(founders) < self.wanted:
            head = means.mapInArrow(_towards(founders, width, belongs, False), "cluster long, grp long, n long, s array<double>").orderBy(F.desc("n"), "grp").limit(HEADS).collect()
            if not head:
                break
            for r in head:
                d = unit(np.array([r.s]))
                if len(founders) < self.wanted and not (founders @ d[0] >= belongs).any():
                    founders = np.concatenate([founders, d])
        joined = means.mapInArrow(_towards(founders, width, belongs, True), "cluster long, grp long, n long, s array<double>")
        found = sorted(self._sums(joined.select("cluster", "n", "s")).collect(), key=lambda r: (-r.n, r.grp))
        return unit(np.array([r.s for r in found]).reshape(-1, width))

    def assigned(self, means: np.ndarray | None = None) -> DataFrame:
        """rows with cluster (from 0) and cos, for the records that belong to one."""
        means = self.directions() if means is None else means
        width, belongs = self.width, self.belongs

        def nearest(batches):
            for b in batches:
                if not b.num_rows:
                    continue
                cos = unit(vectors(b.column(1), width)) @ means.T if len(means) else np.full((b.num_rows, 1), -1.0)
                best = cos.argmax(axis=1)
                top = cos[np.arange(len(best)), best]
                t = pa.RecordBatch.from_arrays([*b.columns, pa.array(best.astype(np.int32)), pa.array(top)], names=[*b.schema.names, "cluster", "cos"])
                yield t.filter(pa.array(top >= belongs))

        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.rows.schema.fields)
        return self.rows.mapInArrow(nearest, f"{kinds}, cluster int, cos double")

    def described(self, typical: int = 5) -> DataFrame:
        """(cluster, n_members, typical): size, and the ids nearest to the mean direction."""
        a = self.assigned().select("id", "cluster", "cos")
        top = a.withColumn("r", F.row_number().over(W.partitionBy("cluster").orderBy(F.desc("cos"), "id"))).where(F.col("r") <= typical)
        names = top.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "id"))), lambda x: x["id"]).alias("typical"))
        return a.groupBy("cluster").agg(F.count("*").alias("n_members")).join(names, "cluster")


def _towards(founders: np.ndarray, width: int, belongs: float, near: bool):
    """A function of (grp, n, s) batches: the groups within ``belongs`` of a founder, with the nearest's number; or the
    others. Groups whose vectors cancel out have no direction and are neither."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            s = vectors(b.column(2), width)
            size = np.linalg.norm(s, axis=1)
            cos = s / np.where(size > 0, size, 1)[:, None] @ founders.T if len(founders) else np.full((len(s), 1), -1.0)
            keep = ((cos.max(axis=1) >= belongs) == near) & (size > 0)
            t = pa.RecordBatch.from_arrays([pa.array(cos.argmax(axis=1)), *b.columns], names=["cluster", "grp", "n", "s"])
            yield t.filter(pa.array(keep))

    return run
