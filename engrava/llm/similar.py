"""Most similar vectors of every vector: multi-index hashing over learned rotated binary codes, floats reranked."""

from __future__ import annotations

import math
from itertools import chain, combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from engrava.llm.kit import batch_of, collected, deal, hot_blocks, mix, pairs_across, pairs_within, runs, spread, vectors, whole_groups
from engrava.operators.skew import lookup_join
from engrava.storage import materialize

#: Rows, about, that the rotations are fitted on: those whose id has a small hash.
SAMPLE = 20_000
ROUNDS = 12
#: Bits of a code that are compared; substrings may use more.
CODE = 192
#: Mean rows of a substring value, the most that meet by a prefix, and the cost of sending a row in units of comparing
#: it with the rows of one substring value.
LOAD, GROUP, SEND = 48, 1 << 13, 6
#: Probability with which two codes at the least cosine meet (bits taken as independent).
TARGET = 0.99
#: Rows of a key from which they are dealt to pairs of blocks, at least; one id in PROBE is looked at to find such keys.
BLOCK, PROBE = 1 << 14, 32
_POP = np.bitwise_count
_U = np.uint64


def usable(column: str, width: int):
    """True for vectors of ``width`` finite values that are not all zero."""
    v = F.col(column)
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return v.isNotNull() & (F.size(v) == width) & F.forall(v, fine) & F.exists(v, lambda x: x != 0)


def fit_codes(sample: np.ndarray, rotations: int = 3, rounds: int = ROUNDS, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """(mean, map): vectors minus mean, times map, have the signs that are the code's bits.

    The sample is whitened along its principal directions (shrunk, as the last ones are noise), then rotated so that
    its points lie near the corners of a cube: alternately take the signs and the best rotation towards them.
    """
    width = sample.shape[1]
    mean = sample.mean(axis=0) if len(sample) else np.zeros(width)
    x = sample - mean
    spread, axes = np.linalg.eigh(x.T @ x / max(1, len(x)) if len(x) else np.eye(width))
    spread = np.maximum(spread, 0) + max(float(np.median(spread)), 1e-12) * 0.1
    white = axes / np.sqrt(spread)
    y, out, rng = x @ white, [], np.random.default_rng(seed)
    for _ in range(rotations):
        r = np.linalg.qr(rng.standard_normal((width, width)))[0]
        for _ in range(rounds if len(y) >= width else 0):
            u, _, vt = np.linalg.svd(np.where(y @ r >= 0, 1.0, -1.0).T @ y)
            r = (u @ vt).T
        out.append(white @ r)
    return mean, np.concatenate(out, axis=1)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def signs(x: np.ndarray, mean: np.ndarray, to: np.ndarray) -> np.ndarray:
    return (x - mean) @ to >= 0


def _words64(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as rows of 64-bit words."""
    wide = np.zeros((len(bits), -(-bits.shape[1] // 64) * 64), bool)
    wide[:, : bits.shape[1]] = bits
    return np.packbits(wide, axis=1, bitorder="little").view(np.int64)


def _prints(batches, width: int):
    """(id, u, s1, s2): the vector in unit length as float32 bytes, and a 128-bit print of it."""
    for b in batches:
        if not b.num_rows:
            continue
        u = unit(vectors(b.column(1), width))
        raw = np.ascontiguousarray(u.astype(np.float32))
        half = raw.view(np.int64)  # two floats a word
        with np.errstate(over="ignore"):
            at = np.arange(half.shape[1])
            s1, s2 = (mix((half + mix(at, k).view(np.int64)), k + 1).sum(axis=1).view(np.int64) for k in (31, 33))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in raw], pa.binary()), pa.array(s1), pa.array(s2)], names=["id", "u", "s1", "s2"])


def _matrix(column, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, width).astype(np.float64)


class IndexPlan(NamedTuple):
    """How codes are indexed: ``tables`` substrings of prefix + suffix bits. Rows that agree in a prefix meet; among them
    those whose suffixes differ in at most ``radius`` bits are compared."""

    tables: int
    prefix: int
    suffix: int
    radius: int

    @property
    def length(self) -> int:
        return self.prefix + self.suffix

    def meets(self, flip: float) -> float:
        """The probability that two codes, each bit of which differs with probability flip, meet in some table."""
        same = 1 - flip
        near = sum(math.comb(self.suffix, r) * flip**r * same ** (self.suffix - r) for r in range(self.radius + 1))
        return 1 - (1 - same**self.prefix * near) ** self.tables


def index_plan(rows: int, flip: float, target: float = TARGET) -> IndexPlan:
    """The cheapest plan by which codes of vectors at the least cosine meet with probability ``target``.

    Substrings have log2(rows / LOAD) bits at any number of rows, so a substring value has about LOAD rows. Prefixes
    are long enough for at most GROUP rows on average to meet. The cost of a row in a table: to send it, and to
    compare it with the rows of each suffix value within the radius.
    """
    length = max(4, math.ceil(math.log2(max(rows, 1) / LOAD)))
    best: tuple[float, IndexPlan] | None = None
    for prefix in range(max(0, math.ceil(math.log2(max(rows, 1) / GROUP))), length + 1):
        suffix = length - prefix
        for radius in range(min(2, suffix) + 1):
            once = IndexPlan(1, prefix, suffix, radius).meets(flip)
            tables = max(4, math.ceil(math.log(1 - target) / math.log1p(-min(once, 1 - 1e-12))))
            cost = tables * (SEND + sum(math.comb(suffix, r) for r in range(radius + 1)))
            if best is None or cost < best[0]:
                best = cost, IndexPlan(tables, prefix, suffix, radius)
    return best[1]


def _masks(suffix: int, radius: int) -> list[int]:
    """Suffix differences of 1 to radius bits."""
    return [sum(1 << b for b in bits) for r in range(1, radius + 1) for bits in combinations(range(suffix), r)]


def _index(batches, width, mean, to, plan, hot):
    length, words = plan.length, CODE // 64
    for b in batches:
        if not b.num_rows:
            continue
        ids = b.column(0).to_numpy()
        bits = signs(_matrix(b.column(1), width), mean, to)
        code = _words64(bits[:, :CODE])
        parts = bits[:, : plan.tables * length].reshape(len(ids), plan.tables, length)
        value = parts @ (1 << np.arange(length, dtype=np.int64))
        salt = np.arange(plan.tables, dtype=np.int64) << 48
        key = mix(((value >> plan.suffix) + salt).ravel(), 41).view(np.int64)
        key, row, side = deal(key, np.arange(len(key)), np.repeat(ids, plan.tables), hot)
        tail, row = (value & ((1 << plan.suffix) - 1)).ravel()[row], row // plan.tables
        yield batch_of(key=key, tail=tail.astype(np.int32), id=ids[row], side=side.astype(np.int8), **{f"c{w}": code[row, w] for w in range(words)})


def _near_codes(batches, most: int, quick: int, masks: list[int]):
    """Pairs of one key, suffixes equal or apart by a mask, whose codes differ in at most ``most`` bits."""
    for table in whole_groups(batches):
        table = table.combine_chunks()
        key, tail, ident, side = (table.column(c).to_numpy() for c in range(4))
        code = [table.column(c).to_numpy().view(_U) for c in range(4, table.num_columns)]
        group = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
        at = (group << 32) | tail  # sorted, as the rows are
        ways = [pairs_within(runs(at))]
        for m in masks:  # from the side whose highest differing bit is 0, so that each pair comes once
            rows = np.flatnonzero(tail & (1 << (m.bit_length() - 1)) == 0)
            to = at[rows] ^ m
            ways.append(pairs_across(rows, np.searchsorted(at, to, "left"), np.searchsorted(at, to, "right")))

        def close():
            for i, j in chain.from_iterable(ways):
                d = _POP(code[0][i] ^ code[0][j])
                ok = np.flatnonzero(d <= quick)  # the cheapest test first: nearly all pairs end here
                i, j, d = i[ok], j[ok], d[ok].astype(np.int16)
                for c in code[1:]:
                    d += _POP(c[i] ^ c[j])
                ok = (d <= most) & (ident[i] != ident[j]) & ((side[i] < 0) | (side[i] != side[j]))
                yield np.stack([np.minimum(ident[i], ident[j])[ok], np.maximum(ident[i], ident[j])[ok]], axis=1)

        for p in collected(close()):
            yield batch_of(a=p[:, 0], b=p[:, 1])


def _cosines(batches, width: int, least: float):
    for b in batches:
        if not b.num_rows:
            continue
        cos = np.einsum("ij,ij->i", _matrix(b.column(1), width), _matrix(b.column(3), width))
        ok = np.flatnonzero(cos >= least)
        yield batch_of(a=b.column(0).to_numpy()[ok], b=b.column(2).to_numpy()[ok], cos=cos[ok])


class SimilarVectors:
    """The k most similar other vectors of each vector, as far as their cosine is at least ``least``.

    A code's bits are the signs of learned rotations. Substrings of log2(rows / 48) bits, at any number of rows, are an
    index each. A substring is a prefix, by which rows are brought together, and a suffix: within the task the suffix
    values are asked for up to ``radius`` bits away. ``index_plan`` chooses the number of substrings, their cut and the
    radius so that codes at the least cosine meet with probability 0.99 (bits taken as independent; recall is measured in
    the tests). By pigeonhole two codes meet for certain if they differ in fewer than tables * (radius + 1) bits, none
    of which falls into a prefix, or in fewer bits than there are tables. Pairs that meet, and whose codes of 192 bits
    differ in at most as many bits as ``least`` allows with four standard deviations to spare (in the first 64 with
    five), are reranked by their float vectors. Every row is indexed. A prefix that has several times the usual rows
    is dealt to pairs of blocks.

    Vectors that are null, of another length, with null or non-finite values, or all zero take no part. Vectors of
    equal direction (as float32) are one node; their ids are each other's neighbours first, in order of id, which also
    decides between equal cosines. Null ids take no part; an id is expected once.
    """

    def __init__(self, table: DataFrame, key: str, vector: str, width: int = 64, k: int = 5, least: float = 0.9, block: int | None = None):
        self.width, self.k, self.least, self.block = width, k, least, block
        rows = table.where(F.col(key).isNotNull() & usable(vector, width)).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<float>").alias("v"))
        self.units = materialize(rows.mapInArrow(lambda it: _prints(it, width), "id long, u binary, s1 long, s2 long"), "units")

    def _classes(self) -> DataFrame:
        """(id, rep): ids whose vectors several have, with the least of these ids."""
        first = self.units.groupBy("s1", "s2").agg(F.min("id").alias("rep"), F.count("*").alias("n")).where("n > 1")
        return materialize(lookup_join(self.units.select("s1", "s2", "id"), first, ["s1", "s2"], "inner").select("id", "rep"), "same")

    def neighbours(self) -> DataFrame:
        """(id, other, cos): each id's k best others, best first by cosine, then by id."""
        from pyspark.sql import Window as W

        width, least, k = self.width, self.least, self.k
        n = self.units.count()
        flip = math.acos(max(-1.0, min(1.0, least))) / math.pi
        most, quick = (int(bits * flip + spare * math.sqrt(bits * flip * (1 - flip))) for bits, spare in ((CODE, 4), (64, 5)))
        plan = index_plan(n, flip)
        # rows whose hash falls in the wanted share, so no task gathers more than the sample
        share = min(1.0, SAMPLE / max(n, 1))
        sample = self.units.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(share * (1 << 20))).select("u").toArrow()
        mean, to = fit_codes(_matrix(sample.column(0), width), -(-max(CODE, plan.tables * plan.length) // width))
        same = self._classes()
        nodes = self.units.join(same.where("id != rep").select("id"), "id", "left_anti")
        schema = "key long, tail int, id long, side byte, " + ", ".join(f"c{w} long" for w in range(CODE // 64))
        probe = nodes.where(F.pmod(F.xxhash64("id"), F.lit(PROBE)) == 0).select("id", "u").mapInArrow(lambda it: _index(it, width, mean, to, plan, {}), schema)
        hot = hot_blocks(probe, PROBE, self.block or max(BLOCK, 4 * n >> plan.prefix))
        index = nodes.select("id", "u").mapInArrow(lambda it: _index(it, width, mean, to, plan, hot), schema)
        masks = _masks(plan.suffix, plan.radius)
        pairs = spread(index, n * plan.tables).sortWithinPartitions("key", "tail").mapInArrow(lambda it: _near_codes(it, most, quick, masks), "a long, b long").distinct()
        u = nodes.select("id", "u")
        near = pairs.join(u.toDF("a", "ua"), "a").join(u.toDF("b", "ub"), "b").select("a", "ua", "b", "ub").mapInArrow(lambda it: _cosines(it, width, least), "a long, b long, cos double")
        both = near.union(near.select("b", "a", "cos")).toDF("id", "other", "cos")
        rank = lambda part, *order: F.row_number().over(W.partitionBy(part).orderBy(*order))
        top = both.withColumn("r", rank("id", F.desc("cos"), "other")).where(F.col("r") <= k).drop("r")
        # of a class of equal vectors its first k + 1 ids are enough, for its own ids and for others
        few = same.withColumn("r", rank("rep", "id")).where(F.col("r") <= k + 1).select("rep", F.col("id").alias("member"))
        each = top.join(few.withColumnRenamed("rep", "other"), "other", "left").select("id", F.coalesce("member", "other").alias("other"), F.least("cos", F.lit(1.0)).alias("cos"))
        best = each.union(few.select("rep", "member", F.lit(1.0))).groupBy("id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("cos")).alias("far"), "other"))), 1, k + 1).alias("best"))
        copies = lookup_join(same, best.withColumnRenamed("id", "rep"), ["rep"], "inner").select("id", "best")
        rows = best.join(same.select(F.col("rep").alias("id")).distinct(), "id", "left_anti").union(copies)
        mine = rows.select("id", F.explode(F.slice(F.filter("best", lambda x: x["other"] != F.col("id")), 1, k)).alias("x"))
        return mine.select("id", "x.other", (-F.col("x.far")).alias("cos"))

    def pairs(self) -> DataFrame:
        """(a, b), a < b: pairs of which one is among the k best of the other."""
        return self.neighbours().select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()
