"""Hypervectors: bits in BIGINT words, phases and sparse index sets in INT arrays.

What is element-wise is an expression; bundling adds up inside each Arrow task first, so a group costs each task one
row; rolls and projections are numpy over Arrow batches.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

BITS = 10_000


def seed_of(prefix: str, value: str) -> int:
    return int.from_bytes(hashlib.sha256(f"{prefix}:{value}".encode()).digest()[:8], "big")


def to_words(bits: np.ndarray) -> np.ndarray:
    wide = np.zeros((len(bits), -(-bits.shape[1] // 64) * 64), bool)
    wide[:, : bits.shape[1]] = bits
    return np.packbits(wide, axis=1, bitorder="little").view(np.int64)


def to_bits(words: np.ndarray, n: int) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(words).view(np.uint8), axis=1, bitorder="little")[:, :n]


def role_vector(name: str, n: int = BITS) -> list[int]:
    return to_words(np.random.default_rng(seed_of("role", name)).integers(0, 2, (1, n)).astype(bool))[0].tolist()


def bind(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y))


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)


def similarity(a: Column, b: Column, n: int = BITS) -> Column:
    """1 for equal, 0 for unrelated, -1 for opposite vectors."""
    return 1 - 2 * hamming(a, b) / n


def _rows(column, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _lists(m: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), pa.array(m.ravel()))


def projected(df: DataFrame, key: str, vector: str, width: int, n: int = BITS, seed: int = 7) -> DataFrame:
    """(key, hv): signs of a fixed random projection, 0 counts as positive."""

    def run(batches):
        to = np.random.default_rng(seed).standard_normal((width, n))
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0), _lists(to_words(_rows(b.column(1), width).astype(float) @ to >= 0))], names=["key", "hv"])

    return df.where(F.size(vector) == width).select(key, vector).mapInArrow(run, f"key {dict(df.dtypes)[key]}, hv array<long>")


def permuted(df: DataFrame, key: str, hv: str, by: int, n: int = BITS) -> DataFrame:
    def run(batches):
        for b in batches:
            if b.num_rows:
                w = _rows(b.column(1), -(-n // 64))
                yield pa.RecordBatch.from_arrays([b.column(0), _lists(to_words(np.roll(to_bits(w, n), by, axis=1).astype(bool)))], names=["key", "hv"])

    return df.select(key, hv).mapInArrow(run, f"key {dict(df.dtypes)[key]}, hv array<long>")


def bundled(df: DataFrame, group: str, hv: str, n: int = BITS) -> DataFrame:
    """(group, n, hv): bitwise majority of each group; an even split is 1."""
    words = -(-n // 64)

    def partial(batches):
        total: dict = {}
        kind_of = None
        for b in batches:
            kind_of = b.schema.field(0).type
            if not b.num_rows:
                continue
            names = b.column(0).dictionary_encode()
            at, bits = names.indices.to_numpy(), to_bits(_rows(b.column(1), words), n)
            order = np.argsort(at, kind="stable")
            starts = np.concatenate([[0], np.flatnonzero(np.diff(at[order])) + 1])
            sums, sizes = np.add.reduceat(bits[order], starts, axis=0, dtype=np.int64), np.diff(np.append(starts, len(at)))
            for g, k1, s1 in zip(names.dictionary.take(pa.array(at[order][starts])).to_pylist(), sizes.tolist(), sums):
                k, s = total.get(g, (0, 0))
                total[g] = (k + k1, s + s1)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), kind_of), pa.array([k for k, _ in total.values()], pa.int64()), _lists(np.array([s for _, s in total.values()]))], names=["g", "n", "s"])

    def final(batches):
        total: dict = {}
        kind_of = None
        for b in batches:
            kind_of = b.schema.field(0).type
            for g, k, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), _rows(b.column(2), n) if b.num_rows else []):
                k0, s0 = total.get(g, (0, 0))
                total[g] = (k0 + k, s0 + s)
        if total:
            bits = np.array([2 * s >= k for k, s in total.values()])
            yield pa.RecordBatch.from_arrays([pa.array(list(total), kind_of), pa.array([k for k, _ in total.values()], pa.int64()), _lists(to_words(bits))], names=["g", "n", "hv"])

    kind = dict(df.dtypes)[group]
    parts = df.where(F.col(group).isNotNull()).select(group, hv).mapInArrow(partial, f"g {kind}, n long, s array<long>")
    return parts.repartition("g").mapInArrow(final, f"g {kind}, n long, hv array<long>").withColumnRenamed("g", group)


def cleaned_up(queries: DataFrame, codebook: DataFrame, n: int = BITS, most: float = 0.5) -> DataFrame:
    """(key, name, far): the nearest vector of a codebook of names (a fixed list, broadcast), if within ``most`` of n bits."""
    d = queries.join(F.broadcast(codebook.toDF("name", "code"))).withColumn("far", hamming(F.col("hv"), F.col("code")) / n)
    return d.groupBy("key").agg(F.min(F.struct("far", "name")).alias("m")).where(F.col("m.far") <= most).select("key", "m.name", F.round("m.far", 6).alias("far"))


def structured(fillers: dict[str, Column], n: int = BITS) -> list[Column]:
    """Role and filler bound, for each role: bundle them (``bundled``) for a record's structure."""
    return [bind(F.array(*[F.lit(x) for x in role_vector(r, n)]), f) for r, f in fillers.items()]


def unpacked(structure: Column, role: str, n: int = BITS) -> Column:
    """A noisy copy of the filler of a role, to be cleaned up against a codebook."""
    return bind(structure, F.array(*[F.lit(x) for x in role_vector(role, n)]))


def orthogonalised(a: Column, b: Column) -> Column:
    """The part of a dense vector a that is orthogonal to b; a itself where b has no length."""
    from engrava.functions.vector import dot

    k = F.when(dot(b, b) > 0, dot(a, b) / dot(b, b)).otherwise(0.0)
    return F.zip_with(a, b, lambda x, y: x - k * y)


# ---- changes to stored vectors


def ones(a: Column) -> Column:
    return F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + F.bit_count(x))


def filler_vector(value: str, n: int = BITS) -> list[int]:
    return to_words(np.random.default_rng(seed_of("filler", value)).integers(0, 2, (1, n)).astype(bool))[0].tolist()


def with_pair(hv: Column, role: str, filler: str, n: int = BITS) -> Column:
    """A vector with a role and its filler bound in; the same pair again takes it out."""
    pair = [a ^ b for a, b in zip(role_vector(role, n), filler_vector(filler, n))]
    return bind(hv, F.array(*[F.lit(x) for x in pair]))


def with_role(hv: Column, role: str, old: str, new: str, n: int = BITS) -> Column:
    """The old filler of a role replaced by a new one."""
    return with_pair(with_pair(hv, role, old, n), role, new, n)


def delta_encoded(canonical: Column, variant: Column) -> Column:
    """What a variant differs in from its canonical vector; few ones if they are alike."""
    return bind(canonical, variant)


def delta_decoded(canonical: Column, delta: Column) -> Column:
    return bind(canonical, delta)


def replayed(df: DataFrame, key: str, hv: str, sigma: float, seed: int, n: int = BITS) -> DataFrame:
    """(key, hv): each bit flipped with probability sigma, by draws that depend on the seed and the key only."""
    if not 0 <= sigma <= 1:
        raise ValueError("sigma is a probability")

    def run(batches):
        for b in batches:
            if b.num_rows:
                flips = np.stack([np.random.default_rng([seed, seed_of("replay", str(k))]).random(n) < sigma for k in b.column(0).to_pylist()])
                yield pa.RecordBatch.from_arrays([b.column(0), _lists(_rows(b.column(1), -(-n // 64)) ^ to_words(flips))], names=["key", "hv"])

    return df.select(key, hv).mapInArrow(run, f"key {dict(df.dtypes)[key]}, hv array<long>").withColumnRenamed("key", key)


def separated(target: np.ndarray, background: np.ndarray, most: float = 0.85, tries: int = 8) -> np.ndarray:
    """A target of bits that is less alike than ``most`` to all of a background: by flipping 16, 32, ... bits chosen from
    the target itself, or the best of ``tries``. An empty background leaves it as it is."""
    alike = lambda x: float((x == background).mean(axis=1).max())
    if not len(background) or alike(target) < most:
        return target
    best = target
    for i in range(1, tries + 1):
        rng = np.random.default_rng(int.from_bytes(hashlib.sha256(f"separate-{i}".encode() + np.packbits(target).tobytes()).digest()[:8], "big"))
        now = target.copy()
        now[rng.choice(len(now), min(16 * i, len(now)), replace=False)] ^= 1
        if alike(now) < alike(best):
            best = now
        if alike(now) < most:
            break
    return best


# ---- phases (0..255)


def phase_bind(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.pmod(x + y, F.lit(256)))


def phase_unbind(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.pmod(x - y, F.lit(256)))


def phase_similarity(a: Column, b: Column) -> Column:
    import math

    cos = F.zip_with(a, b, lambda x, y: F.cos((x - y) * F.lit(2 * math.pi / 256)))
    return F.aggregate(cos, F.lit(0.0), lambda s, x: s + x) / F.size(a)


# ---- sparse sets of indices


def sparse_bind(a: Column, b: Column, cap: int = 20) -> Column:
    return F.slice(F.array_sort(F.array_union(a, b)), 1, cap)


def sparse_unbind(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_except(a, b))


def sparse_permute(a: Column, by: int, n: int = BITS) -> Column:
    return F.array_sort(F.transform(a, lambda x: F.pmod(x + by, F.lit(n))))


def sparse_similarity(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


def sparse_bundled(df: DataFrame, group: str, indices: str, cap: int = 20) -> DataFrame:
    """(group, indices): the ``cap`` most frequent indices of each group, lower ones on ties."""
    from pyspark.sql import Window as W

    c = df.select(group, F.explode(indices).alias("i")).groupBy(group, "i").agg(F.count("*").alias("n"))
    top = c.withColumn("r", F.row_number().over(W.partitionBy(group).orderBy(F.desc("n"), "i"))).where(F.col("r") <= cap)
    return top.groupBy(group).agg(F.array_sort(F.collect_list("i")).alias("indices"))
