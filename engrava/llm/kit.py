"""Array helpers of the operators: grouping, hashing and pairing inside one Arrow task."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

WORD = re.compile(r"[^\W_]+")
_U = np.uint64


def words(text: str) -> list[str]:
    """Maximal runs of letters or digits, lower-cased; an underscore separates."""
    return WORD.findall(text.lower())


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser (multiply, shift, multiply): equal in, equal out, else as random."""
    with np.errstate(over="ignore"):
        x = np.asarray(x).astype(np.int64, copy=False).view(_U) + _U(seed * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def rolling(points: np.ndarray, k: int) -> np.ndarray:
    """A polynomial hash of each k consecutive points, by doubling: log2(k) passes."""
    with np.errstate(over="ignore"):
        cur, have, power = mix(points), 1, _U(0xD6E8FEB86659FD93)
        out, length, n = None, 0, len(points)
        while True:
            if k & 1:
                if out is None:
                    out, length = cur, have
                else:
                    m = n - length - have + 1
                    out = out[:m] * power + cur[length : length + m]
                    length += have
            k >>= 1
            if not k:
                return out
            cur = cur[: len(cur) - have] * power + cur[have:]
            power, have = power * power, have * 2


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values, by doubling."""
    have, cur = 1, x
    while have * 2 <= w:
        cur = np.minimum(cur[: len(cur) - have], cur[have:])
        have *= 2
    return cur if have == w else np.minimum(cur[: len(cur) - (w - have)], cur[w - have :])


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points in a row, and where each text starts (one more entry for the end)."""
    parts = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    return (np.concatenate(parts) if parts else np.empty(0, np.uint32)), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)


def runs(keys: np.ndarray) -> np.ndarray:
    """Boundaries of runs of equal neighbours: starts, then the end."""
    if not len(keys):
        return np.zeros(1, np.int64)
    return np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])


#: Pairs looked at together: so many that their arrays stay in a core's cache.
CHUNK = 1 << 16


def pairs_within(bounds: np.ndarray, chunk: int = CHUNK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All index pairs i < j inside the runs given by their boundaries, at most about chunk pairs at a time."""
    size = np.diff(bounds)
    after = np.repeat(bounds[1:], size) - np.arange(bounds[0], bounds[-1]) - 1  # partners that follow each row
    i0, total = 0, np.concatenate([[0], np.cumsum(after)])
    while i0 < len(after):
        i1 = max(i0 + 1, int(np.searchsorted(total, total[i0] + chunk, "right")) - 1)
        n = after[i0:i1]
        left = np.repeat(np.arange(i0, i1), n)
        if len(left):
            right = left + 1 + np.arange(len(left)) - np.repeat(total[i0:i1] - total[i0], n)
            yield left + bounds[0], right + bounds[0]
        i0 = i1


def pairs_across(rows: np.ndarray, lo: np.ndarray, hi: np.ndarray, chunk: int = CHUNK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each row with every index from its lo up to its hi, at most about chunk pairs at a time."""
    n = np.maximum(hi - lo, 0)
    i0, total = 0, np.concatenate([[0], np.cumsum(n)])
    while i0 < len(rows):
        i1 = max(i0 + 1, int(np.searchsorted(total, total[i0] + chunk, "right")) - 1)
        left = np.repeat(np.arange(i0, i1), n[i0:i1])
        if len(left):
            yield rows[left], lo[left] + np.arange(len(left)) - (total[left] - total[i0])
        i0 = i1


def deal(key: np.ndarray, row: np.ndarray, ids: np.ndarray, hot: dict[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, row, side): index entries, those of hot keys once for each pair of blocks that has theirs, under a key of
    that pair. Side 0 or 1 tells the two blocks apart; -1 says that all pairs of a key's entries count. hot has the
    number of blocks of each hot key; an entry's block follows from its id."""
    side = np.full(len(key), -1, np.int64)
    if not hot:
        return key, row, side
    names = np.array(sorted(hot), np.int64)
    at = np.minimum(np.searchsorted(names, key), len(names) - 1)
    is_hot = names[at] == key
    if not is_hot.any():
        return key, row, side
    blocks = np.array([hot[int(x)] for x in names])[at[is_hot]]
    src = np.repeat(np.flatnonzero(is_hot), blocks)
    other, many = np.arange(len(src)) - np.repeat(np.cumsum(blocks) - blocks, blocks), np.repeat(blocks, blocks)
    mine = (mix(ids[row[src]], 21) % many.astype(_U)).astype(np.int64)
    with np.errstate(over="ignore"):
        pair = mix((key[src].view(_U) + mix(np.minimum(mine, other) * 65536 + np.maximum(mine, other), 22)).view(np.int64), 23).view(np.int64)
    kept = np.flatnonzero(~is_hot)
    return np.concatenate([key[kept], pair]), np.concatenate([row[kept], row[src]]), np.concatenate([side[kept], np.where(other == mine, -1, (mine > other).astype(np.int64))])


def hot_blocks(probe: DataFrame, part: int, block: int, most: int = 10_000) -> dict[int, int]:
    """Keys with more than ``block`` entries, and the number of blocks each is dealt to, from the index entries of one
    id in ``part``. It decides where entries go, never which count. Of the keys, the ``most`` largest are dealt; any
    other then has at most a ``most``-th of all entries."""
    large = probe.groupBy("key").count().where(F.col("count") * part > block).orderBy(F.desc("count")).limit(most).collect()
    return {r.key: -(-r["count"] * part // block) + 1 for r in large}


def collected(parts: Iterator[np.ndarray], rows: int = 1 << 19) -> Iterator[np.ndarray]:
    """Arrays of different pairs, each of about ``rows`` pairs at most, of many small arrays with repeats."""
    held: list[np.ndarray] = []
    have = 0
    for p in parts:
        if not len(p):
            continue
        held.append(p)
        have += len(p)
        if have > rows:
            held = [np.unique(np.concatenate(held), axis=0)]
            have = len(held[0])
            if have > rows // 2:
                yield held[0]
                held, have = [], 0
    if held:
        yield np.unique(np.concatenate(held), axis=0)


def spread(df: DataFrame, rows: int, each: int = 400_000) -> DataFrame:
    """df by its key, on as many partitions as the session wants, or more so that a task gets about ``each`` rows."""
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // each)), "key")


def whole_groups(batches: Iterator[pa.RecordBatch], key: int = 0, rows: int = 1 << 17) -> Iterator[pa.Table]:
    """Tables of about ``rows`` rows that end where the sorted key column changes, so no group is cut."""
    held: list[pa.RecordBatch] = []
    count = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        count += b.num_rows
        if count < rows:
            continue
        k = b.column(key).to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(k, k[-1], "left")) if k[0] <= k[-1] else 0
        if cut == 0 and len(held) > 1 and held[-2].column(key)[held[-2].num_rows - 1].as_py() != k[0]:
            yield pa.Table.from_batches(held[:-1])
            held, count = [b], b.num_rows
        elif cut:
            held[-1] = b.slice(0, cut)
            yield pa.Table.from_batches(held)
            held, count = [b.slice(cut)], b.num_rows - cut
    if held:
        yield pa.Table.from_batches(held)


def vectors(column: pa.Array, width: int) -> np.ndarray:
    """A list column whose rows all have ``width`` values, as a matrix."""
    flat = column.flatten() if isinstance(column, (pa.ListArray, pa.LargeListArray, pa.FixedSizeListArray)) else column
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def batch_of(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v) for v in columns.values()], names=list(columns))
