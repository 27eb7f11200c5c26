"""Cosines of all pairs of rows in a group, block by block, so nothing is missed. Time grows with the square of a group."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, functions as F

from engrava.operators.skew import lookup_join
from engrava.storage import materialize

#: Rows of a block, and rows compared at once.
BLOCK, STEP = 16384, 1024


def comparable(v: Column) -> Column:
    """True for vectors of finite values that are not all zero."""
    return v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)


def _unit(t: pa.Table) -> np.ndarray:
    x = np.array(t["v"].to_pylist(), np.float64).reshape(len(t), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _blocked(rows: DataFrame) -> DataFrame:
    """rows (g, id, v), once for each pair of blocks p <= q that its own block side is in."""
    rows = materialize(rows.where(F.col("g").isNotNull() & comparable(F.col("v"))).withColumn("w", F.size("v")), "rows")
    n = rows.groupBy("g", "w").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("k"))
    r = lookup_join(rows, n, ["g", "w"], "inner").withColumn("side", F.pmod(F.xxhash64("id"), F.col("k")).cast("int"))
    r = r.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    return r.select("g", "w", F.least("side", "o").alias("p"), F.greatest("side", "o").alias("q"), "side", "id", "v")


def near_pairs(rows: DataFrame, least: float) -> DataFrame:
    """(g, a, b, cos), a < b: all pairs of BIGINT ids in one group (any orderable g) with a cosine of at least ``least``."""
    kind = rows.schema["g"].dataType.simpleString()

    def compare(t: pa.Table) -> pa.Table:
        one = t.filter(pa.compute.equal(t["side"], t["p"]))
        two = t.filter(pa.compute.equal(t["side"], t["q"]))
        x, y, a, b, found = _unit(one), _unit(two), one["id"].to_numpy(), two["id"].to_numpy(), []
        same = t["p"][0].as_py() == t["q"][0].as_py()
        for k in range(0, len(x) if len(y) else 0, STEP):
            c = x[k : k + STEP] @ y.T
            i, j = np.nonzero(c >= least)
            keep = a[k + i] < b[j] if same else a[k + i] != b[j]
            i, j = i[keep], j[keep]
            found.append((np.minimum(a[k + i], b[j]), np.maximum(a[k + i], b[j]), c[i, j]))
        cols = [np.concatenate(z) for z in zip(*found, strict=True)] if found else [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
        g = pa.array([t["g"][0].as_py()] * len(cols[0]), t.schema.field("g").type)
        return pa.table([g, *map(pa.array, cols)], names=["g", "a", "b", "cos"])

    return _blocked(rows).groupBy("g", "w", "p", "q").applyInArrow(compare, f"g {kind}, a long, b long, cos double")


def hubness(rows: DataFrame, threshold: float = 0.85) -> DataFrame:
    """(g, mean_cos, max_cos, is_hub, size) of each group, over all pairs of its rows; one row alone is no hub."""
    kind = rows.schema["g"].dataType.simpleString()

    def compare(t: pa.Table) -> pa.Table:
        one = t.filter(pa.compute.equal(t["side"], t["p"]))
        two = t.filter(pa.compute.equal(t["side"], t["q"]))
        x, y, total, top = _unit(one), _unit(two), 0.0, 0.0  # as in the reference, the maximum is 0 at least
        same, n = t["p"][0].as_py() == t["q"][0].as_py(), 0
        for k in range(0, len(x) if len(y) else 0, STEP):
            c = x[k : k + STEP] @ y.T
            if same:
                c[np.arange(len(c)), k + np.arange(len(c))] = 0.0
            total, top = total + float(c.sum()) * (1 if same else 2), max(top, float(c.max()))
        if same:
            n = len(x)
        return pa.table([pa.array([t["g"][0].as_py()], t.schema.field("g").type), pa.array([total]), pa.array([top]), pa.array([n])], names=["g", "total", "top", "n"])

    m = _blocked(rows).groupBy("g", "w", "p", "q").applyInArrow(compare, f"g {kind}, total double, top double, n long")
    s = m.groupBy("g").agg(F.sum("total").alias("total"), F.max("top").alias("max_cos"), F.sum("n").alias("size"))
    mean = F.when(F.col("size") > 1, F.col("total") / (F.col("size") * (F.col("size") - 1))).otherwise(F.lit(0.0))
    return s.select("g", mean.alias("mean_cos"), "max_cos", (mean > threshold).alias("is_hub"), "size")
