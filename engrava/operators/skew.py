"""Joins that hold when one key has a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: A key with at least this many rows may be hot; at most MAX_HOT keys are, so what is broadcast is bounded.
HOT_ROWS, MAX_HOT = 50_000, 1_000


def hot_keys(df: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS, max_hot: int = MAX_HOT) -> DataFrame | None:
    """The most frequent keys with at least hot_rows rows, max_hot of them at most, or None; counted with map-side partial
    sums. They are read once, so that the parts of a join that are told apart by them always fit together."""
    rows = df.select(*keys).dropna().groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") >= hot_rows).orderBy(F.desc("__n")).limit(max_hot).select(*keys)
    found = rows.collect()
    return df.sparkSession.createDataFrame(found, rows.schema) if found else None


def lookup_join(child: DataFrame, parent: DataFrame, keys: list[str], how: str = "left", hot_rows: int = HOT_ROWS) -> DataFrame:
    """child joined to a parent that is unique by keys, without sending a hot key's rows to one task.

    Rows of hot keys stay where they are: the parent rows of those keys (at most MAX_HOT) are broadcast. All others
    are shuffled by the keys. Nothing is dropped: the two parts are disjoint and their union is the plain join. The
    child's keys are counted first, so the child is best a table or what ``materialize`` wrote.
    """
    hot = hot_keys(child, keys, hot_rows)
    if hot is None:
        return child.join(parent, keys, how)
    of_hot = parent.join(F.broadcast(hot), keys, "left_semi")
    return child.join(F.broadcast(hot), keys, "left_semi").join(F.broadcast(of_hot), keys, how).unionByName(child.join(F.broadcast(hot), keys, "left_anti").join(parent, keys, how))


def unmatched(child: DataFrame, parent: DataFrame, on: dict[str, str], also: Column | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Rows of child without a row of parent that equals them in ``on`` (child column: parent column) and fulfils ``also``.

    Columns of parent that ``also`` names must not occur in child. Rows of hot keys stay where they are and get the
    parent rows of those keys broadcast; a hot key's own parent rows must be few.
    """
    cond = [F.col(c) == F.col(k) for c, k in on.items()] + ([also] if also is not None else [])
    hot = hot_keys(child, list(on), hot_rows)
    if hot is None:
        return child.join(parent, cond, "left_anti")
    names = hot.toDF(*on.values())
    of_hot = parent.join(F.broadcast(names), list(on.values()), "left_semi")
    return child.join(F.broadcast(hot), list(on), "left_semi").join(F.broadcast(of_hot), cond, "left_anti").unionByName(child.join(F.broadcast(hot), list(on), "left_anti").join(parent, cond, "left_anti"))
