"""References to records that do not exist, were deleted by then, or came later."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from engrava.operators.skew import HOT_ROWS, lookup_join, unmatched

MATCHES = ("simple", "full", "partial")


def null_mask(keys: list[str]) -> Column:
    """Bit i is set where key i is null."""
    return reduce(lambda x, y: x + y, [F.when(F.col(k).isNull(), F.lit(1 << i)).otherwise(F.lit(0)) for i, k in enumerate(keys)])


def orphans(child: DataFrame, parent: DataFrame, child_keys: list[str], parent_keys: list[str], match: str = "simple", hot_rows: int = HOT_ROWS, at: str | None = None, period: tuple[str, str] | None = None) -> DataFrame:
    """Rows of child whose reference has no parent row, with ``null_mask``, the mask of its null key columns.

    References are grouped by their null mask and each mask is anti-joined on its non-null columns:
    simple - a reference with any null refers to nothing and is no orphan;
    full - all null is no reference; some null is always an orphan; none null must match;
    partial - all null is no reference; the non-null columns must match some parent row.
    With ``at`` and ``period`` a parent row counts only from the first column of period on and before the second, as of
    ``at`` of the child; a null end of the period is open. A null ``at`` is one more bit of the mask, under every match:
    such references are held against all parent rows, whatever their period.

    Parent rows may repeat and may have nulls (which match nothing). Every child row is kept apart, repeats included.
    Columns other than the keys may clash with the parent's: only parent keys and period are read. Empty parent: all
    references are orphans. Hot keys are not shuffled (see ``unmatched``).
    """
    if match not in MATCHES:
        raise ValueError(f"match is one of {MATCHES}")
    if "null_mask" in child.columns:
        child = child.withColumnRenamed("null_mask", "null_mask_of_child")
    masked, every = child.withColumn("null_mask", null_mask(child_keys + ([at] if at else []))), (1 << len(child_keys)) - 1
    found = []
    for mask in range((every + 1) * (2 if at else 1)):
        rows, nulls, timed = masked.where(F.col("null_mask") == mask), mask & every, bool(at) and mask <= every
        if nulls == every or (nulls and match == "simple"):
            continue
        if nulls and match == "full":
            found.append(rows)
            continue
        use = [i for i in range(len(child_keys)) if not nulls >> i & 1]
        names = {child_keys[i]: f"__k{i}" for i in use}
        known = parent.select(*[F.col(parent_keys[i]).alias(f"__k{i}") for i in use], *([F.col(c).alias(n) for c, n in zip(period, ("__from", "__to"))] if timed else [])).dropna(subset=list(names.values()))
        alive = F.coalesce(F.col("__from") <= F.col(at), F.lit(True)) & F.coalesce(F.col("__to") > F.col(at), F.lit(True)) if timed else None
        found.append(unmatched(rows, known if timed else known.distinct(), names, alive, hot_rows))
    return reduce(DataFrame.unionByName, found) if found else masked.limit(0)


def latest(df: DataFrame, keys: list[str], by: str) -> DataFrame:
    """One row per key with the greatest ``by``; null only where no row of the key has one."""
    return df.groupBy(*keys).agg(F.max(by).alias(by))


def dated_orphans(child: DataFrame, parent: DataFrame, key: str, at: str, parent_key: str, deleted_at: str, created_at: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The rows of child whose reference does not hold as of ``at``, with ``reason``.

    missing - no such parent; deleted - gone at or before ``at``; late - created after ``at``. Without ``at`` only
    missing applies; a null key refers to nothing. The parent is unique by its key (null keys are left out); of
    repeated ones the row created first counts. Orphans come from ``orphans``: one anti-join of the references with a
    time, against the parents alive then, and one of those without. Only they are joined to the parents again for the
    reason.
    """
    known = parent.select(F.col(parent_key).alias("__id"), F.col(deleted_at).alias("__gone"), F.col(created_at).alias("__made")).where(F.col("__id").isNotNull())
    known = known.groupBy("__id").agg(F.min_by("__gone", F.coalesce("__made", F.lit("9999-12-31").cast("timestamp"))).alias("__gone"), F.min("__made").alias("__made"), F.lit(True).alias("__there"))
    absent = orphans(child, known, [key], ["__id"], "simple", hot_rows, at, ("__made", "__gone"))
    reason = F.when(F.col("__there").isNull(), "missing").when(F.col("__gone") <= F.col(at), "deleted").otherwise("late")
    return lookup_join(absent, known.withColumnRenamed("__id", key), [key], "left", hot_rows).withColumn("reason", reason).select(*child.columns, "reason")
