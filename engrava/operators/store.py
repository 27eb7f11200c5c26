"""The table interface: a query builder, writes as new tables, and edge maintenance.

Nothing is changed in place: each operator returns the table after the write, to be written where the caller wants.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from engrava.functions.vector import dot, normalized


class TableQuery:
    """``search(vector).where().select().limit()``: a chain over one table; the vector search is exact."""

    def __init__(self, df: DataFrame):
        self._df, self._cols, self._n, self._order, self._near = df, None, None, [], None

    def where(self, predicate) -> TableQuery:
        self._df = self._df.where(predicate)
        return self

    def select(self, *columns: str) -> TableQuery:
        self._cols = columns
        return self

    def order_by(self, *columns) -> TableQuery:
        self._order = list(columns)
        return self

    def limit(self, n: int) -> TableQuery:
        self._n = n
        return self

    def search(self, vector: list[float], column: str = "embedding") -> TableQuery:
        """Adds ``_distance``, 1 - cosine, and sorts by it; rows whose vector has another length or none are left out."""
        unit = F.array(*[F.lit(float(x)) for x in vector])
        ok = F.col(column).isNotNull() & (F.size(column) == len(vector))
        self._df = self._df.where(ok).withColumn("_distance", 1.0 - dot(normalized(F.col(column)), normalized(unit)))
        self._near = "_distance"
        return self

    def to_df(self) -> DataFrame:
        df = self._df
        order = ([self._near] if self._near else []) + self._order
        if order:
            df = df.orderBy(*order)
        if self._n is not None:
            df = df.limit(self._n)
        return df.select(*self._cols, *([self._near] if self._near else [])) if self._cols else df

    def to_pandas(self):
        return self.to_df().toPandas()

    def to_batches(self):
        return self.to_df().toLocalIterator()


def latest_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row per key, the first in the given order; only (key, order) decides, ties are the caller's to break."""
    return df.withColumn("__r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("__r = 1").drop("__r")


def insert_or_ignore(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """table and those rows whose key it doesn't have; of repeated new keys one stays. A null key never conflicts."""
    fresh = rows
    keyed = fresh.where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys)).dropDuplicates(keys)
    free = fresh.where(" OR ".join(f"`{k}` IS NULL" for k in keys))
    return table.unionByName(keyed.join(table.select(*keys).distinct(), keys, "left_anti").select(*table.columns)).unionByName(free.select(*table.columns))


def upsert(table: DataFrame, rows: DataFrame, keys: list[str], update: list[str] | None = None) -> DataFrame:
    """Rows with a known key replace the named columns (all of theirs by default) of the table's row, others are added.

    rows hold each key once. Columns that rows lack keep the table's value, or are null in added rows.
    """
    update = [c for c in rows.columns if c not in keys] if update is None else update
    new = rows.select(*keys, *[F.col(c).alias(f"__new_{c}") for c in rows.columns if c not in keys]).withColumn("__hit", F.lit(True))
    old = table.withColumn("__old", F.lit(True))
    both = old.join(new, keys, "full_outer")
    out = []
    for c in table.columns:
        if c in keys or f"__new_{c}" not in new.columns:
            out.append(F.col(c))
        else:
            take = F.col("__hit").isNotNull() & (F.col("__old").isNull() | F.lit(c in update))
            out.append(F.when(take, F.col(f"__new_{c}")).otherwise(F.col(c)).alias(c))
    return both.select(*out)


def update_where(table: DataFrame, condition: Column, changes: dict[str, Column]) -> DataFrame:
    """Every right-hand side sees the row as it was, so columns can be swapped."""
    hit = F.coalesce(condition, F.lit(False))
    return table.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in changes.items()})


def delete_where(table: DataFrame, condition: Column) -> DataFrame:
    return table.where(~F.coalesce(condition, F.lit(False)))


def update_by_id(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Keyed changes; null in a change leaves the value."""
    new = changes.select(key, *[F.col(c).alias(f"__new_{c}") for c in changes.columns if c != key])
    out = table.join(new, key, "left")
    return out.select(*[F.coalesce(f"__new_{c}", c).alias(c) if f"__new_{c}" in out.columns else F.col(c) for c in table.columns])


def boost_edges(edges: DataFrame, deltas: DataFrame) -> DataFrame:
    """Undirected weights: deltas (a, b, edge_type, delta) are summed per sorted pair and added to the weight."""
    lo, hi = F.least("a", "b"), F.greatest("a", "b")
    add = deltas.where("a is not null and b is not null").groupBy(lo.alias("src"), hi.alias("dst"), "edge_type").agg(F.sum("delta").alias("delta"))
    old = edges.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "edge_type").agg(F.sum("weight").alias("weight"))
    return old.join(add, ["src", "dst", "edge_type"], "full_outer").select("src", "dst", "edge_type", (F.coalesce("weight", F.lit(0.0)) + F.coalesce("delta", F.lit(0.0))).alias("weight"))


def decayed(edges: DataFrame, idle_days: Column, kinds: list[str], after: float = 90, rate: float = 0.9, least: float = 0.01) -> DataFrame:
    """Idle edges of decayable kinds lose weight by rate per day beyond ``after``; what falls below ``least`` is pruned."""
    old = F.col("edge_type").isin(kinds) & (idle_days > after)
    w = F.when(old, F.col("weight") * F.pow(F.lit(rate), idle_days - after)).otherwise(F.col("weight"))
    return edges.withColumn("weight", w).where(~old | (F.col("weight") >= least))


def erasable(age_days: Column, review_days: Column, centrality: Column, kept: Column, weak: float = 0.02, days: float = 30) -> Column:
    """Records to tombstone: weak, old, not reviewed lately, and not held by a flag."""
    return (centrality < weak) & (age_days > days) & F.coalesce(review_days > days, F.lit(True)) & ~F.coalesce(kept, F.lit(False))


def restabilised(stability: Column, recalled: Column, contradicted: Column) -> Column:
    s = stability + F.when(recalled, 0.05).otherwise(0.0) - F.when(contradicted, 0.2).otherwise(0.0)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), s))
