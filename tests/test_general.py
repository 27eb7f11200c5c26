"""Deliveries and references against brute force on small fixtures."""

import random

import pytest
from pyspark.sql import functions as F, types as T

from engrava.functions.instants import parse_instant
from engrava.operators.components import connected_components
from engrava.operators.deliveries import DeliveryLog
from engrava.operators.references import dated_orphans, orphans
from engrava.operators.skew import lookup_join

ROWS = "row_id long, s string, ids array<string>, text string, file string, pos long"


def log_of(spark, tmp_path, rows, parts=3):
    p = str(tmp_path / "log.parquet")
    spark.createDataFrame(rows, ROWS).repartition(parts).write.parquet(p)
    return DeliveryLog(spark, p, "s", F.get(F.filter("ids", lambda x: x.isNotNull()), F.lit(0)), "row_id")


def test_deliveries_keep_one_copy_with_clashing_columns_nulls_and_a_hot_message(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, rng.choice(["a", "b", None, " "]), [None, rng.choice(["m", None]) if i % 3 else "hot"], None if i % 7 else "x" * 5000, "f", i) for i in range(900)]
    log = log_of(spark, tmp_path, rows)
    first: dict = {}
    for r in rows:
        ident = next((x for x in r[2] if x is not None), None)
        if r[1] and r[1].strip() and ident is not None:
            first.setdefault((r[1], ident), []).append(r[0])
    gone = sorted(x for v in first.values() for x in v[1:])
    assert sorted(r[0] for r in log.redundant().select("ord").collect()) == gone
    kept = log.kept()
    assert kept.columns == ["row_id", "s", "ids", "text", "file", "pos"]
    assert sorted(r[0] for r in kept.collect()) == sorted({r[0] for r in rows} - set(gone))
    assert sorted(r[0] for r in log.removed(["row_id"]).collect()) == gone


def test_deliveries_with_tied_or_null_order_and_empty_table(spark, tmp_path):
    log = log_of(spark, tmp_path, [(1, "a", ["m"], "", "", 0), (1, "a", ["m"], "", "", 0), (None, "a", ["m"], None, None, None)], 2)
    assert log.redundant().count() == 2 and log.kept().count() == 1
    empty = log_of(spark, tmp_path / "e", [])
    assert empty.redundant().count() == 0 and empty.kept().count() == 0 and empty.removed().count() == 0


def test_a_file_is_read_by_row_group(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    p = str(tmp_path / "one.parquet")
    n = 150_000  # more than two segments, row groups that end elsewhere
    pq.write_table(pa.table({"row_id": pa.array(range(n), pa.int64()), "s": ["a"] * n, "ids": [[str(i % 70_000)] for i in range(n)]}), p, row_group_size=40_000)
    log = DeliveryLog(spark, p, "s", F.get("ids", F.lit(0)), "row_id")
    kept = log.kept(["row_id"])
    assert kept.rdd.getNumPartitions() == 4
    assert sorted(r[0] for r in kept.collect()) == list(range(70_000))
    assert sorted(r[0] for r in log.removed(["row_id"]).collect()) == list(range(70_000, n))


@pytest.mark.parametrize("match", ["simple", "full", "partial"])
def test_orphans_by_null_mask(spark, match):
    child = [(i, a, b, "x") for i, (a, b) in enumerate([(1, 1), (1, None), (None, 2), (None, None), (9, 9), (9, None), (1, 1), (None, 7)])]
    parent = [(1, 1), (2, 2), (None, 7), (1, 1)]
    c, p = spark.createDataFrame(child, "i int, a int, b int, null_mask string"), spark.createDataFrame(parent, "a int, b int")
    got = sorted(r.i for r in orphans(c, p, ["a", "b"], ["a", "b"], match, hot_rows=2).collect())
    want = []
    for i, a, b, _ in child:
        if a is None and b is None or (match == "simple" and None in (a, b)):
            continue
        if match == "full" and None in (a, b):
            want.append(i)
        elif not any((a is None or a == x) and (b is None or b == y) for x, y in parent):
            want.append(i)
    assert got == want
    assert orphans(c.limit(0), p, ["a", "b"], ["a", "b"], match).count() == 0


def test_dated_orphans(spark):
    t = lambda s: None if s is None else s
    child = [(1, "r1", "2025-01-02"), (2, "r2", "2025-01-02"), (3, "r3", "2025-01-02"), (4, "gone", "2025-01-02"), (5, None, "2025-01-02"), (6, "r2", None), (7, "zz", None), (8, "r2", "2025-01-01")]
    parent = [("r1", None, "2025-01-01", 5), ("r2", "2025-01-02", "2024-01-01", 5), ("r3", None, "2025-01-03", 5), (None, None, None, None)]
    c = spark.createDataFrame([(i, k, t(a)) for i, k, a in child], "i int, dst string, at string").withColumn("at", parse_instant(F.col("at")))
    p = spark.createDataFrame(parent, "id string, g string, m string, i int").withColumns({"g": parse_instant(F.col("g")), "m": parse_instant(F.col("m"))})
    for hot_rows in (2, 50_000):
        got = {r.i: r.reason for r in dated_orphans(c, p, "dst", "at", "id", "g", "m", hot_rows=hot_rows).collect()}
        assert got == {2: "deleted", 3: "late", 4: "missing", 7: "missing"}
    assert {r.i: r.reason for r in dated_orphans(c, p.limit(0), "dst", "at", "id", "g", "m").collect()} == {i: "missing" for i in (1, 2, 3, 4, 6, 7, 8)}


def test_parse_instant(spark):
    texts = {"2025-01-05T10:27:39+02:00": "2025-01-05 08:27:39", "2025-01-05 10:27:39": "2025-01-05 10:27:39", "2025-01-05T10:27:39.5Z": "2025-01-05 10:27:39.5", " 2025-01-05 ": "2025-01-05 00:00:00", "2025-01-05T10:27:39-0530": "2025-01-05 15:57:39", "0000-00-00T00:00:00Z": None, "n/a": None, "": None, "yesterday": None, "2025-13-01T00:00:00Z": None}
    got = {r.s: r.t for r in spark.createDataFrame([(s,) for s in texts], "s string").select("s", parse_instant(F.col("s")).cast("string").alias("t")).collect()}
    assert got == texts


def test_lookup_join_equals_a_plain_join(spark):
    c = spark.createDataFrame([(i, None if i % 11 == 0 else (0 if i % 3 == 0 else i % 5)) for i in range(500)], "i int, k int")
    p = spark.createDataFrame([(0, "z"), (1, "o"), (3, "t")], "k int, v string")
    for how in ("left", "inner"):
        assert sorted(map(str, lookup_join(c, p, ["k"], how, hot_rows=90).collect())) == sorted(map(str, c.join(p, ["k"], how).collect()))


def test_connected_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000, x) for x in range(1001, 1100)] + [(7000 + i, 7001 + i) for i in range(60)] + [(5, 5), (None, 3), (9999, 9999)]
    parent: dict = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long").repartition(7), "a", "b").collect()}
    assert got == {x: find(x) for x in parent}
    assert connected_components(spark.createDataFrame([], T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])), "a", "b").count() == 0
