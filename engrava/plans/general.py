"""Queries p1 and p7, and the SQL that they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from engrava.functions.instants import parse_instant
from engrava.operators.deliveries import DeliveryLog
from engrava.operators.references import dated_orphans, latest, orphans
from engrava.storage import materialize
from engrava.tables import load, table_path


def deliveries(spark: SparkSession, sf_dir: str) -> DeliveryLog:
    first_id = F.get(F.filter(F.col("message.content.id"), lambda x: x.isNotNull()), F.lit(0))
    return DeliveryLog(spark, table_path(sf_dir, "rank_reversed_planted"), "sessionId", first_id, "row_id")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deliveries(spark, sf_dir).removed(["row_id"])


def p1_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = deliveries(spark, sf_dir).kept(["row_id", "type", "sessionId", "message", "batch_id"])
    return kept.select("row_id", "type", "sessionId", "batch_id", F.size("message.content").alias("n_blocks"), F.aggregate("message.content", F.lit(0), lambda n, b: n + F.coalesce(F.length(b["text"]), F.lit(0))).alias("n_chars"))


def canonical_id(c):
    return F.lower(F.trim(F.regexp_replace(F.trim(c), r"[{}]", "")))


def edge_references(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The latest state of each edge, and of these the ones whose reference does not hold, with the reason."""
    edges = load(spark, sf_dir, "edges").select("src", canonical_id(F.col("dst")).alias("dst"), "edge_type", parse_instant(F.col("updated_at")).alias("updated"))
    records = load(spark, sf_dir, "records").select("id", parse_instant(F.col("tombstoned_at")).alias("gone"), parse_instant(F.col("created_at")).alias("made"))
    now = materialize(latest(edges, ["src", "dst", "edge_type"], "updated"), "edges")
    return now, dated_orphans(now, records, "dst", "updated", "id", "gone", "made")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edge_references(spark, sf_dir)[1].select("src", "dst", "edge_type", "reason")


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    now, absent = edge_references(spark, sf_dir)
    rows = now.select("edge_type", "updated", F.lit(1).alias("edge"), F.lit(None).cast("string").alias("reason")).union(absent.select("edge_type", "updated", F.lit(0), "reason"))
    n = lambda r: F.count_if(F.col("reason") == r).alias(f"n_{r}")
    month = F.coalesce(F.date_format("updated", "yyyy-MM"), F.lit("unknown")).alias("month")
    return rows.groupBy("edge_type", month).agg(F.count_if(F.col("edge") == 1).alias("n_edges"), n("missing"), n("deleted"), n("late"))


def p7_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphans of a two-column key with nulls under MATCH PARTIAL: (record, tag) of records' own tags against record_tags."""
    r = load(spark, sf_dir, "records").select("vec_label", F.when(F.col("embedding_pending") == 0, F.col("id")).alias("id"), F.when(F.col("role").isNotNull(), F.concat(F.lit("role:"), F.col("role"))).alias("tag"))
    return orphans(r, load(spark, sf_dir, "record_tags"), ["id", "tag"], ["record_id", "tag"], "partial").select("vec_label", "null_mask")


QUERIES = {"p1_found": p1_found, "p1_kept": p1_kept, "p7_found": p7_found, "p7_report": p7_report, "p7_composite": p7_composite}

_DUPS = """SELECT *, CASE WHEN trim(coalesce(sessionId, '')) <> '' AND mid IS NOT NULL THEN row_number() OVER (PARTITION BY sessionId, mid ORDER BY row_id) ELSE 1 END AS rn
FROM (SELECT *, list_filter(list_transform(message.content, lambda b: b.id), lambda x: x IS NOT NULL)[1] AS mid FROM rank_reversed_planted)"""
_INSTANT = "CASE WHEN regexp_matches(trim({0}), '^\\d{{4}}-\\d\\d-\\d\\d[T ]\\d\\d:\\d\\d:\\d\\d([.]\\d+)?([Zz]|[+-]\\d\\d:?\\d\\d)$') THEN try_cast(trim({0}) AS TIMESTAMPTZ) AT TIME ZONE 'UTC' ELSE try_cast(trim({0}) AS TIMESTAMP) END"
_STATES = f"""SELECT e.src, e.dst, e.edge_type, e.updated,
 CASE WHEN r.id IS NULL THEN 'missing' WHEN r.gone <= e.updated THEN 'deleted' WHEN r.made > e.updated THEN 'late' END AS reason
FROM (SELECT src, lower(trim(regexp_replace(trim(dst), '[{{}}]', '', 'g'))) AS dst, edge_type, max({_INSTANT.format("updated_at")}) AS updated FROM edges GROUP BY ALL) e
LEFT JOIN (SELECT id, {_INSTANT.format("tombstoned_at")} AS gone, {_INSTANT.format("created_at")} AS made FROM records) r ON e.dst = r.id"""

SQL = {
    "p1_found": f"SELECT row_id FROM ({_DUPS}) WHERE rn > 1",
    "p1_kept": f"SELECT row_id, type, sessionId, batch_id, CAST(len(message.content) AS INT) AS n_blocks, CAST(coalesce(list_sum(list_transform(message.content, lambda b: length(b.text))), 0) AS INT) AS n_chars FROM ({_DUPS}) WHERE rn = 1",
    "p7_found": f"SELECT src, dst, edge_type, reason FROM ({_STATES}) WHERE reason IS NOT NULL",
    "p7_report": f"""SELECT edge_type, coalesce(strftime(updated, '%Y-%m'), 'unknown') AS month, count(*) AS n_edges, count(*) FILTER (reason = 'missing') AS n_missing,
 count(*) FILTER (reason = 'deleted') AS n_deleted, count(*) FILTER (reason = 'late') AS n_late FROM ({_STATES}) GROUP BY ALL""",
    "p7_composite": """WITH r AS (SELECT vec_label, CASE WHEN embedding_pending = 0 THEN id END AS id, 'role:' || role AS tag FROM records)
SELECT vec_label, CASE WHEN id IS NULL THEN 1 ELSE 0 END + CASE WHEN tag IS NULL THEN 2 ELSE 0 END AS null_mask FROM r
WHERE NOT (id IS NULL AND tag IS NULL) AND NOT EXISTS (SELECT 1 FROM record_tags t WHERE (r.id IS NULL OR t.record_id = r.id) AND (r.tag IS NULL OR t.tag = r.tag) AND (r.id IS NULL OR t.record_id IS NOT NULL) AND (r.tag IS NULL OR t.tag IS NOT NULL))""",
}
