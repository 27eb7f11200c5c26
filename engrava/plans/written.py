"""Writes as table-to-table transforms, and maintenance of records and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from engrava.functions.instants import parse_instant
from engrava.operators import store as st
from engrava.plans.general import _INSTANT
from engrava.plans.joined import _E, clean_edges
from engrava.plans.registry import Queries
from engrava.tables import load

q = Queries()
_MADE, _UPD = _INSTANT.format("created_at"), _INSTANT.format("updated_at")


def small(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "records").select("vec_label", "tier", "stability", "detail_level")


_T = "(SELECT vec_label, tier, stability, detail_level FROM records)"
_NEW = "(SELECT vec_label + 3 AS vec_label, 'semantic' AS tier, 0.5::DOUBLE AS stability, 9 AS detail_level FROM records WHERE pinned)"


def incoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "records").where("pinned").select((F.col("vec_label") + 3).alias("vec_label"), F.lit("semantic").alias("tier"), F.lit(0.5).alias("stability"), F.lit(9).alias("detail_level"))


@q("write_insert", f"SELECT * FROM {_T} UNION ALL SELECT -1, NULL, 0.25, NULL")
def write_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return small(spark, sf_dir).unionByName(spark.createDataFrame([(-1, 0.25)], "vec_label long, stability double"), allowMissingColumns=True)


@q("write_insert_or_ignore", f"SELECT * FROM {_T} UNION ALL SELECT * FROM {_NEW} n WHERE vec_label NOT IN (SELECT vec_label FROM records)")
def write_insert_or_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.insert_or_ignore(small(spark, sf_dir), incoming(spark, sf_dir), ["vec_label"])


@q("write_insert_or_replace", f"SELECT * FROM {_T} WHERE vec_label NOT IN (SELECT vec_label FROM {_NEW}) UNION ALL SELECT * FROM {_NEW}")
def write_insert_or_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.upsert(small(spark, sf_dir), incoming(spark, sf_dir), ["vec_label"])


@q("write_upsert_columns", f"SELECT coalesce(t.vec_label, n.vec_label) AS vec_label, coalesce(t.tier, n.tier) AS tier, coalesce(n.stability, t.stability) AS stability, coalesce(t.detail_level, n.detail_level) AS detail_level FROM {_T} t FULL JOIN {_NEW} n ON t.vec_label = n.vec_label")
def write_upsert_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.upsert(small(spark, sf_dir), incoming(spark, sf_dir), ["vec_label"], ["stability"])


@q("write_update", "SELECT vec_label, CASE WHEN tier = 'episodic' THEN difficulty ELSE stability END AS stability, CASE WHEN tier = 'episodic' THEN stability ELSE difficulty END AS difficulty FROM records")
def write_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = load(spark, sf_dir, "records").select("vec_label", "tier", "stability", "difficulty")
    return st.update_where(t, F.col("tier") == "episodic", {"stability": F.col("difficulty"), "difficulty": F.col("stability")}).drop("tier")


@q("write_delete", "SELECT vec_label, role FROM records WHERE role <> 'user' OR role IS NULL")
def write_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.delete_where(load(spark, sf_dir, "records").select("vec_label", "role"), F.col("role") == "user")


@q("write_update_by_id", "SELECT r.vec_label, coalesce(c.s, r.stability) AS stability FROM records r LEFT JOIN (SELECT vec_label, 0.75::DOUBLE AS s FROM records WHERE pinned) c ON c.vec_label = r.vec_label")
def write_update_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = load(spark, sf_dir, "records")
    return st.update_by_id(r.select("vec_label", "stability"), r.where("pinned").select("vec_label", F.lit(0.75).alias("stability")), "vec_label")


@q("write_boost_edges", f"""WITH d AS (SELECT least(src, dst) AS src, greatest(src, dst) AS dst, edge_type, 0.05 * count(*) AS delta FROM {_E} WHERE edge_type = 'hebbian' GROUP BY ALL), o AS (SELECT least(src, dst) AS src, greatest(src, dst) AS dst, edge_type, sum(weight) AS weight FROM {_E} GROUP BY ALL)
SELECT src, dst, edge_type, round(coalesce(weight, 0) + coalesce(delta, 0), 6)::DOUBLE AS weight FROM o FULL JOIN d USING (src, dst, edge_type)""")
def write_boost_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = clean_edges(spark, sf_dir)
    deltas = e.where("edge_type = 'hebbian'").select(F.col("src").alias("a"), F.col("dst").alias("b"), "edge_type", F.lit(0.05).alias("delta"))
    return st.boost_edges(e, deltas).withColumn("weight", F.round("weight", 6))


@q("write_schema_evolution", "SELECT vec_label, tier AS kind, 0 AS added FROM records")
def write_schema_evolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return small(spark, sf_dir).withColumn("added", F.lit(0)).withColumnRenamed("tier", "kind").drop("stability", "detail_level")


_AGE = f"(epoch(TIMESTAMP '2026-09-01 00:00:00') - epoch({_MADE})) / 86400"


@q("maintain_erasure", f"SELECT vec_label FROM records WHERE centrality < 0.02 AND {_AGE} > 30 AND coalesce((epoch(TIMESTAMP '2026-09-01 00:00:00') - epoch({_UPD})) / 86400 > 30, TRUE) AND NOT coalesce(pinned OR never_decay OR trim(coalesce(tombstoned_at, '')) <> '', FALSE)")
def maintain_erasure(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = lambda c: (F.unix_micros(F.lit("2026-09-01 00:00:00Z").cast("timestamp")) - F.unix_micros(parse_instant(F.col(c)))) / 86400e6
    kept = F.expr("pinned OR never_decay OR trim(coalesce(tombstoned_at, '')) <> ''")
    return load(spark, sf_dir, "records").where(st.erasable(days("created_at"), days("updated_at"), F.col("centrality"), kept)).select("vec_label")


@q("maintain_procedural_decay", f"SELECT vec_label FROM records WHERE tier = 'procedural' AND {_AGE} > 180 AND (epoch(TIMESTAMP '2026-09-01 00:00:00') - epoch({_UPD})) / 86400 > 90")
def maintain_procedural_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = lambda c: (F.unix_micros(F.lit("2026-09-01 00:00:00Z").cast("timestamp")) - F.unix_micros(parse_instant(F.col(c)))) / 86400e6
    return load(spark, sf_dir, "records").where((F.col("tier") == "procedural") & (days("created_at") > 180) & (days("updated_at") > 90)).select("vec_label")


_KINDS = ["hebbian", "hebbian_cluster_replay", "entity_shared", "curiosity_bridge"]


@q("maintain_edge_decay", f"WITH e AS (SELECT src, lower(trim(regexp_replace(trim(dst), '[{{}}]', '', 'g'))) AS dst, edge_type, max(weight) AS weight, max({_UPD}) AS upd FROM edges GROUP BY ALL), d AS (SELECT *, (epoch(TIMESTAMP '2026-09-01 00:00:00') - epoch(upd)) / 86400 AS idle FROM e), w AS (SELECT src, dst, edge_type, weight AS w0, idle, coalesce(edge_type IN ('hebbian', 'hebbian_cluster_replay', 'entity_shared', 'curiosity_bridge') AND idle > 90, FALSE) AS old FROM d) SELECT src, dst, edge_type, round(CASE WHEN old THEN w0 * pow(0.9, idle - 90) ELSE w0 END, 6) AS weight FROM w WHERE NOT old OR w0 * pow(0.9, idle - 90) >= 0.01")
def maintain_edge_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    from engrava.plans.general import canonical_id

    e = load(spark, sf_dir, "edges").select("src", canonical_id(F.col("dst")).alias("dst"), "edge_type", "weight", parse_instant(F.col("updated_at")).alias("u")).groupBy("src", "dst", "edge_type").agg(F.max("weight").alias("weight"), F.max("u").alias("u"))
    idle = F.coalesce((F.unix_micros(F.lit("2026-09-01 00:00:00Z").cast("timestamp")) - F.unix_micros("u")) / 86400e6, F.lit(0.0))
    return st.decayed(e, idle, _KINDS).select("src", "dst", "edge_type", F.round("weight", 6).alias("weight"))


@q("maintain_contradict", "SELECT src, dst, edge_type FROM edges WHERE edge_type = 'contradicts' UNION ALL SELECT id, 'new-' || id, 'contradicts' FROM records WHERE pinned")
def maintain_contradict(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "edges").where("edge_type = 'contradicts'").select("src", "dst", "edge_type")
    return e.union(load(spark, sf_dir, "records").where("pinned").select("id", F.concat(F.lit("new-"), "id"), F.lit("contradicts")))


@q("maintain_stability", f"WITH c AS (SELECT DISTINCT src FROM {_E} WHERE edge_type = 'contradicts'), h AS (SELECT DISTINCT src FROM {_E} WHERE edge_type = 'hebbian') SELECT vec_label, round(least(1.0, greatest(0.0, stability + CASE WHEN id IN (FROM h) THEN 0.05 ELSE 0 END - CASE WHEN id IN (FROM c) THEN 0.2 ELSE 0 END)), 6)::DOUBLE AS stability FROM records")
def maintain_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = clean_edges(spark, sf_dir).where("edge_type IN ('hebbian', 'contradicts')").groupBy(F.col("src").alias("id")).agg(F.bool_or(F.col("edge_type") == "hebbian").alias("h"), F.bool_or(F.col("edge_type") == "contradicts").alias("c"))
    return load(spark, sf_dir, "records").join(e, "id", "left").select("vec_label", F.round(st.restabilised(F.col("stability"), F.coalesce("h", F.lit(False)), F.coalesce("c", F.lit(False))), 6).alias("stability"))


@q("maintain_dedupe_by_tag", "SELECT tag, min(record_id) AS kept, count(DISTINCT record_id) - 1 AS n_dropped FROM record_tags WHERE tag LIKE 'topic:%' GROUP BY tag")
def maintain_dedupe_by_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "record_tags").where("tag like 'topic:%'").groupBy("tag").agg(F.min("record_id").alias("kept"), (F.countDistinct("record_id") - 1).alias("n_dropped"))


@q("maintain_edge_hygiene", f"SELECT e.src, e.dst, e.edge_type FROM {_E} e JOIN records a ON a.id = e.src JOIN records b ON b.id = e.dst WHERE e.src <> e.dst AND NOT (e.edge_type = 'schema_instance_of' AND b.tier <> 'semantic')")
def maintain_edge_hygiene(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = load(spark, sf_dir, "records").select("id", "tier")
    e = clean_edges(spark, sf_dir).where("src <> dst").join(r.select(F.col("id").alias("src")), "src", "left_semi").join(r.toDF("dst", "tier"), "dst")
    return e.where("NOT (edge_type = 'schema_instance_of' AND tier <> 'semantic')").select("src", "dst", "edge_type")


q.statement("export_salient", "SELECT vec_label, id, centrality FROM records ORDER BY centrality DESC, vec_label LIMIT 1000", "SELECT vec_label, id, centrality FROM records ORDER BY centrality DESC NULLS LAST, vec_label LIMIT 1000")
q.statement("pinned_details", "SELECT vec_label, substring(literal_surface, 1, 100) AS head FROM records WHERE pinned AND detail_level >= 2 ORDER BY detail_level DESC, vec_label LIMIT 10")
QUERIES, SQL = q.queries, q.sql
