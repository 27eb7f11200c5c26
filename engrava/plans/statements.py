"""The embedded SQL engine's surface: scans, projections, predicates, grouping, ordering, as Spark SQL and columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from engrava.functions import dialect
from engrava.plans.registry import Queries, run_sql
from engrava.tables import load

q = Queries()

# ---- scans
q.statement("scan_full", "SELECT * FROM communities")
q.statement("scan_projected", "SELECT vec_label, tier FROM records WHERE detail_level >= 2 AND pinned")
q.statement("scan_count", "SELECT count(*) AS n FROM records")
q.statement("scan_point_lookup", "SELECT r.vec_label, r.tier FROM records r JOIN (SELECT max(id) AS id FROM records) x ON r.id = x.id")
q.statement("scan_key_set", "SELECT vec_label, role FROM records WHERE language IN ('de', 'fr') AND tier IN ('episodic', 'semantic')")
q.statement("scan_key_range", "SELECT vec_label, id FROM records WHERE id BETWEEN '10000000' AND '3fffffff'")
q.statement("scan_ordered_walk", "SELECT vec_label, centrality FROM records WHERE centrality >= 0.5 ORDER BY centrality DESC, vec_label LIMIT 25")
q.statement("scan_keyset_page", "SELECT vec_label, id FROM records WHERE id > '7' ORDER BY id LIMIT 50")
q.statement("scan_segments_minus_tombstones", "SELECT e.src, e.dst, e.edge_type FROM edges e LEFT ANTI JOIN (SELECT id FROM records WHERE trim(coalesce(tombstoned_at, '')) <> '') t ON e.src = t.id", "SELECT src, dst, edge_type FROM edges WHERE NOT EXISTS (SELECT 1 FROM records r WHERE r.id = src AND trim(coalesce(tombstoned_at, '')) <> '')")


@q("scan_catalog", "SELECT column_name, lower(column_name) AS folded FROM (DESCRIBE records)")
def scan_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(f.name, f.name.lower()) for f in load(spark, sf_dir, "records").schema], "column_name string, folded string")


@q("scan_table_info", "SELECT column_name AS name, CAST(row_number() OVER () - 1 AS INT) AS cid FROM (DESCRIBE edges)")
def scan_table_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(f.name, i) for i, f in enumerate(load(spark, sf_dir, "edges").schema)], "name string, cid int")


@q("scan_file_sizes")
def scan_file_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = load(spark, sf_dir, "records")
    return t.groupBy(t.metadataColumn("_metadata")["file_path"].alias("path")).agg(F.max(t.metadataColumn("_metadata")["file_size"]).alias("bytes"), F.count("*").alias("n_rows"))


@q("scan_batches", "SELECT count(*) AS n_rows, sum(vec_label) AS label_sum FROM records")
def scan_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    import pyarrow as pa
    import pyarrow.compute as pc

    def sums(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64()), pa.array([pc.sum(b.column(0)).as_py() or 0], pa.int64())], names=["n", "s"])

    parts = load(spark, sf_dir, "records").select("vec_label").mapInArrow(sums, "n long, s long")
    return parts.agg(F.sum("n").alias("n_rows"), F.sum("s").alias("label_sum"))


# ---- projections and predicates
q.statement("select_columns", "SELECT id, tier, language FROM records")
q.statement("select_aliases", "SELECT r.vec_label AS label, r.tier kind FROM records r")
q.statement("select_literals", "SELECT vec_label, 1 AS one, 2.5 AS half, 'x' AS word, NULL AS none, TRUE AS yes FROM records", "SELECT vec_label, 1 AS one, 2.5 AS half, 'x' AS word, NULL AS none, TRUE AS yes FROM records")
q.statement("select_coalesce", "SELECT vec_label, coalesce(role, 'none') AS role FROM records")
q.statement("where_comparisons", "SELECT vec_label FROM records WHERE stability < 0.5 AND difficulty >= 0.1 AND tier <> 'semantic' AND detail_level = 1 AND centrality > 0.2 AND valence <= 0.4")
q.statement("where_three_valued", "SELECT vec_label FROM records WHERE NOT (role = 'user') OR (language = 'en' AND role IS NULL)")
q.statement("where_null_tests", "SELECT count(*) AS n FROM records WHERE embedding IS NULL OR tags_json IS NOT NULL")
q.statement("where_in_with_null", "SELECT vec_label FROM records WHERE role IN ('user', NULL)")
q.statement("where_not_in_with_null", "SELECT vec_label FROM records WHERE role NOT IN ('user', NULL)")
q.statement("where_like_folded", "SELECT vec_label FROM records WHERE literal_surface ILIKE '%THE QUOTA%'")
q.statement("where_bool_as_number", "SELECT CAST(pinned AS INT) AS p, count(*) AS n FROM records GROUP BY 1")


@q("where_like_ascii", "SELECT vec_label FROM records WHERE translate(literal_surface, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') LIKE '%nach ___ minuten%'")
def where_like_ascii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "records").where(dialect.like_ascii(F.col("literal_surface"), "%NACH ___ Minuten%")).select("vec_label")


@q("where_truthy", "SELECT vec_label FROM records WHERE length(role) > 0 AND centrality <> 0")
def where_truthy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "records").where(dialect.truthy(F.col("role"), "string") & dialect.truthy(F.col("centrality"), "double")).select("vec_label")


@q("where_text_affinity", "SELECT o_orderkey FROM (SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS k FROM orders UNION ALL SELECT -1, '007') WHERE k = '7'")
def where_text_affinity(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderkey").cast("string").alias("k"))
    more = spark.createDataFrame([(-1, "007")], "o_orderkey long, k string")
    return o.union(more).where(dialect.equals_as_text(F.col("k"), 7)).select("o_orderkey")


@q("where_storage_classes", "SELECT vec_label FROM records WHERE CASE WHEN vec_label % 3 = 0 THEN NULL WHEN vec_label % 3 = 1 THEN centrality < 0.5 ELSE FALSE END")
def where_storage_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = load(spark, sf_dir, "records")
    m = F.col("vec_label") % 3
    cell = dialect.storage_class(F.when(m == 1, F.col("centrality")), F.when(m == 2, F.col("tier")))
    return r.where(dialect.typed_less(cell, dialect.storage_class(F.lit(0.5)))).select("vec_label")


@q("where_parameters", "SELECT vec_label, tier FROM records WHERE tier = 'semantic' AND detail_level >= 2")
def where_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_sql(spark, sf_dir, "SELECT vec_label, tier FROM records WHERE tier = :tier AND detail_level >= :least", {"tier": "semantic", "least": 2})


@q("where_positional_parameters", "SELECT count(*) AS n FROM edges WHERE edge_type = 'hebbian' AND weight > 0.5")
def where_positional_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_sql(spark, sf_dir, "SELECT count(*) AS n FROM edges WHERE edge_type = ? AND weight > ?", ["hebbian", 0.5])


_UTC = "CASE WHEN regexp_matches(created_at, '([Zz]|[+-]\\d\\d:?\\d\\d)$') AND length(created_at) > 10 THEN try_cast(created_at AS TIMESTAMPTZ) AT TIME ZONE 'UTC' ELSE try_cast(created_at AS TIMESTAMP) END"


@q("fn_datetime", f"SELECT vec_label, strftime({_UTC}, '%Y-%m-%d %H:%M:%S') AS at FROM records")
def fn_datetime(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "records").select("vec_label", dialect.datetime_text(F.col("created_at")).alias("at"))


@q("fn_datetime_unixepoch", "SELECT event_id, strftime(make_timestamp((1700000000 + event_id) * 1000000), '%Y-%m-%d %H:%M:%S') AS at FROM events")
def fn_datetime_unixepoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").select("event_id", dialect.datetime_text(F.lit(1700000000) + F.col("event_id"), unixepoch=True).alias("at"))


@q("builder_chain", "SELECT id, tier FROM records WHERE tier = 'episodic' AND language = 'en' ORDER BY vec_label LIMIT 20")
def builder_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    from engrava.operators.store import TableQuery

    return TableQuery(load(spark, sf_dir, "records")).where("tier = 'episodic'").where("language = 'en'").select("id", "tier").order_by("vec_label").limit(20).to_df()


@q("rowid_by_key", "SELECT id, row_number() OVER (ORDER BY id) AS rid FROM communities")
def rowid_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_sql(spark, sf_dir, "SELECT community_id AS id, row_number() OVER (ORDER BY community_id) AS rid FROM communities")


q.sql["rowid_by_key"] = "SELECT community_id AS id, row_number() OVER (ORDER BY community_id) AS rid FROM communities"

# ---- aggregates and groups
q.statement("agg_sum", "SELECT edge_type, round(sum(weight), 4) AS s, count(*) AS n FROM edges GROUP BY edge_type")
q.statement("agg_sum_integers", "SELECT sum(vec_label) AS s, sum(CASE WHEN vec_label < 0 THEN vec_label END) AS none FROM records", "SELECT CAST(sum(vec_label) AS BIGINT) AS s, CAST(sum(CASE WHEN vec_label < 0 THEN vec_label END) AS BIGINT) AS none FROM records")
q.statement("agg_min_max", "SELECT min(id) AS lo, max(id) AS hi, min(centrality) AS c0, max(centrality) AS c1 FROM records")
q.statement("agg_limit_zero", "SELECT count(*) AS n FROM records LIMIT 0")
q.statement("group_count", "SELECT role, count(*) AS n FROM records GROUP BY role")
q.statement("group_first_row", "SELECT language, count(*) AS n, min_by(id, vec_label) AS id FROM records GROUP BY language", "SELECT language, count(*) AS n, arg_min(id, vec_label) AS id FROM records GROUP BY language")
q.statement("group_having", "SELECT tag, count(*) AS n FROM record_tags GROUP BY tag HAVING count(*) >= 5")
q.statement("group_distinct_rows", "SELECT tier FROM records GROUP BY tier")
q.statement("group_order_limit_offset", "SELECT tag, count(*) AS n FROM record_tags GROUP BY tag ORDER BY n DESC, tag LIMIT 10 OFFSET 5")
q.statement("overview_counts", "SELECT count(CASE WHEN tier = 'episodic' THEN 1 END) AS episodic, count(CASE WHEN tier = 'semantic' THEN 1 END) AS semantic, count(CASE WHEN tier = 'procedural' THEN 1 END) AS procedural, count(CASE WHEN trim(coalesce(tombstoned_at, '')) <> '' THEN 1 END) AS tombstoned FROM records")
q.statement("group_cube", "SELECT tier, language, count(*) AS n FROM records GROUP BY CUBE (tier, language)")
q.statement("group_grouping_sets", "SELECT tier, role, count(*) AS n FROM records GROUP BY GROUPING SETS ((tier), (role), ())")
q.statement("agg_distinct", "SELECT language, count(DISTINCT community_id) AS n FROM records GROUP BY language")

# ---- order, limits, sets
q.statement("order_nulls_first", "SELECT vec_label, role FROM records ORDER BY role ASC, vec_label LIMIT 40", "SELECT vec_label, role FROM records ORDER BY role ASC NULLS FIRST, vec_label LIMIT 40")
q.statement("order_nulls_last", "SELECT vec_label, role FROM records ORDER BY role DESC, vec_label LIMIT 40", "SELECT vec_label, role FROM records ORDER BY role DESC NULLS LAST, vec_label LIMIT 40")
q.statement("order_alias", "SELECT edge_type, count(*) AS n FROM edges GROUP BY edge_type ORDER BY n DESC, edge_type LIMIT 3")
q.statement("order_large_integers", "SELECT big FROM (SELECT 9007199254740992 + vec_label AS big FROM records) ORDER BY big DESC LIMIT 7")
q.statement("limit_offset", "SELECT vec_label FROM records ORDER BY vec_label LIMIT 10 OFFSET 30")
q.statement("limit_zero", "SELECT vec_label, id FROM records LIMIT 0")
q.statement("set_union", "SELECT src AS id FROM edges WHERE edge_type = 'contradicts' UNION SELECT dst FROM edges WHERE edge_type = 'contradicts'")
q.statement("set_intersect", "SELECT src AS id FROM edges INTERSECT SELECT id FROM records WHERE pinned")
q.statement("set_except", "SELECT id FROM records WHERE trim(coalesce(tombstoned_at, '')) = '' OR tombstoned_at IS NULL EXCEPT SELECT src FROM edges")


@q("order_by_datetime", f"SELECT vec_label FROM records ORDER BY {_UTC} DESC, vec_label LIMIT 30")
def order_by_datetime(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "records").orderBy(F.desc(dialect.parse_instant(F.col("created_at"))), "vec_label").limit(30).select("vec_label")


QUERIES, SQL = q.queries, q.sql
