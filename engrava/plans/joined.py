"""Joins and join-like operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from engrava.functions.instants import parse_instant
from engrava.functions.vector import cosine
from engrava.operators import joins
from engrava.operators.pairs import near_pairs
from engrava.plans.general import _INSTANT, canonical_id
from engrava.plans.registry import Queries
from engrava.tables import load

q = Queries()
_MADE = _INSTANT.format("created_at")
_E = "(SELECT src, lower(trim(regexp_replace(trim(dst), '[{}]', '', 'g'))) AS dst, edge_type, max(weight) AS weight FROM edges GROUP BY ALL)"
_BOTH = f"(SELECT src AS node, dst AS other, edge_type, weight FROM {_E} UNION ALL SELECT dst, src, edge_type, weight FROM {_E} WHERE src <> dst)"


def clean_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (src, dst, edge_type), dst in canonical form, with its greatest weight."""
    return load(spark, sf_dir, "edges").select("src", canonical_id(F.col("dst")).alias("dst"), "edge_type", "weight").groupBy("src", "dst", "edge_type").agg(F.max("weight").alias("weight"))


def made(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "records").select("id", parse_instant(F.col("created_at")).alias("made"))


q.statement("join_edges_to_records", "SELECT e.src, e.edge_type, r.tier, r.vec_label FROM edges e JOIN records r ON e.src = r.id")
q.statement("join_live_endpoints", "SELECT e.src, e.dst, e.edge_type FROM edges e WHERE EXISTS (SELECT 1 FROM records a WHERE a.id = e.src AND a.live = 1) AND EXISTS (SELECT 1 FROM records b WHERE b.id = e.dst AND b.live = 1)")
q.statement("join_orphan_sweep", "SELECT e.src, e.dst, e.edge_type FROM edges e LEFT ANTI JOIN records r ON e.dst = r.id", "SELECT e.src, e.dst, e.edge_type FROM edges e WHERE NOT EXISTS (SELECT 1 FROM records r WHERE e.dst = r.id)")
q.statement("join_tag_lookup", "SELECT t.tag, min(r.vec_label) AS first_label, count(DISTINCT r.id) AS n FROM record_tags t JOIN records r ON r.id = t.record_id GROUP BY t.tag")
q.statement("join_schema_evidence", "SELECT r.id, count(e.src) AS n, count(CASE WHEN e.weight < 0 THEN 1 END) AS n_negative FROM (SELECT id FROM records WHERE tier = 'semantic') r LEFT JOIN edges e ON e.dst = r.id AND e.edge_type = 'schema_instance_of' GROUP BY r.id")
q.statement("join_definitions_references", "SELECT d.record_id AS defined_in, r.record_id AS used_in, d.tag FROM (SELECT tag, min(record_id) AS record_id FROM record_tags WHERE tag LIKE 'topic:%' GROUP BY tag) d JOIN (SELECT DISTINCT record_id, tag FROM record_tags) r ON d.tag = r.tag AND d.record_id <> r.record_id")
q.statement("join_contradicting_hits", "SELECT a.vec_label AS a, b.vec_label AS b FROM records a JOIN edges e ON e.src = a.id AND e.edge_type = 'contradicts' JOIN records b ON e.dst = b.id WHERE a.language = 'en' AND b.language = 'en'")


@q("join_asof", """SELECT p.event_id, p.user_id, c.r_event_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p
ASOF JOIN (SELECT user_id AS u, ts AS t, max(event_id) AS r_event_id FROM events WHERE event_type = 'click' GROUP BY ALL) c ON p.user_id = c.u AND p.ts >= c.t""")
def join_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events")
    got = joins.asof_backward(e.where("event_type = 'purchase'"), e.where("event_type = 'click'"), ["user_id"], "ts", "ts", ["event_id"])
    return got.select("event_id", "user_id", "r_event_id")


@q("join_asof_intersection", """WITH p AS (SELECT p.event_id, p.value AS v, c.value AS w FROM (SELECT * FROM events WHERE event_type = 'purchase') p
ASOF JOIN (SELECT user_id AS u, ts AS t, arg_max(value, event_id) AS value FROM events WHERE event_type = 'view' GROUP BY ALL) c ON p.user_id = c.u AND p.ts >= c.t)
SELECT count(*) AS n_pairs, count(*) FILTER (v >= w) AS n_risen FROM p""")
def join_asof_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events")
    got = joins.asof_backward(e.where("event_type = 'purchase'"), e.where("event_type = 'view'"), ["user_id"], "ts", "ts", ["event_id", "value"])
    return got.agg(F.count("*").alias("n_pairs"), F.count_if(F.col("value") >= F.col("r_value")).alias("n_risen"))


@q("join_validity", f"""WITH r AS (SELECT id, {_MADE} AS made FROM records), e AS (SELECT DISTINCT src, dst FROM {_E} WHERE edge_type = 'contradicts'),
x AS (SELECT e.src, min(b.made) AS valid_to FROM e JOIN r a ON a.id = e.src JOIN r b ON b.id = e.dst WHERE b.made > a.made GROUP BY 1)
SELECT r.id, strftime(r.made, '%Y-%m-%d %H:%M:%S') AS valid_from, strftime(x.valid_to, '%Y-%m-%d %H:%M:%S') AS valid_to FROM r LEFT JOIN x ON x.src = r.id""")
def join_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return joins.validity(made(spark, sf_dir), clean_edges(spark, sf_dir)).select("id", text("valid_from"), text("valid_to"))


@q("join_incident_topk", f"""SELECT node, other, edge_type, weight, CAST(row_number() OVER (PARTITION BY node ORDER BY weight DESC NULLS LAST, other, edge_type) AS INT) AS rank
FROM {_BOTH} WHERE node IN (SELECT id FROM records WHERE pinned) QUALIFY rank <= 5""")
def join_incident_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = load(spark, sf_dir, "records").where("pinned").select(F.col("id").alias("node"))
    return joins.incident(ids, clean_edges(spark, sf_dir), 5).select("node", "other", "edge_type", "weight", "rank")


@q("join_two_hops", f"""WITH nb AS (SELECT node, other, max(weight) AS weight FROM {_BOTH} GROUP BY ALL),
top AS (SELECT node, other FROM nb QUALIFY row_number() OVER (PARTITION BY node ORDER BY weight DESC NULLS LAST, other) <= 5),
f AS (SELECT node AS seed, other AS node FROM top WHERE node IN (SELECT id FROM records WHERE pinned) AND other <> node),
s AS (SELECT DISTINCT f.seed, t.other AS node FROM f JOIN top t ON f.node = t.node WHERE t.other <> f.seed)
SELECT seed, node, 1 AS hop FROM f UNION ALL SELECT seed, node, 2 FROM s WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.seed = s.seed AND f.node = s.node)""")
def join_two_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = load(spark, sf_dir, "records").where("pinned").select(F.col("id").alias("node"))
    return joins.two_hops(ids, clean_edges(spark, sf_dir), 5)


_HITS = "(SELECT id AS node, CAST(row_number() OVER (ORDER BY centrality DESC NULLS LAST, id) AS INT) AS rank FROM records QUALIFY rank <= 100)"


@q("join_anti_hits", f"WITH h AS MATERIALIZED (SELECT * FROM {_HITS}), b AS (SELECT * FROM {_BOTH} WHERE edge_type = 'contradicts') SELECT b.other, min(h.rank) AS of_rank FROM b JOIN h ON b.node = h.node LEFT JOIN h x ON x.node = b.other WHERE x.node IS NULL GROUP BY b.other ORDER BY of_rank, b.other LIMIT 3")
def join_anti_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    top = load(spark, sf_dir, "records").orderBy(F.desc("centrality"), "id").limit(100)
    hits = top.select(F.col("id").alias("node"), F.row_number().over(W.orderBy(F.desc("centrality"), "id")).alias("rank"))
    return joins.anti_hits(hits, clean_edges(spark, sf_dir))


@q("join_supersede_chain", f"""WITH RECURSIVE nx AS (SELECT src, min(dst) AS nxt FROM {_E} WHERE edge_type = 'contradicts' AND src <> dst GROUP BY src),
w(id, cur, hops) AS (SELECT src, src, 0 FROM nx UNION ALL SELECT w.id, nx.nxt, w.hops + 1 FROM w JOIN nx ON nx.src = w.cur WHERE w.hops < 8)
SELECT id, arg_max(cur, hops) AS current, CAST(max(hops) AS INT) AS hops FROM w GROUP BY id""")
def join_supersede_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.supersede_chain(load(spark, sf_dir, "records").select("id").union(clean_edges(spark, sf_dir).select("src")).distinct(), clean_edges(spark, sf_dir))


@q("join_similar_opposites", """WITH h AS (SELECT vec_id, embedding, label FROM embeddings ORDER BY vec_id LIMIT 60)
SELECT a.vec_id AS a, b.vec_id AS b FROM h a JOIN h b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.embedding, b.embedding) >= 0.5 AND a.label <> b.label""")
def join_similar_opposites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs among the served hits (at most 60, a report's size) that are alike but of opposite label."""
    h = load(spark, sf_dir, "embeddings").orderBy("vec_id").limit(60)
    a, b = h.alias("a"), h.alias("b")
    pairs = a.join(F.broadcast(b), F.col("a.vec_id") < F.col("b.vec_id")).where((F.col("a.label") != F.col("b.label")) & (cosine(F.col("a.embedding"), F.col("b.embedding")) >= 0.5))
    return pairs.select(F.col("a.vec_id").alias("a"), F.col("b.vec_id").alias("b"))


@q("join_similar_opposites_whole", "SELECT a.vec_id::BIGINT AS a, b.vec_id::BIGINT AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cos FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id AND a.label <> b.label WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.97")
def join_similar_opposites_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of different label and a cosine of at least 0.97."""
    e = load(spark, sf_dir, "embeddings")
    p = near_pairs(e.select(F.lit(0).alias("g"), F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("v")), 0.97)
    l = e.select(F.col("vec_id").cast("long").alias("id"), "label")  # noqa: E741
    return p.join(l.toDF("a", "la"), "a").join(l.toDF("b", "lb"), "b").where("la <> lb").select("a", "b", F.round("cos", 6).alias("cos"))


@q("join_band", "SELECT a.event_id AS a, b.event_id AS b FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 1 HOUR")
def join_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of one user within an hour after another. The equi-key is the user and the hour: a later event is sent under
    its own hour and the one before, so a user of many events is many keys."""
    e = load(spark, sf_dir, "events")
    hour = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000)
    a = e.select("user_id", F.col("event_id").alias("a"), F.col("ts").alias("ta"), hour.alias("h"))
    b = e.select("user_id", F.col("event_id").alias("b"), F.col("ts").alias("tb"), F.explode(F.array(hour, hour - 1)).alias("h"))
    return a.join(b, ["user_id", "h"]).where("tb > ta AND tb <= ta + INTERVAL 1 HOUR").select("a", "b")


QUERIES, SQL = q.queries, q.sql
