"""Retrieval and ranking: exact vector search, as-of recall, fused scores, adjustments, verdicts, event queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from engrava.functions import text as tx
from engrava.functions.instants import parse_instant
from engrava.functions.vector import cosine
from engrava.operators import joins, ranking as rk
from engrava.operators.store import TableQuery
from engrava.plans.general import _INSTANT
from engrava.plans.joined import _E, clean_edges, made
from engrava.plans.registry import Queries
from engrava.tables import load

q = Queries()
_MADE, _GONE = _INSTANT.format("created_at"), _INSTANT.format("tombstoned_at")
CUE = "the quota"


def with_query(df: DataFrame) -> DataFrame:
    """df with the query vector, one broadcast row: the embedding of least vec_id."""
    one = df.orderBy("vec_id").limit(1).select(F.col("embedding").alias("qv"))
    return df.join(F.broadcast(one))


_QV = "(SELECT embedding AS qv FROM embeddings ORDER BY vec_id LIMIT 1)"


@q("knn_exact", f"SELECT vec_id, round(1 - list_cosine_similarity(embedding::DOUBLE[], qv::DOUBLE[]), 6) AS distance FROM embeddings, {_QV} ORDER BY round(1 - list_cosine_similarity(embedding::DOUBLE[], qv::DOUBLE[]), 6), vec_id LIMIT 10")
def knn_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = with_query(load(spark, sf_dir, "embeddings"))
    return e.select("vec_id", F.round(1 - cosine(F.col("embedding"), F.col("qv")), 6).alias("distance")).orderBy("distance", "vec_id").limit(10)


@q("knn_builder")
def knn_builder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TableQuery(load(spark, sf_dir, "records")).search([1.0] + [0.5] * 63).where("tier = 'episodic'").select("vec_label").order_by("vec_label").limit(10).to_df()


@q("knn_filtered", f"SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], qv::DOUBLE[]), 6) AS cos FROM embeddings, {_QV} WHERE label IN (1, 2, 3) ORDER BY round(list_cosine_similarity(embedding::DOUBLE[], qv::DOUBLE[]), 6) DESC, vec_id LIMIT 10")
def knn_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = with_query(load(spark, sf_dir, "embeddings")).where("label IN (1, 2, 3)")
    return e.select("vec_id", F.round(cosine(F.col("embedding"), F.col("qv")), 6).alias("cos")).orderBy(F.desc("cos"), "vec_id").limit(10)


@q("recall_as_of", f"SELECT vec_label, strftime(made, '%Y-%m-%d %H:%M:%S') AS made FROM (SELECT vec_label, {_MADE} AS made, {_GONE} AS gone FROM records) WHERE made <= TIMESTAMP '2025-12-31 00:00:00' AND (gone IS NULL OR gone > TIMESTAMP '2025-12-31 00:00:00') ORDER BY made DESC, vec_label LIMIT 50")
def recall_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.lit("2025-12-31 00:00:00Z").cast("timestamp")
    r = load(spark, sf_dir, "records").select("vec_label", parse_instant(F.col("created_at")).alias("made"), parse_instant(F.col("tombstoned_at")).alias("gone"))
    return r.where((F.col("made") <= at) & (F.col("gone").isNull() | (F.col("gone") > at))).orderBy(F.desc("made"), "vec_label").limit(50).select("vec_label", F.date_format("made", "yyyy-MM-dd HH:mm:ss").alias("made"))


q.statement("changed_since", "SELECT event_id, event_type FROM events WHERE ts > TIMESTAMP_NTZ '2024-01-15 00:00:00' ORDER BY ts DESC, event_id LIMIT 100", "SELECT event_id, event_type FROM events WHERE ts > TIMESTAMP '2024-01-15 00:00:00' ORDER BY ts DESC, event_id LIMIT 100")
q.statement("event_query", "SELECT event_id, ts, user_id, value FROM events WHERE event_type = 'error' AND value > 10 ORDER BY ts DESC, event_id LIMIT 1000")
q.statement("event_session_query", "SELECT event_id, event_type FROM events WHERE user_id = 235 AND props LIKE '%k%' ORDER BY ts, event_id")
q.statement("event_audit", "SELECT event_type, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM events GROUP BY event_type")
q.statement("induced_patterns", "SELECT r.id, count(e.src) AS evidence FROM records r JOIN edges e ON e.dst = r.id AND e.edge_type = 'schema_instance_of' GROUP BY r.id ORDER BY evidence DESC, r.id LIMIT 3")
q.statement("mode_filter", "SELECT vec_label FROM records r WHERE tier = 'episodic' AND NOT EXISTS (SELECT 1 FROM record_tags t WHERE t.record_id = r.id AND t.tag LIKE 'pattern:%')")
q.statement("degraded_recall", "SELECT vec_label FROM records WHERE lower(literal_surface) LIKE '%the quota%' ORDER BY CASE salience_level WHEN 'critical' THEN 2 WHEN 'notable' THEN 1 ELSE 0 END DESC, vec_label DESC LIMIT 20")
q.statement("event_classes", "SELECT event_id, CASE WHEN event_type = 'error' THEN 'failure' WHEN event_type IN ('purchase', 'signup') THEN 'commit' ELSE 'activity' END AS category, CASE WHEN event_type = 'error' THEN 0 WHEN event_type IN ('purchase', 'signup') THEN 1 ELSE 2 END AS priority FROM events")


@q("recent_user_turns", """WITH d AS (SELECT *, CASE WHEN trim(coalesce(sessionId, '')) <> '' AND mid IS NOT NULL THEN row_number() OVER (PARTITION BY sessionId, mid ORDER BY row_id) ELSE 1 END AS rn FROM (SELECT *, list_filter(list_transform(message.content, lambda b: b.id), lambda x: x IS NOT NULL)[1] AS mid FROM rank_reversed_planted))
SELECT row_id, sessionId FROM d WHERE rn = 1 AND lower(message.role) = 'user' ORDER BY row_id DESC LIMIT 50""")
def recent_user_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from engrava.plans.general import deliveries

    turns = load(spark, sf_dir, "rank_reversed_planted").where("lower(message.role) = 'user'").select("row_id", "sessionId")
    return turns.join(deliveries(spark, sf_dir).redundant().select(F.col("ord").alias("row_id")), "row_id", "left_anti").orderBy(F.desc("row_id")).limit(50)


_DEG = f"(SELECT node, count(*) AS degree FROM (SELECT src AS node FROM {_E} UNION ALL SELECT dst FROM {_E} WHERE src <> dst) GROUP BY node)"
_TRI = "(CASE WHEN length({0}) >= 3 THEN list_distinct(list_transform(range(1, length({0}) - 1), lambda i: substring({0}, i, 3))) ELSE [] END)"
_FUSED = f"""WITH d AS MATERIALIZED (SELECT * FROM {_DEG}), r AS (SELECT r.id, r.vec_label, r.community_id, r.tier, r.salience_level, r.stability, r.valence, {_MADE} AS made, lower(literal_surface) AS t, list_cosine_similarity(e.embedding::DOUBLE[], qv::DOUBLE[]) AS cos FROM records r JOIN embeddings e ON e.vec_id = r.vec_label, {_QV}),
s AS (SELECT r.*, coalesce(d.degree, 0) AS degree, (SELECT max(degree) FROM d) AS md, greatest(0, epoch((SELECT max(made) FROM r)) - epoch(made)) / 86400 AS age,
 CASE WHEN t IS NOT NULL AND length(t) >= 3 THEN len(list_intersect({_TRI.format("t")}, {_TRI.format("'" + CUE + "'")})) / len(list_distinct(list_concat({_TRI.format("t")}, {_TRI.format("'" + CUE + "'")}))) ELSE 0 END AS tri, coalesce(contains(t, '{CUE}'), FALSE) AS whole FROM r LEFT JOIN d ON d.node = r.id),
f AS (SELECT *, ((cos + 0.1 * ln(1 + degree) / ln(1 + md) - 0.05 * least(1.0, coalesce(age, 0) / 30)) + (1 - least(1.0, coalesce(stability, 0.5))) * 0.1) * CASE WHEN valence > 0 THEN 1 + valence ELSE 1 END * CASE WHEN tri > 0.3 THEN 2 ELSE 1 END * CASE WHEN whole THEN 3 ELSE 1 END AS score FROM s)"""


def fused_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = with_query(load(spark, sf_dir, "embeddings")).select(F.col("vec_id").alias("vec_label"), cosine(F.col("embedding"), F.col("qv")).alias("cos"))
    r = load(spark, sf_dir, "records").select("id", "vec_label", "community_id", "tier", "salience_level", "stability", "valence", parse_instant(F.col("created_at")).alias("made"), F.col("literal_surface").alias("t")).join(e, "vec_label")
    edges = clean_edges(spark, sf_dir)
    d = edges.select(F.col("src").alias("id")).union(edges.where("src <> dst").select("dst")).groupBy("id").agg(F.count("*").alias("degree"))
    facts = d.agg(F.max("degree").alias("md")).join(r.agg(F.max("made").alias("now")))  # one row
    s = r.join(d, "id", "left").join(F.broadcast(facts))
    age = F.coalesce((F.unix_seconds("now") - F.unix_seconds("made")) / 86400, F.lit(0.0))
    score = rk.fused(F.col("cos"), F.lit(0.0), F.coalesce("degree", F.lit(0)), F.col("md"), age, F.col("stability"), F.col("valence"), F.coalesce(tx.trigram_jaccard(F.col("t"), F.lit(CUE)), F.lit(0.0)), F.coalesce(tx.contains_cue(F.col("t"), CUE), F.lit(False)))
    return s.withColumn("score", score)


@q("fused_score", f"{_FUSED} SELECT vec_label, round(score, 5) AS score FROM f")
def fused_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fused_hits(spark, sf_dir).select("vec_label", F.round("score", 5).alias("score"))


@q("fused_top", f"{_FUSED} SELECT vec_label, round(score, 5) AS score FROM f ORDER BY round(score, 5) DESC, vec_label LIMIT 10")
def fused_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fused_hits(spark, sf_dir).select("vec_label", F.round("score", 5).alias("score")).orderBy(F.desc("score"), "vec_label").limit(10)


@q("tier_boosted", f"{_FUSED} SELECT vec_label, round(score * CASE WHEN tier = 'semantic' THEN 1.05 + CASE WHEN salience_level IN ('notable', 'critical') THEN 0.5 ELSE 0 END ELSE 1.0 END * (1 + 0.05 * CASE salience_level WHEN 'critical' THEN 2 WHEN 'notable' THEN 1 ELSE 0 END), 5) AS score FROM f")
def tier_boosted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.when(F.col("salience_level") == "critical", 2).when(F.col("salience_level") == "notable", 1).otherwise(0)
    return fused_hits(spark, sf_dir).select("vec_label", F.round(F.col("score") * rk.tier_boost(F.col("tier"), F.col("salience_level"), rank), 5).alias("score"))


@q("community_gate", f"SELECT label, round(max(list_cosine_similarity(embedding::DOUBLE[], qv::DOUBLE[])), 6) AS best FROM embeddings, {_QV} GROUP BY label ORDER BY best DESC, label LIMIT 3")
def community_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = with_query(load(spark, sf_dir, "embeddings")).withColumn("cos", F.round(cosine(F.col("embedding"), F.col("qv")), 6))
    return rk.community_gate(e, "label", "cos")


@q("seed_widening", "WITH t AS (SELECT vec_label, 0 AS lane, row_number() OVER (ORDER BY centrality DESC NULLS LAST, vec_label) AS r FROM records QUALIFY r <= 3), u AS (SELECT * FROM t UNION ALL SELECT vec_label, 1, vec_label FROM records WHERE contains(lower(literal_surface), 'the quota') AND vec_label NOT IN (SELECT vec_label FROM t)) SELECT vec_label, lane FROM u ORDER BY lane, r LIMIT 6")
def seed_widening(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = load(spark, sf_dir, "records")
    top = r.orderBy(F.desc("centrality"), "vec_label").limit(3).select("vec_label", F.lit(0).alias("lane"))
    more = r.where(tx.contains_cue(F.col("literal_surface"), CUE)).join(F.broadcast(top), "vec_label", "left_anti").select("vec_label", F.lit(1).alias("lane")).orderBy("vec_label").limit(6)
    return top.union(more).orderBy("lane", "vec_label").limit(6)


_VAL = f"(SELECT e.src AS id, min(b.made) AS valid_to FROM (SELECT DISTINCT src, dst FROM {_E} WHERE edge_type = 'contradicts') e JOIN m a ON a.id = e.src JOIN m b ON b.id = e.dst WHERE b.made > a.made GROUP BY 1)"


@q("stale_down_weight", f"WITH m AS (SELECT id, vec_label, stability, {_MADE} AS made FROM records) SELECT m.vec_label, round(CASE WHEN v.valid_to < TIMESTAMP '2026-06-01 00:00:00' THEN stability * 0.5 ELSE stability END, 6) AS score FROM m LEFT JOIN {_VAL} v ON v.id = m.id")
def stale_down_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = joins.validity(made(spark, sf_dir), clean_edges(spark, sf_dir))
    r = load(spark, sf_dir, "records").select("id", "vec_label", "stability").join(v, "id", "left")
    return r.select("vec_label", F.round(rk.stale_down(F.col("stability"), F.col("valid_to"), F.lit("2026-06-01 00:00:00Z").cast("timestamp")), 6).alias("score"))


@q("supersede_cap")
def supersede_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = load(spark, sf_dir, "records").where("stability is not null").withColumn("r", F.row_number().over(W.partitionBy("language").orderBy(F.desc("stability"), "id"))).where("r <= 50")
    pairs = clean_edges(spark, sf_dir).where("edge_type = 'contradicts'").select(F.col("src").alias("id"), F.col("dst").alias("by"))
    return rk.supersede_capped(top.where("language is not null").select("language", "id", F.col("stability").alias("score")), "language", pairs)


@q("historical_anchor", f"WITH c AS (SELECT e.src AS id, max(r.stability) - 0.0001 AS up FROM (SELECT DISTINCT src, dst FROM {_E} WHERE edge_type = 'contradicts') e JOIN records r ON r.id = e.dst GROUP BY 1) SELECT r.vec_label, round(greatest(r.stability, coalesce(c.up, r.stability)), 6) AS score FROM records r LEFT JOIN c ON c.id = r.id")
def historical_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = load(spark, sf_dir, "records").select("id", "vec_label", "stability")
    up = clean_edges(spark, sf_dir).where("edge_type = 'contradicts'").select("src", "dst").distinct().join(r.select(F.col("id").alias("dst"), F.col("stability").alias("s")), "dst").groupBy(F.col("src").alias("id")).agg((F.max("s") - 1e-4).alias("up"))
    return r.join(up, "id", "left").select("vec_label", F.round(F.greatest("stability", F.coalesce("up", "stability")), 6).alias("score"))


@q("claim_check", f"""WITH m AS (SELECT id, vec_label, community_id, {_MADE} AS made FROM records), n AS (SELECT community_id, max(made) AS newest, count(*) AS n FROM m GROUP BY 1), x AS (SELECT DISTINCT src FROM {_E} WHERE edge_type = 'contradicts')
SELECT m.vec_label, CASE WHEN x.src IS NOT NULL THEN 'CONTRADICTED' WHEN n.n IS NULL THEN 'NO_EVIDENCE' WHEN (epoch(n.newest) - epoch(m.made)) / 86400 >= 7 THEN 'UNCONFIRMED' ELSE 'CURRENT' END AS verdict FROM m LEFT JOIN n ON n.community_id = m.community_id LEFT JOIN x ON x.src = m.id""")
def claim_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = load(spark, sf_dir, "records").select("id", "vec_label", "community_id", parse_instant(F.col("created_at")).alias("made"))
    n = m.where("community_id is not null").groupBy("community_id").agg(F.max("made").alias("newest"), F.count("*").alias("n"))
    x = clean_edges(spark, sf_dir).where("edge_type = 'contradicts'").select(F.col("src").alias("id"), F.lit(True).alias("x")).distinct()
    days = (F.unix_micros("newest") - F.unix_micros("made")) / 86400e6
    return m.join(n, "community_id", "left").join(x, "id", "left").select("vec_label", rk.claim_verdict(days, F.coalesce("x", F.lit(False)), F.coalesce("n", F.lit(0))).alias("verdict"))


@q("temporal_boost", f"SELECT vec_label, round(stability * CASE WHEN year(made) = 2025 AND month(made) = 3 THEN 1.15 ELSE 1 END, 6) AS score FROM (SELECT vec_label, stability, {_MADE} AS made FROM records)")
def temporal_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = tx.matches_dates(parse_instant(F.col("created_at")), tx.date_mentions("as of 2025-03"))
    return load(spark, sf_dir, "records").select("vec_label", F.round(F.col("stability") * F.when(hit, 1.15).otherwise(1.0), 6).alias("score"))


@q("authority_merge", "WITH h AS (SELECT vec_label, 1.0 AS a FROM records WHERE pinned), t AS (SELECT vec_label, stability AS b FROM records ORDER BY stability DESC NULLS LAST, vec_label LIMIT 50) SELECT vec_label, greatest(coalesce(a, -1), coalesce(b, -1))::DOUBLE AS score FROM h FULL JOIN t USING (vec_label)")
def authority_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = load(spark, sf_dir, "records")
    h = r.where("pinned").select("vec_label", F.lit(1.0).alias("a"))
    t = r.orderBy(F.desc("stability"), "vec_label").limit(50).select("vec_label", F.col("stability").alias("b"))
    return h.join(t, "vec_label", "full_outer").select("vec_label", F.greatest("a", "b").alias("score"))


@q("procedural_priming", f"WITH nx AS (SELECT src, min(dst) AS nxt FROM {_E} WHERE edge_type = 'temporal_next' GROUP BY src), s AS (SELECT id, stability FROM records ORDER BY stability DESC NULLS LAST, id LIMIT 20) SELECT r.vec_label, round(least(r.stability * 1.05, (SELECT max(stability) FROM s)), 6) AS score FROM records r WHERE r.id IN (SELECT nxt FROM nx WHERE src IN (SELECT id FROM s))")
def procedural_priming(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = load(spark, sf_dir, "records")
    s = r.orderBy(F.desc("stability"), "id").limit(20).select("id", "stability")
    nxt = clean_edges(spark, sf_dir).where("edge_type = 'temporal_next'").groupBy("src").agg(F.min("dst").alias("nxt")).join(F.broadcast(s.select(F.col("id").alias("src"))), "src", "left_semi").select(F.col("nxt").alias("id")).distinct()
    return r.join(nxt, "id", "left_semi").join(F.broadcast(s.agg(F.max("stability").alias("top")))).select("vec_label", F.round(F.least(F.col("stability") * 1.05, "top"), 6).alias("score"))


QUERIES, SQL = q.queries, q.sql
