"""Event analytics, roll-ups and window-like operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from engrava.functions.instants import parse_instant
from engrava.operators import analytics as an
from engrava.plans.general import _INSTANT
from engrava.plans.registry import Queries
from engrava.tables import load

q = Queries()
_MADE = _INSTANT.format("created_at")


@q("events_follow_pairs", """WITH p AS (SELECT user_id AS s, event_type AS a, lead(event_type) OVER w AS b, lead(ts) OVER w AS t FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT a, b, count(*) AS n, count(DISTINCT s) AS n_sessions, min(t) AS first_at, max(t) AS last_at FROM p WHERE b IS NOT NULL GROUP BY a, b""")
def events_follow_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return an.follow_pairs(load(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type", "ts")


@q("events_supported_pairs", """WITH p AS (SELECT user_id AS s, event_type AS a, lead(event_type) OVER w AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT a, b, count(*) AS n, count(DISTINCT s) AS n_sessions FROM p WHERE b IS NOT NULL GROUP BY a, b HAVING count(*) >= 20 AND count(DISTINCT s) >= 3""")
def events_supported_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return an.follow_pairs(load(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type", "ts").where("n >= 20 AND n_sessions >= 3").select("a", "b", "n", "n_sessions")


_BLOCKS = "(SELECT row_id, sessionId, i, message.content[i] AS b FROM (SELECT *, unnest(range(1, len(message.content) + 1)) AS i FROM rank_reversed_planted))"


@q("transcript_tool_bigrams", f"""WITH t AS (SELECT sessionId AS s, row_id, i, b.name AS name FROM {_BLOCKS} WHERE b.type = 'tool_use' AND sessionId IS NOT NULL),
p AS (SELECT s, name AS a, lead(name) OVER (PARTITION BY s ORDER BY row_id, i) AS b FROM t) SELECT a, b, count(*) AS n, count(DISTINCT s) AS n_sessions FROM p WHERE b IS NOT NULL GROUP BY a, b""")
def transcript_tool_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = load(spark, sf_dir, "rank_reversed_planted").where("sessionId IS NOT NULL").select("sessionId", "row_id", F.posexplode("message.content")).where("col.type = 'tool_use'").select("sessionId", "row_id", "pos", F.col("col.name").alias("name"))
    return an.follow_pairs(t, "sessionId", ["row_id", "pos"], "name", "row_id").select("a", "b", "n", "n_sessions")


@q("tags_co_occurrence", """WITH u AS (SELECT DISTINCT record_id AS k, tag AS t FROM record_tags WHERE split_part(tag, ':', 1) NOT IN ('role', 'idem', 'session'))
SELECT a.t AS a, b.t AS b, count(*) AS n, round(least(1.0, count(*) / 10.0), 6)::DOUBLE AS confidence, CASE WHEN count(*) >= 5 THEN 'auto' ELSE 'pending' END AS status FROM u a JOIN u b ON a.k = b.k AND a.t < b.t GROUP BY 1, 2""")
def tags_co_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return an.tag_pairs(load(spark, sf_dir, "record_tags"), "record_id", "tag", ["role", "idem", "session"])


@q("session_metrics", """SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'error') AS n_errors, round(avg(value), 4) AS mean_value, count(DISTINCT event_type) AS n_kinds,
round((count(*) - count(DISTINCT CAST(json_extract(props, '$.k') AS INT))) / count(*), 6) AS repeat_rate FROM events GROUP BY user_id""")
def session_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    return e.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("n_errors"), F.round(F.avg("value"), 4).alias("mean_value"), F.countDistinct("event_type").alias("n_kinds"), F.round((F.count("*") - F.countDistinct("k")) / F.count("*"), 6).alias("repeat_rate"))


@q("session_precision_at_5", """WITH v AS (SELECT user_id, event_type, CAST(json_extract(props, '$.k') AS INT) AS k, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r FROM events WHERE event_type IN ('view', 'purchase')),
s AS (SELECT user_id, list_distinct(list(k) FILTER (event_type = 'view' AND r <= 5)) AS a, list_distinct(list(k) FILTER (event_type = 'purchase')) AS b FROM v GROUP BY user_id)
SELECT user_id, round(len(list_intersect(coalesce(a, []), coalesce(b, []))) / 5.0, 4)::DOUBLE AS precision_at_5 FROM s""")
def session_precision_at_5(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events").where("event_type IN ('view', 'purchase')").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    r = e.withColumn("r", F.row_number().over(W.partitionBy("user_id", "event_type").orderBy("ts", "event_id")))
    some = lambda c: F.collect_set(F.when(c, F.col("k")))
    s = r.groupBy("user_id").agg(some((F.col("event_type") == "view") & (F.col("r") <= 5)).alias("a"), some(F.col("event_type") == "purchase").alias("b"))
    return s.select("user_id", F.round(F.size(F.array_intersect("a", "b")) / 5.0, 4).alias("precision_at_5"))


@q("trajectories", "SELECT event_type, CAST(date_trunc('day', ts) AS DATE) AS day, round(avg(value), 4) AS mean_value, count(*) AS n FROM events GROUP BY ALL")
def trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.round(F.avg("value"), 4).alias("mean_value"), F.count("*").alias("n"))


q.statement("user_model_hours", "SELECT hour(ts) AS hour, count(*) AS n FROM events GROUP BY hour(ts)")
q.statement("user_model_kinds", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type ORDER BY n DESC, event_type LIMIT 20")
q.statement("user_model_topics", "SELECT tag, count(DISTINCT record_id) AS n FROM record_tags WHERE tag LIKE 'topic:%' GROUP BY tag ORDER BY n DESC, tag LIMIT 10")
q.statement("coverage_ratio", "SELECT round(count(CASE WHEN EXISTS_ THEN 1 END) / count(*), 6) AS ratio FROM (SELECT r.id, x.src IS NOT NULL AS EXISTS_ FROM records r LEFT JOIN (SELECT DISTINCT src FROM edges) x ON x.src = r.id) c")
q.statement("majority_language", "SELECT community_id, max_by(language, struct(n, language)) AS language FROM (SELECT community_id, language, count(*) AS n FROM records WHERE language IS NOT NULL GROUP BY community_id, language) c GROUP BY community_id", "SELECT community_id, arg_max(language, {'n': n, 'l': language}) AS language FROM (SELECT community_id, language, count(*) AS n FROM records WHERE language IS NOT NULL GROUP BY community_id, language) c GROUP BY community_id")
q.statement("latest_per_community", "SELECT community_id, max_by(vec_label, vec_label) AS vec_label, count(*) AS n FROM records GROUP BY community_id", "SELECT community_id, arg_max(vec_label, vec_label) AS vec_label, count(*) AS n FROM records GROUP BY community_id")


@q("rollup_time_buckets", f"""WITH r AS (SELECT vec_label, {_MADE} AS made FROM records), n AS (SELECT max(made) AS now FROM r)
SELECT CASE WHEN d <= 0 THEN 'today' WHEN d = 1 THEN 'yesterday' WHEN d < 7 THEN 'week' WHEN d < 30 THEN 'month' ELSE 'older' END AS bucket, count(*) AS n, max(vec_label) AS newest_label
FROM (SELECT vec_label, date_diff('day', CAST(made AS DATE), CAST(now AS DATE)) AS d FROM r, n) GROUP BY 1""")
def rollup_time_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = load(spark, sf_dir, "records").select("vec_label", parse_instant(F.col("created_at")).alias("made"))
    now = r.agg(F.max("made").alias("now"))  # one row
    return r.join(F.broadcast(now)).groupBy(an.time_bucket(F.col("made"), F.col("now")).alias("bucket")).agg(F.count("*").alias("n"), F.max("vec_label").alias("newest_label"))


@q("weighted_degree", "WITH b AS (SELECT src AS node FROM edges WHERE edge_type <> 'temporal_next' UNION ALL SELECT dst FROM edges WHERE edge_type <> 'temporal_next' AND src <> dst), d AS (SELECT node, count(*) AS degree FROM b GROUP BY node) SELECT node, degree, round(ln(1 + degree) / ln(1 + (SELECT max(degree) FROM d)), 6) AS share FROM d")
def weighted_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "edges").where("edge_type <> 'temporal_next'")
    d = e.select(F.col("src").alias("node")).union(e.where("src <> dst").select("dst")).groupBy("node").agg(F.count("*").alias("degree"))
    top = d.agg(F.max("degree").alias("most"))  # one row
    return d.join(F.broadcast(top)).select("node", "degree", F.round(F.log1p("degree") / F.log1p("most"), 6).alias("share"))


@q("community_centroids", """WITH u AS (SELECT label, unnest(embedding) AS x, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings), m AS (SELECT label, i, avg(x) AS x FROM u GROUP BY ALL)
SELECT m.label, CAST(m.i AS INT) AS i, round(m.x / n.n, 5) AS x FROM m JOIN (SELECT label, sqrt(sum(x * x)) AS n FROM m GROUP BY label) n ON m.label = n.label""")
def community_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = load(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", (F.col("i") + 1).alias("i")).agg(F.avg(F.col("x").cast("double")).alias("x"))
    n = m.groupBy("label").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("n"))
    return m.join(n, "label").select("label", "i", F.round(F.col("x") / F.col("n"), 5).alias("x"))


@q("score_entropy", "WITH p AS (SELECT event_type, sum(value) AS s, count(*) AS n, sum(value * log2(value)) AS x FROM events WHERE value > 0 GROUP BY 1) SELECT event_type, round(CASE WHEN n > 1 THEN (log2(s) - x / s) / log2(n) ELSE 0 END, 6) AS entropy FROM p")
def score_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return an.entropy(load(spark, sf_dir, "events"), "event_type", "value").select("event_type", F.round("entropy", 6).alias("entropy"))


@q("drift_alerts", """WITH d AS (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY ALL), l AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY day DESC) AS r FROM d),
s AS (SELECT event_type, CAST(n > lead(n) OVER (PARTITION BY event_type ORDER BY day DESC) AS INT) AS up FROM l WHERE r <= 5)
SELECT event_type, CAST(coalesce(sum(up), 0) AS BIGINT) AS rises, count(*) >= 5 AND coalesce(sum(up), 0) >= 3 AS alert FROM s GROUP BY 1""")
def drift_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return an.drifting(d, "event_type", "day", "n", 5)


# ---- windows
@q("window_rank_cut", "SELECT language, vec_label, CAST(row_number() OVER (PARTITION BY language ORDER BY centrality DESC NULLS LAST, id) AS INT) AS rank FROM records QUALIFY rank <= 10")
def window_rank_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.row_number().over(W.partitionBy("language").orderBy(F.desc("centrality"), "id"))
    return load(spark, sf_dir, "records").select("language", "vec_label", r.alias("rank")).where("rank <= 10")


@q("window_average_percentile", "SELECT vec_label, round((rank() OVER (PARTITION BY tier ORDER BY detail_level) - 1 + (count(*) OVER (PARTITION BY tier, detail_level) - 1) / 2.0) / nullif(count(*) OVER (PARTITION BY tier) - 1, 0), 6) AS percentile FROM records")
def window_average_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return an.average_rank_percentile(load(spark, sf_dir, "records").select("vec_label", "tier", "detail_level"), "detail_level", ["tier"]).select("vec_label", F.round("percentile", 6).alias("percentile"))


@q("window_boundary_pairs", """WITH s AS (SELECT user_id, CAST(ts AS DATE) AS day, arg_min(event_type, {'t': ts, 'e': event_id}) AS first_kind, arg_max(event_type, {'t': ts, 'e': event_id}) AS last_kind FROM events GROUP BY ALL),
b AS (SELECT last_kind AS a, lead(first_kind) OVER (PARTITION BY user_id ORDER BY day) AS b FROM s) SELECT a, b, count(*) AS n FROM b WHERE b IS NOT NULL GROUP BY a, b""")
def window_boundary_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events")
    s = e.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.min_by("event_type", F.struct("ts", "event_id")).alias("f"), F.max_by("event_type", F.struct("ts", "event_id")).alias("a"))
    b = s.select("a", F.lead("f").over(W.partitionBy("user_id").orderBy("day")).alias("b"))
    return b.where("b is not null").groupBy("a", "b").agg(F.count("*").alias("n"))


@q("window_head_spread", "SELECT language, round(max(centrality) - min(centrality), 6) AS spread FROM (SELECT language, centrality FROM records WHERE centrality IS NOT NULL QUALIFY row_number() OVER (PARTITION BY language ORDER BY centrality DESC, vec_label) <= 10) GROUP BY language")
def window_head_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.row_number().over(W.partitionBy("language").orderBy(F.desc("centrality"), "vec_label"))
    return load(spark, sf_dir, "records").where("centrality is not null").withColumn("r", r).where("r <= 10").groupBy("language").agg(F.round(F.max("centrality") - F.min("centrality"), 6).alias("spread"))


@q("window_budget_pack", """WITH h AS (SELECT language, vec_label, length(literal_surface) // 4 AS cost, row_number() OVER w AS place, sum(length(literal_surface) // 4) OVER (PARTITION BY language ORDER BY vec_label ROWS UNBOUNDED PRECEDING) AS running FROM records WHERE literal_surface IS NOT NULL WINDOW w AS (PARTITION BY language ORDER BY vec_label)),
s AS (SELECT language, min(place) FILTER (running > 800 AND place > 1) AS stop FROM h GROUP BY language)
SELECT h.language, h.vec_label, CAST(h.running AS BIGINT) AS running FROM h JOIN s ON h.language IS NOT DISTINCT FROM s.language WHERE (s.stop IS NULL OR h.place < s.stop) AND h.place <= 50""")
def window_budget_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = load(spark, sf_dir, "records").where("literal_surface is not null").select("language", "vec_label", F.floor(F.length("literal_surface") / 4).alias("cost"))
    return an.budget_packed(h, "language", "vec_label", "cost", 800).select("language", "vec_label", "running")


@q("window_seed_blend", """WITH r AS (SELECT community_id, vec_label, centrality, stability FROM records WHERE centrality IS NOT NULL AND stability IS NOT NULL AND trim(coalesce(community_id, '')) <> ''),
p AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY community_id) > 1 THEN (rank() OVER (PARTITION BY community_id ORDER BY centrality) - 1 + (count(*) OVER (PARTITION BY community_id, centrality) - 1) / 2.0) / (count(*) OVER (PARTITION BY community_id) - 1) ELSE 0 END AS pct FROM r)
SELECT community_id, vec_label, round(0.6 * stability + 0.4 * pct, 6) AS blend FROM p QUALIFY row_number() OVER (PARTITION BY community_id ORDER BY round(0.6 * stability + 0.4 * pct, 6) DESC, vec_label) <= 3""")
def window_seed_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = load(spark, sf_dir, "records").where("centrality is not null and stability is not null and trim(coalesce(community_id, '')) <> ''").select("community_id", "vec_label", "centrality", "stability")
    b = an.average_rank_percentile(r, "centrality", ["community_id"]).withColumn("blend", F.round(0.6 * F.col("stability") + 0.4 * F.col("percentile"), 6))
    return b.withColumn("r", F.row_number().over(W.partitionBy("community_id").orderBy(F.desc("blend"), "vec_label"))).where("r <= 3").select("community_id", "vec_label", "blend")


@q("window_cooldown", """WITH t AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS turn, event_type FROM events), a AS (SELECT *, turn - lag(turn) OVER (PARTITION BY user_id ORDER BY turn) AS d FROM t WHERE event_type = 'error'),
s AS (SELECT * FROM a WHERE d IS NULL OR d >= 3) SELECT user_id, event_id FROM s QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY turn) <= 2""")
def window_cooldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = load(spark, sf_dir, "events").withColumn("turn", F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id"))).where("event_type = 'error'")
    return an.cooldown(t, "user_id", ["turn"], "turn", 3, 2).select("user_id", "event_id")


@q("window_consensus_votes", "SELECT event_id, votes FROM (SELECT event_id, count(*) OVER (PARTITION BY user_id, event_type ORDER BY epoch(date_trunc('second', ts))::BIGINT RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS votes FROM events) WHERE votes >= 3")
def window_consensus_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events").withColumn("key", F.concat_ws("|", "user_id", "event_type")).withColumn("sec", F.unix_timestamp(F.col("ts").cast("timestamp")))
    return an.consensus(e, "key", "sec").select("event_id", "votes")


@q("window_use_rate", "WITH u AS (SELECT user_id, count(*) FILTER (event_type = 'purchase') / count(*) AS rate, count(*) AS n FROM events GROUP BY user_id) SELECT count(*) AS n_users, round(avg(rate), 6) AS use_rate, round(greatest(0.90, least(1.10, 1.0 + greatest(-0.05, least(0.05, avg(rate) - 0.2)))), 6)::DOUBLE AS weight FROM u")
def window_use_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = load(spark, sf_dir, "events").groupBy("user_id").agg((F.count_if(F.col("event_type") == "purchase") / F.count("*")).alias("rate"))
    step = F.greatest(F.lit(-0.05), F.least(F.lit(0.05), F.avg("rate") - 0.2))
    return u.agg(F.count("*").alias("n_users"), F.round(F.avg("rate"), 6).alias("use_rate"), F.round(F.greatest(F.lit(0.90), F.least(F.lit(1.10), 1.0 + step)), 6).alias("weight"))


@q("cofire_uses")
def cofire_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from engrava.operators.cofire import transcript_uses

    return transcript_uses(load(spark, sf_dir, "rank_reversed_planted")).select("session", "row_id", F.size("used").alias("n_used"), F.array_join("used", " ").alias("used"))


@q("cofire_pairs")
def cofire_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from engrava.operators.cofire import transcript_uses, use_pairs

    return use_pairs(transcript_uses(load(spark, sf_dir, "rank_reversed_planted")))


QUERIES, SQL = q.queries, q.sql
