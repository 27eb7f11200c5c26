"""Roll-ups, series, packs, corrections and lineage that complete the operators of the other modules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from engrava.functions.instants import parse_instant
from engrava.operators import analytics as an, graphs as gr, joins, lexical as lex
from engrava.plans.general import _INSTANT
from engrava.plans.graphed import _LAB, labels
from engrava.plans.joined import _E, clean_edges
from engrava.plans.registry import Queries
from engrava.tables import load

q = Queries()
_MADE = _INSTANT.format("created_at")
#: Kinds of edges along which a hop passes a seed's weight on.
TRANSFER = ("hebbian", "entity_shared", "temporal_next")
#: Tiers from the shortest-lived to the most lasting.
TIERS = ("working", "episodic", "procedural", "semantic")


@q("rollup_folders", f"""WITH r AS (SELECT id, vec_label, pinned, stability, lower(trim(community_id)) AS c, {_MADE} AS made FROM records),
f AS (SELECT 'community' AS folder, c AS name, vec_label, made FROM r WHERE c <> '' UNION ALL SELECT 'tag', tag, vec_label, made FROM (SELECT DISTINCT record_id, tag FROM record_tags) t JOIN r ON r.id = t.record_id UNION ALL SELECT 'pinned', 'pinned', vec_label, made FROM r WHERE pinned UNION ALL SELECT 'fading', 'fading', vec_label, made FROM r WHERE stability < 0.2
 UNION ALL SELECT 'session', sessionId, row_id, {_INSTANT.format('"timestamp"')} FROM rank_reversed_planted WHERE trim(coalesce(sessionId, '')) <> '')
SELECT folder, name, count(*) AS n, strftime(max(made), '%Y-%m-%d %H:%M:%S') AS last_at, max(vec_label) AS representative FROM f GROUP BY folder, name""")
def rollup_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, last time and the latest row of each community, tag and session, of what is pinned and of what fades."""
    r = load(spark, sf_dir, "records").select("id", "vec_label", "pinned", "stability", F.lower(F.trim("community_id")).alias("c"), parse_instant(F.col("created_at")).alias("made"))
    tags = load(spark, sf_dir, "record_tags").select("record_id", "tag").distinct().join(r.withColumnRenamed("id", "record_id"), "record_id")
    turns = load(spark, sf_dir, "rank_reversed_planted").where("trim(coalesce(sessionId, '')) <> ''")
    row = lambda df, folder, name, label="vec_label", made="made": df.select(F.lit(folder).alias("folder"), name.alias("name"), F.col(label).alias("label"), made if not isinstance(made, str) else F.col(made).alias("made"))
    parts = [row(r.where("c <> ''"), "community", F.col("c")), row(tags, "tag", F.col("tag")), row(r.where("pinned"), "pinned", F.lit("pinned")), row(r.where("stability < 0.2"), "fading", F.lit("fading")), row(turns, "session", F.col("sessionId"), "row_id", parse_instant(F.col("timestamp")).alias("made"))]
    f = reduce(DataFrame.union, parts).groupBy("folder", "name")
    return f.agg(F.count("*").alias("n"), F.date_format(F.max("made"), "yyyy-MM-dd HH:mm:ss").alias("last_at"), F.max("label").alias("representative"))


@q("trajectory_series", "SELECT event_type, user_id, CAST(row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) AS INT) AS place, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, value FROM events")
def trajectory_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ordered (time, value) series of each metric and user, a row a point, so a long series is no long array."""
    e = load(spark, sf_dir, "events")
    return e.select("event_type", "user_id", F.row_number().over(W.partitionBy("event_type", "user_id").orderBy("ts", "event_id")).alias("place"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"), "value")


@q("authority_pack", """WITH h AS (SELECT vec_label, 1.0 AS a FROM records WHERE pinned ORDER BY vec_label LIMIT 20), t AS (SELECT vec_label, stability AS b FROM records ORDER BY stability DESC NULLS LAST, vec_label LIMIT 50),
m AS (SELECT vec_label, greatest(coalesce(a, -1), coalesce(b, -1))::DOUBLE AS score FROM h FULL JOIN t USING (vec_label)), c AS (SELECT m.*, coalesce(length(literal_surface), 0) // 4 AS cost, row_number() OVER (ORDER BY score DESC, vec_label) AS place FROM m JOIN records USING (vec_label)),
s AS (SELECT *, sum(cost) OVER (ORDER BY place) AS running FROM c), x AS (SELECT min(place) FILTER (running > 600 AND place > 1) AS stop FROM s) SELECT vec_label, score, CAST(running AS BIGINT) AS running FROM s, x WHERE stop IS NULL OR place < stop""")
def authority_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact hits and ranked ones, the higher score of each, packed into a budget of 600 tokens."""
    r = load(spark, sf_dir, "records")
    h = r.where("pinned").orderBy("vec_label").limit(20).select("vec_label", F.lit(1.0).alias("a"))
    t = r.orderBy(F.desc("stability"), "vec_label").limit(50).select("vec_label", F.col("stability").alias("b"))
    m = h.join(t, "vec_label", "full_outer").select("vec_label", F.greatest("a", "b").alias("score"))  # 70 rows at most
    cost = r.join(F.broadcast(m), "vec_label").select("vec_label", "score", F.floor(F.coalesce(F.length("literal_surface"), F.lit(0)) / 4).alias("cost"), F.lit(1).alias("all"))
    ranked = cost.withColumn("rank", F.row_number().over(W.partitionBy("all").orderBy(F.desc("score"), "vec_label")))
    return an.budget_packed(ranked, "all", "rank", "cost", 600, 100).select("vec_label", "score", "running")


@q("maintain_tier_upgrade", "WITH o AS (SELECT *, list_position(['working', 'episodic', 'procedural', 'semantic'], tier) AS t, CASE salience_level WHEN 'critical' THEN 4 WHEN 'notable' THEN 3 ELSE 2 END AS p FROM records) SELECT vec_label, CASE WHEN t IS NOT NULL AND p > t THEN ['working', 'episodic', 'procedural', 'semantic'][p] ELSE tier END AS tier FROM o")
def maintain_tier_upgrade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record moves to the tier that its salience asks for if that is a higher one, and never down; other tiers stay."""
    order = F.array(*[F.lit(t) for t in TIERS])
    now, asked = F.array_position(order, F.col("tier")), F.when(F.col("salience_level") == "critical", 4).when(F.col("salience_level") == "notable", 3).otherwise(2)
    return load(spark, sf_dir, "records").select("vec_label", F.when((now > 0) & (asked > now), F.get(order, asked - 1)).otherwise(F.col("tier")).alias("tier"))


@q("maintain_corrected", """WITH o AS (SELECT id, literal_surface, tier, tags_json FROM records WHERE pinned)
SELECT 'record' AS part, 'fix-' || id AS id, NULL AS other, tier AS kind, 'directive' AS state FROM o UNION ALL SELECT 'edge', id, 'fix-' || id, 'contradicts', NULL FROM o UNION ALL SELECT 'record', id, NULL, tier, 'cleared' FROM o""")
def maintain_corrected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A contradiction of the pinned records: a correcting row for each, an edge from it to that, and the original, which
    is a directive no longer; what is written to the two tables, one row each."""
    o, none = load(spark, sf_dir, "records").where("pinned").select("id", "tier"), F.lit(None).cast("string")
    new = F.concat(F.lit("fix-"), "id")
    rows = [(F.lit("record"), new, none, F.col("tier"), F.lit("directive")), (F.lit("edge"), F.col("id"), new, F.lit("contradicts"), none), (F.lit("record"), F.col("id"), none, F.col("tier"), F.lit("cleared"))]
    names = ("part", "id", "other", "kind", "state")
    return o.select(F.explode(F.array(*[F.struct(*[c.alias(n) for c, n in zip(x, names)]) for x in rows])).alias("x")).select("x.*")


@q("window_use_rate_gated", "WITH u AS (SELECT user_id, count(*) FILTER (event_type = 'purchase') / count(*) AS rate FROM events GROUP BY user_id HAVING count(*) >= 20) SELECT count(*) AS n_windows, round(avg(rate), 6) AS use_rate, round(CASE WHEN count(*) >= 20 THEN greatest(0.90, least(1.10, 1.0 + greatest(-0.05, least(0.05, avg(rate) - 0.2)))) ELSE 1.0 END, 6)::DOUBLE AS weight FROM u")
def window_use_rate_gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean use rate over users of twenty events or more, and the bounded step from it; from fewer than twenty rates no step."""
    u = load(spark, sf_dir, "events").groupBy("user_id").agg((F.count_if(F.col("event_type") == "purchase") / F.count("*")).alias("rate"), F.count("*").alias("n")).where("n >= 20")
    step = F.greatest(F.lit(-0.05), F.least(F.lit(0.05), F.avg("rate") - 0.2))
    weight = F.when(F.count("*") >= 20, F.greatest(F.lit(0.90), F.least(F.lit(1.10), 1.0 + step))).otherwise(1.0)
    return u.agg(F.count("*").alias("n_windows"), F.round(F.avg("rate"), 6).alias("use_rate"), F.round(weight, 6).alias("weight"))


_KINDS = ", ".join(f"'{k}'" for k in TRANSFER)


@q("join_two_hops_traced", f"""WITH b AS (SELECT src AS node, dst AS other, edge_type, weight FROM {_E} UNION ALL SELECT dst, src, edge_type, weight FROM {_E} WHERE src <> dst), nb AS (SELECT node, other, max(weight) AS weight, bool_or(edge_type IN ({_KINDS})) AS passes FROM b GROUP BY ALL),
top AS (SELECT * FROM nb QUALIFY row_number() OVER (PARTITION BY node ORDER BY weight DESC NULLS LAST, other) <= 5), f AS (SELECT node AS seed, other AS node, passes FROM top WHERE node IN (SELECT id FROM records WHERE pinned) AND other <> node),
s AS (SELECT f.seed, t.other AS node, min(f.node) AS via, arg_min(f.passes AND t.passes, f.node) AS passes FROM f JOIN top t ON f.node = t.node WHERE t.other <> f.seed GROUP BY f.seed, t.other)
SELECT seed, node, 1 AS hop, seed AS via, passes FROM f UNION ALL SELECT seed, node, 2, via, passes FROM s WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.seed = s.seed AND f.node = s.node)""")
def join_two_hops_traced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two hops with where each came from (the least discoverer) and whether all edges on the way pass weight on."""
    nb = joins.both_ways(clean_edges(spark, sf_dir)).groupBy("node", "other").agg(F.max("weight").alias("weight"), F.bool_or(F.col("edge_type").isin(*TRANSFER)).alias("passes"))
    top = nb.withColumn("r", F.row_number().over(W.partitionBy("node").orderBy(F.desc("weight"), "other"))).where("r <= 5").select("node", "other", "passes")
    seeds = load(spark, sf_dir, "records").where("pinned").select(F.col("id").alias("seed")).distinct()
    first = seeds.join(top.withColumnRenamed("node", "seed"), "seed").where("other <> seed").select("seed", F.col("other").alias("node"), "passes")
    second = first.join(top.withColumnRenamed("passes", "further"), "node").where("other <> seed").groupBy("seed", F.col("other").alias("found")).agg(F.min("node").alias("via"), F.min_by(F.col("passes") & F.col("further"), "node").alias("passes")).withColumnRenamed("found", "node")
    second = second.join(first.select("seed", "node"), ["seed", "node"], "left_anti")
    return first.select("seed", "node", F.lit(1).alias("hop"), F.col("seed").alias("via"), "passes").union(second.select("seed", "node", F.lit(2), "via", "passes"))


@q("graph_lineage_events", f"""WITH w AS (SELECT r.tier AS o, l.c AS n, count(*) AS k FROM records r JOIN {_LAB} l ON l.node = r.id GROUP BY ALL), x AS (SELECT *, k / sum(k) OVER (PARTITION BY o) AS of_old, k / sum(k) OVER (PARTITION BY n) AS of_new FROM w)
SELECT 'split' AS event, o AS community, count(*) AS n_parts FROM x WHERE of_old >= 0.03 GROUP BY o HAVING count(*) > 1 UNION ALL SELECT 'merge', n, count(*) FROM x WHERE of_new >= 0.03 GROUP BY n HAVING count(*) > 1""")
def graph_lineage_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which old communities (here the tiers) split into several of the new, and which new ones merge several old."""
    return gr.lineage_events(load(spark, sf_dir, "records").select("id", "tier"), labels(spark, sf_dir), 0.03)


@q("lexical_token_chunks")
def lexical_token_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 256 tokens of a public tokenizer, 48 of them shared with the window before."""
    return lex.token_chunked(load(spark, sf_dir, "documents"), "doc_id", "text").select(F.col("key").alias("doc_id"), "chunk_no", F.length("chunk").alias("n_chars"))


QUERIES, SQL = q.queries, q.sql
