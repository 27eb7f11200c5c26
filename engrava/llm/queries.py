"""Queries of the operators over the given tables, and SQL where it can express them."""

from __future__ import annotations

import secrets

from pyspark.sql import DataFrame, SparkSession, functions as F

from engrava.functions.instants import blank, parse_instant
from engrava.llm.clusters import MinHashClusters
from engrava.llm.conversations import Conversations, speaker_of
from engrava.llm.leaks import leaked
from engrava.llm.near import NearTexts
from engrava.llm.packing import Packing
from engrava.llm.pii import PersonalData
from engrava.llm.similar import SimilarVectors
from engrava.llm.spans import SharedSpans
from engrava.plans.general import _INSTANT, deliveries
from engrava.tables import load


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    cues = load(spark, sf_dir, "recall_cues").where("split = 'holdout'")
    return leaked(load(spark, sf_dir, "documents"), "doc_id", "text", cues, "cue_id", "gold_literal_surface").toDF("doc_id", "cue_id")


def p9_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    cues = load(spark, sf_dir, "recall_cues").where("split = 'holdout'")
    return leaked(load(spark, sf_dir, "documents"), "doc_id", "text", cues, "cue_id", "gold_literal_surface", spans=True).toDF("doc_id", "cue_id", "start_at", "end_at")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SharedSpans(load(spark, sf_dir, "documents"), "doc_id", "text").pairs().toDF("doc_a", "doc_b")


def p10_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SharedSpans(load(spark, sf_dir, "documents"), "doc_id", "text").shared_parts().toDF("doc_id", "n_chars", "n_shared", "share", "copies")


def p10_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SharedSpans(load(spark, sf_dir, "documents"), "doc_id", "text").classes().toDF("doc_id", "class_id", "copies")


def near_records(spark: SparkSession, sf_dir: str) -> NearTexts:
    return NearTexts(load(spark, sf_dir, "records"), "vec_label", "literal_surface", share=0.70, least=14)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_records(spark, sf_dir).pairs().toDF("vec_label_a", "vec_label_b")


def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_records(spark, sf_dir).groups().toDF("vec_label", "group_id", "n_links")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SimilarVectors(load(spark, sf_dir, "records"), "vec_label", "embedding", k=5, least=0.90).pairs().toDF("vec_label_a", "vec_label_b")


def conversations(spark: SparkSession, sf_dir: str) -> Conversations:
    of_type = lambda t, field: F.transform(F.filter("message.content", lambda b: F.lower(F.trim(b["type"])) == t), lambda b: b[field])
    rows = load(spark, sf_dir, "rank_reversed_planted").where(~blank(F.col("sessionId"))).select(
        F.col("sessionId").alias("session"),
        F.col("row_id").alias("row"),
        parse_instant(F.col("timestamp")).alias("ts"),
        speaker_of(F.col("message.role"), F.col("type")).alias("speaker"),
        F.coalesce(F.exists("message.content", lambda b: F.coalesce(F.lower(F.trim(b["type"])) == "text", F.lit(False)) & ~blank(b["text"])), F.lit(False)).alias("spoken"),
        of_type("tool_use", "id").alias("uses"),
        of_type("tool_result", "tool_use_id").alias("answers"),
    )
    return Conversations(rows.join(deliveries(spark, sf_dir).redundant().select(F.col("ord").alias("row")), "row", "left_anti"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations(spark, sf_dir).faults().select(F.col("session").alias("session_id")).distinct()


def p6_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations(spark, sf_dir).turns().toDF("session_id", "turn", "part", "row_id", "speaker")


def p6_inferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations(spark, sf_dir).inferred().toDF("session_id", "row_id", "speaker")


def p8_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Packing(load(spark, sf_dir, "documents"), "doc_id", "text").placed().toDF("doc_id", "part", "start_token", "n_tokens", "container_id")


def record_clusters(spark: SparkSession, sf_dir: str) -> tuple[MinHashClusters, DataFrame]:
    known = load(spark, sf_dir, "communities").select("community_id", F.lower(F.trim("community_id")).alias("stored")).dropDuplicates(["stored"])
    records = load(spark, sf_dir, "records").withColumn("stored", F.lower(F.regexp_replace(F.coalesce("community_id", F.lit("")), r"^\s+|\s+$", "")))
    return MinHashClusters(records, "vec_label", "embedding", known.count(), extra=["stored"]), known


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    clusters, known = record_clusters(spark, sf_dir)
    rows = clusters.assigned().select("id", "cluster", "stored")
    counts = rows.join(F.broadcast(known), "stored").groupBy("cluster", "stored", "community_id").agg(F.count("*").alias("n"))
    right = counts.groupBy("cluster").agg(F.max_by(F.struct("stored", "community_id"), F.struct("n", "stored")).alias("c")).select("cluster", F.col("c.stored").alias("right"), "c.community_id")
    return rows.join(F.broadcast(right), "cluster").where("stored != right").select(F.col("id").alias("vec_label"), "community_id")


def p2_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return record_clusters(spark, sf_dir)[0].described()


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = load(spark, sf_dir, "rank_reversed_planted").select("row_id", F.posexplode(F.col("message.content.text")))
    records = load(spark, sf_dir, "records").select(F.lit("records").alias("src_table"), F.col("vec_label").alias("row_key"), F.lit(0).alias("block_no"), F.col("literal_surface").alias("text"))
    return records.union(blocks.select(F.lit("rank_reversed_planted"), "row_id", "pos", "col")).where("text is not null")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = PersonalData(load(spark, sf_dir, "name_parts"), "name_part", "part_kind")
    return data.found(_texts(spark, sf_dir), ["src_table", "row_key", "block_no"], "text").select("src_table", "row_key", "block_no", "kind", "start_at")


def p5_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key is the session's ``spark.engrava.pii.key``; without one, a secret that ends with this call."""
    key = (spark.conf.get("spark.engrava.pii.key", None) or secrets.token_hex(32)).encode()
    data = PersonalData(load(spark, sf_dir, "name_parts"), "name_part", "part_kind")
    return data.redacted(_texts(spark, sf_dir), ["src_table", "row_key", "block_no"], "text", key, dates=True)


QUERIES = {"p5_found": p5_found, "p5_redacted": p5_redacted, "p2_found": p2_found, "p2_clusters": p2_clusters, "p6_found": p6_found, "p6_turns": p6_turns, "p6_inferred": p6_inferred, "p8_packed": p8_packed, "p3_found": p3_found, "p4_found": p4_found, "p4_groups": p4_groups, "p9_found": p9_found, "p9_spans": p9_spans, "p10_found": p10_found, "p10_shared": p10_shared, "p10_copies": p10_copies}

_WORDS = "regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}]+')"
_NEAR = f"""WITH RECURSIVE s AS (SELECT vec_label AS id, list_distinct({_WORDS.format("literal_surface")}) AS w FROM records WHERE literal_surface IS NOT NULL), t AS (SELECT id, len(w) AS n, unnest(w) AS t FROM s WHERE len(w) >= 14),
p AS (SELECT a.id AS x, b.id AS y FROM t a JOIN t b ON a.t = b.t AND a.id < b.id GROUP BY a.id, b.id, a.n, b.n HAVING count(*) >= 0.7 * (a.n + b.n - count(*)) - 1e-9), u AS (SELECT x AS u, y AS v FROM p UNION SELECT y, x FROM p),
r(node, far) AS (SELECT u, u FROM u UNION SELECT r.node, u.v FROM r JOIN u ON u.u = r.far), c AS (SELECT node, min(far) AS component FROM r GROUP BY node)"""
_FULL = "({0} IS NOT NULL AND NOT regexp_full_match({0}, '\\s*'))"
_TURNS = f"""WITH d AS (SELECT *, list_filter(list_transform(message.content, lambda b: b.id), lambda x: x IS NOT NULL)[1] AS mid FROM rank_reversed_planted WHERE {_FULL.format("sessionId")}),
k AS (SELECT * FROM d QUALIFY mid IS NULL OR row_number() OVER (PARTITION BY sessionId, mid ORDER BY row_id) = 1),
t AS (SELECT sessionId AS s, row_id, {_INSTANT.format('"timestamp"')} AS ts, lower(regexp_replace(CASE WHEN {_FULL.format("message.role")} THEN message.role ELSE coalesce(type, '') END, '^\\s+|\\s+$', '', 'g')) AS speaker, message.content AS c,
 len(list_filter(message.content, lambda b: lower(trim(b.type)) = 'text' AND b.text IS NOT NULL AND NOT regexp_full_match(b.text, '\\s*'))) > 0 AS spoken FROM k),
n AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY ts NULLS FIRST, row_id) AS pos, CASE WHEN spoken AND speaker IN ('user', 'assistant') THEN speaker END AS who FROM t),
a AS (SELECT s, who, lead(who) OVER (PARTITION BY s ORDER BY pos) AS answer FROM n WHERE who IS NOT NULL),
u AS (SELECT s, pos, unnest(list_transform(list_filter(c, lambda b: lower(trim(b.type)) = 'tool_use' AND b.id IS NOT NULL), lambda b: b.id)) AS tool FROM n),
v AS (SELECT s, pos, unnest(list_transform(list_filter(c, lambda b: lower(trim(b.type)) = 'tool_result'), lambda b: b.tool_use_id)) AS tool FROM n)"""
_UNITS = """v AS (SELECT vec_label, lower(regexp_replace(coalesce(community_id, ''), '^\\s+|\\s+$', '', 'g')) AS stored, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS u
 FROM records WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0), known AS (SELECT lower(trim(community_id)) AS stored, any_value(community_id) AS community_id FROM communities GROUP BY 1)"""


def _assigned_sql(name: str, members: str) -> str:
    """CTEs: the mean directions of the members (vec_label, c), and each vector with the nearest, at a cosine of 0.5 or more."""
    return f"""{name}m AS (SELECT c, list(x ORDER BY i) AS m FROM (SELECT c, i, sum(u[i]) AS x FROM {members} JOIN v USING (vec_label), range(1, 65) r(i) GROUP BY c, i) GROUP BY c),
{name} AS (SELECT vec_label, arg_max(c, cos) AS c FROM (SELECT vec_label, c, list_cosine_similarity(u, m) AS cos FROM v, {name}m) WHERE cos >= 0.5 GROUP BY vec_label)"""


#: Another way to the same clusters: from the records' stored communities, which are mostly right, to their mean directions, and
#: from the members of these to theirs.
_CLUSTERS = f"WITH {_UNITS}, k0 AS (SELECT vec_label, stored AS c FROM v JOIN known USING (stored)), {_assigned_sql('k1', 'k0')}, {_assigned_sql('k2', 'k1')}, {_assigned_sql('k3', 'k2')}"
_DROPPED = """SELECT s AS session_id FROM n GROUP BY s HAVING bool_or(ts IS NULL OR speaker NOT IN ('user', 'assistant', 'system')) OR count(*) FILTER (who = 'user') = 0 OR count(*) FILTER (who = 'assistant') = 0
UNION SELECT s FROM a WHERE who = 'user' AND answer IS DISTINCT FROM 'assistant' UNION SELECT s FROM u WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.s = u.s AND v.tool = u.tool AND v.pos > u.pos) UNION SELECT s FROM v WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.s = v.s AND u.tool = v.tool AND u.pos < v.pos)"""
_WINDOWS = "w AS (SELECT doc_id, i, hash(substring(text, i, 300)) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text) - 298)) AS i FROM documents WHERE length(text) >= 300)), g AS (SELECT h FROM w GROUP BY h HAVING min(doc_id) <> max(doc_id)), e AS (SELECT w.* FROM w JOIN g USING (h))"
SQL = {
    "p10_copies": "SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS class_id, count(*) OVER (PARTITION BY text) AS copies FROM documents WHERE length(text) >= 300 QUALIFY copies > 1",
    "p2_found": f"""{_CLUSTERS}, n AS (SELECT k3.c, stored, count(*) AS n FROM k3 JOIN v USING (vec_label) JOIN known USING (stored) GROUP BY ALL), r AS (SELECT c, arg_max(stored, {{'n': n, 's': stored}}) AS fits FROM n GROUP BY c)
SELECT vec_label, known.community_id FROM k3 JOIN v USING (vec_label) JOIN r USING (c) JOIN known ON known.stored = r.fits WHERE v.stored <> r.fits""",
    "p3_found": f"""WITH {_UNITS}, p AS (SELECT a.vec_label AS a, b.vec_label AS b, list_dot_product(a.u, b.u) AS cos FROM v a, v b WHERE a.vec_label <> b.vec_label AND list_dot_product(a.u, b.u) >= 0.9),
t AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY a ORDER BY cos DESC, b) <= 5) SELECT DISTINCT least(a, b) AS vec_label_a, greatest(a, b) AS vec_label_b FROM t""",
    "p6_inferred": f"""{_TURNS} SELECT s AS session_id, row_id, CASE before WHEN 'user' THEN 'assistant' ELSE 'user' END AS speaker FROM (SELECT *, last_value(who IGNORE NULLS) OVER (PARTITION BY s ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
 first_value(who IGNORE NULLS) OVER (PARTITION BY s ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after FROM n) WHERE spoken AND speaker NOT IN ('user', 'assistant', 'system') AND before = after""",
    "p4_found": f"{_NEAR} SELECT a.node AS vec_label_a, b.node AS vec_label_b FROM c a JOIN c b USING (component) WHERE a.node < b.node",
    "p4_groups": f"{_NEAR} SELECT node AS vec_label, component AS group_id, n AS n_links FROM c JOIN (SELECT u AS node, count(*) AS n FROM u GROUP BY u) USING (node)",
    "p6_found": f"{_TURNS} {_DROPPED}",
    "p6_turns": f"""{_TURNS}, x AS ({_DROPPED}), h AS (SELECT *, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY s ORDER BY pos) AS gap FROM n), l AS (SELECT exp(avg(ln(gap)) + 3 * stddev_pop(ln(gap))) AS rest FROM h WHERE gap > 0)
SELECT s AS session_id, pos AS turn, CAST(1 + count(*) FILTER (gap > rest) OVER (PARTITION BY s ORDER BY pos) AS INT) AS part, row_id, speaker FROM h, l WHERE s NOT IN (FROM x)""",
    "p10_found": f"WITH {_WINDOWS} SELECT DISTINCT a.doc_id AS doc_a, b.doc_id AS doc_b FROM (SELECT DISTINCT doc_id, h FROM e) a JOIN (SELECT DISTINCT doc_id, h FROM e) b ON a.h = b.h AND a.doc_id < b.doc_id",
    "p10_shared": f"""WITH {_WINDOWS}, o AS (SELECT doc_id, CAST(sum(step) AS INT) AS n FROM (SELECT doc_id, least(300, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 300)) AS step FROM e) GROUP BY doc_id)
SELECT doc_id, CAST(length(text) AS INT) AS n_chars, coalesce(n, 0) AS n_shared, round(coalesce(n, 0) / length(text), 6) AS share, count(*) OVER (PARTITION BY text) AS copies FROM documents LEFT JOIN o USING (doc_id) WHERE length(text) >= 300""",
    "p9_found": f"""WITH g AS (SELECT DISTINCT cue_id, array_to_string(w[i:i+12], ' ') AS s FROM (SELECT cue_id, w, unnest(range(1, len(w) - 11)) AS i FROM (SELECT cue_id, {_WORDS.format("gold_literal_surface")} AS w FROM recall_cues WHERE split = 'holdout'))),
d AS (SELECT doc_id, array_to_string(w[i:i+12], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents)))
SELECT DISTINCT doc_id, cue_id FROM d JOIN g USING (s)""",
}
