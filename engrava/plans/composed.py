"""Compositions: anchors, packs, links, structural recall, checks of communities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from engrava.functions import text as tx
from engrava.functions.instants import parse_instant
from engrava.functions.vector import cosine
from engrava.operators import graphs as gr, hyper as hd, lexical as lex, ranking as rk
from engrava.operators.components import connected_components
from engrava.operators.pairs import near_pairs
from engrava.plans.general import _INSTANT
from engrava.plans.graphed import D, _E, _G, _LAB, graph, labels, vectors
from engrava.plans.joined import clean_edges
from engrava.plans.registry import Queries
from engrava.plans.retrieval import with_query
from engrava.plans.texts import CUE, _BM, _COS, _RQV, _TRI, _WHOLE, surfaces, with_record_query
from engrava.storage import materialize
from engrava.tables import load

q = Queries()
CUE_TOKENS = ["topic", "quota", "dralensta", "threshold"]
_ANS = " + ".join(f"CAST(coalesce(len(list_filter(a, lambda x: x = '{t}' OR (((starts_with(x, '{t}') AND {len(t)} >= 5) OR (starts_with('{t}', x) AND length(x) >= 5)) AND abs(length(x) - {len(t)}) <= 3))), 0) > 0 AS INT)" for t in CUE_TOKENS)


@q("rank_anchor_overlap", f"WITH t AS (SELECT record_id, list(lower(split_part(tag, ':', 2))) AS a FROM record_tags GROUP BY record_id) SELECT record_id, round(({_ANS}) / {float(len(CUE_TOKENS))}, 6)::DOUBLE AS overlap FROM t")
def rank_anchor_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record's tags are few, so they are gathered per record."""
    part = F.coalesce(F.get(F.split(F.lower("tag"), ":"), F.lit(1)), F.lit(""))
    t = load(spark, sf_dir, "record_tags").groupBy("record_id").agg(F.collect_set(part).alias("a"))
    return t.select("record_id", F.round(tx.anchor_overlap(CUE_TOKENS, F.col("a")), 6).alias("overlap"))


@q("join_near_links", """WITH k AS (SELECT vec_id, embedding::DOUBLE[] AS e, unnest(range(0, 8)) AS j FROM embeddings), b AS (SELECT vec_id, e, j, array_to_string(list_transform(e[j * 8 + 1 : j * 8 + 8], lambda x: CASE WHEN x >= 0 THEN '1' ELSE '0' END), '') AS key FROM k)
SELECT DISTINCT x.vec_id AS a, y.vec_id AS b, CASE WHEN list_cosine_similarity(x.e, y.e) >= 0.92 THEN 'skip' ELSE 'link' END AS action FROM b x JOIN b y ON x.j = y.j AND x.key = y.key AND x.vec_id < y.vec_id WHERE list_cosine_similarity(x.e, y.e) >= 0.70""")
def join_near_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that share the signs of one of eight stretches of eight values are candidates; their cosine decides."""
    j = F.sequence(F.lit(0), F.lit(7))
    keys = F.transform(j, lambda i: F.concat_ws("|", i.cast("string"), F.array_join(F.transform(F.slice("embedding", i * 8 + 1, F.lit(8)), lambda x: F.when(x >= 0, "1").otherwise("0")), "")))
    b = load(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.explode(keys).alias("key"))
    p = b.select("key", F.col("vec_id").alias("a"), F.col("embedding").alias("x")).join(b.select("key", F.col("vec_id").alias("b"), F.col("embedding").alias("y")), "key").where("a < b")
    c = cosine(F.col("x"), F.col("y"))
    return p.where(c >= 0.70).select("a", "b", F.when(c >= 0.92, "skip").otherwise("link").alias("action")).distinct()


@q("join_near_links_whole", f"""WITH r AS (SELECT tier, vec_label, embedding::DOUBLE[] AS e FROM records WHERE embedding IS NOT NULL AND tier IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_label AS a, b.vec_label AS b, list_cosine_similarity(a.e, b.e) AS cos FROM r a JOIN r b ON a.tier = b.tier AND len(a.e) = len(b.e) AND a.vec_label <> b.vec_label WHERE list_cosine_similarity(a.e, b.e) >= 0.70),
n AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY cos DESC, b) AS r, max(cos) OVER (PARTITION BY a) AS top FROM p QUALIFY r <= 8) SELECT a, b, round(cos, 6) AS cos, CASE WHEN top >= 0.92 THEN 'skip' ELSE 'link' END AS action FROM n WHERE top < 0.92 OR r = 1""")
def join_near_links_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each record against all others of its tier: its 8 nearest, if none has a cosine of 0.92, are links from 0.70 on;
    else the nearest alone is what it duplicates."""
    r = load(spark, sf_dir, "records").select(F.col("tier").alias("g"), F.col("vec_label").cast("long").alias("id"), F.col("embedding").alias("v"))
    p = near_pairs(r, 0.70)
    both = p.select("a", "b", "cos").union(p.select(F.col("b").alias("a"), F.col("a").alias("b"), "cos"))
    near = both.withColumn("r", F.row_number().over(W.partitionBy("a").orderBy(F.desc("cos"), "b"))).where("r <= 8")
    top = F.max("cos").over(W.partitionBy("a"))
    return near.withColumn("top", top).where("top < 0.92 OR r = 1").select("a", "b", F.round("cos", 6).alias("cos"), F.when(F.col("top") >= 0.92, "skip").otherwise("link").alias("action"))


@q("recall_structural")
def recall_structural(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    one = v.orderBy("key").limit(1).select(F.col("hv").alias("q"))
    return v.join(F.broadcast(one)).select("key", F.round(hd.similarity(F.col("hv"), F.col("q"), D), 6).alias("similarity")).orderBy(F.desc("similarity"), "key").limit(20)


@q("pack_proactive", """WITH h AS (SELECT language, id, stability, CASE WHEN salience_level = 'notable' THEN 1.05 ELSE 1.0 END AS b, length(literal_surface) // 4 AS cost FROM records WHERE stability >= 0.6 AND literal_surface IS NOT NULL AND id NOT IN (SELECT src FROM edges WHERE edge_type = 'curiosity_bridge')),
r AS (SELECT *, row_number() OVER (PARTITION BY language ORDER BY stability * b DESC, id) AS rank FROM h), s AS (SELECT *, sum(cost) OVER (PARTITION BY language ORDER BY rank ROWS UNBOUNDED PRECEDING) AS running FROM r), x AS (SELECT language, min(rank) FILTER (running > 300 AND rank > 1) AS stop FROM s GROUP BY 1)
SELECT s.language, s.id, s.stability, CAST(s.rank AS INT) AS rank FROM s JOIN x ON s.language IS NOT DISTINCT FROM x.language WHERE (x.stop IS NULL OR s.rank < x.stop) AND s.rank <= 10""")
def pack_proactive(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = load(spark, sf_dir, "records").where("literal_surface is not null").select("language", "id", "stability", "salience_level", F.floor(F.length("literal_surface") / 4).alias("cost"))
    served = load(spark, sf_dir, "edges").where("edge_type = 'curiosity_bridge'").select(F.col("src").alias("id"))
    boost = F.when(F.col("salience_level") == "notable", 1.05).otherwise(1.0)
    return rk.packed(r, "language", "stability", boost, "cost", served, "id", 0.6, 300).select("language", "id", "stability", "rank")


@q("pack_marker_reclaim", """WITH r AS (SELECT language, vec_label AS rank, length(literal_surface) // 4 AS cost, embedding_pending FROM records WHERE literal_surface IS NOT NULL),
m AS (SELECT language, rank, cost, sum(cost) OVER (PARTITION BY language ORDER BY rank) AS run FROM r WHERE embedding_pending <> 0 QUALIFY run <= 200), u AS (SELECT language, max(run) AS used FROM m GROUP BY language),
h AS (SELECT language, rank, cost, sum(cost) OVER (PARTITION BY language ORDER BY rank) AS run FROM r WHERE embedding_pending = 0)
SELECT h.language, rank, cost, FALSE AS marker FROM h LEFT JOIN u ON u.language = h.language WHERE run <= 800 - coalesce(used, 0) UNION ALL SELECT language, rank, cost, TRUE FROM m""")
def pack_marker_reclaim(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = load(spark, sf_dir, "records").where("literal_surface is not null").select("language", F.col("vec_label").alias("rank"), F.floor(F.length("literal_surface") / 4).alias("cost"), "embedding_pending")
    keep = ["language", "rank", "cost"]
    return rk.reclaimed(r.where("embedding_pending = 0").select(*keep), r.where("embedding_pending <> 0").select(*keep), "language", "rank", "cost", 800)


@q("rank_flat_damp", "WITH c AS (SELECT label, list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]) AS c FROM embeddings, (SELECT embedding AS q FROM embeddings ORDER BY vec_id LIMIT 1)), t AS (SELECT label, c FROM c QUALIFY row_number() OVER (PARTITION BY label ORDER BY c DESC) <= 10) SELECT label, round(least(1.0, greatest(0.0, (max(c) - min(c)) / 0.02)), 5)::DOUBLE AS damp FROM t GROUP BY label")
def rank_flat_damp(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = with_query(load(spark, sf_dir, "embeddings")).select("label", cosine(F.col("embedding"), F.col("qv")).alias("c"))
    t = c.withColumn("r", F.row_number().over(W.partitionBy("label").orderBy(F.desc("c")))).where("r <= 10")
    return t.groupBy("label").agg(F.round(rk.damped(F.max("c") - F.min("c")), 5).alias("damp"))


@q("rank_candidate_union", f"SELECT id FROM (SELECT id FROM records WHERE centrality > 0.9 UNION SELECT dst FROM {_E} WHERE edge_type = 'hebbian' AND weight > 0.9 UNION SELECT id FROM records WHERE contains(lower(literal_surface), 'the quota'))")
def rank_candidate_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = load(spark, sf_dir, "records")
    lanes = r.where("centrality > 0.9").select("id").union(clean_edges(spark, sf_dir).where("edge_type = 'hebbian' AND weight > 0.9").select("dst")).union(r.where(tx.contains_cue(F.col("literal_surface"), "the quota")).select("id"))
    return lanes.distinct()


@q("graph_community_connected", f"""WITH RECURSIVE k AS (SELECT l.node, l.c, r.vec_label AS x FROM {_LAB} l JOIN records r ON r.id = l.node), e AS (SELECT a.x AS u, b.x AS v FROM {_G} g JOIN k a ON a.node = g.a JOIN k b ON b.node = g.b WHERE a.c = b.c), s AS (SELECT u, v FROM e UNION SELECT v, u FROM e),
w(x, far) AS (SELECT x, x FROM k UNION SELECT w.x, s.v FROM w JOIN s ON s.u = w.far), p AS (SELECT x, min(far) AS component FROM w GROUP BY x) SELECT c, count(DISTINCT component) AS n_parts, count(*) AS n FROM k JOIN p USING (x) GROUP BY c""")
def graph_community_connected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(c, n_parts): components inside each community, over edges between its own members."""
    l, r = labels(spark, sf_dir), load(spark, sf_dir, "records").select(F.col("id").alias("node"), "vec_label")  # noqa: E741
    k = l.join(r, "node")
    e = graph(spark, sf_dir).join(k.toDF("a", "ca", "x"), "a").join(k.toDF("b", "cb", "y"), "b").where("ca = cb")
    parts = connected_components(e, "x", "y").select(F.col("node").alias("vec_label"), "component")
    return k.join(parts, "vec_label", "left").groupBy("c").agg(F.countDistinct(F.coalesce("component", "vec_label")).alias("n_parts"), F.count("*").alias("n"))


@q("graph_coverage_skip", f"WITH e AS (SELECT src, count(*) AS n, count(*) FILTER (weight >= 0.5) AS k FROM {_E} WHERE edge_type = 'hebbian' GROUP BY src) SELECT src FROM e WHERE k / n >= 0.6 AND n < 1.5 * greatest(k, 1)")
def graph_coverage_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = clean_edges(spark, sf_dir).where("edge_type = 'hebbian'").groupBy("src").agg(F.count("*").alias("n"), F.count_if(F.col("weight") >= 0.5).alias("k"))
    return e.where("k / n >= 0.6 AND n < 1.5 * greatest(k, 1)").select("src")


_DOT = "list_sum(list_transform({0}, lambda x, i: x::DOUBLE * qv[i]::DOUBLE))"


@q("hyper_orthogonalised", f"SELECT vec_id, round(list_sum(list_transform(embedding, lambda x, i: abs(x::DOUBLE - {_DOT.format('embedding')} / {_DOT.format('qv')} * qv[i]::DOUBLE))), 5) AS size, TRUE AS fine FROM embeddings, (SELECT embedding AS qv FROM embeddings ORDER BY vec_id LIMIT 1)")
def hyper_orthogonalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sum of the absolute values of what is left, and whether it is orthogonal to the query vector."""
    from engrava.functions.vector import dot

    e = with_query(load(spark, sf_dir, "embeddings")).withColumn("o", hd.orthogonalised(F.transform("embedding", lambda x: x.cast("double")), F.transform("qv", lambda x: x.cast("double"))))
    return e.select("vec_id", F.round(F.aggregate("o", F.lit(0.0), lambda s, x: s + F.abs(x)), 5).alias("size"), (F.abs(dot(F.col("o"), F.col("qv"))) < 1e-6).alias("fine"))


@q("hyper_structure_unpack")
def hyper_structure_unpack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector as the filler of one of two roles in a bundle, unpacked again and held against the filler."""
    v = vectors(spark, sf_dir).withColumn("two", hd.bind(F.col("hv"), F.reverse("hv")))
    a, b = hd.structured({"subject": F.col("hv"), "object": F.col("two")}, D)
    rows = v.select("key", F.explode(F.array(a, b)).alias("part"))
    s = hd.bundled(rows, "key", "part", D)
    return s.join(v.select("key", F.col("hv").alias("filler")), "key").select("key", F.round(hd.similarity(hd.unpacked(F.col("hv"), "subject", D), F.col("filler"), D), 4).alias("similarity"))


@q("monitor_structure_spread", "SELECT label, round(stddev_pop(embedding[1]), 5) AS spread, stddev_pop(embedding[1]) < 0.05 AS alarm FROM embeddings GROUP BY label")
def monitor_structure_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.stddev_pop(F.get("embedding", F.lit(0)).cast("double"))
    return load(spark, sf_dir, "embeddings").groupBy("label").agg(F.round(s, 5).alias("spread"), (s < 0.05).alias("alarm"))


@q("turns_live_union", "SELECT row_id, source FROM (SELECT row_id, 'stored' AS source FROM rank_reversed_planted WHERE batch_id % 2 = 0 UNION ALL SELECT row_id, 'live' FROM rank_reversed_planted WHERE batch_id % 2 = 1) ORDER BY row_id DESC LIMIT 100")
def turns_live_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns that are stored already, and those that only the spool has; here batches stand for the two."""
    r = load(spark, sf_dir, "rank_reversed_planted")
    stored, live = r.where("batch_id % 2 = 0"), r.where("batch_id % 2 = 1")
    new = live.select("row_id").join(stored.select("row_id"), "row_id", "left_anti")
    return stored.select("row_id", F.lit("stored").alias("source")).union(new.select("row_id", F.lit("live"))).orderBy(F.desc("row_id")).limit(100)


@q("merge_shared_members", """WITH RECURSIVE t AS (SELECT DISTINCT tag, vec_label FROM record_tags JOIN records ON id = record_id WHERE tag LIKE 'topic:%'), p AS (SELECT DISTINCT a.tag AS a, b.tag AS b FROM t a JOIN t b USING (vec_label)),
w(tag, far) AS (SELECT a, a FROM p UNION SELECT w.tag, p.b FROM w JOIN p ON p.a = w.far), l AS (SELECT tag, min(vec_label) AS least FROM t GROUP BY tag), c AS (SELECT w.tag, min(least) AS component FROM w JOIN l ON l.tag = w.far GROUP BY w.tag)
SELECT component, count(DISTINCT vec_label) AS n FROM t JOIN c USING (tag) GROUP BY component""")
def merge_shared_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics that share a record merge: components of the graph of records and the first record of each topic."""
    r = load(spark, sf_dir, "records").select(F.col("id").alias("record_id"), "vec_label")
    t = load(spark, sf_dir, "record_tags").where("tag like 'topic:%'").join(r, "record_id").select("tag", "vec_label")
    e = t.join(t.groupBy("tag").agg(F.min("vec_label").alias("leader")), "tag")
    return connected_components(e, "vec_label", "leader").groupBy("component").agg(F.count("*").alias("n"))


_FULL = f"""{_BM}, lx AS (SELECT doc AS vec_label, row_number() OVER (ORDER BY round(sum(score), 9) DESC, doc) - 1 AS lex FROM x GROUP BY doc QUALIFY lex < 100),
ue AS (SELECT src AS u, dst AS v FROM {_E} WHERE src <> dst UNION SELECT dst, src FROM {_E} WHERE src <> dst), dg AS (SELECT u AS id, count(*) AS degree FROM ue GROUP BY u),
an AS (SELECT record_id AS id, ({_ANS}) / {float(len(CUE_TOKENS))} AS anchor FROM (SELECT record_id, list(lower(split_part(tag, ':', 2))) AS a FROM record_tags GROUP BY record_id)),
c AS (SELECT id, vec_label, community_id, stability, valence, literal_surface AS t, {_INSTANT.format('created_at')} AS made, {_COS} AS cos, len(list_filter(list_zip(embedding, qv), lambda z: (z[1] >= 0) = (z[2] >= 0))) / 64 AS alike FROM records, {_RQV} WHERE {_WHOLE}),
sd AS (SELECT id, cos FROM c ORDER BY cos DESC, vec_label LIMIT 3), h1 AS (SELECT v AS id, max(cos) * 0.6 AS seed FROM sd JOIN ue ON u = sd.id GROUP BY v), h2 AS (SELECT v AS id, max(seed) * 0.6 AS seed FROM h1 JOIN ue ON u = h1.id GROUP BY v),
sp AS (SELECT id, max(seed) AS seed FROM (SELECT id, cos AS seed FROM sd UNION ALL FROM h1 UNION ALL FROM h2) GROUP BY id), cm AS (SELECT community_id, max(cos) AS best FROM c WHERE community_id IS NOT NULL GROUP BY 1),
k AS (SELECT (SELECT max(degree) FROM dg) AS md, (SELECT max(best) FROM cm) AS mc, (SELECT max(made) FROM c) AS now, least(1.0, greatest(0.0, (SELECT max(cos) - min(cos) FROM (SELECT cos FROM c ORDER BY cos DESC LIMIT 10)) / 0.02)) AS damp),
f AS (SELECT c.vec_label, 0.9 * (cos + 0.3 * coalesce(anchor, 0) + 0.1 * damp * ln(1 + coalesce(degree, 0)) / ln(1 + md) - 0.05 * least(1.0, greatest(0.0, coalesce((epoch(now) - epoch(made)) / 86400, 0) / 30)) + 0.2 * coalesce(seed, 0) + 0.1 * damp * cos * greatest(0.0, coalesce(best, 0) / mc)) + 0.1 * alike AS base,
 stability, valence, lex, coalesce(length(t) >= 3 AND len(list_intersect({_TRI.format('lower(t)')}, {_TRI.format("'" + CUE + "'")})) / len(list_distinct(list_concat({_TRI.format('lower(t)')}, {_TRI.format("'" + CUE + "'")}))) > 0.3, FALSE) AS tri, coalesce(contains(lower(t), '{CUE}'), FALSE) AS whole
 FROM c LEFT JOIN lx USING (vec_label) LEFT JOIN dg ON dg.id = c.id LEFT JOIN an ON an.id = c.id LEFT JOIN sp ON sp.id = c.id LEFT JOIN cm ON cm.community_id = c.community_id, k)
SELECT vec_label, round((base + (1 - least(1.0, coalesce(stability, 0.5))) * 0.1) * CASE WHEN valence > 0 THEN 1 + valence ELSE 1 END * CASE WHEN tri THEN 2 ELSE 1 END * CASE WHEN whole THEN 3 ELSE 1 END + coalesce(0.35 / (1 + lex), 0), 5) AS score FROM f"""


@q("fused_full", _FULL)
def fused_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fused score with all its terms: anchors, lexical ranks, spread over two hops from the three best, community bias,
    structural agreement (of signs), damped where the ten best cosines are alike."""
    c = materialize(with_record_query(spark, sf_dir, "id", "community_id", "stability", "valence", "literal_surface", "created_at", "embedding").withColumn("made", parse_instant(F.col("created_at"))), "candidates")
    first = c.orderBy("vec_label").limit(1).select(F.col("embedding").alias("qv"))
    edges = clean_edges(spark, sf_dir).where("src <> dst").select("src", "dst")
    both = materialize(edges.union(edges.select("dst", "src")).distinct().toDF("u", "v"), "both")
    degree = both.groupBy(F.col("u").alias("id")).agg(F.count("*").alias("degree"))
    tags = load(spark, sf_dir, "record_tags").groupBy(F.col("record_id").alias("id")).agg(F.collect_set(F.coalesce(F.get(F.split(F.lower("tag"), ":"), F.lit(1)), F.lit(""))).alias("a"))
    anchor = tags.select("id", tx.anchor_overlap(CUE_TOKENS, F.col("a")).alias("anchor"))
    scores = lex.scored(surfaces(spark, sf_dir), "vec_label", "text", CUE).groupBy("doc").agg(F.round(F.sum("score"), 9).alias("bm25")).orderBy(F.desc("bm25"), "doc").limit(100)
    ranks = scores.select(F.col("doc").alias("vec_label"), (F.row_number().over(W.orderBy(F.desc("bm25"), "doc")) - 1).alias("lexical_rank"))  # 100 rows
    seeds = c.orderBy(F.desc("cos"), "vec_label").limit(3).select("id", F.col("cos").alias("seed"))
    hop = lambda near: both.join(F.broadcast(near.withColumnRenamed("id", "u")), "u").groupBy(F.col("v").alias("id")).agg((F.max("seed") * 0.6).alias("seed"))
    one = hop(seeds)
    two = both.join(one.withColumnRenamed("id", "u"), "u").groupBy(F.col("v").alias("id")).agg((F.max("seed") * 0.6).alias("seed"))
    spread = seeds.union(one).union(two).groupBy("id").agg(F.max("seed").alias("seed"))
    community = c.where("community_id is not null").groupBy("community_id").agg(F.max("cos").alias("community"))
    head = c.orderBy(F.desc("cos")).limit(10).agg((F.max("cos") - F.min("cos")).alias("head"))
    facts = head.join(degree.agg(F.max("degree").alias("max_degree"))).join(c.agg(F.max("made").alias("now"))).join(community.agg(F.max("community").alias("max_community"))).join(first)  # one row
    rows = c.join(F.broadcast(ranks), "vec_label", "left").join(degree, "id", "left").join(anchor, "id", "left").join(spread, "id", "left").join(community, "community_id", "left").join(F.broadcast(facts))
    signals = {k: F.col(k) for k in ("cos", "anchor", "degree", "max_degree", "stability", "valence", "lexical_rank", "seed", "community", "max_community")}
    signals |= {
        "age_days": (F.unix_micros("now") - F.unix_micros("made")) / 86400e6,
        "trigram": F.coalesce(tx.trigram_jaccard(F.col("literal_surface"), F.lit(CUE)), F.lit(0.0)),
        "whole_cue": F.coalesce(tx.contains_cue(F.col("literal_surface"), CUE), F.lit(False)),
        "structural": F.size(F.filter(F.zip_with("embedding", "qv", lambda x, y: (x >= 0) == (y >= 0)), lambda x: x)) / 64,
        "damp": rk.damped(F.col("head")),
    }
    return rows.select("vec_label", F.round(rk.fused_full(signals, w_spread=0.2, w_struct=0.1), 5).alias("score"))


QUERIES, SQL = q.queries, q.sql
