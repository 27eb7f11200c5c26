"""Graph measures, hypervectors and secondary operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from engrava.functions.instants import parse_instant
from engrava.functions.vector import cosine
from engrava.operators import analytics as an, graphs as gr, hyper as hd
from engrava.operators.components import connected_components
from engrava.operators.leiden import leiden
from engrava.operators.pairs import hubness
from engrava.operators.paths import Graph
from engrava.plans.general import _INSTANT, canonical_id
from engrava.plans.joined import _E, clean_edges
from engrava.plans.registry import Queries
from engrava.storage import materialize
from engrava.tables import load

q = Queries()
#: Kinds that clusters for consolidation are made of.
CONNECTIVE = ("hebbian", "pattern_separation_seed", "hebbian_cluster_replay")
_G = f"(SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM {_E} WHERE edge_type IN ('hebbian', 'entity_shared', 'contradicts') AND src <> dst)"
_A = f"(SELECT a AS u, b AS v FROM g UNION ALL SELECT b, a FROM g)"


def graph(spark: SparkSession, sf_dir: str, kinds=("hebbian", "entity_shared", "contradicts")) -> DataFrame:
    return gr.simple(clean_edges(spark, sf_dir).where(F.col("edge_type").isin(*kinds)))


def numbered(spark: SparkSession, sf_dir: str, kinds=("contradicts",)) -> DataFrame:
    """Edges between known records as pairs of vec_label."""
    r = load(spark, sf_dir, "records").select("id", "vec_label")
    return graph(spark, sf_dir, kinds).join(r.toDF("a", "x"), "a").join(r.toDF("b", "y"), "b").select("x", "y")


_N = f"(SELECT x.vec_label AS x, y.vec_label AS y FROM (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM {_E} WHERE edge_type = 'contradicts' AND src <> dst) g JOIN records x ON x.id = g.a JOIN records y ON y.id = g.b)"


@q("graph_components", f"WITH RECURSIVE n AS MATERIALIZED (SELECT * FROM {_N}), e AS (SELECT x AS u, y AS v FROM n UNION SELECT y, x FROM n), w(node, r) AS (SELECT u, u FROM e UNION SELECT w.node, e.v FROM w JOIN e ON e.u = w.r) SELECT node, min(r) AS component FROM w GROUP BY node")
def graph_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return connected_components(numbered(spark, sf_dir), "x", "y")


@q("graph_components_whole", f"WITH RECURSIVE g AS {_G}, e AS (SELECT a AS u, b AS v FROM g UNION SELECT b, a FROM g), i AS (SELECT u, row_number() OVER (ORDER BY u)::INT AS k FROM (SELECT DISTINCT u FROM e)), n AS (SELECT x.k AS u, y.k AS v FROM e JOIN i x ON x.u = e.u JOIN i y ON y.u = e.v), w(node, far) AS (SELECT k, k FROM i UNION SELECT w.node, n.v FROM w JOIN n ON n.u = w.far), c AS (SELECT node, min(far) AS root FROM w GROUP BY node) SELECT x.u AS node, y.u AS component FROM c JOIN i x ON x.k = c.node JOIN i y ON y.k = c.root")
def graph_components_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the same graph as graph_degrees."""
    return gr.components(graph(spark, sf_dir))


@q("graph_degrees", f"WITH g AS {_G} SELECT u AS node, count(*) AS degree FROM {_A} GROUP BY u")
def graph_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gr.degrees(graph(spark, sf_dir))


@q("graph_clustering", f"""WITH g AS MATERIALIZED {_G}, t AS (SELECT x.a AS a, x.b AS b, y.b AS c FROM g x JOIN g y ON x.b = y.a JOIN g z ON z.a = x.a AND z.b = y.b), n AS (SELECT node, count(*) AS n FROM (SELECT a AS node FROM t UNION ALL SELECT b FROM t UNION ALL SELECT c FROM t) GROUP BY node),
d AS (SELECT u AS node, count(*) AS degree FROM {_A} GROUP BY u) SELECT d.node, d.degree, round(CASE WHEN degree > 1 THEN 2 * coalesce(n, 0) / (degree * (degree - 1)) ELSE 0 END, 6) AS c FROM d LEFT JOIN n ON n.node = d.node""")
def graph_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gr.clustering(graph(spark, sf_dir)).select("node", "degree", F.round("c", 6).alias("c"))


_BFS = f"""WITH RECURSIVE g AS MATERIALIZED {_G}, a AS MATERIALIZED (SELECT * FROM {_A}), l AS (SELECT u AS node FROM a GROUP BY u ORDER BY count(*) DESC, u LIMIT 2),
w(source, node, d) AS (SELECT node, node, 0 FROM l UNION SELECT w.source, a.v, w.d + 1 FROM w JOIN a ON a.u = w.node WHERE w.d < 4),
b AS (SELECT source, node, min(d) AS d FROM w GROUP BY ALL)"""


@q("graph_distances", f"{_BFS} SELECT source, node, CAST(d AS INT) AS d FROM b")
def graph_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = materialize(graph(spark, sf_dir), "g")
    return gr.distances(g, gr.landmarks(g, 2), most=4)


@q("graph_harmonic", f"{_BFS} SELECT node, round(sum(1.0 / d), 6)::DOUBLE AS harmonic FROM b WHERE d > 0 GROUP BY node")
def graph_harmonic(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = materialize(graph(spark, sf_dir), "g")
    return gr.harmonic(gr.distances(g, gr.landmarks(g, 2), most=4)).select("node", F.round("harmonic", 6).alias("harmonic"))


@q("graph_distances_whole")
def graph_distances_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Graph(graph(spark, sf_dir)).distances()


@q("graph_harmonic_whole")
def graph_harmonic_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Graph(graph(spark, sf_dir)).reach().select("node", F.round("harmonic", 6).alias("harmonic"))


@q("graph_mean_path_length")
def graph_mean_path_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all pairs in the largest component; of equal ones, that of the least node."""
    g = materialize(graph(spark, sf_dir), "g")
    c = materialize(gr.components(g), "cc")
    top = c.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").limit(1)
    r = Graph(g.join(c.join(F.broadcast(top), "component").select(F.col("node").alias("a")), "a", "left_semi").select("a", "b")).reach()
    return r.agg((F.sum("total") / F.sum("n")).alias("apsl"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_pairs"))


@q("graph_betweenness")
def graph_betweenness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Graph(graph(spark, sf_dir)).betweenness()


@q("graph_communities")
def graph_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gr.propagated_communities(graph(spark, sf_dir), rounds=4)


@q("graph_leiden")
def graph_leiden(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leiden(graph(spark, sf_dir))


_LAB = "(SELECT id AS node, lower(trim(community_id)) AS c FROM records WHERE trim(coalesce(community_id, '')) <> '')"


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "records").where("trim(coalesce(community_id, '')) <> ''").select(F.col("id").alias("node"), F.lower(F.trim("community_id")).alias("c"))


@q("graph_modularity", f"WITH g AS {_G}, l AS {_LAB}, e AS (SELECT x.c AS ca, y.c AS cb FROM g JOIN l x ON x.node = g.a JOIN l y ON y.node = g.b), s AS (SELECT c, count(*) AS s FROM (SELECT ca AS c FROM e UNION ALL SELECT cb FROM e) GROUP BY c) SELECT round((SELECT count(*) FILTER (ca = cb) / count(*) FROM e) - (SELECT sum(s * s) FROM s) / (4 * (SELECT count(*) FROM e) * (SELECT count(*) FROM e)), 7) AS q")
def graph_modularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gr.modularity(graph(spark, sf_dir), labels(spark, sf_dir)).select(F.round("q", 7).alias("q"))


@q("graph_singletons", f"SELECT round(count(*) FILTER (n = 1) / count(*), 6) AS singleton_ratio, count(*) AS n_communities FROM (SELECT c, count(*) AS n FROM {_LAB} GROUP BY c)")
def graph_singletons(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = labels(spark, sf_dir).groupBy("c").agg(F.count("*").alias("n"))
    return n.agg(F.round(F.count_if(F.col("n") == 1) / F.count("*"), 6).alias("singleton_ratio"), F.count("*").alias("n_communities"))


@q("graph_rich_club", f"WITH g AS {_G}, d AS (SELECT u AS node, count(*) AS degree FROM {_A} GROUP BY u), k AS (SELECT CAST(floor(quantile_cont(degree, 0.9)) AS INT) AS k FROM d), r AS (SELECT node FROM d, k WHERE degree > k), e AS (SELECT count(*) AS e FROM g WHERE a IN (FROM r) AND b IN (FROM r)) SELECT k, (SELECT count(*) FROM r) AS n_rich, round(CASE WHEN (SELECT count(*) FROM r) > 1 THEN 2 * e / ((SELECT count(*) FROM r) * ((SELECT count(*) FROM r) - 1)) ELSE 0 END, 6) AS phi FROM k, e")
def graph_rich_club(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gr.rich_club(graph(spark, sf_dir)).select("k", "n_rich", F.round("phi", 6).alias("phi"))


_AGED = "round(centrality * (1 - CASE WHEN made IS NULL THEN 0 ELSE least(1.0, greatest(0, epoch(TIMESTAMP '2026-01-01 00:00:00') - epoch(made)) / 86400 / 30) END), 9)"


@q("graph_rich_nodes", f"WITH r AS (SELECT vec_label, centrality, {_INSTANT.format('created_at')} AS made FROM records WHERE centrality IS NOT NULL), n AS (SELECT greatest(1, CAST(ceil(0.1 * count(*)) AS BIGINT)) AS n FROM r) SELECT vec_label FROM (SELECT vec_label, row_number() OVER (ORDER BY {_AGED} DESC, vec_label) AS k FROM r), n WHERE k <= n.n")
def graph_rich_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tenth of the nodes with the highest centrality, which fades to nothing within thirty days (as of a fixed day)."""
    made, now = parse_instant(F.col("created_at")), F.lit("2026-01-01 00:00:00Z").cast("timestamp")
    r = load(spark, sf_dir, "records").where("centrality is not null").select("vec_label", F.round(F.col("centrality") * (1 - gr.age_penalty(made, now)), 9).alias("aged"))
    return an.first_share(r, 0.1, F.desc("aged"), F.asc("vec_label")).select("vec_label")


@q("graph_small_world")
def graph_small_world(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clustering and path length over those of three random graphs of the same size (their means)."""
    g = materialize(graph(spark, sf_dir), "g")
    others = [materialize(gr.random_like(g, seed), "g") for seed in (42, 43, 44)]
    c = lambda x: gr.clustering(x).agg(F.avg("c")).first()[0] or 0.0
    length = lambda x: gr.mean_path_length(gr.distances(x, gr.landmarks(x, 2))).first()[0] or 1.0
    n = gr.degrees(g).count()
    cg, lg = c(g), length(g)
    cr, lr = (sum(map(f, others)) / len(others) for f in (c, length))
    sigma = (cg / max(cr, 1e-9)) / (lg / max(lr, 1e-9))
    out = spark.createDataFrame([(n, cg, lg, sigma)], "n long, c double, l double, sigma double")
    return out.withColumn("regime", gr.regime(F.col("n"), F.col("sigma")))


@q("graph_lineage", f"WITH o AS (SELECT id AS node, tier AS o FROM records), w AS (SELECT o.o, l.c AS n, count(*) AS k FROM o JOIN {_LAB} l ON l.node = o.node GROUP BY ALL) SELECT n AS community, arg_max(o, {{'k': k, 'o': o}}) AS ancestor, max(k) AS overlap FROM w GROUP BY n")
def graph_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gr.lineage(load(spark, sf_dir, "records").select("id", "tier"), labels(spark, sf_dir))


@q("graph_consolidation_clusters", f"WITH RECURSIVE n AS MATERIALIZED (SELECT x.vec_label AS x, y.vec_label AS y FROM (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM {_E} WHERE edge_type = 'consolidated_from' AND weight >= 0.05 AND src <> dst) g JOIN records x ON x.id = g.a AND x.tier = 'episodic' JOIN records y ON y.id = g.b AND y.tier = 'episodic'), e AS (SELECT x AS u, y AS v FROM n UNION SELECT y, x FROM n), w(node, r) AS (SELECT u, u FROM e UNION SELECT w.node, e.v FROM w JOIN e ON e.u = w.r), c AS (SELECT node, min(r) AS component FROM w GROUP BY node) SELECT component, count(*) AS n FROM c GROUP BY component HAVING count(*) >= 3")
def graph_consolidation_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = load(spark, sf_dir, "records").where("tier = 'episodic'").select("id", "vec_label")
    e = gr.simple(clean_edges(spark, sf_dir).where("edge_type = 'consolidated_from' AND weight >= 0.05")).join(r.toDF("a", "x"), "a").join(r.toDF("b", "y"), "b")
    return connected_components(e, "x", "y").groupBy("component").agg(F.count("*").alias("n")).where("n >= 3")


@q("graph_consolidation_clusters_whole")
def graph_consolidation_clusters_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node, component, n) by vec_label, over all three kinds that connect living episodic records."""
    r = load(spark, sf_dir, "records").where("tier = 'episodic' AND trim(coalesce(tombstoned_at, '')) = ''").select("id", "vec_label")
    e = load(spark, sf_dir, "edges").where(F.col("edge_type").isin(*CONNECTIVE) & ~F.isnan("weight") & (F.col("weight") >= 0.05))
    g = gr.simple(e.select("src", canonical_id(F.col("dst")).alias("dst"))).join(r.toDF("a", "x"), "a").join(r.toDF("b", "y"), "b")
    return gr.bounded_clusters(gr.simple(g, "x", "y"))


@q("graph_hubness", "WITH h AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings ORDER BY vec_id LIMIT 40), p AS (SELECT a.vec_id, list_cosine_similarity(a.e, b.e) AS c FROM h a JOIN h b ON a.vec_id <> b.vec_id) SELECT vec_id, round(avg(c), 6) AS mean_cos, round(max(c), 6) AS max_cos, avg(c) > 0.85 AS is_hub FROM p GROUP BY vec_id")
def graph_hubness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the served hits (at most 40)."""
    h = load(spark, sf_dir, "embeddings").orderBy("vec_id").limit(40)
    p = h.select("vec_id", F.col("embedding").alias("x")).join(F.broadcast(h.select(F.col("vec_id").alias("o"), F.col("embedding").alias("y"))), F.col("vec_id") != F.col("o")).withColumn("c", cosine(F.col("x"), F.col("y")))
    return p.groupBy("vec_id").agg(F.round(F.avg("c"), 6).alias("mean_cos"), F.round(F.max("c"), 6).alias("max_cos"), (F.avg("c") > 0.85).alias("is_hub"))


@q("graph_hubness_whole", "WITH p AS (SELECT a.label, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS c FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id), m AS (SELECT label, avg(c) AS mean_cos, greatest(0, max(c)) AS max_cos FROM p GROUP BY label) SELECT label, round(mean_cos, 6) AS mean_cos, round(max_cos, 6) AS max_cos, mean_cos > 0.85 AS is_hub, count(*) AS size FROM m JOIN embeddings USING (label) GROUP BY ALL")
def graph_hubness_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each label, over all its rows."""
    h = hubness(load(spark, sf_dir, "embeddings").select(F.col("label").alias("g"), F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("v")))
    return h.select(F.col("g").alias("label"), F.round("mean_cos", 6).alias("mean_cos"), F.round("max_cos", 6).alias("max_cos"), "is_hub", "size")


# ---- hypervectors (2,048 bits, to keep the queries light; the width is a parameter)
D = 2048


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hd.projected(load(spark, sf_dir, "embeddings"), "vec_id", "embedding", 64, D)


@q("hyper_projection")
def hyper_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).select("key", F.size("hv").alias("n_words"), F.aggregate("hv", F.lit(0).cast("long"), lambda s, x: s + F.bit_count(x)).alias("n_ones"))


_ROLE = [hd.role_vector("subject", 64)[0] >> i & 1 for i in range(64)]
_SIGNS = "list_transform(embedding, lambda x: CAST(x >= 0 AS INT))"
_FLAT = "list_reduce(list_transform({0}, lambda x, i: x::HUGEINT << (i - 1)::HUGEINT), lambda a, b: a + b)"
_WORD = "array_to_string(list_transform({0}, lambda x: x::VARCHAR), '')"


def sign_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, hv): the signs of each embedding as one word of 64 bits, the first lowest."""
    bit = lambda x, i: F.when(x >= 0, F.call_function("shiftleft", F.lit(1).cast("long"), i.cast("int"))).otherwise(F.lit(0).cast("long"))
    word = F.aggregate(F.transform("embedding", bit), F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(x))
    return load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"), F.array(word).alias("hv"))


def bit_text(hv):
    return F.reverse(F.lpad(F.bin(hv[0]), 64, "0"))


@q("hyper_bind_unbind", f"SELECT vec_id AS key, {_WORD.format(f'list_transform({_SIGNS}, lambda x, i: xor(x, {_ROLE}[i]))')} AS bound, len(list_filter({_ROLE}, lambda x: x = 1)) AS far, CAST(0 AS BIGINT) AS again FROM embeddings")
def hyper_bind_unbind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bound with a role: the bits, how far that is from the vector, and how far what is unbound again is from it."""
    role = F.array(*[F.lit(x) for x in hd.role_vector("subject", 64)])
    v = sign_words(spark, sf_dir).withColumn("b", hd.bind(F.col("hv"), role))
    return v.select("key", bit_text(F.col("b")).alias("bound"), hd.hamming(F.col("b"), F.col("hv")).alias("far"), hd.hamming(hd.bind(F.col("b"), role), F.col("hv")).alias("again"))


@q("hyper_bundle_recall")
def hyper_bundle_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir).join(load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"), "label"), "key")
    code = hd.bundled(v, "label", "hv", D).select(F.col("label").cast("string"), "hv")  # ten labels
    return hd.cleaned_up(v.select("key", "hv"), code, D)


@q("hyper_permute", f"SELECT vec_id AS key, {_WORD.format(f'list_concat({_SIGNS}[60:64], {_SIGNS}[1:59])')} AS rolled, CAST(0 AS BIGINT) AS far FROM embeddings")
def hyper_permute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rolled by five bits, and how far what is rolled back is from the vector."""
    v = sign_words(spark, sf_dir)
    rolled = hd.permuted(v, "key", "hv", 5, 64).withColumnRenamed("hv", "r")
    back = hd.permuted(rolled, "key", "r", -5, 64).withColumnRenamed("hv", "again")
    return v.join(rolled, "key").join(back, "key").select("key", bit_text(F.col("r")).alias("rolled"), hd.hamming(F.col("hv"), F.col("again")).alias("far"))


_PH = "list_transform(embedding, lambda x: ((CAST(floor(x::DOUBLE * 512) AS INT) % 256) + 256) % 256)"


@q("hyper_phases", f"SELECT vec_id, CAST(list_sum(b) AS BIGINT) AS total, round(list_sum(list_transform(b, lambda x, i: cos((x - p[i]) * 2 * pi() / 256))) / 64, 6) AS similarity, TRUE AS same FROM (SELECT vec_id, p, list_transform(p, lambda x, i: (x + p[65 - i]) % 256) AS b FROM (SELECT vec_id, {_PH} AS p FROM embeddings))")
def hyper_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phases bound with their own reverse: their sum, how similar that is to them, and whether unbinding gives them back."""
    p = F.transform("embedding", lambda x: F.pmod(F.floor(x.cast("double") * 512).cast("int"), F.lit(256)))
    e = load(spark, sf_dir, "embeddings").select("vec_id", p.alias("p")).withColumn("k", F.reverse("p")).withColumn("b", hd.phase_bind(F.col("p"), F.col("k")))
    total = F.aggregate("b", F.lit(0).cast("long"), lambda s, x: s + x)
    return e.select("vec_id", total.alias("total"), F.round(hd.phase_similarity(F.col("b"), F.col("p")), 6).alias("similarity"), (hd.phase_unbind(F.col("b"), F.col("k")) == F.col("p")).alias("same"))


@q("hyper_delta", f"WITH v AS (SELECT vec_id, label, {_SIGNS} AS s FROM embeddings), c AS (SELECT label, s AS c FROM v QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) = 1) SELECT vec_id AS key, {_WORD.format('list_transform(s, lambda x, i: xor(x, c[i]))')} AS delta, CAST(list_sum(list_transform(s, lambda x, i: xor(x, c[i]))) AS BIGINT) AS n_bits, CAST(0 AS BIGINT) AS far FROM v JOIN c USING (label)")
def hyper_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector as its difference from its label's first one: the bits, their number, and how far the decoded one is."""
    v = sign_words(spark, sf_dir).join(load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"), "label"), "key")
    first = v.groupBy("label").agg(F.min_by("hv", "key").alias("c"))
    d = v.join(first, "label").withColumn("d", hd.delta_encoded(F.col("c"), F.col("hv")))
    return d.select("key", bit_text(F.col("d")).alias("delta"), hd.ones(F.col("d")).alias("n_bits"), hd.hamming(hd.delta_decoded(F.col("c"), F.col("d")), F.col("hv")).alias("far"))


@q("hyper_replayed")
def hyper_replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of 2,048 bits a replay with 5 % of noise flips."""
    v = vectors(spark, sf_dir)
    return hd.replayed(v, "key", "hv", 0.05, 11, D).withColumnRenamed("hv", "noisy").join(v, "key").select("key", hd.hamming(F.col("noisy"), F.col("hv")).alias("n_flipped"))


@q("hyper_sparse_bundle", """WITH t AS (SELECT label, unnest(list_transform(list_sort(list_transform(list_filter(list_zip(embedding, range(64)), lambda z: z[1] > 0), lambda z: {'v': -z[1], 'i': z[2]}))[1:20], lambda s: s.i)) AS i FROM embeddings),
c AS (SELECT label, i FROM t GROUP BY label, i QUALIFY row_number() OVER (PARTITION BY label ORDER BY count(*) DESC, i) <= 20) SELECT label, string_agg(i::VARCHAR, ' ' ORDER BY i) AS indices FROM c GROUP BY label""")
def hyper_sparse_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the indices of each vector's twenty greatest positive values, the twenty most frequent of each label."""
    ranked = F.array_sort(F.filter(F.transform("embedding", lambda x, i: F.struct((-x).alias("v"), i.alias("i"))), lambda s: s["v"] < 0))
    top = F.transform(F.slice(ranked, 1, 20), lambda s: s["i"])
    return hd.sparse_bundled(load(spark, sf_dir, "embeddings").select("label", top.alias("ix")), "label", "ix").select("label", F.array_join("indices", " ").alias("indices"))


# ---- secondary operators
@q("order_boosted_display_raw", "SELECT vec_label, stability FROM records WHERE pinned ORDER BY round(stability * CASE WHEN tier = 'semantic' THEN 1.05 ELSE 1 END, 9) DESC NULLS LAST, vec_label LIMIT 20")
def order_boosted_display_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    boosted = F.round(F.col("stability") * F.when(F.col("tier") == "semantic", 1.05).otherwise(1.0), 9)
    return load(spark, sf_dir, "records").where("pinned").orderBy(F.desc(boosted), "vec_label").limit(20).select("vec_label", "stability")


@q("reserve_cue_tokens", "SELECT cue_id, t FROM (SELECT cue_id, unnest(list_distinct(regexp_extract_all(lower(cue_text), '[a-z]{4,}'))) AS t FROM recall_cues) QUALIFY row_number() OVER (PARTITION BY cue_id ORDER BY length(t) DESC, t) <= 3")
def reserve_cue_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = load(spark, sf_dir, "recall_cues").select("cue_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("cue_text"), F.lit("[a-z]{4,}"), F.lit(0)))).alias("t"))
    return t.withColumn("r", F.row_number().over(W.partitionBy("cue_id").orderBy(F.desc(F.length("t")), "t"))).where("r <= 3").select("cue_id", "t")


@q("gate_trivial_cues", "SELECT cue_id FROM recall_cues WHERE length(trim(cue_text)) >= 3 AND len(list_distinct(regexp_extract_all(lower(cue_text), '[a-z0-9]{4,}'))) >= 3")
def gate_trivial_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.array_distinct(F.regexp_extract_all(F.lower("cue_text"), F.lit("[a-z0-9]{4,}"), F.lit(0)))
    return load(spark, sf_dir, "recall_cues").where((F.length(F.trim("cue_text")) >= 3) & (F.size(words) >= 3)).select("cue_id")


@q("embedding_integrity", "WITH e AS (SELECT label, avg(CASE WHEN abs(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) - 1) > 0.02 THEN 1.0 ELSE 0.0 END) AS bad, count(*) AS n FROM embeddings GROUP BY label) SELECT label, n, round(bad, 6) AS bad_share, n >= 25 AND bad >= 0.2 AS alarm FROM e")
def embedding_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from engrava.functions.vector import norm

    e = load(spark, sf_dir, "embeddings").select("label", (F.abs(norm(F.col("embedding")) - 1) > 0.02).cast("double").alias("bad"))
    return e.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg("bad"), 6).alias("bad_share"), ((F.count("*") >= 25) & (F.avg("bad") >= 0.2)).alias("alarm"))


@q("evaluation_metrics", """WITH c AS (SELECT cue_id, split, lower(gold_literal_surface) AS g FROM recall_cues), k AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS r, lower(text) AS t FROM documents WHERE text IS NOT NULL), h AS (SELECT cue_id, split, min(r) AS r FROM c LEFT JOIN k ON contains(t, g) GROUP BY ALL)
SELECT split, count(*) AS n, count(r) AS n_found, round(avg(coalesce(1.0 / r, 0)), 8)::DOUBLE AS mrr FROM h GROUP BY split""")
def evaluation_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cues are the stated, small set of queries, broadcast against all documents."""
    c = load(spark, sf_dir, "recall_cues").select("cue_id", "split", F.lower("gold_literal_surface").alias("g"))
    d = load(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.lower("text").alias("t"))
    hit = d.join(F.broadcast(c), F.col("t").contains(F.col("g"))).groupBy("cue_id").agg(F.min("doc_id").alias("doc_id"))
    # the rank of a document is how many have no greater id: counted between the ids that are asked for, one a cue at most
    asked = sorted(r[0] for r in hit.select("doc_id").distinct().collect())
    slot = F.size(F.filter(F.array(*[F.lit(x) for x in asked]).cast("array<long>"), lambda x: x < F.col("doc_id")))
    counts = dict(d.select("doc_id").groupBy(slot.alias("slot")).count().collect()) if asked else {}
    ranks, total = [], 0
    for i, x in enumerate(asked):
        total += counts.get(i, 0)
        ranks.append((x, total))
    before = spark.createDataFrame(ranks, "doc_id long, r long")
    h = c.join(hit, "cue_id", "left").join(before, "doc_id", "left")
    return h.groupBy("split").agg(F.count("*").alias("n"), F.count("r").alias("n_found"), F.round(F.avg(F.coalesce(1 / F.col("r"), F.lit(0.0))), 8).alias("mrr"))


@q("evaluation_bootstrap")
def evaluation_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """95 % interval of the mean event value per kind, from 200 resamples by Poisson weights drawn from a hash."""
    e = load(spark, sf_dir, "events").select("event_id", "event_type", "value", F.explode(F.sequence(F.lit(1), F.lit(200))).alias("sample"))
    u = F.pmod(F.xxhash64("event_id", "sample"), F.lit(1_000_000)) / 1e6
    w = F.when(u < 0.367879, 0).when(u < 0.735759, 1).when(u < 0.919699, 2).when(u < 0.981012, 3).otherwise(4)
    m = e.groupBy("event_type", "sample").agg((F.sum(w * F.col("value")) / F.sum(w)).alias("m"))
    return m.groupBy("event_type").agg(F.round(F.percentile("m", F.lit(0.025)), 4).alias("low"), F.round(F.percentile("m", F.lit(0.975)), 4).alias("high"))


QUERIES, SQL = q.queries, q.sql
