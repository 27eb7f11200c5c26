"""Scalar text functions and lexical search."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from engrava.functions import text as tx, vector as vec
from engrava.functions.instants import parse_instant
from engrava.operators import lexical as lex, ranking as rk
from engrava.plans.general import _INSTANT
from engrava.plans.registry import Queries
from engrava.tables import load

q = Queries()
_MADE = _INSTANT.format("created_at")
CUE = "the quota checklist shadows every stale threshold and ranking"


def surfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "records").select("vec_label", F.col("literal_surface").alias("text"), "language")


_LOW = "translate(literal_surface, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SEAMS = "lower(regexp_replace(regexp_replace(x, '([a-z0-9])([A-Z])', '\\1#\\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1#\\2', 'g'))"
_PARTS = "CASE WHEN len(list_filter(string_split({0}, '{1}'), lambda p: length(p) > 2)) > 1 THEN list_filter(string_split({0}, '{1}'), lambda p: length(p) > 2) ELSE [] END"
_LEX = f"list_concat([lower(x)], {_PARTS.format('lower(x)', '_')}, {_PARTS.format(_SEAMS, '#')})"
_TOKENS = f"flatten(list_transform(regexp_extract_all(literal_surface, '[A-Za-z_][A-Za-z0-9_]{{1,}}|[0-9]{{3,}}'), lambda x: {_LEX}))"


@q("text_tokens", f"SELECT vec_label, CAST(len(t) AS INT) AS n, array_to_string(t, ' ') AS t FROM (SELECT vec_label, {_TOKENS} AS t FROM records WHERE literal_surface IS NOT NULL)")
def text_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = surfaces(spark, sf_dir).where("text is not null").select("vec_label", tx.tokens(F.col("text")).alias("t"))
    return t.select("vec_label", F.size("t").alias("n"), F.array_join("t", " ").alias("t"))


@q("text_camel_tokens", f"SELECT doc_id, CAST(len(t) AS INT) AS n, array_to_string(t, ' ') AS t FROM (SELECT doc_id, {_TOKENS.replace('literal_surface', 'text')} AS t FROM documents WHERE text IS NOT NULL)")
def text_camel_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = load(spark, sf_dir, "documents").where("text is not null").select("doc_id", tx.tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").alias("n"), F.array_join("t", " ").alias("t"))


_TRI = "(CASE WHEN length({0}) >= 3 THEN list_distinct(list_transform(range(1, length({0}) - 1), lambda i: substring({0}, i, 3))) ELSE [] END)"


@q("text_trigram_jaccard", f"SELECT cue_id, round(CASE WHEN len(a) > 0 AND len(b) > 0 THEN len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) ELSE 0 END, 6) AS j FROM (SELECT cue_id, {_TRI.format('lower(cue_text)')} AS a, {_TRI.format('lower(gold_literal_surface)')} AS b FROM recall_cues)")
def text_trigram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "recall_cues").select("cue_id", F.round(tx.trigram_jaccard(F.col("cue_text"), F.col("gold_literal_surface")), 6).alias("j"))


q_flag = "SELECT vec_label FROM records WHERE contains(lower(literal_surface), 'the quota')"


@q("text_contains_cue", q_flag)
def text_contains_cue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surfaces(spark, sf_dir).where(tx.contains_cue(F.col("text"), "The Quota")).select("vec_label")


#: DuckDB's expressions have no lookaround: a word with a letter and a digit is worded otherwise.
_IDENT = " OR ".join(f"regexp_matches(literal_surface, '{p}')" for p in [r"\b\w*(?:[A-Za-z]\w*\d|\d\w*[A-Za-z])\w*\b" if "(?=" in p else p for p in tx.IDENTIFIER])


@q("text_identifier_shaped", f"SELECT vec_label FROM records WHERE {_IDENT}")
def text_identifier_shaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surfaces(spark, sf_dir).where(tx.identifier_shaped(F.col("text"))).select("vec_label")


def _sql_any(words: list[str], column: str) -> str:
    return f"regexp_matches({column}, '(?i)\\b(?:{'|'.join(w.replace(chr(39), chr(39) * 2) for w in words)})\\b')"


_H = "substring(literal_surface, 1, 2000)"
_EPI = f"""CASE WHEN literal_surface IS NULL OR regexp_matches({_H}, '^\\s*$') THEN 'unknown' WHEN {_sql_any(tx.ESTIMATE, _H)} OR regexp_matches({_H}, '~\\s?\\d') THEN 'estimate' WHEN {_sql_any(tx.HYPOTHESIS, _H)} THEN 'hypothesis' WHEN {_sql_any(tx.OPINION, _H)} THEN 'opinion' WHEN {_sql_any(tx.FACT, _H)} THEN 'fact' ELSE 'unknown' END"""


@q("text_epistemic", f"SELECT vec_label, {_EPI} AS status FROM records")
def text_epistemic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surfaces(spark, sf_dir).select("vec_label", tx.epistemic_status(F.col("text")).alias("status"))


@q("text_salience", f"SELECT vec_label, CASE WHEN pinned OR {_EPI} = 'fact' THEN 'notable' ELSE 'unflagged' END AS level FROM records")
def text_salience(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = load(spark, sf_dir, "records")
    return r.select("vec_label", tx.salience(F.col("pinned"), F.array(F.col("tier")), tx.epistemic_status(F.col("literal_surface"))).alias("level"))


@q("text_noise", f"SELECT vec_label FROM records WHERE {' OR '.join(f'starts_with(literal_surface, {chr(39)}{p}{chr(39)})' for p in tx.NOISE_STARTS)} OR literal_surface = '{tx.NOISE_IS[0]}'")
def text_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surfaces(spark, sf_dir).where(tx.is_noise(F.col("text"))).select("vec_label")


@q("text_correction", f"SELECT vec_label FROM records WHERE {_sql_any(tx.CORRECTION, 'literal_surface')}")
def text_correction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surfaces(spark, sf_dir).where(tx.is_correction(F.col("text"))).select("vec_label")


@q("text_cue_classes", f"""SELECT cue_id, CASE WHEN {' OR '.join(f"regexp_matches(gold_literal_surface, '{p}')" for p in tx.VERBATIM)} THEN 'verbatim' ELSE 'concept' END AS mode,
CASE WHEN NOT {_sql_any(tx.CORRECTION_CUE, 'gold_literal_surface')} AND {_sql_any(tx.HISTORICAL, 'gold_literal_surface')} THEN 'historical_verbatim' END AS intent FROM recall_cues""")
def text_cue_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("gold_literal_surface")
    return load(spark, sf_dir, "recall_cues").select("cue_id", tx.cue_mode(t).alias("mode"), tx.cue_intent(t).alias("intent"))


_SIG = lambda words: "(" + " OR ".join(f"contains(lower(coalesce(literal_surface, '')), '{w}')" for w in words) + ")"
_STRONG = f"({_SIG(tx.SIGNALS)} OR " + " OR ".join(f"(language = '{k}' AND {_SIG(v)})" for k, v in tx.SIGNALS_BY_LANGUAGE.items()) + ")"


@q("text_injection", f"SELECT vec_label, CASE WHEN coalesce({_STRONG}, FALSE) THEN 'strong' WHEN {_SIG(tx.WEAK_SIGNALS)} THEN 'weak' ELSE 'none' END AS severity FROM records")
def text_injection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surfaces(spark, sf_dir).select("vec_label", tx.injection(F.col("text"), F.col("language"))["severity"].alias("severity"))


@q("text_anchors")
def text_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surfaces(spark, sf_dir).select("vec_label", F.array_join(tx.entity_anchors(F.col("text")), " ").alias("anchors"))


@q("text_dates", f"SELECT vec_label FROM (SELECT vec_label, {_MADE} AS made FROM records) WHERE (year(made) = 2025 AND month(made) = 3) OR (month(made) = 7 AND day(made) = 4)")
def text_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    mentions = tx.date_mentions("what did we say in 2025-03, or on 4th of July; may I ask")
    return load(spark, sf_dir, "records").where(tx.matches_dates(parse_instant(F.col("created_at")), mentions)).select("vec_label")


@q("text_age_labels", f"""WITH r AS (SELECT vec_label, {_MADE} AS made FROM records), a AS (SELECT vec_label, epoch((SELECT max(made) FROM r)) - epoch(made) AS s FROM r)
SELECT vec_label, CASE WHEN s < 0 THEN '' WHEN s < 3600 THEN CAST(greatest(1, floor(s / 60)) AS BIGINT) || 'm' WHEN s < 172800 THEN CAST(floor(s / 3600) AS BIGINT) || 'h' WHEN s / 86400 < 14 THEN CAST(floor(s / 86400) AS BIGINT) || 'd' WHEN s / 86400 < 63 THEN CAST(floor(s / 604800) AS BIGINT) || 'w'
WHEN s / 86400 / 30.44 < 18 THEN CAST(floor(s / 86400 / 30.44) AS BIGINT) || 'mo' ELSE CAST(round_even(s / 86400 / 365.25, 0) AS BIGINT) || 'y' END AS age, round(least(1.0, greatest(0.0, s / 86400 / 30)), 6) AS penalty FROM a""")
def text_age_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = load(spark, sf_dir, "records").select("vec_label", F.unix_seconds(parse_instant(F.col("created_at"))).alias("made"))
    s = F.col("now") - F.col("made")
    return r.join(F.broadcast(r.agg(F.max("made").alias("now")))).select("vec_label", tx.age_label(s).alias("age"), F.round(tx.age_penalty(s / 86400), 6).alias("penalty"))


q.statement("text_idempotency_key", "SELECT row_id, sha2(concat_ws('|', sessionId, message.role, timestamp), 256) AS key FROM rank_reversed_planted", "SELECT row_id, sha256(concat_ws('|', sessionId, message.role, timestamp)) AS key FROM rank_reversed_planted")
q.statement("text_json_fields", "SELECT event_id, CAST(get_json_object(props, '$.k') AS INT) AS k FROM events", "SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k FROM events")
q.statement("text_token_estimate", "SELECT doc_id, CAST(floor(length(text) / 4) AS BIGINT) AS n FROM documents")


@q("text_json_tags", "SELECT vec_label, CAST(CASE WHEN json_valid(tags_json) THEN json_array_length(tags_json) END AS INT) AS n FROM records")
def text_json_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "records").select("vec_label", F.json_array_length("tags_json").alias("n"))


@q("text_tool_trailers", "SELECT row_id, CAST(len(n) AS INT) AS n_tools, array_to_string(n[1:8], ', ') AS tools FROM (SELECT row_id, list_distinct(list(name ORDER BY i)) AS n FROM (SELECT row_id, i, message.content[i].name AS name FROM (SELECT *, unnest(range(1, len(message.content) + 1)) AS i FROM rank_reversed_planted)) WHERE name IS NOT NULL AND name <> '' GROUP BY row_id)")
def text_tool_trailers(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = load(spark, sf_dir, "rank_reversed_planted").select("row_id", tx.tools_of(F.concat(F.lit("done."), tx.tools_trailer(F.col("message.content.name")))).alias("n"))
    return t.where(F.size("n") > 0).select("row_id", F.size("n").alias("n_tools"), F.array_join("n", ", ").alias("tools"))


@q("text_scrub", r"SELECT doc_id, regexp_replace(text, '(?im)^.*(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|-----BEGIN [A-Z ]*PRIVATE KEY-----|(?:password|passwd|secret|token|api[_-]?key)\s*[:=]\s*\S{8,}).*$', '[redacted]', 'g') AS text FROM documents")
def text_scrub(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", tx.scrub_secrets(F.col("text")).alias("text"))


@q("text_quantized_vectors", "WITH m AS (SELECT vec_id, embedding, list_max(list_transform(embedding, lambda x: abs(x::DOUBLE))) / 127.0 AS s FROM embeddings) SELECT vec_id, round(s, 8) AS scale, CAST(list_sum(list_transform(embedding, lambda x: round_even(x::DOUBLE / s, 0))) AS BIGINT) AS total FROM m")
def text_quantized_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = load(spark, sf_dir, "embeddings").select("vec_id", vec.quantized(F.col("embedding")).alias("z"))
    return z.select("vec_id", F.round("z.scale", 8).alias("scale"), F.aggregate("z.values", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


# ---- lexical search
_POST = f"(SELECT vec_label AS doc, len(t) AS len, unnest(t) AS token FROM (SELECT vec_label, {_TOKENS} AS t FROM records WHERE literal_surface IS NOT NULL) WHERE len(t) > 0)"
_WANT = "(" + ", ".join(f"'{t}'" for t in lex.query_tokens(CUE)) + ")"
_BM = f"""WITH p AS MATERIALIZED (SELECT * FROM {_POST}), h AS (SELECT doc, token, len, count(*) AS tf FROM p WHERE token IN {_WANT} GROUP BY ALL), d AS (SELECT token, count(*) AS df FROM h GROUP BY token),
s AS (SELECT count(*)::DOUBLE AS n, greatest(1.0, avg(len)) AS a FROM (SELECT DISTINCT doc, len FROM p)),
x AS (SELECT doc, token, ln(1.0 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / a)) AS score FROM h JOIN d USING (token), s)"""


@q("lexical_postings", f"SELECT doc, token, count(*) AS tf, CAST(max(len) AS INT) AS len FROM {_POST} GROUP BY doc, token")
def lexical_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lex.postings(surfaces(spark, sf_dir), "vec_label", "text")


@q("lexical_stats", f"SELECT count(*) AS n_docs, round(greatest(1.0, avg(len)), 6) AS avg_len FROM (SELECT DISTINCT doc, len FROM {_POST})")
def lexical_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lex.stats(surfaces(spark, sf_dir), "vec_label", "text").select("n_docs", F.round("avg_len", 6).alias("avg_len"))


@q("lexical_search_any", f"{_BM} SELECT doc, round(sum(score), 6) AS score FROM x GROUP BY doc ORDER BY sum(score) DESC, doc LIMIT 20")
def lexical_search_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lex.search_any(surfaces(spark, sf_dir), "vec_label", "text", CUE, 20).select("doc", F.round("score", 6).alias("score"))


def _soft_sql() -> str:
    ctes, prev = [], "(SELECT DISTINCT doc FROM x)"
    for i, t in enumerate(lex.query_tokens(CUE)):
        ctes.append(f"c{i} AS (SELECT doc FROM {prev} z WHERE NOT EXISTS (SELECT 1 FROM {prev} y JOIN x ON x.doc = y.doc AND x.token = '{t}') OR doc IN (SELECT doc FROM x WHERE token = '{t}'))")
        prev = f"c{i}"
    return f"{_BM}, {', '.join(ctes)} SELECT doc, round(sum(score), 6) AS score FROM x WHERE doc IN (SELECT doc FROM {prev}) GROUP BY doc ORDER BY sum(score) DESC, doc LIMIT 20"


@q("lexical_search_soft_and", _soft_sql())
def lexical_search_soft_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lex.search_soft_and(surfaces(spark, sf_dir), "vec_label", "text", CUE, 20).select("doc", F.round("score", 6).alias("score"))


@q("lexical_snippets", "WITH l AS (SELECT doc_id AS doc, i - 1 AS line_no, s[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS s, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents WHERE text IS NOT NULL)), "
   f"o AS (SELECT doc, line_no, len(list_intersect(list_distinct({_TOKENS.replace('literal_surface', 'line')}), {list(lex.query_tokens(CUE))})) AS overlap FROM l) "
   "SELECT doc, CAST(line_no AS INT) AS line_no, CAST(overlap AS INT) AS overlap FROM o WHERE overlap > 0 QUALIFY row_number() OVER (PARTITION BY doc ORDER BY overlap DESC, line_no) = 1")
def lexical_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    import string

    d = load(spark, sf_dir, "documents").withColumn("text", F.translate("text", string.ascii_uppercase, string.ascii_lowercase))
    return lex.snippet_lines(d, "doc_id", "text", CUE)


@q("lexical_literal_scan", "SELECT doc_id AS doc, CAST(length(substring(text, 1, instr(text, 'ERR-') - 1)) - length(replace(substring(text, 1, instr(text, 'ERR-') - 1), chr(10), '')) AS INT) AS line_no FROM documents WHERE instr(text, 'ERR-') > 0")
def lexical_literal_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lex.literal_scan(load(spark, sf_dir, "documents"), "doc_id", "text", "ERR-")


@q("lexical_chunks")
def lexical_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lex.chunked(load(spark, sf_dir, "documents"), "doc_id", "text").toDF("doc_id", "chunk_no", "chunk")


@q("lexical_entity_edges", "WITH t AS (SELECT DISTINCT record_id AS k, lower(split_part(tag, ':', 2)) AS t FROM record_tags WHERE tag LIKE 'topic:%'), u AS (SELECT t, k FROM t WHERE regexp_matches(t, '^[a-z]{5,}$') QUALIFY count(*) OVER (PARTITION BY t) BETWEEN 2 AND 8) SELECT DISTINCT a.k AS src, b.k AS dst, 0.3::DOUBLE AS weight FROM u a JOIN u b ON a.t = b.t AND a.k < b.k ORDER BY 1, 2 LIMIT 500")
def lexical_entity_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = load(spark, sf_dir, "record_tags").where("tag like 'topic:%'").select("record_id", F.substring_index("tag", ":", -1).alias("t"))
    return lex.entity_shared_edges(t, "record_id", "t")


# ---- fusion
_LANE = f"(SELECT doc, sum(score) AS score FROM x GROUP BY doc ORDER BY 2 DESC, doc LIMIT 100)"
_TRIL = f"(SELECT vec_label AS doc, len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) AS score FROM (SELECT vec_label, {_TRI.format(f'lower({_LOW})')} AS a, {_TRI.format(chr(39) + CUE + chr(39))} AS b FROM records WHERE literal_surface IS NOT NULL) WHERE len(a) > 0 ORDER BY round(score, 9) DESC, doc LIMIT 100)"


@q("hybrid_rrf", f"{_BM}, a AS (SELECT doc, 1.0 / (59 + row_number() OVER (ORDER BY round(score, 9) DESC, doc)) AS part FROM {_LANE.replace('ORDER BY 2', 'ORDER BY round(sum(score), 9)')}), b AS (SELECT doc, 1.0 / (59 + row_number() OVER (ORDER BY round(score, 9) DESC, doc)) AS part FROM {_TRIL}) SELECT doc, round(sum(part), 8)::DOUBLE AS rrf FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY doc ORDER BY rrf DESC, doc LIMIT 24")
def hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = surfaces(spark, sf_dir)
    a = lex.scored(d, "vec_label", "text", CUE).groupBy("doc").agg(F.round(F.sum("score"), 9).alias("score"))
    b = d.where(F.length("text") >= 3).select(F.col("vec_label").alias("doc"), F.round(tx.trigram_jaccard(F.col("text"), F.lit(CUE)), 9).alias("score"))
    return rk.rrf([a, b], "doc", "score").select("doc", F.round("rrf", 8).alias("rrf")).orderBy(F.desc("rrf"), "doc").limit(24)


_WHOLE = "len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"
_ALIVE = "trim(coalesce(tombstoned_at, '')) = ''"
#: The query vector: the well-formed embedding of least vec_label.
_RQV = f"(SELECT embedding AS qv FROM records WHERE {_WHOLE} ORDER BY vec_label LIMIT 1)"
_COS = "round(list_cosine_similarity(embedding::DOUBLE[], qv::DOUBLE[]), 9)"


def with_record_query(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Records with a well-formed embedding, their columns, and ``cos`` to the query vector (one broadcast row)."""
    r = load(spark, sf_dir, "records").where(vec.well_formed(F.col("embedding"), 64))
    one = r.orderBy("vec_label").limit(1).select(F.col("embedding").alias("qv"))
    return r.select("vec_label", "embedding", *columns).join(F.broadcast(one)).select("vec_label", *columns, F.round(vec.cosine(F.col("embedding"), F.col("qv")), 9).alias("cos"))


@q("hybrid_search", f"{_BM.replace('WHERE literal_surface IS NOT NULL', f'WHERE literal_surface IS NOT NULL AND {_ALIVE}')}, a AS (SELECT doc, round(sum(score), 9) AS bm25, row_number() OVER (ORDER BY round(sum(score), 9) DESC, doc) AS ra FROM x GROUP BY doc QUALIFY ra <= 24), "
   f"b AS (SELECT vec_label AS doc, {_COS} AS cos, row_number() OVER (ORDER BY {_COS} DESC, vec_label) AS rb FROM records, {_RQV} WHERE {_WHOLE} AND {_ALIVE} QUALIFY rb <= 24) "
   "SELECT doc, round(coalesce(1.0::DOUBLE / (59 + ra), 0) + coalesce(1.0::DOUBLE / (59 + rb), 0), 8) AS rrf, CASE WHEN ra IS NOT NULL AND rb IS NOT NULL THEN 'both' WHEN ra IS NOT NULL THEN 'lexical' ELSE 'semantic' END AS lane, round(cos, 3) AS cos FROM a FULL JOIN b USING (doc) ORDER BY coalesce(1.0::DOUBLE / (59 + ra), 0) + coalesce(1.0::DOUBLE / (59 + rb), 0) DESC, coalesce(bm25, 0) DESC, coalesce(b.cos, 0) DESC, doc LIMIT 24")
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The k = 24 best of a lexical and a semantic lane of k each among living records, by reciprocal ranks from 0."""
    alive = load(spark, sf_dir, "records").where("trim(coalesce(tombstoned_at, '')) = ''").select("vec_label", F.col("literal_surface").alias("text"))
    a = lex.scored(alive, "vec_label", "text", CUE).groupBy("doc").agg(F.round(F.sum("score"), 9).alias("bm25"))
    b = with_record_query(spark, sf_dir, "tombstoned_at").where("trim(coalesce(tombstoned_at, '')) = ''").select(F.col("vec_label").alias("doc"), "cos")
    return rk.two_lanes(a, b, "doc", "bm25", "cos", 24).select("doc", F.round("rrf", 8).alias("rrf"), "lane", F.round("cos", 3).alias("cos"))


_AT = "TIMESTAMP '2025-12-31 00:00:00'"
_THEN = f"embedding_pending IS DISTINCT FROM 1 AND {_MADE} <= {_AT} AND ({_INSTANT.format('tombstoned_at')} IS NULL OR {_INSTANT.format('tombstoned_at')} > {_AT})"


@q("recall_similar_as_of", f"SELECT 'cue' AS asked, vec_label, {_COS} AS score FROM records, {_RQV} WHERE {_WHOLE} AND {_ALIVE} AND embedding_pending IS DISTINCT FROM 1 QUALIFY row_number() OVER (ORDER BY {_COS} DESC, vec_label) <= 10 "
   f"UNION ALL SELECT 'cue and time', vec_label, {_COS} FROM records, {_RQV} WHERE {_WHOLE} AND {_THEN} QUALIFY row_number() OVER (ORDER BY {_COS} DESC, vec_label) <= 10 "
   f"UNION ALL SELECT 'time', vec_label, 0.0 FROM records WHERE {_THEN} QUALIFY row_number() OVER (ORDER BY {_MADE} DESC, vec_label) <= 10")
def recall_similar_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What recall answers with a cue, with a cue as of a time, and as of a time alone; with neither it answers nothing."""
    at = F.lit("2025-12-31 00:00:00Z").cast("timestamp")
    columns = ("created_at", "tombstoned_at", "embedding_pending")
    ready = F.coalesce("embedding_pending", F.lit(0)) != 1
    cued = with_record_query(spark, sf_dir, *columns).where(ready)
    every = load(spark, sf_dir, "records").where(ready).select("vec_label", *columns, F.lit(0.0).alias("cos"))
    return reduce(DataFrame.union, [rk.recalled(cued, "cue", None).select(F.lit("cue").alias("asked"), "vec_label", F.col("cos").alias("score")), rk.recalled(cued, "cue", at).select(F.lit("cue and time"), "vec_label", "cos"), rk.recalled(every, None, at).select(F.lit("time"), "vec_label", "cos"), rk.recalled(every, None, None).select(F.lit("nothing"), "vec_label", "cos")])


@q("tools_rrf_weak_gate", f"{_BM}, a AS (SELECT doc, 1.0::DOUBLE / (60 + row_number() OVER (ORDER BY round(score, 9) DESC, doc)) AS part FROM {_LANE.replace('ORDER BY 2', 'ORDER BY round(sum(score), 9)')}), b AS (SELECT doc, 1.0::DOUBLE / (60 + row_number() OVER (ORDER BY round(score, 9) DESC, doc)) AS part FROM {_TRIL}), t AS (SELECT doc, round(sum(part), 12) AS rrf FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY doc ORDER BY rrf DESC, doc LIMIT 10) SELECT doc, round(rrf, 8) AS rrf, max(rrf) OVER () < 0.03 AS weak FROM t")
def tools_rrf_weak_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = surfaces(spark, sf_dir)
    a = lex.scored(d, "vec_label", "text", CUE).groupBy("doc").agg(F.round(F.sum("score"), 9).alias("score"))
    b = d.where(F.length("text") >= 3).select(F.col("vec_label").alias("doc"), F.round(tx.trigram_jaccard(F.col("text"), F.lit(CUE)), 9).alias("score"))
    top = rk.rrf([a, b], "doc", "score", base=1).withColumn("rrf", F.round("rrf", 12)).orderBy(F.desc("rrf"), "doc").limit(10)
    return top.withColumn("weak", F.max("rrf").over(W.partitionBy()) < 0.03).withColumn("rrf", F.round("rrf", 8))


QUERIES, SQL = q.queries, q.sql
