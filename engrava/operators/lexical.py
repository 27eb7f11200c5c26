"""Lexical search: postings, BM25, soft conjunction, snippets, chunks."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from engrava.functions.text import tokens
from engrava.functions.tokenizer import token_spans, tokenizer_path
from engrava.storage import materialize

K1, B = 1.2, 0.75
MOST_QUERY_TOKENS = 8


def tokenized(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc, t): the tokens of each document, computed once (the generator keeps later columns from repeating it)."""
    return docs.select(F.col(key).alias("doc"), F.explode(F.array(tokens(F.col(text)))).alias("t")).where(F.size("t") > 0)


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, token, tf, len): one row per document and token. A document's tokens are counted where it is."""
    t = tokenized(docs, key, text)
    return t.select("doc", F.size("t").alias("len"), F.explode("t").alias("token")).groupBy("doc", "token").agg(F.count("*").alias("tf"), F.first("len").alias("len"))


def stats(docs: DataFrame, key: str, text: str) -> DataFrame:
    """One row: n_docs with a token, and their mean length, at least 1."""
    return tokenized(docs, key, text).select(F.size("t").alias("len")).agg(F.count("*").alias("n_docs"), F.greatest(F.lit(1.0), F.avg("len")).alias("avg_len"))


def idf(n_docs: Column, df: Column) -> Column:
    return F.log(1.0 + (n_docs - df + 0.5) / (df + 0.5))


def bm25(tf: Column, df: Column, length: Column, n_docs: Column, avg_len: Column, k1: float = K1, b: float = B) -> Column:
    return idf(n_docs, df) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / avg_len))


def query_tokens(text: str, most: int = MOST_QUERY_TOKENS) -> list[str]:
    """The first distinct tokens of a query, by the rule of ``tokens``."""
    out: list[str] = []
    for raw in re.findall(r"[A-Za-z_][A-Za-z0-9_]{1,}|[0-9]{3,}", text or ""):
        low = raw.lower()
        snake = [p for p in low.split("_") if len(p) > 2]
        camel = [p.lower() for p in re.split(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", raw) if len(p) > 2]
        out += [low, *(snake if len(snake) > 1 else []), *(camel if len(camel) > 1 else [])]
    return list(dict.fromkeys(out))[:most]


def scored(docs: DataFrame, key: str, text: str, query: str, most: int = MOST_QUERY_TOKENS) -> DataFrame:
    """(doc, token, score) of a query's tokens.

    Texts are read and tokenised once, into a narrow table of lengths and of the few query tokens each document has;
    the statistics (one row) and the scores both come from it.
    """
    wanted = query_tokens(query, most)
    few = F.filter("t", lambda x: x.isin(wanted)) if wanted else F.array().cast("array<string>")
    narrow = materialize(tokenized(docs, key, text).select("doc", F.size("t").alias("len"), few.alias("few")), "tokens")
    hit = narrow.where(F.size("few") > 0).select("doc", "len", F.explode("few").alias("token")).groupBy("doc", "token", "len").agg(F.count("*").alias("tf"))
    df = hit.groupBy("token").agg(F.count("*").alias("df"))  # at most ``most`` rows
    s = narrow.agg(F.count("*").alias("n_docs"), F.greatest(F.lit(1.0), F.avg("len")).alias("avg_len"))  # one row
    return hit.join(F.broadcast(df), "token").join(F.broadcast(s)).select("doc", "token", bm25(F.col("tf"), F.col("df"), F.col("len"), F.col("n_docs"), F.col("avg_len")).alias("score"))


def search_any(docs: DataFrame, key: str, text: str, query: str, k: int) -> DataFrame:
    """Documents with any token of the query, best first by the sum of BM25, then by key."""
    return scored(docs, key, text, query).groupBy("doc").agg(F.sum("score").alias("score")).orderBy(F.desc("score"), "doc").limit(k)


def search_soft_and(docs: DataFrame, key: str, text: str, query: str, k: int) -> DataFrame:
    """Documents with all tokens, as far as there are any: tokens are taken in order, and one that would leave nothing
    is passed over. Scores sum over all tokens a kept document has."""
    wanted = query_tokens(query)
    per = scored(docs, key, text, query).groupBy("doc").agg(F.sum("score").alias("score"), F.collect_set("token").alias("has"))
    kept: list[str] = []
    masks = per.groupBy(F.array_sort("has").alias("has")).count().select("has").collect()  # at most 2**8 rows
    alive = [set(r.has) for r in masks]
    for t in wanted:
        if any(t in m for m in alive):
            alive = [m for m in alive if t in m]
            kept.append(t)
    out = per
    for t in kept:
        out = out.where(F.array_contains("has", t))
    return out.select("doc", "score").orderBy(F.desc("score"), "doc").limit(k)


def snippet_lines(docs: DataFrame, key: str, text: str, query: str) -> DataFrame:
    """(doc, line_no, overlap): the line of each document that shares most tokens with the query, the lower on ties."""
    wanted = F.array(*[F.lit(t) for t in query_tokens(query)])
    lines = docs.select(F.col(key).alias("doc"), F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "line"))
    return lines.withColumn("overlap", F.size(F.array_intersect(tokens(F.col("line")), wanted))).groupBy("doc").agg(F.max(F.struct("overlap", (-F.col("line_no")).alias("up"))).alias("m")).where("m.overlap > 0").select("doc", (-F.col("m.up")).alias("line_no"), "m.overlap")


def literal_scan(docs: DataFrame, key: str, text: str, needle: str) -> DataFrame:
    """(doc, line_no): the line of the first exact, case-sensitive occurrence."""
    at = F.instr(F.col(text), needle)
    before = F.substring(F.col(text), F.lit(1), at - 1)
    return docs.where(at > 0).select(F.col(key).alias("doc"), (F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit("")))).alias("line_no"))


def _chunks(text: str, spans: list[tuple[int, int]], size: int, overlap: int) -> list[str]:
    """Windows of about ``size`` units (words, or tokens), cut back to the last sentence end in their second half."""
    out, i = [], 0
    while i < len(spans):
        window = spans[i : i + size]
        start, end, used = window[0][0], window[-1][1], size - overlap
        if len(window) == size:
            ends = [m.end() for m in re.finditer(r"\.(?=\s)", text[start:end])]
            if ends and ends[-1] >= (end - start) // 2:
                end = start + ends[-1]
                inside = sum(1 for s, _ in window if s < end)
                used = min(size - overlap, max(1, inside - overlap))
        out.append(text[start:end])
        i += used
    if len(out) > 1 and len(out[-1]) < 12:
        out[-2:] = [f"{out[-2]} {out[-1]}"]
    return [] if len(out) == 1 and len(out[0]) < 12 else out


def _word_spans(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in re.finditer(r"\S+", text)]


def _chunk_rows(docs: DataFrame, key: str, text: str, spans_of, size: int, overlap: int) -> DataFrame:
    def run(batches):
        spans = spans_of()
        for b in batches:
            rows = [(i, n, c) for i, t in enumerate(b.column(1).to_pylist()) if t and t.strip() for n, c in enumerate(_chunks(t.strip(), spans(t.strip()), size, overlap))]
            if rows:
                i, n, c = zip(*rows)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(i, pa.int64())), pa.array(n, pa.int32()), pa.array(c)], names=["key", "chunk_no", "chunk"])

    return docs.select(key, text).mapInArrow(run, f"key {dict(docs.dtypes)[key]}, chunk_no int, chunk string")


def chunked(docs: DataFrame, key: str, text: str, size: int = 190, overlap: int = 36) -> DataFrame:
    """(key, chunk_no, chunk): sliding windows of words (190 of them are about 256 tokens) with carry-over."""
    return _chunk_rows(docs, key, text, lambda: _word_spans, size, overlap)


def token_chunked(docs: DataFrame, key: str, text: str, size: int = 256, overlap: int = 48, tokenizer: str = tokenizer_path()) -> DataFrame:
    """(key, chunk_no, chunk): sliding windows of tokens of a byte-level vocabulary, with carry-over. Null and blank texts
    have no chunks, nor has a text of less than twelve characters."""
    return _chunk_rows(docs, key, text, lambda: token_spans(tokenizer), size, overlap)


def entity_shared_edges(tags: DataFrame, key: str, tag: str, low: int = 2, high: int = 8, most: int = 500) -> DataFrame:
    """(src, dst, weight): records that share a rare alphabetic token; tokens are in ``low``..``high`` records, so a
    token gives 28 pairs at most."""
    t = tags.select(F.col(key).alias("k"), F.lower(F.col(tag)).alias("t")).where(F.col("t").rlike("^[a-z]{5,}$")).distinct()
    rare = t.groupBy("t").agg(F.count("*").alias("df")).where(F.col("df").between(low, high))
    u = t.join(rare, "t").select("t", "k")
    return u.toDF("t", "src").join(u.toDF("t", "dst"), "t").where("src < dst").select("src", "dst").distinct().orderBy("src", "dst").limit(most).withColumn("weight", F.lit(0.3))
