"""Which retrieved hits a reply really used, and what is used after what."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

HITS = "struct<hits: array<struct<record_id: string, score: double, literal_surface: string>>>"


def _starts(text: Column, needle: Column) -> Column:
    """Where each occurrence of a text starts, from the lengths of the pieces between them."""
    pieces = F.split(text, F.concat(F.lit(r"\Q"), needle, F.lit(r"\E")), -1)
    none = F.array().cast("array<int>")
    step = lambda acc, p: F.struct((acc["at"] + F.length(p) + F.length(needle)).alias("at"), F.concat(acc["starts"], F.array(acc["at"] + F.length(p))).alias("starts"))
    return F.aggregate(F.slice(pieces, 1, F.size(pieces) - 1), F.struct(F.lit(0).alias("at"), none.alias("starts")), step)["starts"]


def used_hits(hits: Column, reply: Column) -> Column:
    """Ids of the hits whose text stands in the reply, exactly, in order of first mention.

    Hits without id or text are not used. A mention inside a longer mention of another hit doesn't count, and a reply
    that repeats all hits in their given order is an echo, which uses none.
    """
    text = F.coalesce(reply, F.lit(""))
    fine = F.filter(hits, lambda h: h["record_id"].isNotNull() & (F.trim(F.coalesce(h["literal_surface"], F.lit(""))) != ""))
    spans = F.flatten(F.transform(fine, lambda h: F.transform(_starts(text, F.trim(h["literal_surface"])), lambda s: F.struct(s.alias("at"), (s + F.length(F.trim(h["literal_surface"]))).alias("end"), h["record_id"].alias("id")))))
    outer = F.filter(spans, lambda p: ~F.exists(spans, lambda o: (o["at"] <= p["at"]) & (o["end"] >= p["end"]) & (o["end"] - o["at"] > p["end"] - p["at"])))
    used = F.array_distinct(F.transform(F.array_sort(outer), lambda p: p["id"]))
    given = F.transform(hits, lambda h: h["record_id"])
    none = F.array().cast("array<string>")
    return F.when(hits.isNull() | (F.coalesce(used == given, F.lit(False)) & (F.size(given) > 0)), none).otherwise(used)


def transcript_uses(rows: DataFrame) -> DataFrame:
    """(session, row_id, used): for each result of a search the hits that the session's next text of the assistant used.

    rows are transcript rows with row_id, sessionId and message; a result that is no JSON has no hits. One window over
    each session's results and replies.
    """
    b = rows.where("trim(coalesce(sessionId, '')) <> ''").select(F.col("sessionId").alias("session"), "row_id", F.lower(F.trim("message.role")).alias("role"), F.posexplode("message.content"))
    b = b.select("session", "row_id", "pos", F.when(F.col("col.type") == "tool_result", F.from_json("col.content", HITS)["hits"]).alias("hits"), F.when((F.col("role") == "assistant") & (F.col("col.type") == "text") & (F.trim("col.text") != ""), F.col("col.text")).alias("reply"))
    few = b.where("hits IS NOT NULL OR reply IS NOT NULL")
    # from the end, so that the frame only grows: the last reply seen is the next one in order
    w = W.partitionBy("session").orderBy(F.desc("row_id"), F.desc("pos")).rowsBetween(W.unboundedPreceding, -1)
    return few.withColumn("next", F.last("reply", ignorenulls=True).over(w)).where("hits IS NOT NULL AND next IS NOT NULL").select("session", "row_id", used_hits(F.col("hits"), F.col("next")).alias("used"))


def use_pairs(uses: DataFrame) -> DataFrame:
    """(a, b, n, n_sessions): hits used one directly after the other in a reply."""
    p = uses.where(F.size("used") > 1).select("session", F.explode(F.arrays_zip(F.slice("used", 1, F.size("used") - 1).alias("a"), F.expr("slice(used, 2, size(used) - 1)").alias("b"))).alias("p"))
    return p.groupBy("p.a", "p.b").agg(F.count("*").alias("n"), F.countDistinct("session").alias("n_sessions"))
