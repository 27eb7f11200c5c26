"""Streams over the events table, run to the end and held against the same in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from engrava.plans.registry import Queries
from engrava.streaming import ingest as si
from engrava.tables import load

q = Queries()


def stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return si.event_stream(spark, sf_dir)


@q("stream_exactly_once", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def stream_exactly_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    twice = stream(spark, sf_dir).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    once = si.drained(si.deduplicated(twice.drop("copy"), "event_id", "ts", "1 hour"))
    return once.groupBy("event_type").agg(F.count("*").alias("n"))


@q("stream_merge_once", "SELECT count(*) AS n, count(DISTINCT event_id) AS n_ids FROM events")
def stream_merge_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    twice = stream(spark, sf_dir).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    return si.drained(twice, each=si.merge_once("event_id", "ts")).agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("n_ids"))


@q("stream_windows", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start_at, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = si.drained(si.windowed(stream(spark, sf_dir), "ts", "10 minutes", "1 hour", None, "event_type", "value"), "complete")
    return w.select(F.date_format("start_at", "yyyy-MM-dd HH:mm:ss").alias("start_at"), "event_type", "n", F.round("total", 4).alias("total"))


def closing(spark: SparkSession, sf_dir: str) -> si.Ending:
    return si.Ending(stream(spark, sf_dir), "ts", {"event_id": -1, "user_id": -1})


_AT = "strftime({}, '%Y-%m-%d %H:%M:%S')"


@q("stream_sliding_windows", f"SELECT {_AT.format('s')} AS start_at, event_type, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT event_type, value, unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS s FROM events) GROUP BY ALL")
def stream_sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    end = closing(spark, sf_dir)
    w = si.drained(si.windowed(end.stream, "ts", "10 minutes", "1 hour", "30 minutes", "event_type", "value"), ending=end)
    return w.select(F.date_format("start_at", "yyyy-MM-dd HH:mm:ss").alias("start_at"), "event_type", "n", F.round("total", 4).alias("total"))


@q("stream_sessions", f"SELECT {_AT.format('min(ts)')} AS start_at, {_AT.format('max(ts) + INTERVAL 30 MINUTE')} AS end_at, user_id, count(*) AS n FROM (SELECT *, sum(CASE WHEN ts >= before + INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)) GROUP BY user_id, s")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    end = closing(spark, sf_dir)
    s = si.drained(si.sessions(end.stream, "ts", "10 minutes", "30 minutes", "user_id"), ending=end)
    at = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return s.select(at("start_at"), at("end_at"), "user_id", "n")


@q("stream_recent", "SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 200")
def stream_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = si.drained(stream(spark, sf_dir), each=si.recent(200, [F.desc("ts"), F.desc("event_id")]))
    return out.orderBy(F.desc("ts"), F.desc("event_id")).limit(200).select("event_id")


#: The rows of a user in order; c finds, for each first row, the first one that starts the next window.
_NEXT = "WITH RECURSIVE e AS (SELECT user_id, ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events), c AS (SELECT user_id, r, ts FROM e WHERE r = 1 UNION ALL SELECT user_id, r, ts FROM (SELECT e.user_id, e.r, e.ts, row_number() OVER (PARTITION BY e.user_id ORDER BY e.r) AS k FROM c JOIN e ON e.user_id = c.user_id AND e.r > c.r AND {}) WHERE k = 1)"


@q("stream_first_event_clusters", _NEXT.format("e.ts > c.ts + INTERVAL 3600 SECOND") + f" SELECT user_id, {_AT.format('min(ts)')} AS start_at, count(*) AS n, arg_min(event_id, r) AS first_id, arg_max(event_id, r) AS last_id FROM (SELECT e.*, (SELECT max(c.r) FROM c WHERE c.user_id = e.user_id AND c.r <= e.r) AS w FROM e) GROUP BY user_id, w")
def stream_first_event_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    end = closing(spark, sf_dir)
    return si.drained(si.clustered(end.stream, "10 minutes", 3600), ending=end).withColumn("start_at", F.date_format("start_at", "yyyy-MM-dd HH:mm:ss"))


@q("stream_buffers", _NEXT.format("(e.r = c.r + 5 OR e.ts >= c.ts + INTERVAL 86400 SECOND)") + " SELECT user_id, CASE WHEN count(*) = 5 THEN 'size' ELSE 'age' END AS flushed_because, arg_min(event_id, r) AS first_id, count(*) AS n FROM (SELECT e.*, (SELECT max(c.r) FROM c WHERE c.user_id = e.user_id AND c.r <= e.r) AS w FROM e) GROUP BY user_id, w")
def stream_buffers(spark: SparkSession, sf_dir: str) -> DataFrame:
    end = closing(spark, sf_dir)
    return si.drained(si.buffered(end.stream, "10 minutes", 5, 86400), ending=end)


@q("stream_around_strong", "SELECT a.event_id, b.event_id AS strong_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.ts <= b.ts AND a.ts >= b.ts - INTERVAL 3600 SECONDS AND a.event_id <> b.event_id WHERE b.event_type = 'purchase'")
def stream_around_strong(spark: SparkSession, sf_dir: str) -> DataFrame:
    return si.drained(si.around_strong(stream(spark, sf_dir), "event_type = 'purchase'", "10 minutes", 3600))


@q("stream_late_rows_asof", "SELECT event_type, count(*) AS n FROM events WHERE ts <= TIMESTAMP '2024-01-10 00:00:00' GROUP BY event_type")
def stream_late_rows_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Late rows keep their own time; an as-of read sees them once they are in."""
    return si.drained(stream(spark, sf_dir)).where(F.col("ts") <= F.lit("2024-01-10 00:00:00Z").cast("timestamp")).groupBy("event_type").agg(F.count("*").alias("n"))


@q("layer_fence", "SELECT 'events' AS layer, 'current' AS state UNION ALL SELECT 'purchases', CASE WHEN max(ts) FILTER (event_type = 'purchase') IS NULL THEN 'never_run' WHEN max(ts) FILTER (event_type = 'purchase') < max(ts) THEN 'lagging' ELSE 'current' END FROM events UNION ALL SELECT 'none', 'never_run'")
def layer_fence(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events")
    return si.fence({"events": e, "purchases": e.where("event_type = 'purchase'"), "none": e.limit(0)}, "ts", "events")


QUERIES, SQL = q.queries, q.sql
