"""Streams of events and transcript lines: exactly-once ingest, windows, keyed state, joins, dead letters.

Every stream runs with ``availableNow`` into Parquet under the shared folder, with its checkpoint beside it, so a run
that lost an executor, or its driver, goes on from the last committed batch. State is bounded by watermarks.
"""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from engrava.storage import _delete, shared_dir

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


#: A time after all others, in files that mark the end of a stream (nanoseconds of it still fit 64 bits).
AFTER_ALL = "2200-01-01 00:00:00"


def event_stream(spark: SparkSession, folder: str, pattern: str = "events.parquet", bytes_per_batch: int = 1 << 30) -> DataFrame:
    """New files of the folder, oldest first, so many bytes in each batch (one file at least); times as instants in UTC."""
    s = spark.readStream.schema(EVENTS).option("pathGlobFilter", pattern).option("maxBytesPerTrigger", bytes_per_batch).parquet(folder)
    return s.withColumn("ts", F.concat(F.col("ts").cast("string"), F.lit("Z")).cast("timestamp"))


class Ending:
    """A stream that can be brought to its end: ``stream`` is the given one and the mark that ``close`` writes.

    Windows, sessions and other state come out once the watermark has passed them, so what is still open when the last
    row is in would stay in the state. The mark is one row, null but for its time, which is after all others, and for
    ``values``; it moves the watermark past everything. Apply the watermark to ``stream``, and leave the mark's own key
    out where an operator gives rows out at once. A stream that goes on later isn't to be closed: rows behind
    the mark are late.
    """

    def __init__(self, stream: DataFrame, time: str, values: dict | None = None):
        spark = stream.sparkSession
        self.folder, self.schema, self.row = f"{shared_dir(spark)}/engrava/end-{uuid.uuid4().hex}", stream.schema, {**(values or {}), time: AFTER_ALL}
        self.spark = spark
        path = spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
        atexit.register(_delete, spark, self.folder)
        self.stream = stream.unionByName(spark.readStream.schema(stream.schema).parquet(self.folder))

    def close(self) -> None:
        cells = [F.lit(self.row.get(f.name)).cast(f.dataType).alias(f.name) for f in self.schema.fields]
        self.spark.range(1).select(*cells).coalesce(1).write.mode("append").parquet(self.folder)


def drained(stream: DataFrame, mode: str = "append", name: str | None = None, each: Callable | None = None, ending: Ending | None = None) -> DataFrame:
    """Run the stream over all there is and read what it wrote. With ``each`` batches go through it (foreachBatch).

    Mode complete keeps the last batch's whole result. Append writes what is final; with ``ending`` the stream is then
    closed and run on, so that nothing stays behind in its state. Mode update, whose batches only make sense merged by
    key, needs an ``each`` that does so.
    """
    if mode == "update" and each is None:
        raise ValueError("update gives changed rows only: pass an each that merges them by key")
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/engrava/stream-{name or uuid.uuid4().hex}"
    atexit.register(_delete, spark, base)

    def run() -> None:
        writer = stream.writeStream.option("checkpointLocation", f"{base}/state").trigger(availableNow=True)
        if each is not None:
            q = writer.outputMode(mode).foreachBatch(lambda df, n: each(df, n, f"{base}/out")).start()
        elif mode == "append":
            q = writer.outputMode("append").format("parquet").option("path", f"{base}/out").start()
        else:
            q = writer.outputMode(mode).foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{base}/out")).start()
        q.awaitTermination()

    run()
    if ending is not None:
        ending.close()
        run()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def deduplicated(stream: DataFrame, key: str, time: str, late: str) -> DataFrame:
    """One row per key within the watermark; the same key in a later run is found by ``merge_once``."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def merge_once(key: str, time: str) -> Callable:
    """foreachBatch: append the rows whose key the target doesn't have; a batch that is run again writes the same file.

    The target is kept by day of ``time``, and only the days that a batch has are read of it. So copies must carry the
    time of the first, as redelivered rows do; rows without a time are a day of their own.
    """

    def each(df: DataFrame, n: int, path: str) -> None:
        spark = df.sparkSession
        new = df.withColumn("__day", F.coalesce(F.to_date(time).cast("string"), F.lit("none"))).dropDuplicates([key])
        days = [r[0] for r in new.select("__day").distinct().collect()]
        try:
            old = spark.read.parquet(path).where(F.col("__day").cast("string").isin(days) & (F.col("__batch") != n)).select(key)
            new = new.join(old, key, "left_anti")
        except Exception as e:  # the first batch: there is no target yet
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        new.withColumn("__batch", F.lit(n)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("__day", "__batch").parquet(path)

    return each


def quarantining(bad: str, each: Callable | None = None) -> Callable:
    """foreachBatch: rows whose column ``bad`` is not null go to the folder quarantine beside the output, with the
    number of their batch; the others are written, or go through ``each``. A batch that is run again overwrites its own."""

    def run(df: DataFrame, n: int, path: str) -> None:
        df.where(F.col(bad).isNotNull()).select(F.col(bad).alias("line")).write.mode("overwrite").parquet(f"{path.rsplit('/', 1)[0]}/quarantine/batch={n}")
        good = df.where(F.col(bad).isNull()).drop(bad)
        if each is not None:
            each(good, n, path)
        else:
            good.write.mode("overwrite").parquet(f"{path}/batch={n}")

    return run


BUFFERED = "user_id long, flushed_because string, first_id long, n long"


def buffered(stream: DataFrame, late: str, size: int, age_s: int) -> DataFrame:
    """(user_id, flushed_because, first_id, n): events of a user gathered until there are ``size``, or until the
    watermark is ``age_s`` past the first of them. The state is one number of rows, not the rows."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out = []
        if state.hasTimedOut:
            _, first, n = state.get
            state.remove()
            out.append((key[0], "age", first, n))
        else:
            now = list(state.get) if state.exists else None
            rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
            for ts, i in zip(rows["ts"], rows["event_id"]):
                us = int(ts.value // 1000)
                if now is not None and us - now[0] >= age_s * 1_000_000:
                    out.append((key[0], "age", now[1], now[2]))
                    now = None
                now = [us, int(i), 1] if now is None else [now[0], now[1], now[2] + 1]
                if now[2] == size:
                    out.append((key[0], "size", now[1], now[2]))
                    now = None
            if now is None:
                if state.exists:
                    state.remove()
            else:
                state.update(tuple(now))
                state.setTimeoutTimestamp(max(now[0] // 1000 + age_s * 1000, state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame(out, columns=["user_id", "flushed_because", "first_id", "n"])

    return stream.withWatermark("ts", late).groupBy("user_id").applyInPandasWithState(run, BUFFERED, "t long, first long, n long", "append", GroupStateTimeout.EventTimeTimeout)


def windowed(stream: DataFrame, time: str, late: str, length: str, slide: str | None, by: str, value: str) -> DataFrame:
    w = F.window(time, length, slide) if slide else F.window(time, length)
    return stream.withWatermark(time, late).groupBy(w.alias("w"), by).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start_at"), by, "n", "total")


def sessions(stream: DataFrame, time: str, late: str, gap: str, by: str) -> DataFrame:
    return stream.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start_at"), F.col("w.end").alias("end_at"), by, "n")


def recent(n: int, order: list, by: str | None = None) -> Callable:
    """foreachBatch: keep the newest n rows of all batches (per key ``by``, if given)."""
    from pyspark.sql import Window as W

    def each(df: DataFrame, batch: int, path: str) -> None:
        spark, rows = df.sparkSession, df
        if batch:
            rows = rows.unionByName(spark.read.parquet(f"{path}/_{batch - 1}"))
        rows = rows.orderBy(*order).limit(n) if by is None else rows.withColumn("__r", F.row_number().over(W.partitionBy(by).orderBy(*order))).where(F.col("__r") <= n).drop("__r")
        rows.write.mode("overwrite").parquet(f"{path}/_{batch}")
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return each


CLUSTERS = "user_id long, start_at timestamp, n long, first_id long, last_id long"


def first_event_clusters(length_s: int = 300):
    """applyInPandasWithState function: windows that start at a key's first unassigned event and last ``length_s``; an
    event beyond starts the next. The state is one open window per key. Rows of a batch are taken in order of time."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out = []
        if state.hasTimedOut:
            s = state.get
            state.remove()
            yield pd.DataFrame([(key[0], pd.Timestamp(s[0], unit="us", tz="UTC"), s[1], s[2], s[3])], columns=["user_id", "start_at", "n", "first_id", "last_id"])
            return
        now = list(state.get) if state.exists else None
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        for ts, i in zip(rows["ts"], rows["event_id"]):
            us = int(ts.value // 1000)
            if now is None or us - now[0] > length_s * 1_000_000:
                if now is not None:
                    out.append((key[0], pd.Timestamp(now[0], unit="us", tz="UTC"), now[1], now[2], now[3]))
                now = [us, 1, int(i), int(i)]
            else:
                now[1], now[3] = now[1] + 1, int(i)
        state.update(tuple(now))
        state.setTimeoutTimestamp(max(now[0] // 1000 + length_s * 1000, state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame(out, columns=["user_id", "start_at", "n", "first_id", "last_id"])

    return run


def clustered(stream: DataFrame, late: str, length_s: int = 300) -> DataFrame:
    return stream.withWatermark("ts", late).groupBy("user_id").applyInPandasWithState(first_event_clusters(length_s), CLUSTERS, "t long, n long, a long, b long", "append", GroupStateTimeout.EventTimeTimeout)


def around_strong(stream: DataFrame, strong: str, late: str, seconds: int) -> DataFrame:
    """(event_id, strong_id): events of a user at most ``seconds`` before a strong event of that user; an interval
    join of the stream with itself, its state bounded by both watermarks."""
    a = stream.select(F.col("event_id"), F.col("user_id").alias("u"), F.col("ts").alias("t")).withWatermark("t", late)
    b = stream.where(strong).select(F.col("event_id").alias("strong_id"), F.col("user_id").alias("v"), F.col("ts").alias("s")).withWatermark("s", late)
    return a.join(b, F.expr(f"u = v AND t <= s AND t >= s - INTERVAL {seconds} SECONDS AND event_id <> strong_id")).select("event_id", "strong_id")


def transcript_lines(spark: SparkSession, folder: str, schema: str, pattern: str = "*.jsonl", bytes_per_batch: int = 1 << 30) -> DataFrame:
    """Newline-JSON as a stream; a line that doesn't parse keeps its text in ``_corrupt_record`` (see ``quarantining``)."""
    return spark.readStream.schema(f"{schema}, _corrupt_record string").option("pathGlobFilter", pattern).option("maxBytesPerTrigger", bytes_per_batch).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(folder)


def fence(layers: dict[str, DataFrame], time: str, source: str) -> DataFrame:
    """(layer, state): current, lagging, impossible (ahead of its source) or never_run, by newest time."""
    from functools import reduce

    newest = reduce(DataFrame.union, [d.agg(F.lit(k).alias("layer"), F.max(time).alias("at")) for k, d in layers.items()])
    src = newest.where(F.col("layer") == source).select(F.col("at").alias("source_at"))  # one row
    state = F.when(F.col("at").isNull(), "never_run").when(F.col("at") > F.col("source_at"), "impossible").when(F.col("at") < F.col("source_at"), "lagging").otherwise("current")
    return newest.join(F.broadcast(src)).select("layer", state.alias("state"))
