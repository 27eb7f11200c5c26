"""Streams of several files: batches bounded by bytes, rows that come late, twice or broken, and state that is open at the end."""

import json
import time

from pyspark.sql import functions as F

from engrava.streaming import ingest as si


def write(folder, name, lines):
    p = folder / name
    p.write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines) + "\n")
    time.sleep(0.05)  # files are taken in order of their times


def test_files_come_in_batches_and_broken_lines_are_kept_apart(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    row = lambda i, ts: {"id": i, "ts": ts}
    write(src, "a.jsonl", [row(1, "2025-01-01T00:00:00Z"), row(2, "2025-01-01T01:00:00Z")])
    write(src, "b.jsonl", [row(2, "2025-01-01T01:00:00Z"), "{not json", row(3, "2025-01-02T00:00:00Z")])
    write(src, "c.jsonl", [row(4, "2024-12-31T00:00:00Z"), row(1, "2025-01-01T00:00:00Z"), row(None, None)])
    lines = si.transcript_lines(spark, str(src), "id long, ts timestamp", bytes_per_batch=1)
    seen = []
    merge = si.merge_once("id", "ts")

    def each(df, n, path):
        seen.append(n)
        merge(df, n, path)

    out = si.drained(lines, name="lines-" + tmp_path.name, each=si.quarantining("_corrupt_record", each))
    assert seen == [0, 1, 2]  # one file a batch
    assert sorted(r.id if r.id is not None else -1 for r in out.collect()) == [-1, 1, 2, 3, 4]
    bad = spark.read.parquet(out.inputFiles()[0].split("/out/")[0] + "/quarantine")
    assert [tuple(r) for r in bad.collect()] == [("{not json", 1)]


def events(spark, folder, name, rows):
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long").select("*", F.lit("x").alias("event_type"), F.lit(1.0).alias("value"), F.lit(None).cast("string").alias("props")).coalesce(1).write.parquet(str(folder / name))
    for p in (folder / name).iterdir():
        if p.suffix == ".parquet":
            p.rename(folder / f"{name}.parquet")
    time.sleep(0.05)


def test_what_is_open_at_the_end_comes_out(spark, tmp_path):
    from datetime import datetime, timedelta

    at = lambda m: datetime(2025, 1, 1) + timedelta(minutes=m)
    events(spark, tmp_path, "a", [(1, at(0), 7), (2, at(20), 7), (3, at(50), 7), (4, at(0), 8)])
    events(spark, tmp_path, "b", [(5, at(110), 7), (6, at(111), 8), (7, at(115), 7)])
    source = lambda: si.Ending(si.event_stream(spark, str(tmp_path), "*.parquet", 1), "ts", {"event_id": -1, "user_id": -1})
    end = source()
    s = si.drained(si.sessions(end.stream, "ts", "10 minutes", "40 minutes", "user_id"), ending=end)
    assert sorted((r.user_id, r.n) for r in s.collect()) == [(7, 2), (7, 3), (8, 1), (8, 1)]
    end = source()
    c = si.drained(si.clustered(end.stream, "10 minutes", 30 * 60), ending=end)
    assert sorted((r.user_id, r.first_id, r.last_id, r.n) for r in c.collect()) == [(7, 1, 2, 2), (7, 3, 3, 1), (7, 5, 7, 2), (8, 4, 4, 1), (8, 6, 6, 1)]
    end = source()
    b = si.drained(si.buffered(end.stream, "10 minutes", 2, 3600), ending=end)
    assert sorted((r.user_id, r.flushed_because, r.first_id, r.n) for r in b.collect()) == [(7, "age", 3, 1), (7, "size", 1, 2), (7, "size", 5, 2), (8, "age", 4, 1), (8, "age", 6, 1)]


def test_update_needs_a_merge(spark, tmp_path):
    import pytest

    with pytest.raises(ValueError):
        si.drained(si.event_stream(spark, str(tmp_path)), "update")
