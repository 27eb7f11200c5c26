"""Intermediate tables in the folder that all executors share.

A table written there cuts the lineage: when an executor is lost its readers only read files again. The folder is the
cluster's ``spark.checkpoint.dir``; where that is unset (tests, a laptop) a local one is made and removed at exit.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_scopes: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session (a path or URI without a trailing slash)."""
    set_by_cluster = spark.conf.get("spark.checkpoint.dir", None)
    if set_by_cluster:
        return set_by_cluster.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        _own[app] = tempfile.mkdtemp(prefix="engrava-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
        spark.sparkContext.setCheckpointDir(_own[app])
    return _own[app]


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone already; the folder's owner clears what is left
        pass


def materialize(df: DataFrame, label: str = "t") -> DataFrame:
    """Write df as Parquet into the shared folder and read it back; gone at exit, or earlier by ``discard``."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/engrava/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(_delete, spark, path)
    if _scopes:
        _scopes[-1].append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._engrava_path = path
    return out


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are materialized inside are removed at the end: for work whose result the driver has by then."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            _delete(spark, path)


def discard(df: DataFrame) -> None:
    """Remove what ``materialize`` wrote; only for tables that no later plan reads."""
    path = getattr(df, "_engrava_path", None)
    if path:
        _delete(df.sparkSession, path)
