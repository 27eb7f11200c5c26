"""Messages delivered more than once: keep one copy of each, reading the wide payload once and never shuffling it."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from engrava.functions.instants import blank
from engrava.storage import materialize

#: Rows that one deletion-vector segment covers; a segment holds at most that many positions.
SEGMENT = 1 << 16


class DeliveryLog:
    """A Parquet table in which a message may occur several times.

    A message is what shares a non-blank ``scope`` (the session) and a non-null ``identifier``. The copy with the
    least ``order`` stays (null order last; equal orders: the earlier file by its hash, then the earlier row); rows
    without scope or identifier are no copies of anything and all stay. An empty table gives empty results.

    Only (scope, identifier, order, file, row position) is shuffled, with map-side minima, so that a message that is
    a third of all rows costs each task one row. The redundant rows become deletion vectors, one per file and
    65,536 rows, and the payload is read row group by row group with its vectors applied.

    The columns of the table may have any names; the operator's own are its positions' aliases in plans of its own.
    """

    def __init__(self, spark: SparkSession, path: str, scope: str, identifier: Column, order: str):
        self.spark, self.path, self.scope, self.identifier, self.order = spark, path, scope, identifier, order
        self.table = spark.read.parquet(path)

    def _positions(self) -> DataFrame:
        meta = self.table.metadataColumn("_metadata")
        return self.table.select(F.col(self.scope).alias("scope"), self.identifier.alias("ident"), F.col(self.order).alias("ord"), F.xxhash64(meta["file_path"]).alias("file"), meta["row_index"].alias("pos"))

    def redundant(self) -> DataFrame:
        """(ord, file, pos) of every redundant copy."""
        keyed = self._positions().where(~blank(F.col("scope")) & F.col("ident").isNotNull())
        first = F.min(F.struct(F.col("ord").isNull().alias("none"), "ord", "file", "pos")).alias("w")
        winners = keyed.groupBy("scope", "ident").agg(first).select("w.file", "w.pos")
        return keyed.select("ord", "file", "pos").join(winners, ["file", "pos"], "left_anti")

    def deletion_vectors(self, redundant: DataFrame | None = None) -> DataFrame:
        """(file, segment, gone): the sorted positions, within a segment of a file, of the rows to skip."""
        r = self.redundant() if redundant is None else redundant
        return r.groupBy("file", F.expr(f"pos div {SEGMENT}").alias("segment")).agg(F.sort_array(F.collect_list((F.col("pos") % SEGMENT).cast("int"))).alias("gone"))

    def kept(self, columns: list[str] | None = None, vectors: DataFrame | None = None) -> DataFrame:
        """The table without its redundant copies. The payload is not shuffled: a task gets row groups and their vectors."""
        return self._read(columns, vectors, False)

    def removed(self, columns: list[str] | None = None, vectors: DataFrame | None = None) -> DataFrame:
        """The redundant copies, read at the positions in the deletion vectors; row groups without any are not read."""
        return self._read(columns, vectors, True)

    def _read(self, columns: list[str] | None, vectors: DataFrame | None, gone: bool) -> DataFrame:
        wanted = self.table.select(*columns) if columns else self.table
        schema, names = wanted.schema, wanted.columns
        vectors = self.deletion_vectors() if vectors is None else vectors
        files = self.table.select(self.table.metadataColumn("_metadata")["file_path"].alias("path")).distinct()
        groups = materialize(files.mapInArrow(_row_groups, "path string, part int, start long, n long").withColumn("file", F.xxhash64("path")), "groups")
        covered = groups.withColumn("segment", F.explode(F.expr(f"sequence(start div {SEGMENT}, (start + n - 1) div {SEGMENT})")))
        work = covered.join(vectors, ["file", "segment"], "inner" if gone else "left").groupBy("path", "part", "start").agg(F.collect_list(F.when(F.col("gone").isNotNull(), F.struct("segment", "gone"))).alias("segments"))
        work = work.repartition(max(1, groups.count()))  # a task a row group, dealt evenly
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(schema)
        return work.mapInArrow(lambda batches: _read_rows(batches, names, target, gone), schema)


def _opened(path: str):
    from urllib.parse import unquote, urlparse

    from pyarrow import fs

    if urlparse(path).scheme in ("", "file"):
        return fs.LocalFileSystem().open_input_file(unquote(urlparse(path).path))
    system, where = fs.FileSystem.from_uri(path)
    return system.open_input_file(where)


def _row_groups(batches):
    """Number, first row and rows of each row group of the files, from their footers."""
    import pyarrow.parquet as pq

    for batch in batches:
        for path in batch.column(0).to_pylist():
            with pq.ParquetFile(_opened(path)) as f:
                n = [f.metadata.row_group(i).num_rows for i in range(f.num_row_groups)]
            rows = [(path, i, sum(n[:i]), k) for i, k in enumerate(n) if k]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int32(), pa.int64(), pa.int64()))], names=["path", "part", "start", "n"])


def _read_rows(batches, names: list[str], target: pa.Schema, wanted: bool):
    """Rows of the row groups that are in their vectors (wanted), or are not."""
    import numpy as np
    import pyarrow.parquet as pq

    for batch in batches:
        for row in batch.to_pylist():
            gone = [np.asarray(s["gone"], np.int64) + s["segment"] * SEGMENT for s in row["segments"] or []]
            gone = np.sort(np.concatenate(gone)) if gone else np.empty(0, np.int64)
            at = row["start"]
            with pq.ParquetFile(_opened(row["path"])) as f:
                for b in f.iter_batches(batch_size=8192, row_groups=[row["part"]], columns=names):
                    lo, hi = np.searchsorted(gone, [at, at + b.num_rows])
                    mask = np.full(b.num_rows, not wanted)
                    mask[gone[lo:hi] - at] = wanted
                    at += b.num_rows
                    if mask.any():
                        t = pa.Table.from_batches([b]).filter(pa.array(mask)).select(names)
                        yield from t.cast(target).to_batches()
