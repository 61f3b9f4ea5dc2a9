"""Table sinks: create-or-replace by path or by name, append, repeat-safe batches, bucketed layouts,
and lineage-cutting materialization."""

from __future__ import annotations

import time
import uuid
from collections.abc import Sequence
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql.types import StructType

from cohortlens.session import ensure_checkpoint_dir


_kept: dict[str, list[str]] = {}  # intermediate tables by application
recorder = None  # called with (name, DataFrame) before an intermediate table is written


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder with all that it holds; a missing one is no error."""
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def overwrite(df: DataFrame, path: str, partition_by: list[str] | None = None,
              fmt: str = "parquet") -> None:
    """``create or replace table … as select``: the whole result is written beside the old table
    and takes its place by renames when it is complete; a failed run leaves the old table."""
    path = path.rstrip("/")
    fresh = f"{path}.new-{uuid.uuid4().hex}"
    w = df.write.format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(fresh)
    _swap(df.sparkSession, fresh, path)


def _swap(spark: SparkSession, fresh: str, path: str) -> None:
    """Put the folder ``fresh`` in the place of ``path``, which may exist."""
    fs, target = _fs(spark, path)
    new = _fs(spark, fresh)[1]
    before = _fs(spark, f"{path}.old-{uuid.uuid4().hex}")[1]
    had = fs.exists(target)
    if had and not fs.rename(target, before):
        raise OSError(f"cannot move {path} aside")
    if not fs.rename(new, target):
        if had:
            fs.rename(before, target)
        raise OSError(f"cannot put the new table at {path}")
    if had:
        fs.delete(before, True)


def append(df: DataFrame, path: str, partition_by: list[str] | None = None,
           fmt: str = "parquet") -> None:
    """Append load (WRITE_APPEND) of a result table; re-running adds another batch of rows."""
    w = df.write.mode("append").format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


def replace_batch(df: DataFrame, path: str, batch: Sequence[str], fmt: str = "parquet") -> None:
    """Repeat-safe append: rows of ``df`` take the place of those that an earlier run loaded with the
    same values of the ``batch`` columns; other batches stay.

    The batch columns are partition folders and only the folders that ``df`` has rows for are
    replaced, by the job's commit: a run that fails before leaves the earlier batch, and repeating
    it, once or often, leaves one. A result without rows replaces nothing.
    """
    w = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").format(fmt)
    w.partitionBy(*batch).save(path)


def replace_batch_table(df: DataFrame, name: str, batch: Sequence[str], fmt: str = "parquet") -> None:
    """``replace_batch`` on a catalog table partitioned by the ``batch`` columns, made when missing."""
    spark = df.sparkSession
    if not spark.catalog.tableExists(name):
        df.limit(0).write.format(fmt).partitionBy(*batch).saveAsTable(name)
    order = spark.table(name).columns  # partition columns last
    df.select(*order).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").insertInto(name)


@dataclass(frozen=True)
class Layout:
    """Stored layout of a table: rows dealt by the hash of ``by`` to ``buckets`` files, sorted."""

    by: tuple[str, ...]
    buckets: int
    sort: tuple[str, ...] = ()

    def writer(self, df: DataFrame, fmt: str = "parquet") -> DataFrameWriter:
        """Rows are dealt as the buckets are before the write, so each bucket is one task's file."""
        w = df.repartition(self.buckets, *self.by).write.format(fmt).bucketBy(self.buckets, *self.by)
        return w.sortBy(*self.sort) if self.sort else w


def _drop(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def overwrite_bucketed(df: DataFrame, path: str, layout: Layout) -> DataFrame:
    """``overwrite`` in a bucketed layout; returns the table as stored, so that groupings and windows
    whose keys include ``layout.by`` need no exchange."""
    spark, path = df.sparkSession, path.rstrip("/")
    name, fresh = f"cohortlens_{uuid.uuid4().hex}", f"{path}.new-{uuid.uuid4().hex}"
    try:
        layout.writer(df).option("path", fresh).saveAsTable(name)
    finally:
        _drop(spark, name)
    _swap(spark, fresh, path)
    return read_bucketed(spark, path, df.schema, layout)


def read_bucketed(spark: SparkSession, path: str, schema: StructType, layout: Layout) -> DataFrame:
    """The files of ``overwrite_bucketed`` with their layout known to the planner. The name that tells
    it is dropped once the table is resolved; the files stay."""
    name = f"cohortlens_{uuid.uuid4().hex}"
    by = ", ".join(f"`{c}`" for c in layout.by)
    sort = f" SORTED BY ({', '.join(f'`{c}`' for c in layout.sort)})" if layout.sort else ""
    spark.sql(f"CREATE TABLE {name} ({schema.toDDL()}) USING parquet "
              f"CLUSTERED BY ({by}){sort} INTO {layout.buckets} BUCKETS LOCATION '{path}'")
    try:
        return spark.table(name)
    finally:
        _drop(spark, name)


def replace_table(df: DataFrame, name: str, *, layout: Layout | None = None,
                  partition_by: Sequence[str] = (), fmt: str = "parquet", keep: int = 1) -> None:
    """``create or replace table name as select`` in the session catalog, never without a table.

    Every load is a table of its own, ``<name>__v<time>``; ``name`` is a view on the newest, moved by
    one catalog operation when the load is complete. A reader sees the old or the new rows, a
    failed load leaves the old, and a query that began on the old version finishes on it: the
    last ``keep`` versions before the current one stay, older ones are dropped.
    """
    spark = df.sparkSession
    if spark.catalog.tableExists(name) and spark.catalog.getTable(name).tableType != "VIEW":
        raise ValueError(f"{name} is a table; replace_table keeps its versions behind a view of that name")
    version = f"{name}__v{time.time_ns():020d}"
    w = layout.writer(df, fmt) if layout else df.write.format(fmt)
    try:
        (w.partitionBy(*partition_by) if partition_by else w).saveAsTable(version)
        spark.sql(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM {version}")
    except BaseException:
        _drop(spark, version)
        raise
    for old in versions(spark, name)[:-1 - keep]:
        _drop(spark, old)


def versions(spark: SparkSession, name: str) -> list[str]:
    """Stored versions of a table of ``replace_table``, the oldest first."""
    *db, table = name.split(".")
    rows = spark.sql(f"SHOW TABLES{' IN ' + db[0] if db else ''} LIKE '{table}__v*'").collect()
    return sorted(".".join([*db, r.tableName]) for r in rows)


def drop_table(spark: SparkSession, name: str) -> None:
    """Drop a table of ``replace_table`` with all its versions."""
    spark.sql(f"DROP VIEW IF EXISTS {name}")
    for v in versions(spark, name):
        _drop(spark, v)


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` once as Parquet under the shared ``spark.checkpoint.dir`` and read it back.

    Used at the stage boundaries the analysed pipeline persists as tables. Each consumer then
    scans only the columns it needs (a shared lineage would be recomputed per consumer, since
    column pruning makes the branches differ), and the lineage is cut: a lost executor costs a
    re-read of files on shared storage, not a recomputation from raw data.
    """
    spark = df.sparkSession
    root = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{root}/cohortlens-tables/{name}-{uuid.uuid4().hex}"
    if recorder is not None:
        recorder(name, df)
    df.write.parquet(path)
    _kept.setdefault(spark.sparkContext.applicationId, []).append(path)
    out = spark.read.parquet(path)
    out._stored_at = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables of ``materialize`` that nothing reads any more: all that was built on them is
    itself written or collected."""
    for df in tables:
        path, spark = df._stored_at, df.sparkSession
        kept = _kept.get(spark.sparkContext.applicationId, [])
        if path in kept:
            fs, p = _fs(spark, path)
            fs.delete(p, True)
            kept.remove(path)


@contextmanager
def intermediates(spark: SparkSession):
    """Delete the intermediate tables made inside the block when it ends. Results built from them
    must be written or collected inside."""
    made = _kept.setdefault(spark.sparkContext.applicationId, [])
    start = len(made)
    try:
        yield
    finally:
        for path in made[start:]:
            fs, p = _fs(spark, path)
            fs.delete(p, True)
        del made[start:]
