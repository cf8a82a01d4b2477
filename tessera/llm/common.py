"""Shared plumbing of the corpus operators: shipping code, shared files, batches."""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_SHIPPED: set[str] = set()
_OWN_DIRS: dict[str, str] = {}
_WRITTEN: list[tuple[SparkSession, str]] = []


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers (once per application)."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    name = os.path.basename(root)
    target = os.path.join(tempfile.mkdtemp(prefix=f"{name}-"), f"{name}.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.join(name, os.path.relpath(full, root)))
    spark.sparkContext.addPyFile(target)
    _SHIPPED.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor and the driver can reach: ``spark.checkpoint.dir``.

    Only where the session does not name one (local tests) a folder of our own is used.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIRS:
        _OWN_DIRS[app] = tempfile.mkdtemp(prefix="tessera-shared-")
    return "file://" + _OWN_DIRS[app]


def shared_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append((spark, path))
    return path


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a folder through Spark's own file system layer."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


@atexit.register
def _clean() -> None:
    for spark, path in _WRITTEN:
        try:
            delete_path(spark, path)
        except Exception:  # the session may be gone already
            break


def written(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet to the shared folder and read it back."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    w = df.write.mode("overwrite")
    (w.option("compression", codec) if codec else w).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def forget(table: DataFrame) -> None:
    """Delete a table of :func:`written` that nothing reads any more."""
    delete_path(table.sparkSession, table._written_to)
    release(table.sparkSession)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of finished queries now: it goes by the driver's garbage collection,
    which may be long in coming."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def trim() -> None:
    """Give memory that is free back to the system: Python workers live on, and stand beside others in an executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not with every C library
        pass


def remainder(id_col: str, n: int):
    """crc32 of the id as text, modulo ``n``; null ids give 1 (never held out)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % F.lit(n), F.lit(1).cast("long"))


def lower_ascii(col):
    """Lower-case A-Z only."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lowest(df: DataFrame, key: str, n: int, total: int) -> list:
    """The ``n`` rows of least ``key``, a 64-bit hash column, collected in its order (ties: all columns).

    ``total`` is about how many rows there are. Only rows under the hash value that some more than n
    of them stay below are sorted and sent, so that what reaches the driver follows n, not the number of
    partitions. Should too few come (rare, or a wrong total), all rows are looked at."""
    order = [F.col(key), *[F.col(c) for c in df.columns if c != key]]
    if total > 3 * n:
        cut = min(2**63 - 1, -(2**63) + int(2**64 * (1.2 * n + 50) / total))
        rows = df.where(F.col(key) <= F.lit(cut)).orderBy(*order).limit(n).collect()
        if len(rows) == n:
            return rows
    return df.orderBy(*order).limit(n).collect()


def lowest_of_each(df: DataFrame, key: str, by: str, n: int) -> list:
    """At most ``n`` rows, an equal share (one at least) for each value of ``by``, those of least ``key``, a
    64-bit hash column; collected in order of ``by`` and ``key``. As in :func:`lowest`, only rows under a value's
    hash floor are ranked; should too few come of any value, all rows are."""
    totals = {r[0]: r[1] for r in df.groupBy(by).agg(F.count(F.lit(1))).collect()}
    if not totals:
        return []
    share = max(1, n // len(totals))
    cuts = {v: min(2**63 - 1, -(2**63) + int(2**64 * (1.2 * share + 50) / t)) for v, t in totals.items() if t > 3 * share}
    order = [F.col(by), F.col(key), *[F.col(c) for c in df.columns if c not in (by, key)]]
    place = Window.partitionBy(by).orderBy(*order[1:])

    def take(rows: DataFrame) -> list:
        return rows.withColumn("_place", F.row_number().over(place)).where(F.col("_place") <= share).drop("_place").orderBy(*order).collect()

    if cuts:
        floor = F.coalesce(F.create_map(*[F.lit(x) for pair in cuts.items() for x in pair])[F.col(by)], F.lit(2**63 - 1))
        rows = take(df.where(F.col(key) <= floor))
        if len(rows) == sum(min(share, t) for t in totals.values()):
            return rows
    return take(df)


LOWER = {i: i + 32 for i in range(65, 91)}


def byte_slices(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch into consecutive slices of about ``limit`` bytes of ``column`` (one row at least)."""
    import numpy as np
    import pyarrow.compute as pc

    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0)
    ends = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
