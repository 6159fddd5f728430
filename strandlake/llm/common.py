"""Shared plumbing: the shared folder, written tables, packaging for executors, column hygiene."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import small_batches

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    target = os.path.join(tempfile.mkdtemp(prefix="strandlake-"), "strandlake.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent).as_posix())
    spark.sparkContext.addPyFile(target)
    small_batches(spark)
    _SHIPPED.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. Where none is named one is made for a local master (tests); a cluster must name it."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="strandlake-shared-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def shared_table(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: a cut in the lineage that outlives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/strandlake-{uuid.uuid4().hex}"
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._strandlake_path = path
    return found


def shared_runs(runs: Iterable[DataFrame], by: str | None = None) -> DataFrame:
    """The rows of one or more runs as one shared table, with a folder for each value of the column by. A run is written, and its shuffle
    given up, before the next one is asked for."""
    path = None
    for df in runs:
        spark, schema = df.sparkSession, df.schema
        path = path or f"{shared_dir(spark)}/strandlake-{uuid.uuid4().hex}"
        df.write.mode("append").partitionBy(*([by] if by else [])).parquet(path)
        del df
    found = spark.read.schema(schema).parquet(path)
    found._strandlake_path = path
    return found


def shared_parts(df: DataFrame, by: list[str], columns: list[list[str]]) -> list[DataFrame]:
    """df written once as several shared tables: the rows whose first column of by is 0, 1, ... with the columns given for each, which
    have a folder for each value of the other columns of by."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/strandlake-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    out = []
    for i, names in enumerate(columns):
        kind, at = df.select(*names).schema, f"{path}/{by[0]}={i}"
        p = spark._jvm.org.apache.hadoop.fs.Path(at)
        there = p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)  # not without rows
        found = spark.read.schema(kind).parquet(at) if there else spark.createDataFrame([], kind)
        found._strandlake_path = at
        out.append(found)
    return out


def drop_folders(table: DataFrame, by: str, values: Iterable) -> None:
    """Delete the folders of a shared table for these values of the column by, when their readers are done, as drop_tables does."""
    spark = table.sparkSession
    for v in values:
        p = spark._jvm.org.apache.hadoop.fs.Path(f"{table._strandlake_path}/{by}={v}")
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    gc.collect()
    spark._jvm.System.gc()


def drop_tables(*tables: DataFrame) -> None:
    """Delete shared tables whose readers are done, and have Spark delete the shuffle files of plans that are done (it does so
    when the driver's JVM collects its garbage)."""
    for t in tables:
        spark, path = t.sparkSession, t._strandlake_path
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    gc.collect()
    if tables:
        tables[0].sparkSession._jvm.System.gc()


def few(ids: DataFrame, most: int = 1_000_000) -> DataFrame:
    """A written table of ids (a long or a 16-byte key and little else), to be broadcast where it is counted as at most that
    many rows (some 50 MB), and joined by a shuffle where not. The result is the same."""
    return F.broadcast(ids) if ids.count() <= most else ids


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df has not, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def texts(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, text (null: empty) and the named columns; other columns are left unread."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *keep)


def crc_remainder(doc_id, mod: int):
    """crc32 of the id written as text, modulo mod (null ids: the remainder of the empty text)."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(mod))


_CACHES: dict[str, dict] = {}


def cache(name: str, own: dict | None = None) -> dict:
    """A worker's cache of that name. Workers live on from stage to stage: the caches of other names are emptied."""
    for other, held in _CACHES.items():
        if other != name:
            held.clear()
    return _CACHES.setdefault(name, {} if own is None else own)


def tidy(name: str, run):
    """run for mapInArrow, with one live cache and unused memory given back after each task."""

    def task(batches):
        import pyarrow as pa

        cache(name)
        pa.set_memory_pool(pa.system_memory_pool())  # gives large blocks back at once
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                import ctypes

                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except OSError:
                pass

    return task
