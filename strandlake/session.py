"""Session defaults."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "strandlake", **conf: str) -> SparkSession:
    """A session with the settings the library expects; conf adds to them or overrides them (dots as double underscores)."""
    b = SparkSession.builder.appName(app)
    defaults = {"spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true", "spark.sql.adaptive.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    for key, value in (defaults | {k.replace("__", "."): v for k, v in conf.items()}).items():
        b = b.config(key, value)
    return b.getOrCreate()


def ensure_checkpoints(spark: SparkSession) -> str:
    """The folder that all executors share. Where none is named, one is made for a local master (tests); a cluster must name it."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="strandlake-checkpoints-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage, and the plan's statistics become those of the files (a checkpoint
    keeps the products that joins guess, whose digits grow from round to round)."""
    path = f"{ensure_checkpoints(df.sparkSession)}/strandlake-{uuid.uuid4().hex}"
    df.write.parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found._strandlake_path = path
    return found


def small_batches(spark: SparkSession) -> None:
    """Rows reach Python in batches of a bounded size: what is made of a batch of whole texts (k-mers take eight bytes a base) is some times as large."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "1m")


def dropped(*tables: DataFrame | None) -> None:
    """Delete written tables whose readers are done; None is skipped."""
    for t in tables:
        if t is not None:
            spark, path = t.sparkSession, t._strandlake_path
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
