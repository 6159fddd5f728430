"""Sketches as folders of Parquet: counts by sample, a row a sample that tells its shape, and counts above 255."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import counting

COUNTS = "tab int, bin long, count smallint, sample string"
SAMPLES = "sample string, ksize int, tablesizes array<long>, use_bigcount boolean, occupied long"
BIG = "sample string, kmer decimal(20,0), count int"


def is_table(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/samples")
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def write(counts: DataFrame, k: int, sizes: list[int], path: str, big: DataFrame | None = None, names: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """counts as a folder, and what read() gives of it. names: (sample) of all samples, those without k-mers too."""
    spark = counts.sparkSession
    counts.select("tab", "bin", F.col("count").cast("smallint").alias("count"), "sample").write.mode("overwrite").partitionBy("sample").parquet(f"{path}/counts")
    if big is not None:
        big.select("sample", F.col("kmer").cast("decimal(20,0)").alias("kmer"), "count").write.mode("overwrite").parquet(f"{path}/big")
    described = counting.samples(spark.read.schema(COUNTS).parquet(f"{path}/counts"), k, sizes, big is not None)
    if names is not None:
        shape = counting.shape(k, sizes, big is not None)
        described = names.join(described.select("sample", "occupied"), "sample", "left").select("sample", *shape, F.coalesce("occupied", F.lit(0)).cast("long").alias("occupied"))
    described.write.mode("overwrite").parquet(f"{path}/samples")
    return read(spark, path)


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(counts, samples)."""
    return spark.read.schema(COUNTS).parquet(f"{path}/counts").select("sample", "tab", "bin", "count"), spark.read.schema(SAMPLES).parquet(f"{path}/samples")


def read_big(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BIG).parquet(f"{path}/big")
