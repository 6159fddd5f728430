"""Bin weights: a table of any number of sketch tables (Parquet), or text of one: a head line with the number of bins, then a
line of bin and weight for every bin, of which only the order counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import FileFormatError

#: Fixed value of the format.
HEAD = "kWIP_BinEntVector"


def weights_to_text(weights: DataFrame, size: int) -> DataFrame:
    """(line, value) of table 0, every bin, in order of line."""
    spark = weights.sparkSession
    bins = spark.range(size).withColumnRenamed("id", "bin").join(weights.where("tab = 0").select("bin", "weight"), "bin", "left")
    lines = bins.select((F.col("bin") + 1).alias("line"), F.concat_ws("\t", F.col("bin").cast("string"), F.format_string("%g", F.coalesce("weight", F.lit(0.0)))).alias("value"))
    return spark.createDataFrame([(0, f"{HEAD}\t{size}")], "line long, value string").unionByName(lines)


def weights_from_text(spark: SparkSession, path: str) -> DataFrame:
    """(tab 0, bin, weight) by the order of lines, whatever index they name; zero weights left out."""
    head = spark.read.text(path).first()
    if head is None or head[0].split("\t")[0] != HEAD:
        raise FileFormatError("no weight file")
    size = int(head[0].split("\t")[1])
    lines = spark.read.text(path).select("value", F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"))
    rows = lines.where(~F.col("value").startswith(HEAD) & (F.trim("value") != ""))
    blocks, base, before = sorted((r["block"], r["count"]) for r in rows.groupBy("block").count().collect()), 0, []  # a row a file block
    for block, n in blocks:
        before.append((block, base))
        base += n
    at = F.broadcast(spark.createDataFrame(before, "block long, base long"))
    place = F.col("base") + F.row_number().over(Window.partitionBy("block").orderBy("n")) - 1
    out = rows.join(at, "block").select(F.lit(0).alias("tab"), place.cast("long").alias("bin"), F.split(F.trim("value"), r"\s+")[1].cast("double").alias("weight"))
    if base != size:
        raise FileFormatError(f"{size} bins were announced")
    return out.where("weight <> 0")
