"""The population over all samples: presence and sums of bins, occupancy, and entropy weights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kmers import binary_entropy


def population(counts: DataFrame) -> DataFrame:
    """(tab, bin, n_samples, total)."""
    return counts.groupBy("tab", "bin").agg(F.count("*").alias("n_samples"), F.sum("count").cast("long").alias("total"))


def table_sums(counts: DataFrame) -> DataFrame:
    return counts.groupBy("tab").agg(F.sum("count").cast("long").alias("total"))


def occupancy_rate(counts: DataFrame, sizes: list[int]) -> DataFrame:
    """One row: the product over tables of occupied bins of the population by table size."""
    bins = counts.select("tab", "bin").distinct().groupBy("tab").agg(F.count("*").alias("n"))
    size = F.element_at(F.array(*(F.lit(s) for s in sizes)), F.col("tab") + 1)
    return bins.agg(F.product(F.col("n") / size).alias("rate"))


def entropy_weights(counts: DataFrame, n_samples: int, root: bool = False) -> DataFrame:
    """(tab, bin, weight): binary entropy of a bin's presence (or its square root); zero weights have no row."""
    w = binary_entropy(F.col("n_samples"), F.lit(n_samples))
    rows = population(counts).where((F.col("n_samples") > 0) & (F.col("n_samples") < n_samples))
    return rows.select("tab", "bin", (F.sqrt(w) if root else w).alias("weight"))
