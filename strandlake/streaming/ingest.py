"""Sketches of reads that keep arriving. Counts add up, so micro-batches fold into a running sketch (an extension)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.counting import MAX_COUNT, _bins, explode_kmers


def stream_counts(reads: DataFrame, k: int, sizes: list[int]) -> DataFrame:
    """The running counts(sample, tab, bin, count) of a stream of reads, for output modes update and complete."""
    bins = _bins(explode_kmers(reads, k), "kmer", sizes)
    return bins.groupBy("sample", "tab", "bin").agg(F.count("*").alias("n")).select("sample", "tab", "bin", F.least("n", F.lit(MAX_COUNT)).cast("smallint").alias("count"))


def stream_cardinality(reads: DataFrame, k: int) -> DataFrame:
    return explode_kmers(reads, k).groupBy("sample").agg(F.approx_count_distinct("kmer").alias("n_unique"))
