"""Per-sample statistics of sketches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .population import entropy_weights


def sample_stats(counts: DataFrame, sizes: list[int], n_samples: int) -> DataFrame:
    """(sample, sample_sum, weighted_sum, entropy): the first table's sum; the least table's sum of counts times root entropy
    weights; the Shannon entropy of the first table's histogram of bin counts, empty bins included."""
    weights = entropy_weights(counts, n_samples, root=True)
    names = counts.select("sample").distinct()
    per_tab = counts.join(weights, ["tab", "bin"]).groupBy("sample", "tab").agg(F.sum(F.col("count") * F.col("weight")).alias("w"))
    tabs = names.select("sample", F.explode(F.sequence(F.lit(0), F.lit(len(sizes) - 1))).alias("tab"))
    weighted = tabs.join(per_tab, ["sample", "tab"], "left").groupBy("sample").agg(F.min(F.coalesce("w", F.lit(0.0))).alias("weighted_sum"))
    first = counts.where("tab = 0")
    sums = first.groupBy("sample").agg(F.sum("count").cast("long").alias("sample_sum"), F.count("*").alias("used"))
    histogram = first.groupBy("sample", "count").agg(F.count("*").alias("n")).select("sample", "n").unionByName(sums.select("sample", (F.lit(sizes[0]) - F.col("used")).alias("n")))
    p = F.col("n") / F.lit(float(sizes[0]))
    entropy = histogram.where("n > 0").groupBy("sample").agg(F.sum(-p * F.log2(p)).alias("entropy"))
    return sums.join(weighted, "sample").join(entropy, "sample").select("sample", "sample_sum", "weighted_sum", "entropy")
