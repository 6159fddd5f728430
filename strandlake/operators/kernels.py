"""Inner-product kernels between all pairs of samples, normalised kernels and distances, as long frames (a, b, value).

Per table the kernel is a sum over shared bins, and the least table counts. Products are summed as integers grouped by the
number of samples a bin occurs in, on which alone the entropy weight depends; bins that all samples have weigh nothing and
are dropped before pairs are formed; bins of one sample touch the diagonal alone and need no pairing."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import NoMatrix
from ..functions.kmers import binary_entropy

GRAM_SAMPLES, BLOCK_BINS = 64, 256
REGISTRY: dict[str, Callable[[Column, Column], Column]] = {}


def register(name: str, weight: Callable[[Column, Column], Column]) -> None:
    """A kernel by its weight of (samples that have the bin, all samples)."""
    REGISTRY[name] = weight


register("unweighted", lambda n, total: F.lit(1.0))
register("entropy", binary_entropy)
register("zero", lambda n, total: F.lit(0.0))


def sample_ids(counts: DataFrame, names: DataFrame | None = None) -> list[str]:
    """All samples, in order; kernels are for some thousands of them at most."""
    rows = (names or counts).select("sample").distinct().orderBy("sample").limit(100_001).collect()
    if len(rows) < 2:
        raise NoMatrix("a matrix needs two samples")
    if len(rows) > 100_000:
        raise ValueError("more than 100 000 samples make no matrix")
    return [r["sample"] for r in rows]


def _pair_sums(rows: DataFrame) -> DataFrame:
    """rows (sample, tab, bin, count, pc) -> (a, b, tab, pc, dot) by an equi-join on bins."""
    lone = rows.where("pc = 1").select(F.col("sample").alias("a"), F.col("sample").alias("b"), "tab", "pc", (F.col("count") * F.col("count")).cast("long").alias("p"))
    many = rows.where("pc > 1")
    left = many.select(F.col("sample").alias("a"), "tab", "bin", "pc", F.col("count").cast("long").alias("ca"))
    right = many.select(F.col("sample").alias("b"), "tab", "bin", F.col("count").cast("long").alias("cb"))
    pairs = left.join(right, ["tab", "bin"]).where("a <= b").select("a", "b", "tab", "pc", (F.col("ca") * F.col("cb")).alias("p"))
    return pairs.unionByName(lone.select("a", "b", "tab", "pc", "p")).groupBy("a", "b", "tab", "pc").agg(F.sum("p").alias("dot"))


def _gram_sums(rows: DataFrame) -> DataFrame:
    """The same by dense products of blocks of bins (a bin is never split), for many samples."""

    def gram(pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        out = []
        for (tab, pc), g in pdf.groupby(["tab", "pc"]):
            names, i = np.unique(g["sample"], return_inverse=True)
            bins, j = np.unique(g["bin"], return_inverse=True)
            m = np.zeros((len(names), len(bins)))
            m[i, j] = g["count"]
            x, y = np.triu_indices(len(names))
            dot = (m @ m.T)[x, y]
            keep = dot > 0
            out.append(pd.DataFrame({"a": names[x[keep]], "b": names[y[keep]], "tab": tab, "pc": pc, "dot": dot[keep].astype("int64")}))
        return pd.concat(out)

    blocks = rows.withColumn("block", F.floor(F.col("bin") / BLOCK_BINS))
    parts = blocks.groupBy("tab", "block").applyInPandas(gram, "a string, b string, tab int, pc long, dot long")
    return parts.groupBy("a", "b", "tab", "pc").agg(F.sum("dot").alias("dot"))


def triangle(spark, names: list[str], tabs: int) -> DataFrame:
    """(a, b, tab) of all pairs a <= b, so that samples without a shared bin still meet."""
    one = spark.createDataFrame([(names,)], "names array<string>")
    pairs = one.select("names", F.explode("names").alias("a")).select("a", F.explode("names").alias("b")).where("a <= b")
    return pairs.select("a", "b", F.explode(F.sequence(F.lit(0), F.lit(tabs - 1))).alias("tab"))


def pairwise_kernel(counts: DataFrame, tabs: int, kernel: str = "entropy", weights: DataFrame | None = None, names: list[str] | None = None, plan: str = "auto") -> DataFrame:
    """(a, b, value) for a <= b. weights (tab, bin, weight): given ones in place of the kernel's own (an absent bin weighs 0).
    plan: 'pairs', 'gram', or 'auto' by the number of samples."""
    spark = counts.sparkSession
    names = names or sample_ids(counts)
    n = len(names)
    if weights is not None and kernel != "unweighted":
        rows = counts.join(weights, ["tab", "bin"])
        left = rows.select(F.col("sample").alias("a"), "tab", "bin", F.col("count").cast("long").alias("ca"), "weight")
        right = counts.select(F.col("sample").alias("b"), "tab", "bin", F.col("count").cast("long").alias("cb"))
        table = left.join(right, ["tab", "bin"]).where("a <= b").groupBy("a", "b", "tab").agg(F.sum(F.col("ca") * F.col("cb") * F.col("weight")).alias("value"))
    else:
        pc = counts.groupBy("tab", "bin").agg(F.count("*").alias("pc"))
        rows = counts.join(pc, ["tab", "bin"])
        if kernel == "entropy":
            rows = rows.where(F.col("pc") < n)
        sums = _gram_sums(rows) if plan == "gram" or plan == "auto" and n > GRAM_SAMPLES else _pair_sums(rows)
        table = sums.groupBy("a", "b", "tab").agg(F.sum(F.col("dot") * REGISTRY[kernel](F.col("pc"), F.lit(n))).alias("value"))
    full = triangle(spark, names, tabs).join(table, ["a", "b", "tab"], "left")
    return full.groupBy("a", "b").agg(F.min(F.coalesce("value", F.lit(0.0))).cast("double").alias("value"))


def mirror(matrix: DataFrame) -> DataFrame:
    other = matrix.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "value")
    return matrix.unionByName(other)


def normalised(matrix: DataFrame) -> DataFrame:
    """K_ab / sqrt(K_aa K_bb); 0 where a norm is zero."""
    norm = matrix.where("a = b").select(F.col("a").alias("s"), F.col("value").alias("norm"))
    both = matrix.join(norm.select(F.col("s").alias("a"), F.col("norm").alias("na")), "a").join(norm.select(F.col("s").alias("b"), F.col("norm").alias("nb")), "b")
    scale = F.sqrt(F.col("na") * F.col("nb"))
    return both.select("a", "b", F.when(scale > 0, F.col("value") / F.when(scale > 0, scale)).otherwise(F.lit(0.0)).alias("value"))


def distance(matrix: DataFrame, normalise: bool = True) -> DataFrame:
    """sqrt(K_aa + K_bb - 2 K_ab) of the normalised kernel; 0 where that is not above zero, and for samples of zero norm."""
    m = normalised(matrix) if normalise else matrix
    diag = m.where("a = b").select(F.col("a").alias("s"), F.col("value").alias("d"))
    both = m.join(diag.select(F.col("s").alias("a"), F.col("d").alias("da")), "a").join(diag.select(F.col("s").alias("b"), F.col("d").alias("db")), "b")
    d2 = F.col("da") + F.col("db") - 2 * F.col("value")
    real = (d2 > 0) & (F.col("a") != F.col("b"))
    if normalise:
        real = real & (F.col("da") > 0) & (F.col("db") > 0)
    return both.select("a", "b", F.when(real, F.sqrt(F.greatest(d2, F.lit(0.0)))).otherwise(F.lit(0.0)).alias("value"))
