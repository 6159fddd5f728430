"""Stretches of reads that earlier reads, or a table of k-mers, do not have.

A window of k-mers is new where at most a share of them is seen. From the left, the first new window is extended to the right while the
windows stay new, the stretch is taken, and the search goes on after it."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import dropped, written
from .tagging import lined, new_kmers

KIND = "array<struct<start:int,length:int>>"


def stretches(seen: np.ndarray, k: int, min_length: int, min_new: float) -> list[tuple[int, int]]:
    """(start, length in bases) of the new stretches of a read, given which of its k-mers are seen."""
    size, n = min_length - k + 1, len(seen)
    if n < size:
        return []
    sums = np.concatenate([[0], np.cumsum(seen)])
    fits = (sums[size:] - sums[:-size]).astype(np.float32) / np.float32(size) <= np.float32(1.0 - np.float32(min_new))
    good, bad = np.flatnonzero(fits[:-1]), np.flatnonzero(~fits)  # the last window is only reached by extension
    out, i = [], 0
    while (g := np.searchsorted(good, i)) < len(good):
        begin = int(good[g])
        b = np.searchsorted(bad, begin)
        end = int(bad[b]) - 2 if b < len(bad) else n - size - 1
        out.append((begin, min(end + size + k - begin, n + k - 1 - begin)))
        i = end + size + 1
    return out


def _stretches(kmers: Column, known: Column, k: int, min_length: int, min_new: float, known_is_new: bool) -> Column:
    if min_length < k:
        raise ValueError("a stretch is as long as a k-mer at least")

    def run(kmers: pd.Series, known: pd.Series) -> pd.Series:
        out = []
        for own, listed in zip(kmers, known, strict=True):
            isin = np.isin(own, listed if listed is not None else [])
            out.append([{"start": s, "length": n} for s, n in stretches(~isin if known_is_new else isin, k, min_length, min_new)])
        return pd.Series(out)

    return F.pandas_udf(run, KIND)(kmers, known)


def _shown(found: DataFrame, keep: list[str]) -> DataFrame:
    each = found.select(*keep, "sequence", F.posexplode("found").alias("path", "s"))
    return each.select(*keep, "path", "s.start", "s.length", F.substring("sequence", F.col("s.start") + 1, F.col("s.length")).alias("bases"))


def unique_paths(reads: DataFrame, order: list[str], k: int, min_length: int, min_new: float = 0.5) -> DataFrame:
    """(order, path, start, length, bases) of the stretches of valid reads that reads before them in order do not have. Each k-mer
    meets its first read only, so no k-mer, however frequent, gathers rows in one task."""
    every = lined(reads, order, k)
    known = written(new_kmers(every))
    both = every.join(known, "read_no", "left").select(*order, "sequence", "kmers", F.coalesce("new", F.array().cast("array<bigint>")).alias("new"))
    out = written(both.select(*order, "sequence", _stretches(F.col("kmers"), F.col("new"), k, min_length, min_new, True).alias("found")))
    dropped(every, known)
    return _shown(out, order)


def unseen_paths(reads: DataFrame, seen: DataFrame, read: list[str], k: int, min_length: int, min_new: float = 0.5) -> DataFrame:
    """(read, path, start, length, bases) of the stretches of valid reads that a table of k-mers (kmer) does not have."""
    every = lined(reads, read, k)
    met = every.select("read_no", F.explode("kmers").alias("kmer")).distinct().join(seen.select("kmer").distinct(), "kmer", "left_semi")
    known = met.groupBy("read_no").agg(F.collect_list("kmer").alias("seen"))
    both = every.join(known, "read_no", "left").select(*read, "sequence", "kmers", F.coalesce("seen", F.array().cast("array<bigint>")).alias("seen"))
    return _shown(both.select(*read, "sequence", _stretches(F.col("kmers"), F.col("seen"), k, min_length, min_new, False).alias("found")), read)
