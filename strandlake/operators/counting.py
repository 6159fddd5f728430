"""K-mer counting: exact counts and saturating multi-table sketches as sparse frames counts(sample, tab, bin, count).

A zero bin has no row. Sizes of the tables come with the call; samples() describes the sketches that were made."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import IncompatibleSketches
from ..functions import kmers as K
from ..session import small_batches, written

MAX_COUNT, MAX_BIG = 255, 65535


def valid_reads(reads: DataFrame, k: int, n_as_a: bool = False) -> DataFrame:
    """Upper-case reads of k bases and more without other letters."""
    small_batches(reads.sparkSession)
    return reads.withColumn("sequence", K.normalise(F.col("sequence"), n_as_a)).where(K.is_valid(F.col("sequence"), k))


def explode_kmers(reads: DataFrame, k: int, canonical: bool = True, n_as_a: bool = False) -> DataFrame:
    """(other columns, pos, kmer) of all valid reads."""
    keep = [c for c in reads.columns if c not in ("sequence", "quality")]
    return valid_reads(reads, k, n_as_a).select(*keep, F.posexplode(K.kmer_hashes(F.col("sequence"), k, canonical)).alias("pos", "kmer"))


def consume_totals(reads: DataFrame, k: int) -> DataFrame:
    """Per sample: reads seen (invalid ones too) and k-mers consumed."""
    seq = K.normalise(F.col("sequence"))
    return reads.groupBy("sample").agg(F.count("*").alias("n_reads"), F.sum(F.when(K.is_valid(seq, k), F.length(seq) - k + 1).otherwise(0)).alias("n_kmers"))


def kmer_totals(reads: DataFrame, k: int) -> DataFrame:
    """(kmer, count) over all valid reads, k up to 31: counted in each batch of reads, so that no row is made of an occurrence. A written
    table, so that what takes its nodes and tags from it does not go over the reads again."""

    def run(batches):
        for b in batches:
            kmer, n = np.unique(K.numbers_of(b.column("sequence"), k).values.to_numpy(), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(kmer, pa.int64()), pa.array(n, pa.int64())], names=["kmer", "n"])

    found = valid_reads(reads, k).select("sequence").mapInArrow(run, "kmer long, n long")
    return written(found.groupBy("kmer").agg(F.sum("n").alias("count")))


def exact_counts(kmers: DataFrame) -> DataFrame:
    return kmers.groupBy("sample", "kmer").agg(F.count("*").alias("count"))


def _bins(df: DataFrame, key: str, sizes: list[int]) -> DataFrame:
    tabs = F.explode(F.array(*(F.struct(F.lit(t).alias("tab"), F.pmod(F.col(key), F.lit(s)).cast("long").alias("bin")) for t, s in enumerate(sizes))))
    return df.select("*", tabs.alias("b")).select(*df.columns, "b.tab", "b.bin")


def sketch(kmers: DataFrame, sizes: list[int], key: str = "kmer", weight: Column | None = None) -> DataFrame:
    """counts(sample, tab, bin, count): bins by remainder, each count held at 255. K-mers are counted before they are
    dealt to the tables, so the shuffle carries each distinct one once."""
    n = F.count("*") if weight is None else F.sum(weight)
    once = kmers.groupBy("sample", key).agg(n.alias("n"))
    return _bins(once, key, sizes).groupBy("sample", "tab", "bin").agg(F.least(F.sum("n"), F.lit(MAX_COUNT)).cast("smallint").alias("count"))


def merge_sketches(*parts: DataFrame) -> DataFrame:
    """The sketch of all reads from sketches of parts of them: counts add up to 255."""
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both.groupBy("sample", "tab", "bin").agg(F.least(F.sum("count"), F.lit(MAX_COUNT)).cast("smallint").alias("count"))


def presence_union(counts: DataFrame) -> DataFrame:
    """(tab, bin) that are set in any sample: the union of presence sketches."""
    return counts.select("tab", "bin").distinct()


def big_counts(kmers: DataFrame, sizes: list[int], order: list[str]) -> DataFrame:
    """(sample, kmer, count) above 255: a k-mer overflows when every one of its bins is full; counts stop at 65535.
    order gives the order of occurrences."""
    seen = kmers
    for t, s in enumerate(sizes):
        w = Window.partitionBy("sample", F.pmod("kmer", F.lit(s))).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        seen = seen.withColumn(f"full{t}", F.count("*").over(w) >= MAX_COUNT)
    full = F.col("full0")
    for t in range(1, len(sizes)):
        full = full & F.col(f"full{t}")
    return seen.where(full).groupBy("sample", "kmer").agg(F.least(F.count("*") + MAX_COUNT, F.lit(MAX_BIG)).cast("int").alias("count"))


def sketch_unique(kmers: DataFrame, sizes: list[int], order: list[str]) -> DataFrame:
    """Per sample: occurrences that met an empty bin in any table."""
    seen = kmers
    for t, s in enumerate(sizes):
        w = Window.partitionBy("sample", F.pmod("kmer", F.lit(s))).orderBy(*order)
        seen = seen.withColumn(f"new{t}", F.row_number().over(w) == 1)
    new = F.col("new0")
    for t in range(1, len(sizes)):
        new = new | F.col(f"new{t}")
    return seen.groupBy("sample").agg(F.count_if(new).alias("n_unique"))


def unique_kmers(kmers: DataFrame) -> DataFrame:
    return kmers.groupBy("sample").agg(F.count_distinct("kmer").alias("n_unique"))


def occupied(counts: DataFrame) -> DataFrame:
    """Per sample: non-empty bins of the first table."""
    return counts.where("tab = 0").groupBy("sample").agg(F.count("*").alias("occupied"))


def cap(counts: DataFrame, most: int) -> DataFrame:
    if not 1 <= most <= MAX_COUNT:
        raise ValueError("a cap is 1..255")
    return counts.withColumn("count", F.least("count", F.lit(most)).cast("smallint"))


def shape(k: int, sizes: list[int], bigcount: bool = False) -> list[Column]:
    return [F.lit(k).alias("ksize"), F.array(*(F.lit(s).cast("long") for s in sizes)).alias("tablesizes"), F.lit(bigcount).alias("use_bigcount")]


def samples(counts: DataFrame, k: int, sizes: list[int], bigcount: bool = False) -> DataFrame:
    return occupied(counts).select("sample", *shape(k, sizes, bigcount), "occupied")


def check_compatible(described: DataFrame) -> None:
    """Raise unless all sketches have one k-mer size and the same table sizes."""
    if described.select("ksize", "tablesizes").distinct().limit(2).count() > 1:
        raise IncompatibleSketches("k-mer or table sizes differ")


def lookup(kmers: DataFrame, counts: DataFrame, sizes: list[int], big: DataFrame | None = None) -> DataFrame:
    """kmers with count: the least of a k-mer's bins in its sample's sketch, or its big count."""
    keys = _bins(kmers.select("sample", "kmer").distinct(), "kmer", sizes)
    found = keys.join(counts, ["sample", "tab", "bin"], "left").groupBy("sample", "kmer").agg(F.min(F.coalesce("count", F.lit(0))).cast("int").alias("count"))
    if big is not None:
        found = found.join(big.select("sample", "kmer", F.col("count").alias("big")), ["sample", "kmer"], "left").select("sample", "kmer", F.coalesce("big", "count").alias("count"))
    return kmers.join(found, ["sample", "kmer"])


def present(kmers: DataFrame, table: DataFrame) -> DataFrame:
    return kmers.join(table.select("kmer").distinct(), "kmer", "left_semi")


def with_counts(kmers: DataFrame, counts: DataFrame, on: list[str] | None = None) -> DataFrame:
    """Occurrences with the exact count of their k-mer; 0 where it was not counted."""
    return kmers.join(counts, on or ["sample", "kmer"], "left").withColumn("count", F.coalesce("count", F.lit(0)))


def counted(kmers: DataFrame, on: list[str] | None = None) -> DataFrame:
    """Occurrences with the exact count of their k-mer among them, from one shuffle."""
    return kmers.withColumn("count", F.count("*").over(Window.partitionBy(*on or ["sample", "kmer"])))
