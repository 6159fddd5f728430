"""Operators on the k-mer spectrum of reads: medians, extremes, trimming, error positions, histograms, cardinality.

occurrences: (read columns, pos, kmer, count), one row for each k-mer of a valid read; read: the columns that name a read."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import dropped, written
from .counting import explode_kmers, valid_reads

FIRST = 16  # reads_meeting looks up one in so many k-mers first

#: By precision from 4 on, the estimates up to which linear counting is the better one.
LINEAR_BELOW = (10, 20, 40, 80, 220, 400, 900, 1800, 3100, 6500, 11500, 20000, 50000)


def read_median(occurrences: DataFrame, read: list[str]) -> DataFrame:
    """Upper median, mean and population deviation of the counts of a read's k-mers, from each read's histogram of counts."""
    level = occurrences.groupBy(*read, "count").agg(F.count("*").alias("n"))
    got = level.groupBy(*read).agg(F.sort_array(F.collect_list(F.struct("count", "n"))).alias("h"), F.sum("n").alias("all"), F.sum(F.col("count") * F.col("n")).alias("s"))
    beyond = lambda acc, x: F.when(acc["left"] < 0, acc).otherwise(F.struct((acc["left"] - x["n"]).alias("left"), x["count"].alias("count")))
    begin = F.struct(F.floor(F.col("all") / 2).cast("long").alias("left"), F.lit(0).cast("long").alias("count"))
    mean = F.col("s") / F.col("all")
    spread = F.aggregate("h", F.lit(0.0), lambda acc, x: acc + x["n"] * (x["count"] - mean) * (x["count"] - mean))
    return got.select(*read, F.aggregate("h", begin, beyond, lambda acc: acc["count"]).alias("median"), mean.alias("mean"), F.sqrt(spread / F.col("all")).alias("stddev"))


def read_extremes(occurrences: DataFrame, read: list[str]) -> DataFrame:
    return occurrences.groupBy(*read).agg(F.least(F.min("count"), F.lit(255)).alias("min_count"), F.max("count").alias("max_count"))


def median_at_least(occurrences: DataFrame, read: list[str], cutoff: int) -> DataFrame:
    enough = F.sum(F.when(F.col("count") >= cutoff, 1).otherwise(0)) >= F.floor(F.lit(0.5) + F.count("*") / 2)
    return occurrences.groupBy(*read).agg(enough.alias("enough"))


def trim_length(occurrences: DataFrame, read: list[str], k: int, least: int | None = None, most: int | None = None) -> DataFrame:
    """Usable prefix of a valid read: up to before the end of its first k-mer outside the band; 0 if that is the first one
    or there is only one k-mer."""
    bad = F.lit(False)
    if least is not None:
        bad = bad | (F.col("count") < least)
    if most is not None:
        bad = bad | (F.col("count") > most)
    got = occurrences.groupBy(*read).agg(F.min(F.when(bad, F.col("pos"))).alias("bad"), F.count("*").alias("n"))
    length = F.when((F.col("n") == 1) | (F.col("bad") == 0), F.lit(0)).when(F.col("bad").isNull(), F.col("n") + k - 1).otherwise(F.col("bad") + k - 1)
    return got.select(*read, length.cast("long").alias("usable"))


def error_positions(occurrences: DataFrame, read: list[str], k: int, most: int) -> DataFrame:
    """(read, positions): bases at which trusted k-mers (count above most) turn untrusted. Before the first trusted k-mer the
    base just before it counts; after a trusted run the last base of the first untrusted k-mer."""
    w = Window.partitionBy(*read).orderBy("pos")
    trusted = F.col("count") > most
    seen = occurrences.withColumn("trusted", trusted).withColumn("before", F.lag(trusted).over(w)).withColumn("first", F.min(F.when(trusted, F.col("pos"))).over(Window.partitionBy(*read)))
    at = F.when((F.col("pos") == F.col("first")) & (F.col("pos") > 0), F.col("pos") - 1).when(~F.col("trusted") & F.col("before"), F.col("pos") + k - 1)
    return seen.withColumn("at", at).groupBy(*read).agg(F.sort_array(F.collect_list("at")).alias("positions"))


def abundance_distribution(counts: DataFrame) -> DataFrame:
    """(abundance, n_kmers) of (kmer, count)."""
    return counts.groupBy(F.least("count", F.lit(65535)).cast("int").alias("abundance")).agg(F.count("*").alias("n_kmers"))


def counts_by_position(occurrences: DataFrame, max_len: int | None = None, equal: int = 0) -> DataFrame:
    """K-mers at each position: at all of them, or at those below max_len."""
    kept = occurrences if max_len is None else occurrences.where(F.col("pos") < max_len)
    kept = kept.where(F.col("count") == equal) if equal else kept
    return kept.groupBy("pos").agg(F.count("*").alias("n_kmers"))


def by_abundance(counts: DataFrame, equal: int) -> DataFrame:
    return counts.where(F.col("count") == equal)


def reads_without(kmers: DataFrame, table: DataFrame, read: list[str]) -> DataFrame:
    """Names of valid reads none of whose k-mers is in the table."""
    hit = kmers.join(table.select("kmer").distinct(), "kmer", "left_semi").select(*read).distinct()
    return kmers.select(*read).distinct().join(hit, read, "left_anti")


def reads_meeting(reads: DataFrame, k: int, table: DataFrame, read: list[str]) -> DataFrame:
    """Names of valid reads any of whose k-mers is in the table. One in FIRST k-mers by hash is looked up first; of the reads that meet the
    table by none of these all k-mers are. A written table. reads: (read, sequence)."""
    known, own = table.select("kmer").distinct(), reads.select(*read, "sequence")
    look = lambda rows: rows.join(known, "kmer", "left_semi").select(*read).distinct()
    few = written(look(explode_kmers(own, k).where(F.pmod(F.xxhash64("kmer"), F.lit(FIRST)) == 0)))
    more = written(look(explode_kmers(own.join(few, read, "left_anti"), k)).unionByName(few))
    dropped(few)
    return more


def reads_not_meeting(reads: DataFrame, k: int, table: DataFrame, read: list[str]) -> DataFrame:
    """Names of valid reads none of whose k-mers is in the table. reads: (read, sequence)."""
    return valid_reads(reads, k).select(*read).distinct().join(reads_meeting(reads, k, table, read), read, "left_anti")


def position_counts(occurrences: DataFrame, read: list[str]) -> DataFrame:
    """One line of counts in order for each read."""
    got = occurrences.groupBy(*read).agg(F.sort_array(F.collect_list(F.struct("pos", "count"))).alias("c"))
    return got.select(*read, F.array_join(F.transform("c", lambda x: x["count"].cast("string")), " ").alias("line"))


def high_abundance(kmers: DataFrame, low: int, high: int) -> DataFrame:
    """(kmer, count) of at least low among the reads up to the one in which a k-mer first reaches high. kmers: (read_idx, pos, kmer)."""
    nth = F.row_number().over(Window.partitionBy("kmer").orderBy("read_idx", "pos"))
    stop = kmers.withColumn("nth", nth).where(F.col("nth") >= high).agg(F.min("read_idx").alias("stop"))
    last = F.broadcast(stop)  # one row
    kept = kmers.withColumn("one", F.lit(1)).join(last.withColumn("one", F.lit(1)), "one").where(F.col("stop").isNull() | (F.col("read_idx") <= F.col("stop")))
    return kept.groupBy("kmer").agg(F.count("*").alias("count")).where(F.col("count") >= low)


def approx_unique(kmers: DataFrame, error: float = 0.02) -> DataFrame:
    return kmers.groupBy("sample").agg(F.approx_count_distinct("kmer", error).alias("n_unique"))


def cardinality_sketch(kmers: DataFrame, lg: int = 14) -> DataFrame:
    """Mergeable sketches per sample; union_sketches joins them, sketch_estimate reads them."""
    return kmers.groupBy("sample").agg(F.hll_sketch_agg("kmer", F.lit(lg)).alias("sketch"))


def union_sketches(sketches: DataFrame, *by: str) -> DataFrame:
    """The sketches of each group (or of all rows) as one."""
    return sketches.groupBy(*by).agg(F.hll_union_agg("sketch").alias("sketch"))


def sketch_estimate(sketches: DataFrame) -> DataFrame:
    return sketches.withColumn("n_unique", F.hll_sketch_estimate("sketch")).drop("sketch")


def precision(error: float) -> int:
    """Address bits of registers for a relative error."""
    p = math.ceil(math.log2((1.04 / error) ** 2)) if error > 0 else 0
    if not 4 <= p <= 16:
        raise ValueError("an error of 0.0040625 to 0.367")
    return p


def registers(hashed: DataFrame, p: int, *by: str) -> DataFrame:
    """(by, register, rank) of 64-bit hashes h: the low p bits address a register, which holds the largest rank, that is 1 and
    the leading zeros of the other bits. Empty registers have no row; registers of parts merge by merge_registers."""
    rest = F.shiftrightunsigned("h", p)
    rank = F.when(rest == 0, 65 - p).otherwise(65 - p - F.length(F.bin(rest)))
    return hashed.where(F.col("h").isNotNull()).groupBy(*by, F.col("h").bitwiseAND(F.lit((1 << p) - 1)).alias("register")).agg(F.max(rank).cast("int").alias("rank"))


def merge_registers(first: DataFrame, second: DataFrame, *by: str) -> DataFrame:
    return first.unionByName(second).groupBy(*by, "register").agg(F.max("rank").alias("rank"))


def register_estimate(held: DataFrame, p: int, *by: str) -> DataFrame:
    """(by, n_unique): linear counting below its bound, else the harmonic mean of the registers, without a bias table."""
    m = 1 << p
    alpha = {4: 0.673, 5: 0.697, 6: 0.709}.get(p, 0.7213 / (1 + 1.079 / m))
    got = held.groupBy(*by).agg(F.count("*").alias("used"), F.sum(F.pow(F.lit(2.0), -F.col("rank"))).alias("total"))
    linear = m * F.log(F.lit(float(m)) / F.nullif(F.lit(m) - F.col("used"), F.lit(0)))
    raw = alpha * m * m / (F.col("total") + m - F.col("used"))
    return got.select(*by, F.floor(F.when(linear <= LINEAR_BELOW[p - 4], linear).otherwise(raw)).alias("n_unique"))
