"""Numbers of k-mers made for a batch of reads together, against those of single k-mers."""

import random

import pytest
from pyspark.sql import functions as F

from strandlake.functions import kmers as K

RNG = random.Random(9)
READS = [None, "", "A", "ACGT", "G" * 40, *("".join(RNG.choice("ACGT") for _ in range(RNG.randint(0, 90))) for _ in range(60)), None]


@pytest.mark.parametrize("canonical", [True, False])
def test_numbers_of_reads(spark, canonical):
    df = spark.createDataFrame(list(enumerate(READS)), "i int, s string").repartition(3)
    sizes = (1, 2, 3, 5, 11, 16, 21, 31, 32)
    got = df.select("i", *(K.kmer_hashes(F.col("s"), k, canonical).alias(f"k{k}") for k in sizes)).collect()
    assert len(got) == len(READS)
    for k in sizes:
        words = df.select("i", F.posexplode(K.kmers(F.col("s"), k)).alias("pos", "w")).select("i", "pos", K.kmer_hash(F.col("w"), k, canonical).alias("x")).collect()
        want = {}
        for r in sorted(words):
            want.setdefault(r["i"], []).append(r["x"])
        assert {r["i"]: r[f"k{k}"] for r in got} == {i: want.get(i, []) for i in range(len(READS))}


@pytest.mark.parametrize("k", [1, 4, 15, 31])
def test_other_strand(spark, k):
    words = ["".join(RNG.choice("ACGT") for _ in range(k)) for _ in range(50)] + ["A" * k, "G" * k]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    r = df.select(K.reverse_number(K.forward_hash(F.col("w"), k), k).alias("a"), K.reverse_hash(F.col("w"), k).alias("b")).collect()
    assert all(x["a"] == x["b"] for x in r)
