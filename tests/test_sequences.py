"""FASTQ in several splits, mixed folders and interleaved pairs, against plain parsing."""

import gzip
import random

import pytest

from strandlake.errors import InvalidRead
from strandlake.functions import kmers as F_K
from strandlake.sources import sequences


def fastq(n, seed=1, most=60):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        size = rng.randint(1, most)
        quality = "".join(rng.choice("@+I#>") for _ in range(size))  # marks that may be taken for starts
        rows.append((f"r{i} x/{i % 2 + 1}", "".join(rng.choice("ACGTN") for _ in range(size)), quality))
    return rows


def text(rows, names=False, end="\n"):
    return end.join(f"@{n}{end}{s}{end}+{n if names else ''}{end}{q}" for n, s, q in rows) + end


@pytest.fixture
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_many_splits_are_one_file(spark, small_splits, tmp_path, end):
    want = {}
    for name, n in (("a", 150), ("b", 31), ("c", 1)):
        want[name] = fastq(n, seed=n)
        (tmp_path / f"{name}.ct.fq").write_bytes((text(want[name], n == 31, end) + end * 2).encode())
    path = f"file://{tmp_path}"
    assert sequences.split_lines(sequences._splits(spark, path)).count() > 20
    found = sequences.read_fastq(spark, path)
    assert found.rdd.getNumPartitions() > 10
    got = {}
    for r in found.orderBy("sample", "read_idx").collect():
        got.setdefault(r["sample"], []).append((r["name"], r["sequence"], r["quality"]))
        assert r["read_idx"] == len(got[r["sample"]]) - 1
    assert got == want


def test_wrapped_packed_and_mixed(spark, small_splits, tmp_path):
    rows = fastq(40, 7)
    (tmp_path / "plain.ct.fq").write_text(text(rows))
    (tmp_path / "wrapped.ct.fq").write_text("@w\nACG\nTT\n+\nII@\n@I\n@v\nA\n+\nI\n")
    (tmp_path / "packed.ct.fq.gz").write_bytes(gzip.compress(text(rows[:9]).encode()))
    (tmp_path / "other.ct.fa").write_text(">f1 x\nACG\nTT\n>f2\nGG\n")
    got = {}
    for r in sequences.read_sequences(spark, f"file://{tmp_path}").orderBy("sample", "read_idx").collect():
        got.setdefault(r["sample"], []).append((r["name"], r["sequence"], r["quality"]))
    assert got == {"plain": rows, "packed": rows[:9], "wrapped": [("w", "ACGTT", "II@@I"), ("v", "A", "I")], "other": [("f1 x", "ACGTT", None), ("f2", "GG", None)]}


@pytest.mark.parametrize("bad", ["", "ACGT\n", "@r\nAC\n+\nI\n", "@r\nAC\n+s\nII\n", "@r\nAC\n", "@r\n\n+\n\n", "@a\nAC\n+\nII\n@b\nAC\n+b c\nII\n"])
def test_wrong_files(spark, tmp_path, bad):
    (tmp_path / "x.fq").write_text(bad)
    with pytest.raises(Exception) as e:
        sequences.read_fastq(spark, f"file://{tmp_path}/x.fq").collect()
    assert isinstance(e.value, InvalidRead) or "InvalidRead" in str(e.value) or "USER_RAISED" in str(e.value)


def taken(names):
    """Reads in turn, as the rule says."""
    first, second = lambda n: n.endswith("/1"), lambda a, b: a.endswith("/1") and b.endswith("/2") and a[:-2] == b[:-2]
    out, i = [], 0
    while i < len(names):
        if first(names[i]) and i + 1 < len(names):
            if second(names[i], names[i + 1]):
                out.append((names[i], names[i + 1]))
            i += 2
        else:
            i += 1
    return out


@pytest.mark.parametrize("chunk", [5, 1_000_000])
def test_pairs_are_taken_in_turn(spark, monkeypatch, chunk):
    rng, rows, want = random.Random(4), [], []
    for sample in ("s", "t", "u"):
        names = [f"{rng.choice('ab')}/{rng.choice('112')}" for _ in range(500)] if sample != "u" else ["a/1"] * 7 + ["a/2", "a/1", "a/2"]
        want += [(sample, *p) for p in taken(names)]
        rows += [(sample, 3 * i, n, "ACG", None) for i, n in enumerate(names)]
    inner = sequences._last_stop
    monkeypatch.setattr(sequences, "_last_stop", lambda rows: inner(rows, chunk))
    got = sequences.pairs(spark.createDataFrame(rows, sequences.READS).repartition(4), "ignore").collect()
    assert sorted((r["sample"], r["first"]["name"], r["second"]["name"]) for r in got) == sorted(want) and len(want) > 20


def test_pairs_or_an_error(spark):
    good = [("s", i, f"r{i // 2}/{i % 2 + 1}", "ACG", None) for i in range(6)] + [("t", 5, "q 1:N:0:ACG", "A", "I"), ("t", 9, "q 2:Y:0:ACG", "C", "I")]
    got = sequences.pairs(spark.createDataFrame(good, sequences.READS)).collect()
    assert sorted((r["first"]["name"], r["second"]["name"]) for r in got) == [("q 1:N:0:ACG", "q 2:Y:0:ACG"), ("r0/1", "r0/2"), ("r1/1", "r1/2"), ("r2/1", "r2/2")]
    for bad in (good[:3], [good[1], good[0]]):
        with pytest.raises(Exception, match="no pair"):
            sequences.pairs(spark.createDataFrame([(s, i, n, q, x) for i, (s, _, n, q, x) in enumerate(bad)], sequences.READS)).collect()
    with pytest.raises(ValueError):
        sequences.pairs(spark.createDataFrame(good, sequences.READS), "allow")
    marks = spark.createDataFrame([("a/1",), ("/1",), ("x 1:N:0:ACG",), ("x 2:N:0:ACG",), (None,)], "n string")
    assert [r[0] for r in marks.select(F_K.first_of_pair(marks["n"])).collect()] == [True, False, True, False, False]
