import math
import os

import numpy as np
import pytest

from strandlake.errors import FileFormatError, IncompatibleSketches, InvalidRead, NoMatrix
from strandlake.operators import counting, kernels, matrix, population, stats
from strandlake.sources import sequences, sketch_file

R = {1: "CTGATCAGCTAGTCGTA", 2: "TGTACGTAGTCAGTAGC", 3: "GCTAGCTAGTCGTAGTA", 5: "CATTTATTGTCTATATC"}
SAMPLES = {"d1": (1, 2, 5), "d2": (1, 3, 5), "d3": (2, 3, 5)}
KERNEL = [[15.611, 9.18296, 6.42807], [9.18296, 10.1013, 0.918296], [6.42807, 0.918296, 7.34637]]
DISTANCE = [[0, 0.733113, 0.894153], [0.733113, 0, 1.33671], [0.894153, 1.33671, 0]]


@pytest.fixture(scope="module")
def counts(spark):
    rows = [(s, i, str(r), R[r], None) for s, own in SAMPLES.items() for i, r in enumerate(own)]
    reads = spark.createDataFrame(rows, sequences.READS)
    return counting.sketch(counting.explode_kmers(reads, 5), [97]).persist()


def near(df, want):
    _, m = matrix.dense(df)
    assert np.linalg.norm(m - np.array(want)) <= 1e-4 * np.linalg.norm(want)


@pytest.mark.parametrize("plan", ["pairs", "gram"])
def test_known_kernel_and_distance(counts, plan):
    k = kernels.pairwise_kernel(counts, 1, "entropy", plan=plan)
    near(k, KERNEL)
    near(kernels.distance(k), DISTANCE)
    near(kernels.pairwise_kernel(counts, 1, "unweighted", plan=plan), [[55, 50, 50], [50, 75, 54], [50, 54, 63]])
    assert matrix.is_positive_semidefinite(matrix.dense(k)[1])


def test_population_and_stats(counts):
    assert math.isclose(population.occupancy_rate(counts, [97]).first()["rate"], 33 / 97)
    assert {r["sample"]: r["occupied"] for r in counting.occupied(counts).collect()} == {"d1": 32, "d2": 26, "d3": 29}
    assert {r["sample"]: r["sample_sum"] for r in stats.sample_stats(counts, [97], 3).collect()} == dict.fromkeys(SAMPLES, 39)


def test_disjoint_identical_and_universal_bins(spark):
    c = spark.createDataFrame([("a", 0, 1, 2), ("b", 0, 2, 2), ("c", 0, 1, 2)], "sample string, tab int, bin long, count smallint")
    d = {(r["a"], r["b"]): r["value"] for r in kernels.distance(kernels.pairwise_kernel(c, 1, "unweighted")).collect()}
    assert math.isclose(d["a", "b"], math.sqrt(2)) and d["a", "c"] == 0
    same = spark.createDataFrame([("a", 0, 1, 2), ("b", 0, 1, 2)], "sample string, tab int, bin long, count smallint")
    assert all(r["value"] == 0 for r in kernels.distance(kernels.pairwise_kernel(same, 1)).collect())
    with pytest.raises(NoMatrix):
        kernels.pairwise_kernel(same.where("sample = 'a'"), 1)


def test_sketch_file_round_trip(spark, counts, tmp_path):
    for r in sketch_file.sketch_bytes(counts, 5, [97], compress=True).collect():
        (tmp_path / f"{r['sample']}.ct.gz").write_bytes(bytes(r["content"]))
    back, described = sketch_file.read_sketches(spark, f"file://{tmp_path}")
    key = lambda df: sorted((r["sample"], r["tab"], r["bin"], r["count"]) for r in df.collect())
    assert key(back) == key(counts)
    counting.check_compatible(described)
    with pytest.raises(IncompatibleSketches):
        from pyspark.sql import functions as F

        counting.check_compatible(described.withColumn("ksize", F.when(F.col("sample") == "d1", 12).otherwise(F.col("ksize"))))
    for bad in (b"", b"XXXX\x04\x01", b"OXLI\x03\x01", b"OXLI\x04\x02", b"OXLI\x04\x01\x00"):
        with pytest.raises((FileFormatError, IndexError)):
            sketch_file.decode_counts(bad)


def test_command_line(spark, counts, tmp_path):
    from strandlake.plans import compare

    for r in sketch_file.sketch_bytes(counts, 5, [97]).collect():
        (tmp_path / f"{r['sample']}.ct").write_bytes(bytes(r["content"]))
    files = [str(tmp_path / f"{s}.ct") for s in SAMPLES]
    assert compare.main(["dist", "-d", str(tmp_path / "d.txt"), "-k", str(tmp_path / "k.txt"), *files], spark) == 0
    labels, m = matrix.from_text((tmp_path / "k.txt").read_text())
    assert labels == list(SAMPLES) and np.allclose(m, KERNEL, rtol=1e-4)
    assert compare.main(["weights", "-w", str(tmp_path / "w.txt"), *files], spark) == 0
    compare.main(["dist", "-w", str(tmp_path / "w.txt"), "-d", str(tmp_path / "e.txt"), *files], spark)
    assert np.allclose(matrix.from_text((tmp_path / "e.txt").read_text())[1], DISTANCE, atol=1e-3)
    assert compare.main(["cap", "-c", "1", files[0]], spark) == 0
    assert sketch_file.decode_counts(open(files[0] + ".capped.gz", "rb").read())["tables"][0].max() == 1
    with pytest.raises(SystemExit):
        compare.main(["dist", files[0]], spark)


def test_from_reads_to_matrices_by_commands(spark, tmp_path):
    from strandlake.plans import compare

    for s, own in SAMPLES.items():
        (tmp_path / f"{s}.fa").write_text("".join(f">{r}\n{R[r]}\n" for r in own))
    reads, out = [f"file://{tmp_path}/{s}.fa" for s in SAMPLES], str(tmp_path / "sketches")
    assert compare.main(["sketch", "-k", "5", "-x", "97", "-b", "-o", out, *reads], spark) == 0
    for files in ([out], [f"{out}/{s}.fa.ct.gz" for s in SAMPLES]):
        assert compare.main(["dist", "-v", "-k", str(tmp_path / "k.txt"), "-d", str(tmp_path / "d.txt"), *files], spark) == 0
        assert np.allclose(matrix.from_text((tmp_path / "k.txt").read_text())[1], KERNEL, rtol=1e-4)
        assert np.allclose(matrix.from_text((tmp_path / "d.txt").read_text())[1], DISTANCE, rtol=1e-4)
    assert compare.main(["dist", "-q", "-C", "-w", str(tmp_path / "w.txt"), out], spark) == 0
    assert (tmp_path / "w.txt").read_text().endswith("\n") and len((tmp_path / "w.txt").read_text().splitlines()) == 98
    assert compare.main(["stats", "-o", str(tmp_path / "s.txt"), out], spark) == 0
    assert [line.split("\t")[:2] for line in (tmp_path / "s.txt").read_text().splitlines()[1:]] == [[s, "39"] for s in SAMPLES]
    for bad in (["dist", "-C", out], ["--version"], ["dist", str(tmp_path / "sketches" / "d1.fa.ct.gz")]):
        with pytest.raises(SystemExit):
            compare.main(bad, spark)


def test_big_counts_through_files(spark, tmp_path):
    from strandlake.plans import compare

    (tmp_path / "a.fa").write_text(f">x\n{'A' * 404}\n")
    (tmp_path / "b.fa").write_text(">x\nACGTACGT\n")
    out = str(tmp_path / "o")
    assert compare.main(["sketch", "-k", "5", "-x", "97", "89", "-b", "-B", "-o", out, f"file://{tmp_path}/a.fa", f"file://{tmp_path}/b.fa"], spark) == 0
    got = sketch_file.decode_counts(open(f"{out}/a.fa.ct.gz", "rb").read())
    assert got["use_bigcount"] and got["bigcounts"] == [(0, 400)] and got["tables"][0][0] == 255
    assert [(r["sample"], int(r["kmer"]), r["count"]) for r in sketch_file.read_big_counts(spark, f"file://{out}/*.ct.gz").collect()] == [("a.fa", 0, 400)]
    assert sketch_file.decode_counts(open(f"{out}/b.fa.ct.gz", "rb").read())["bigcounts"] == []


def test_read_files(spark, tmp_path):
    (tmp_path / "x.fa").write_text(">one a\nACGT\nACGT\n>two\nTTTT\n")
    got = sequences.read_sequences(spark, f"file://{tmp_path}/x.fa").orderBy("read_idx").collect()
    assert [(r["name"], r["sequence"]) for r in got] == [("one a", "ACGTACGT"), ("two", "TTTT")]
    assert list(sequences.parse_fastq("@r\nAC\nGT\n+\nII\nI@\n@s\nA\n+s\nI\n")) == [("r", "ACGT", "III@"), ("s", "A", "I")]
    for bad in ("r\n", "@r\nAC\n+\nI\n", "@r\n\n+\n\n", "@r\nAC\n"):
        with pytest.raises(InvalidRead):
            list(sequences.parse_fastq(bad))


def test_largest_kmer(spark):
    from pyspark.sql import functions as F

    from strandlake.functions import kmers as K

    row = spark.createDataFrame([("G" * 32,)], "s string").select(K.forward_hash(F.col("s"), 32).alias("f"), K.kmer_hash(F.col("s"), 32).alias("u")).first()
    assert int(row["f"]) == 2**64 - 1 and int(row["u"]) == int("3" * 32, 4) - int("1" * 32, 4)


def test_contract_imports():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert os.path.exists(e.__file__)


def test_weights_by_order_of_lines(spark, tmp_path):
    from strandlake.sources import weights

    (tmp_path / "w.txt").write_text(f"{weights.HEAD}\t4\n9 0.5\n\n0 0\n3 0.25\n2 1\n")
    got = weights.weights_from_text(spark, str(tmp_path / "w.txt"))
    assert sorted(map(tuple, got.collect())) == [(0, 0, 0.5), (0, 2, 0.25), (0, 3, 1.0)]


def test_partition_maps_and_labels_in_files(spark, tmp_path):
    for kind, pairs in ((sketch_file.PARTITIONS, [(5, 2), (2**64 - 1, 2**32 - 1)]), (sketch_file.LABELS, [(5, 2), (5, 3), (9, 2**64 - 1)])):
        data = sketch_file.encode_entries(kind, 9, reversed(pairs))
        assert sketch_file.decode_entries(data, kind) == (9, pairs)
        (tmp_path / f"{kind}.bin").write_bytes(data)
        got = sketch_file.read_entries(spark, f"file://{tmp_path}/{kind}.bin", kind).collect()
        assert [(int(r[1]), int(r[2])) for r in got] == pairs and got[0]["file"] == f"{kind}.bin"
        for bad in (data[:-1], data + b"x", data[:8], data[:5] + b"\x09" + data[6:]):
            with pytest.raises(FileFormatError):
                sketch_file.decode_entries(bad, kind)
    assert sketch_file.decode_entries(sketch_file.encode_entries(sketch_file.LABELS, 9, []), sketch_file.LABELS) == (9, [])


def test_murmur_hash_and_registers(spark):
    from pyspark.sql import functions as F

    from strandlake.functions import kmers as K
    from strandlake.operators import spectrum

    known = K._murmur(np.frombuffer(b"foo", np.uint8).reshape(1, 3)).view(np.int64)  # the published value of this text
    assert known.tolist() == [-2129773440516405919]
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("ACGT"), size=n)) for n in (1, 5, 16, 17, 31, 32) for _ in range(300)]
    df = spark.createDataFrame([(w,) for w in words] + [(None,)], "w string")
    both = df.select(K.murmur_hash(F.col("w")).alias("h"), K.murmur_hash(K.reverse_complement(F.col("w"))).alias("r"))
    got = both.collect()
    assert all(r["h"] == r["r"] for r in got) and got[-1]["h"] is None
    p, want = spectrum.precision(0.1), {}
    for h in {r["h"] for r in got[:-1]}:
        u = h % 2**64
        want[u % 2**p] = max(want.get(u % 2**p, 0), 64 - p - (u >> p).bit_length() + 1)
    half = [both.where(F.col("h") % 2 == 0), both.where("h % 2 <> 0 OR h IS NULL")]
    held = spectrum.merge_registers(*(spectrum.registers(x, p) for x in half))
    assert {r["register"]: r["rank"] for r in held.collect()} == want
    estimate = spectrum.register_estimate(held, p).first()["n_unique"]
    assert abs(estimate / len({r["h"] for r in got[:-1]}) - 1) < 0.3
    with pytest.raises(ValueError):
        spectrum.precision(0.9)
