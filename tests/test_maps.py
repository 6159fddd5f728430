"""Live partition maps against plain code, and files of tags, entries and presence bits against the frames they came from."""

import random

import numpy as np
import pytest

from strandlake.operators import partition_map
from strandlake.sources import entry_files, sketch_file

MAP, GROUPS = "kmer long, partition_id long", "group_id long, kmer long"


def rows(df):
    return sorted(map(tuple, df.select("kmer", "partition_id").collect()))


def test_ids_are_set_replaced_and_taken_out(spark):
    parts = spark.createDataFrame([(1, 5), (2, 6), (3, 7)], MAP)
    updates = spark.createDataFrame([(2, 9), (3, 0), (4, 1), (4, 8), (5, 0)], MAP)
    new = partition_map.set_ids(parts, updates)
    assert rows(new) == [(1, 5), (2, 9), (4, 8)]
    asked = spark.createDataFrame([(1,), (3,), (3,), (9,)], "kmer long")
    assert rows(partition_map.get_ids(new, asked)) == [(1, 5), (3, 0), (9, 0)]
    none = spark.createDataFrame([], MAP)
    assert rows(partition_map.set_ids(none, none)) == [] and rows(partition_map.set_ids(parts, none)) == rows(parts)


def joined_one_by_one(parts, groups):
    """Partitions as sets of k-mers with the ids and groups that went into them."""
    sets = []
    for kmers, ids, own in [({a for a, p in parts if p == i}, {i}, set()) for i in {p for _, p in parts if p}] + [(ks, set(), {g}) for g, ks in groups.items()]:
        for x in [x for x in sets if x[0] & kmers]:
            sets.remove(x)
            kmers, ids, own = kmers | x[0], ids | x[1], own | x[2]
        sets.append((kmers, ids, own))
    highest = max([p for _, p in parts], default=0)
    fresh = {min(x[2]): highest + n for n, x in enumerate(sorted((x for x in sets if not x[1]), key=lambda x: min(x[2])), 1)}
    return sorted((a, min(ids) if ids else fresh[min(own)]) for kmers, ids, own in sets for a in kmers)


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_join_partitions_of_a_map(spark, seed):
    rng = random.Random(seed)
    parts = [(a, rng.choice([0, 3, 4, 8, 11, 12])) for a in range(0, 60)]
    groups = {g: {rng.randrange(40, 240) for _ in range(rng.randint(1, 4))} for g in range(45)}
    groups[7] |= set(range(100, 120))  # one group holds much of all
    told = [(g, a) for g, ks in groups.items() for a in ks] * 2
    got = partition_map.assign(spark.createDataFrame(parts, MAP), spark.createDataFrame(told, GROUPS))
    assert rows(got) == joined_one_by_one(parts, groups)


def test_assign_with_nothing(spark):
    none, no_groups = spark.createDataFrame([], MAP), spark.createDataFrame([], GROUPS)
    assert rows(partition_map.assign(none, no_groups)) == []
    assert rows(partition_map.assign(spark.createDataFrame([(1, 4), (2, 0)], MAP), no_groups)) == [(1, 4)]
    assert rows(partition_map.assign(none, spark.createDataFrame([(0, 3), (5, 4)], GROUPS))) == [(3, 1), (4, 2)]


@pytest.mark.parametrize("stop", [False, True])
def test_tags_in_folders(spark, tmp_path, stop):
    tags = random.Random(4).sample(range(2**62), 1000)
    path = f"file://{tmp_path}/tags"
    df = spark.createDataFrame([(t,) for t in tags + tags[:50]], "kmer long")
    assert entry_files.write_tags(df, path, 31, 40, stop, entries_a_file=150) == 1000
    names = sorted(p.name for p in (tmp_path / "tags").iterdir())
    assert len(names) > 6
    held = [sketch_file.decode_tags((tmp_path / "tags" / n).read_bytes(), stop) for n in names]
    assert all(k == 31 and density == 40 and len(own) <= 150 for k, density, own in held)
    assert [t for _, _, own in held for t in own] == sorted(tags)
    got = entry_files.read_tags(spark, path, stop).collect()
    assert sorted(int(r["kmer"]) for r in got) == sorted(tags) and {(r["ksize"], r["density"]) for r in got} == {(31, 40)}
    with pytest.raises(FileExistsError):
        entry_files.write_tags(df, path, 31, 40, stop)


def test_no_tags_in_a_folder(spark, tmp_path):
    path = f"file://{tmp_path}/none"
    assert entry_files.write_tags(spark.createDataFrame([], "kmer long"), path, 9, 40) == 0
    assert entry_files.read_tags(spark, path).count() == 0


def test_maps_and_labels_in_folders(spark, tmp_path):
    from decimal import Decimal

    pairs = [(5, 2), (5, 3), (2**64 - 1, 2**32 - 1), *((i * 977, i % 7 + 1) for i in range(400))]
    for kind, value in ((sketch_file.PARTITIONS, "partition_id"), (sketch_file.LABELS, "label")):
        df = spark.createDataFrame([(Decimal(a), b) for a, b in pairs + pairs[:9]], f"kmer decimal(20,0), {value} long")
        path = f"file://{tmp_path}/{kind}"
        assert entry_files.write_entries(df, path, kind, 32, entries_a_file=64) == len(set(pairs))
        got = sketch_file.read_entries(spark, path, kind).collect()
        assert sorted((int(r["kmer"]), int(r[value])) for r in got) == sorted(set(pairs))
    with pytest.raises(Exception, match="too large"):
        entry_files.write_entries(spark.createDataFrame([(1, 2**32)], MAP), f"file://{tmp_path}/big", sketch_file.PARTITIONS, 9)


def test_presence_in_folders(spark, tmp_path):
    sizes, rng = [1009, 1013], np.random.default_rng(5)
    own = {(s, t, int(b)) for s in ("one", "two") for t, size in enumerate(sizes) for b in [*rng.integers(0, size, 200), 0, size - 1]}
    path = f"file://{tmp_path}/bits"
    df = spark.createDataFrame([*own, *list(own)[:20]], "sample string, tab int, bin long")
    assert entry_files.write_presence(df, path, 20, sizes, bins_a_block=128) == 2
    got = {(r["file"].removesuffix(".pt"), r["tab"], r["bin"]) for r in entry_files.read_presence(spark, path).collect()}
    assert got == own
    bins = [np.array(sorted(b for s, t, b in own if s == "one" and t == tab)) for tab in range(2)]
    data = (tmp_path / "bits" / "one.pt").read_bytes()
    assert data == sketch_file.encode_presence(20, sizes, bins) and sketch_file.decode_presence(data)["occupied"] == len(bins[0])
