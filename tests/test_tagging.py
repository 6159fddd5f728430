"""Tags set in read order, labels and unique paths, against plain walks over all reads."""

import random

import numpy as np
import pytest

from strandlake.operators import paths, tagging

K = 7
CODE = {"A": 0, "T": 1, "C": 2, "G": 3}


def canonical(word):
    f = r = 0
    for c in word:
        f = f * 4 + CODE[c]
    for c in reversed(word):
        r = r * 4 + (CODE[c] ^ 1)
    return min(f, r)


def kmers(seq, k=K):
    return [canonical(seq[i : i + k]) for i in range(len(seq) - k + 1)]


def reads_of(seed=3, n=60):
    rng = random.Random(seed)
    genome = "".join(rng.choice("ACGT") for _ in range(400))
    out = []
    for i in range(n):
        at = rng.randrange(0, 330)
        s = list(genome[at : at + rng.randint(5, 70)])
        if rng.random() < 0.4:
            s[rng.randrange(len(s))] = rng.choice("ACGTN")
        out.append((i, "".join(s)))
    return out + [(n, "A" * 60), (n + 1, None), (n + 2, "acgtacgtac"), (n + 3, "A" * 60)]


ROWS = reads_of()
VALID = [(i, s.upper()) for i, s in ROWS if s and len(s) >= K and set(s.upper()) <= set("ACGT")]


def plain(density, stops=frozenset()):
    """One walk over all reads, as the rules say."""
    tagged, met = set(), []
    for number, (_, s) in enumerate(VALID):
        since, last, own = density // 2 + 1, None, []
        for x in kmers(s):
            if x in stops:
                if last is not None and not own:
                    own.append(last)
                    tagged.add(last)
                since = density - 1
            else:
                since = 1 if x in tagged else since + 1
                if since == 1 or since >= density:
                    own.append(x)
                if since >= density:
                    tagged.add(x)
                    since = 1
            last = x
        if last not in stops and since >= density // 2 - 1:
            tagged.add(last)
            own.append(last)
        met += [(number, x) for x in own]
    return tagged, set(met)


@pytest.fixture(scope="module")
def reads(spark):
    return spark.createDataFrame(ROWS, "doc_id long, sequence string").repartition(5)


@pytest.mark.parametrize("block,density,stopped", [(10_000, 12, False), (150, 4, False), (150, 12, True)])
def test_tags_are_those_of_one_walk(spark, reads, block, density, stopped):
    every = sorted({x for _, s in VALID for x in kmers(s)})
    stops = set(every[::9]) if stopped else set()
    lined = tagging.lined(reads, ["doc_id"], K, block)
    assert sorted(r["doc_id"] for r in lined.collect()) == [i for i, _ in VALID]
    assert {r["read_no"]: r["doc_id"] for r in lined.collect()} == {n: i for n, (i, _) in enumerate(VALID)}
    if block == 150:
        assert lined.select("block").distinct().count() > 5
    stop = spark.createDataFrame([(x,) for x in stops], "kmer long") if stopped else None
    events = tagging.consume_and_tag(lined, density, stop)
    tagged, met = plain(density, stops)
    assert {r["kmer"] for r in tagging.tags(events).collect()} == tagged
    assert {(r["read_no"], r["kmer"]) for r in events.collect()} == met
    assert {(r["label"], r["tag"]) for r in tagging.read_labels(events).collect()} == met
    fresh = [r["kmer"] for r in events.where("new").collect()]
    assert len(fresh) == len(set(fresh))


def test_partitions_of_reads(spark, reads):
    stops = set(sorted({x for _, s in VALID for x in kmers(s)})[::9])
    lined = tagging.lined(reads, ["doc_id"], K, 200)
    events = tagging.consume_and_tag(lined, 6, spark.createDataFrame([(x,) for x in stops], "kmer long"))
    group = {x: x for x in plain(6, stops)[0]}

    def top(x):
        while group[x] != x:
            x = group[x]
        return x

    by_read = {}
    for n, x in plain(6, stops)[1]:
        by_read.setdefault(n, []).append(x)
    for own in by_read.values():
        for x in own:
            a, b = sorted((top(own[0]), top(x)))
            group[b] = a
    got = {r["kmer"]: r["partition_id"] for r in tagging.path_partitions(events).collect()}
    assert got == {x: top(x) for x in group} and len(set(got.values())) > 1


def test_named_reads(spark):
    rows = [(i, f"r{i}\t{p}", s) for i, (p, s) in enumerate([(3, "ACGTACGTAA"), (0, "ACGTACGCC"), (5, "ACGTACGTTT"), (0, "GGGGGGGCC"), (2, "AC")])]
    lined = tagging.lined(spark.createDataFrame(rows, "doc_id long, name string, sequence string"), ["doc_id"], K)
    tags, parts = tagging.named_partitions(lined)
    first = canonical("ACGTACG")
    assert {r["kmer"] for r in tags.collect()} == {first, canonical("GGGGGGG")}
    assert [(r["kmer"], r["partition_id"]) for r in parts.collect()] == [(first, 5)]
    events = tagging.consume_and_tag(lined, 4)
    got = {(r["tag"], r["label"]) for r in tagging.named_labels(events, lined).collect()}
    assert got == {(r["kmer"], [3, 0, 5, 0][r["read_no"]]) for r in events.collect()}


def test_no_reads(spark):
    none = spark.createDataFrame([], "doc_id long, sequence string")
    lined = tagging.lined(none, ["doc_id"], K)
    assert tagging.consume_and_tag(lined, 4).count() == 0 and tagging.new_kmers(lined).count() == 0
    assert paths.unique_paths(none, ["doc_id"], K, 10).count() == 0
    with pytest.raises(ValueError):
        tagging.check_density(5)


def plain_paths(seen, k, min_length, share):
    """The windows one by one."""
    size, n, out, i = min_length - k + 1, len(seen), [], 0
    most = np.float32(1.0 - np.float32(share))
    bad = lambda s: np.float32(sum(seen[s : s + size])) / np.float32(size) > most
    while n >= size and i < n - size:
        if bad(i):
            i += 1
            continue
        start, ended = i, False
        while start + size < n and not ended:
            start += 1
            ended = bad(start)
        start -= 2 if ended else 1
        out.append((i, min(start + size + k - i, n + k - 1 - i)))
        i = start + size + 1
    return out


@pytest.mark.parametrize("min_length,share", [(12, 0.5), (30, 0.9)])
def test_unique_paths(spark, reads, min_length, share):
    want, before = [], set()
    for i, s in VALID:
        own = kmers(s)
        want += [(i, n, a, b, s[a : a + b]) for n, (a, b) in enumerate(plain_paths([x in before for x in own], K, min_length, share))]
        before |= set(own)
    got = sorted(map(tuple, paths.unique_paths(reads, ["doc_id"], K, min_length, share).collect()))
    assert got == want and want
    table = {x for _, s in VALID[:20] for x in kmers(s)}
    want = [(i, n, a, b, s[a : a + b]) for i, s in VALID for n, (a, b) in enumerate(plain_paths([x in table for x in kmers(s)], K, min_length, share))]
    got = paths.unseen_paths(reads, spark.createDataFrame([(x,) for x in table], "kmer long"), ["doc_id"], K, min_length, share)
    assert sorted(map(tuple, got.collect())) == want


def test_blocks_are_few_waves(spark, reads, monkeypatch):
    """Blocks were walked again in rounds, each with tables of its own, until nothing changed."""
    tables, write = [], tagging.written
    monkeypatch.setattr(tagging, "written", lambda df: tables.append(1) or write(df))
    lined = tagging.lined(reads, ["doc_id"], K, 150)
    assert lined.select("block").distinct().count() > 5
    events = tagging.consume_and_tag(lined, 4)
    assert {r["kmer"] for r in tagging.tags(events).collect()} == plain(4)[0]
    assert len(tables) <= 12
