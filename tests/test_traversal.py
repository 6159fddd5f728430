"""Searches of the k-mer graph against plain queues."""

from collections import deque

import pytest

from strandlake.operators import traversal
from tests.test_tagging import CODE, VALID, canonical, kmers

K = 7
LETTER = {v: c for c, v in CODE.items()}
COUNT = {}
for _, s in VALID:
    for x in kmers(s):
        COUNT[x] = COUNT.get(x, 0) + 1
NODES = sorted(COUNT)
TAGS = NODES[::13]


def word(x):
    return "".join(LETTER[(x >> 2 * i) & 3] for i in range(K - 1, -1, -1))


def near(x):
    w = word(x)
    every = [canonical(w[1:] + c) for c in "ACGT"] + [canonical(c + w[:-1]) for c in "ACGT"]
    return [y for y in every if y in COUNT]


def visit(starts, radius=None, stop=(), tags=(), most=None, enter=lambda x: True, multi=False):
    """A queue of (k-mer, depth); the k-mers in the order of visits."""
    seen, queue, tagged = {}, deque((x, 0) for x in starts), []
    while queue:
        x, d = queue.popleft()
        if x in seen or x in stop:
            continue
        if most is not None and len(seen) >= most:
            break
        seen[x] = d
        if x in tags and (d or multi):
            tagged.append(x)
            continue
        if radius is None or d < radius:
            queue.extend((y, d + 1) for y in near(x) if enter(y))
    return seen, tagged


@pytest.fixture(scope="module")
def nodes(spark):
    return spark.createDataFrame([(x, n) for x, n in COUNT.items()], "kmer long, count long").repartition(3)


def frame(spark, rows):
    return spark.createDataFrame([(x,) for x in rows], "kmer long")


@pytest.mark.parametrize("threshold,hubs", [(None, False), (None, True), (10, True), (25, False)])
def test_connected_sizes(spark, nodes, threshold, hubs):
    stop = set(NODES[::7])
    enter = (lambda x: len(near(x)) <= 4) if hubs else (lambda x: True)
    starts = [*NODES[::5], 10**6 + 1]
    want = {x: len(visit([x], stop=stop, most=threshold, enter=enter)[0]) if x in COUNT else 0 for x in starts}
    got = traversal.connected_sizes(nodes, spark.createDataFrame([(x, x) for x in starts], "source long, kmer long"), K, threshold, frame(spark, stop), hubs)
    assert {r["source"]: r["size"] for r in got.collect()} == want and len(set(want.values())) > (1 if threshold != 1 else 0)


@pytest.mark.parametrize("most", [None, 12])
def test_traverse_keeps_the_first_in_order(spark, nodes, most):
    stop = set(NODES[::9])
    want = {(t, x, d) for t in TAGS for x, d in visit([t], 4, stop, most=None if most is None else most + 1)[0].items()}
    starts = spark.createDataFrame([(x, x) for x in TAGS], "source long, kmer long")
    assert set(map(tuple, traversal.traverse(nodes, starts, K, 4, frame(spark, stop), most).collect())) == want


@pytest.mark.parametrize("big,band", [(8, None), (None, (2, 9))])
def test_find_tags(spark, nodes, big, band):
    stop = set(NODES[::10])
    inside = (lambda x: band[0] <= COUNT[x] <= band[1]) if band else (lambda x: True)
    want = set()
    for t in TAGS:
        if inside(t):
            seen, found = visit([t], 5, stop, set(TAGS), enter=inside)
            want |= {(t, x) for x in found} if not big or len(seen) <= big else set()
    got = traversal.find_tags(nodes, frame(spark, TAGS), K, 2, frame(spark, stop), bool(big), band, big or 200)
    assert set(map(tuple, got.collect())) == want and want


def one_after_the_other(tags, radius, threshold, frequency, stop=(), skip=()):
    stop, counts, small = set(stop), dict(COUNT), set()
    for t in sorted(tags):
        if t in skip:
            continue
        seen, _ = visit([t], radius, stop)
        if len(seen) < threshold:
            small.add(t)
            continue
        for x in seen:
            if counts[x] > frequency:
                stop.add(x)
            else:
                counts[x] += 1
    return stop, counts, small


@pytest.mark.parametrize("radius,threshold,frequency", [(3, 6, 5), (4, 1, 2)])
def test_traverse_from_tags(spark, nodes, radius, threshold, frequency):
    first = set(NODES[::31])
    stop, counts, small = one_after_the_other(NODES[::5], radius, threshold, frequency, first)
    new, after, little = traversal.traverse_from_tags(nodes, frame(spark, NODES[::5]), nodes, K, radius, threshold, frequency, frame(spark, first))
    assert {r["kmer"] for r in new.collect()} | first == stop and len(stop) > len(first)
    assert {r["kmer"]: r["count"] for r in after.collect()} == counts
    assert {r["kmer"] for r in little.collect()} == small


@pytest.mark.parametrize("wave,most", [(10**6, 1), (6000, 20)])
def test_traverse_from_tags_in_waves(spark, nodes, monkeypatch, wave, most):
    """Searches that avoided a stop tag too late were run again, in as many rounds as tags depend on each other."""
    asked, search = [], traversal.search
    monkeypatch.setattr(traversal, "search", lambda *a, **b: asked.append(1) or search(*a, **b))
    tags = NODES[::2][:240]
    stop, counts, small = one_after_the_other(tags, 2, 2, 1)
    new, after, little = traversal.traverse_from_tags(nodes, frame(spark, tags), nodes, K, 2, 2, 1, **({} if most == 1 else {"wave": wave}))
    assert {r["kmer"] for r in new.collect()} == stop and {r["kmer"]: r["count"] for r in after.collect()} == counts
    assert {r["kmer"] for r in little.collect()} == small and len(asked) <= most and (most == 1 or len(asked) > 1)


def groups(tags, links):
    root = {t: t for t in tags}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = sorted((top(a), top(b)))
        root[y] = x
    return {t: top(t) for t in tags}


def test_repartition_largest(spark, nodes):
    tags = NODES[::6]
    parts = groups(tags, [(t, x) for t in tags for x in visit([t], 5, (), set(tags))[1]])
    size = {p: sum(q == p for q in parts.values()) for p in set(parts.values())}
    first = max(size, key=lambda p: (size[p], p))
    own = {t for t, p in parts.items() if p == first}
    stop, _, small = one_after_the_other(own, 4, 6, 4)
    split = groups(own, [(t, x) for t in own for x in visit([t], 5, stop, set(tags))[1] if x in own])
    want = {t: split.get(t, p) for t, p in parts.items()}
    before = spark.createDataFrame(list(parts.items()), "kmer long, partition_id long")
    got = traversal.repartition_largest(nodes, frame(spark, tags), before, nodes, K, 2, 4, 6, 4)
    assert {r["kmer"]: r["partition_id"] for r in got["parts"].collect()} == want and len(set(split.values())) > 1
    assert {r["kmer"] for r in got["stop"].collect()} == stop and {r["kmer"] for r in got["small"].collect()} == small
    looped = traversal.split_largest(nodes, frame(spark, tags), nodes, K, 2, 4, 6, 4)
    assert {r["kmer"]: r["partition_id"] for r in looped["parts"].collect()} == want


@pytest.mark.parametrize("radius,big", [(0, None), (3, 60)])
def test_sweep(spark, nodes, radius, big):
    stop, rows, want, labels = set(NODES[::17]), [], set(), [(x, x % 4) for x in TAGS for _ in range(2)]
    for i, s in VALID[:30]:
        own = kmers(s)
        rows += [(i, x) for x in own]
        seen, found = visit(own, radius, stop, set(TAGS), multi=True)
        want |= {(i, x) for x in found} if big is None or len(seen) <= big else set()
    got = traversal.sweep(nodes, spark.createDataFrame(rows, "source long, kmer long"), frame(spark, TAGS), K, radius, frame(spark, stop), big)
    assert set(map(tuple, got.collect())) == want and want
    named = traversal.sweep_labels(got, spark.createDataFrame(labels, "tag long, label long"))
    assert sorted(map(tuple, named.collect())) == sorted({(i, x % 4) for i, x in want})
