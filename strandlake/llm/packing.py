"""Best-fit packing of token pieces into sequences, improved by swap-based local search.

Documents are tokenised where they are read; only longer ones than a sequence are cut. The pieces (a few dozen
bytes each) are dealt evenly to shards of bounded size. A shard starts from best fit in decreasing order. Then local search
takes its underfull bins apart, the emptiest first: a document moves to a bin with room, or is exchanged for a smaller one, two
for one or one for two, and every step raises the sum of squared fills. The search ends when the bins are as few as the
tokens allow, when no step is left, or after STEPS_A_PIECE steps for each piece. Shards cost at most a bin or so each.

Defined cases: null text is empty (the end id alone); every row is packed, repeated ones too; ids may be null; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import shared_table, ship, texts, tidy
from .tokens import END, encoder

CAPACITY, SHARD_PIECES, STEPS_A_PIECE = 2048, 20_000, 2
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """The pieces of all documents, written once."""
    ship(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches):
        enc = encoder("word", vocabulary)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = enc.encode(text.as_py()) + END
                for k, a in enumerate(range(0, len(ids), 4 * capacity)):
                    piece = ids[a : a + 4 * capacity]
                    rows.append((doc_id, k, a // 4, len(piece) // 4, zlib.crc32(piece)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)] if rows else [pa.array([], f.type) for f in schema], schema=schema)

    return shared_table(texts(docs).mapInArrow(tidy("tokens", run), PIECES))


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Best fit, largest first: a bit set of the rooms that open bins have gives the tightest in one step."""
    rooms: dict[int, list[int]] = {}
    bins: list[list[int]] = []
    some = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[i])
        fits = some >> s
        if fits:
            room = s + (fits & -fits).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                some &= ~(1 << room)
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        if room > s:
            rooms.setdefault(room - s, []).append(b)
            some |= 1 << (room - s)
    return bins


class LocalSearch:
    """Bins whose documents are exchanged; the sum of squared fills rises with every step."""

    def __init__(self, sizes: np.ndarray, bins: list[list[int]], capacity: int):
        self.sizes, self.capacity = sizes, capacity
        self.own = [set(x) for x in bins]
        self.owner = np.empty(len(sizes), np.int64)
        for b, items in enumerate(bins):
            self.owner[items] = b
        self.fill = np.array([sizes[items].sum() for items in bins], np.int64)

    def put(self, i: int, to: int) -> None:
        a = int(self.owner[i])
        self.own[a].discard(i)
        self.own[to].add(i)
        self.owner[i] = to
        self.fill[a] -= self.sizes[i]
        self.fill[to] += self.sizes[i]

    def exchange(self, b: int, out: list[int], back: list[int], to: int) -> bool:
        for i in back:
            self.put(i, b)
        for i in out:
            self.put(i, to)
        return True

    def step(self, b: int) -> bool:
        """One step that takes tokens from bin b to another underfull bin: t gains d when d fits and t + d > b."""
        fill, sizes, room = self.fill, self.sizes, self.capacity - self.fill
        others = np.flatnonzero((room > 0) & (fill > 0))
        others = others[others != b]
        if not len(others):
            return False
        mine = sorted(self.own[b], key=lambda i: -sizes[i])
        space, level, below = room[others], fill[others], int(fill[b])
        for i in mine:  # move: the tightest bin
            ok = np.flatnonzero((space >= sizes[i]) & (level + sizes[i] > below))
            if len(ok):
                return self.exchange(b, [i], [], int(others[ok[space[ok].argmin()]]))
        near = np.array([i for t in others.tolist() for i in self.own[t]])
        size, space, level = sizes[near], room[self.owner[near]], fill[self.owner[near]]

        def best(total: int) -> int:
            gain = total - size
            ok = np.flatnonzero((gain > 0) & (gain <= space) & (level + gain > below))
            return int(near[ok[gain[ok].argmax()]]) if len(ok) else -1

        for i in mine:  # one for one
            j = best(int(sizes[i]))
            if j >= 0:
                return self.exchange(b, [i], [j], int(self.owner[j]))
        tried = set()
        for x, i in enumerate(mine):  # two for one
            for k in mine[x + 1 :]:
                total = int(sizes[i] + sizes[k])
                if total not in tried and total < self.capacity:
                    tried.add(total)
                    j = best(total)
                    if j >= 0:
                        return self.exchange(b, [i, k], [j], int(self.owner[j]))
        wanted = sorted({int(sizes[i]): i for i in mine}.items(), reverse=True)
        for t in others.tolist():  # one for two
            theirs = sorted(self.own[t], key=lambda i: -sizes[i])
            for s, i in wanted:
                if not theirs or s <= 2 * sizes[theirs[-1]]:
                    continue
                low, high = s - int(room[t]), s - 1  # what the two may sum to
                a, z = 0, len(theirs) - 1
                while a < z:
                    two = int(sizes[theirs[a]] + sizes[theirs[z]])
                    if two > high:
                        a += 1
                    elif two < low or fill[t] + s - two <= below:
                        z -= 1
                    else:
                        return self.exchange(b, [i], [theirs[a], theirs[z]], t)
        return False


def improve(sizes: np.ndarray, bins: list[list[int]], capacity: int) -> list[list[int]]:
    """bins after local search over their underfull ones, in passes until one changes nothing."""
    search = LocalSearch(sizes, bins, capacity)
    least, alive, left, changed = -(-int(sizes.sum()) // capacity), len(bins), STEPS_A_PIECE * len(sizes), True
    while changed and alive > least and left > 0:
        changed = False
        for b in np.argsort(search.fill, kind="stable").tolist():
            while search.own[b] and search.fill[b] < capacity and alive > least and left > 0 and search.step(b):
                changed, left = True, left - 1
                alive -= not search.own[b]
    return [sorted(x, key=lambda i: -sizes[i]) for x in search.own if x]


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to every piece."""
    ship(pieces.sparkSession)
    shards = max(1, -(-pieces.count() // SHARD_PIECES))
    names = [*PIECES.replace(" long", "").replace(" int", "").split(", "), "sequence_id", "offset"]

    def run(batches):
        from pyspark import TaskContext

        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        table = pa.Table.from_batches(batches)
        sizes = table.column("length").to_numpy()
        part = np.flatnonzero(sizes < capacity)
        bins = improve(sizes[part], best_fit(sizes[part], capacity), capacity)
        seq, offset = np.empty(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        full = np.flatnonzero(sizes >= capacity)
        seq[full] = np.arange(len(full))
        for b, items in enumerate(bins, len(full)):
            items = part[items]
            seq[items] = b
            offset[items] = np.cumsum(sizes[items]) - sizes[items]
        seq += TaskContext.get().partitionId() << 32
        yield from pa.Table.from_arrays([*table.columns, pa.array(seq), pa.array(offset)], names=names).combine_chunks().to_batches()

    return pieces.repartition(shards).mapInArrow(tidy("packing", run), f"{PIECES}, sequence_id long, offset long")


def op2_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack_pieces(cut(spark.read.parquet(f"{sf_dir}/documents.parquet")))
