"""Token ids as patched frame-of-reference segments, written as a table of binary segments and read back.

Segment layout (little-endian): "PFR1", u32 values, u32 blocks, u32 exceptions; then per block u32 minimum, u32 start of
its packed bits, u8 width, u8 exceptions; then u8 place and u32 excess of every exception; then the packed bits.
A block has 128 values less their minimum, packed at the width that holds 90 % of them; the others are exceptions.
The last block is filled up with its minimum.

Defined cases: null text encodes as empty (the end id alone); rows follow ascending (doc_id, hash of text, text), null
ids first; repeated rows are kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_table, ship, texts
from .tokens import END, encoder

BLOCK, SHARE, HEAD = 128, 0.90, struct.Struct("<4sIII")
SEGMENT_TOKENS = 1 << 18


def pack(values: np.ndarray) -> bytes:
    n = len(values)
    m = -(-n // BLOCK)
    v = np.zeros((m, BLOCK), np.uint32)
    v.reshape(-1)[:n] = values
    if n % BLOCK:
        v[-1, n % BLOCK :] = v[-1, : n % BLOCK].min()
    low = v.min(axis=1) if m else np.zeros(0, np.uint32)
    v -= low[:, None]
    edge = np.sort(v, axis=1)[:, int(np.ceil(BLOCK * SHARE)) - 1] if m else low
    width = np.ceil(np.log2(edge.astype(np.float64) + 1)).astype(np.uint8)
    row, place = np.nonzero(v >> np.minimum(width, 31)[:, None].astype(np.uint32) * (width < 32)[:, None])
    out = width[row] < 32
    row, place = row[out], place[out]
    start = np.concatenate([[0], np.cumsum(width.astype(np.int64) * (BLOCK // 8))])
    body = np.zeros(int(start[-1]), np.uint8)
    for w in np.unique(width):
        if w:
            at = np.flatnonzero(width == w)
            kind = np.uint16 if w <= 16 else np.uint32
            bits = np.unpackbits(v[at].astype(kind).view(np.uint8), bitorder="little").reshape(len(at), BLOCK, -1)[:, :, :w]
            body[start[at][:, None] + np.arange(int(w) * BLOCK // 8)] = np.packbits(bits.reshape(len(at), -1), axis=1, bitorder="little")
    return b"".join([
        HEAD.pack(b"PFR1", n, m, len(row)), low.astype("<u4").tobytes(), start[:-1].astype("<u4").tobytes(), width.tobytes(),
        np.bincount(row, minlength=m).astype(np.uint8).tobytes(), place.astype(np.uint8).tobytes(), v[row, place].astype("<u4").tobytes(), body.tobytes(),
    ])


def unpack(data: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """The values of blocks first..last (all by default); only their bits are read."""
    magic, n, m, e = HEAD.unpack_from(data)
    if magic != b"PFR1":
        raise ValueError("not a PFR1 segment")
    at = HEAD.size

    def part(kind, count):
        nonlocal at
        x = np.frombuffer(data, kind, count, at)
        at += x.nbytes
        return x

    low, start, width, many = part("<u4", m), part("<u4", m), part(np.uint8, m), part(np.uint8, m)
    place, excess = part(np.uint8, e), part("<u4", e)
    body = np.frombuffer(data, np.uint8, -1, at)
    last = m if last is None else min(last, m)
    v = np.zeros((last - first, BLOCK), np.uint32)
    for w in np.unique(width[first:last]):
        if w:
            b = np.flatnonzero(width[first:last] == w)
            raw = body[start[first + b].astype(np.int64)[:, None] + np.arange(int(w) * BLOCK // 8)]
            size = 16 if w <= 16 else 32
            bits = np.zeros((len(b), BLOCK, size), np.uint8)
            bits[:, :, :w] = np.unpackbits(raw, axis=1, bitorder="little").reshape(len(b), BLOCK, w)
            v[b] = np.packbits(bits.reshape(len(b), -1), axis=1, bitorder="little").view(f"<u{size // 8}").reshape(len(b), BLOCK)
    owner = np.repeat(np.arange(m), many)
    mine = (owner >= first) & (owner < last)
    v[owner[mine] - first, place[mine]] = excess[mine]
    v += low[first:last, None]
    return v.reshape(-1)[: max(0, n - first * BLOCK)]


SEGMENTS = "part int, seg int, part_start long, n_tokens long, doc_ids array<long>, lengths array<long>, data binary"


def write_segments(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Encode docs in ascending doc_id order into a written table of segments (a document is never split)."""
    ship(docs.sparkSession)
    schema = pa.schema([("part", pa.int32()), ("seg", pa.int32()), ("part_start", pa.int64()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("data", pa.binary())])

    def run(batches):
        from pyspark import TaskContext

        enc, part = encoder("byte", vocabulary), TaskContext.get().partitionId()
        seg, begun, size, ids, chunks = 0, 0, 0, [], []

        def flush():
            nonlocal seg, begun, size, ids, chunks
            lengths = [len(c) // 4 for c in chunks]
            data = pack(np.frombuffer(b"".join(chunks), "<u4"))
            row = pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((part, seg, begun, size, ids, lengths, data), schema, strict=True)], schema=schema)
            seg, begun, size, ids, chunks = seg + 1, begun + size, 0, [], []
            return row

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                chunks.append(enc.encode(text.as_py()) + END)
                ids.append(doc_id)
                size += len(chunks[-1]) // 4
                if size >= SEGMENT_TOKENS:
                    yield flush()
        if ids:
            yield flush()

    order = ["doc_id", "h", "text"]
    dealt = texts(docs).withColumn("h", F.xxhash64("text")).repartitionByRange("doc_id", "h").sortWithinPartitions(*order)
    return shared_table(dealt.select("doc_id", "text").mapInArrow(run, SEGMENTS))


def read_segments(segments: DataFrame) -> DataFrame:
    """Per document: doc_id, start, n_tokens, ids (little-endian unsigned 32-bit)."""
    spark = segments.sparkSession
    ship(spark)
    begun, starts = 0, []
    for r in segments.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect():  # a row per written partition
        starts.append((r["part"], begun))
        begun += r["n"]
    at = F.broadcast(spark.createDataFrame(starts, "part int, base long"))  # as many rows as partitions were written
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                raw = memoryview(unpack(row["data"]).astype("<u4").tobytes())
                ends = np.cumsum(row["lengths"])
                begin = ends - row["lengths"]
                yield pa.RecordBatch.from_arrays([
                    pa.array(row["doc_ids"], pa.int64()), pa.array(begin + row["start"]), pa.array(row["lengths"], pa.int64()),
                    pa.array([bytes(raw[4 * a : 4 * b]) for a, b in zip(begin, ends, strict=True)], pa.binary()),
                ], schema=schema)

    rows = segments.join(at, "part").select((F.col("base") + F.col("part_start")).alias("start"), "doc_ids", "lengths", "data")
    return rows.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def op8_pfor_tokens(spark, sf_dir: str) -> DataFrame:
    back = read_segments(write_segments(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
