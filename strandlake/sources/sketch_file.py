"""Binary sketch files, read and written as sparse frames. All numbers are little-endian.

Count sketches: "OXLI", u8 version 4, u8 type 1, u8 big counts, u32 k, u8 tables, u64 occupied; for each table u64 size and a
byte a bin; then u64 entries of (u64 k-mer, u16 count). Presence sketches: type 2, without the big-count byte and entries,
and a bit a bin. Tag sets: types 3 (tags) and 4 (stop tags). Partition maps and labels: types 5 and 6, u32 k, u64 entries of (u64 k-mer,
u32 partition) or (u64 k-mer, u64 label)."""

from __future__ import annotations

import gzip
import struct
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import FileFormatError
from ..functions import kmers as K
from .sequences import unpacked

#: Fixed values of the format.
SIGNATURE, VERSION, COUNTS, PRESENCE, TAGS, STOP_TAGS, PARTITIONS, LABELS = b"OXLI", 4, 1, 2, 3, 4, 5, 6


def _head(data: bytes, kind: int) -> int:
    if data[:4] != SIGNATURE:
        raise FileFormatError("no sketch file")
    if data[4] != VERSION:
        raise FileFormatError(f"version {data[4]}, not {VERSION}")
    if data[5] != kind:
        raise FileFormatError(f"type {data[5]}, not {kind}")
    return 6


def decode_counts(data: bytes) -> dict:
    data = unpacked(data)
    at = _head(data, COUNTS)
    try:
        big, k, tabs, used = struct.unpack_from("<BIBQ", data, at)
        at += 14
        tables = []
        for _ in range(tabs):
            (size,) = struct.unpack_from("<Q", data, at)
            tables.append(np.frombuffer(data, np.uint8, size, at + 8))
            at += 8 + size
        (n,) = struct.unpack_from("<Q", data, at)
        bigs = [struct.unpack_from("<QH", data, at + 8 + 10 * i) for i in range(n)]
    except (struct.error, ValueError) as e:
        raise FileFormatError("cut off") from e
    return {"k": k, "use_bigcount": bool(big), "occupied": used, "tables": tables, "bigcounts": bigs}


def encode_counts(k: int, tables: list[np.ndarray], bigcounts=(), use_bigcount: bool = False, compress: bool = False) -> bytes:
    used = int(np.count_nonzero(tables[0])) if tables else 0
    out = [SIGNATURE, struct.pack("<BBBIBQ", VERSION, COUNTS, use_bigcount, k, len(tables), used)]
    for t in tables:
        out += [struct.pack("<Q", len(t)), np.asarray(t, np.uint8).tobytes()]
    out.append(struct.pack("<Q", len(bigcounts)))
    out += [struct.pack("<QH", a, c) for a, c in bigcounts]
    data = b"".join(out)
    return gzip.compress(data) if compress else data


def decode_presence(data: bytes) -> dict:
    data = unpacked(data)
    k, tabs, used = struct.unpack_from("<IBQ", data, _head(data, PRESENCE))
    at, tables = 19, []
    for _ in range(tabs):
        (size,) = struct.unpack_from("<Q", data, at)
        raw = np.frombuffer(data, np.uint8, size // 8 + 1, at + 8)
        tables.append(np.flatnonzero(np.unpackbits(raw, bitorder="little")[:size]))
        at += 8 + size // 8 + 1
    return {"k": k, "occupied": used, "bins": tables}


def encode_presence(k: int, sizes: list[int], bins: list[np.ndarray]) -> bytes:
    tables = []
    for size, own in zip(sizes, bins, strict=True):
        bits = np.zeros((size // 8 + 1) * 8, np.uint8)
        bits[np.asarray(own, np.int64)] = 1
        tables.append(np.packbits(bits, bitorder="little"))
    return encode_presence_bits(k, sizes, tables)


def encode_presence_bits(k: int, sizes: list[int], tables: list[np.ndarray]) -> bytes:
    """The same from tables whose bits are packed, the lowest first, in size // 8 + 1 bytes each."""
    used = int(np.bitwise_count(tables[0]).sum()) if tables else 0
    out = [SIGNATURE, struct.pack("<BBIBQ", VERSION, PRESENCE, k, len(sizes), used)]
    for size, own in zip(sizes, tables, strict=True):
        out += [struct.pack("<Q", size), own.tobytes()]
    return b"".join(out)


def encode_tags(k: int, tags, density: int, stop: bool = False) -> bytes:
    tags = np.sort(np.fromiter(tags, "<u8"))
    return SIGNATURE + struct.pack("<BBIQI", VERSION, STOP_TAGS if stop else TAGS, k, len(tags), density) + tags.tobytes()


def decode_tags(data: bytes, stop: bool = False) -> tuple[int, int, list[int]]:
    """(k, density, tags)."""
    k, n, density = struct.unpack_from("<IQI", data, _head(data, STOP_TAGS if stop else TAGS))
    return k, density, np.frombuffer(data, "<u8", n, 22).tolist()


#: Names and layout of the entries of a partition map and of labels.
ENTRIES = {PARTITIONS: np.dtype([("kmer", "<u8"), ("partition_id", "<u4")]), LABELS: np.dtype([("kmer", "<u8"), ("label", "<u8")])}


def encode_entries(kind: int, k: int, entries) -> bytes:
    """A file of PARTITIONS or LABELS from (k-mer, value) pairs, or an array of ENTRIES, in ascending order."""
    rows = np.unique(np.asarray(entries if isinstance(entries, np.ndarray) else list(entries), ENTRIES[kind]))
    return SIGNATURE + struct.pack("<BBIQ", VERSION, kind, k, len(rows)) + rows.tobytes()


def decode_entries(data: bytes, kind: int) -> tuple[int, list[tuple[int, int]]]:
    """(k, pairs); a file that holds fewer or more entries than it announces is an error."""
    data = unpacked(data)
    at = _head(data, kind)
    if len(data) < at + 12:
        raise FileFormatError("cut off")
    k, n = struct.unpack_from("<IQ", data, at)
    if len(data) != at + 12 + n * ENTRIES[kind].itemsize:
        raise FileFormatError(f"{n} entries were announced")
    return k, np.frombuffer(data, ENTRIES[kind], n, at + 12).tolist()


def read_entries(spark: SparkSession, path: str, kind: int) -> DataFrame:
    """(file, kmer, partition_id or label) of all files of a path."""
    value = ENTRIES[kind].names[1]
    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")

    def rows(frames):
        for f in frames:
            for name, data in zip(f["file"], f["content"], strict=True):
                _, pairs = decode_entries(data, kind)
                for a in range(0, len(pairs), 1 << 16):
                    part = pairs[a : a + (1 << 16)]
                    yield pd.DataFrame({"file": name, "kmer": [Decimal(x) for x, _ in part], value: [Decimal(y) for _, y in part]})

    return files.mapInPandas(rows, f"file string, kmer decimal(20,0), {value} decimal(20,0)")


def read_sketches(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(counts, samples) of all sketch files of a path: bins are emitted where a file is read."""
    files = spark.read.format("binaryFile").load(path).select(K.sample_name(F.col("path")).alias("sample"), "content")

    def bins(frames):
        for f in frames:
            for sample, data in zip(f["sample"], f["content"], strict=True):
                for tab, t in enumerate(decode_counts(data)["tables"]):
                    at = np.flatnonzero(t)
                    for a in range(0, len(at), 1 << 16):
                        part = at[a : a + (1 << 16)]
                        yield pd.DataFrame({"sample": sample, "tab": tab, "bin": part, "count": t[part].astype("int16")})

    def heads(frames):
        for f in frames:
            rows = [(s, (d := decode_counts(c))["k"], [len(t) for t in d["tables"]], d["use_bigcount"], d["occupied"]) for s, c in zip(f["sample"], f["content"], strict=True)]
            yield pd.DataFrame(rows, columns=["sample", "ksize", "tablesizes", "use_bigcount", "occupied"])

    counts = files.mapInPandas(bins, "sample string, tab int, bin long, count smallint")
    return counts, files.mapInPandas(heads, "sample string, ksize int, tablesizes array<long>, use_bigcount boolean, occupied long")


def read_big_counts(spark: SparkSession, path: str) -> DataFrame:
    """(sample, kmer, count) above 255 of all sketch files of a path."""
    files = spark.read.format("binaryFile").load(path).select(K.sample_name(F.col("path")).alias("sample"), "content")

    def bigs(frames):
        for f in frames:
            for sample, data in zip(f["sample"], f["content"], strict=True):
                rows = [(sample, Decimal(kmer), n) for kmer, n in decode_counts(data)["bigcounts"]]
                yield pd.DataFrame(rows, columns=["sample", "kmer", "count"])

    return files.mapInPandas(bigs, "sample string, kmer decimal(20,0), count int")


def sketch_bytes(counts: DataFrame, k: int, sizes: list[int], compress: bool = False, big: DataFrame | None = None) -> DataFrame:
    """(sample, content): one dense file a sample, as the format asks for; with the big counts (sample, kmer, count) if given."""
    use_bigcount = big is not None

    def content(pdf: pd.DataFrame, bigs=()) -> bytes:
        tables = [np.zeros(s, np.uint8) for s in sizes]
        for tab, g in pdf.groupby("tab"):
            tables[int(tab)][g["bin"].to_numpy()] = g["count"].to_numpy()
        return encode_counts(k, tables, sorted(bigs), use_bigcount, compress)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"sample": [pdf["sample"].iloc[0]], "content": [content(pdf)]})

    def both(pdf: pd.DataFrame, more: pd.DataFrame) -> pd.DataFrame:
        name = (pdf if len(pdf) else more)["sample"].iloc[0]
        return pd.DataFrame({"sample": [name], "content": [content(pdf, [(int(a), int(c)) for a, c in zip(more["kmer"], more["count"], strict=True)])]})

    if big is None:
        return counts.groupBy("sample").applyInPandas(one, "sample string, content binary")
    return counts.groupBy("sample").cogroup(big.groupBy("sample")).applyInPandas(both, "sample string, content binary")
