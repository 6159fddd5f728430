"""Tags, stop tags, partition maps, labels and presence sketches as folders of binary files, written and read by tasks.

Each file of a folder is whole by itself: its head announces the entries that it holds. Entries are dealt by ranges, so the files
in order of their names hold all entries in ascending order, each once; no task holds more than one file's entries.
A file appears under its name when it is whole, so a task that runs again replaces what it wrote.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sketch_file as S

ENTRIES_A_FILE, BINS_A_BLOCK = 2_000_000, 1 << 19


def _whole_numbers(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Unsigned numbers of a column of long or decimal(20,0)."""
    if pa.types.is_decimal(column.type):
        return np.array([int(x) for x in column.to_pylist()], np.uint64)
    return column.to_numpy(zero_copy_only=False).astype(np.uint64)


def _new_folder(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        raise FileExistsError(path)


def _put(path: str, name: str, data: bytes) -> None:
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    store.create_dir(root, recursive=True)
    held = f"{root}/_{name}-{uuid.uuid4().hex}"
    with store.open_output_stream(held) as f:
        f.write(data)
    store.move(held, f"{root}/{name}")


def _write_sorted(df: DataFrame, path: str, columns: list[str], encode, entries_a_file: int) -> int:
    """Writes the distinct rows of df; encode makes a file of arrays. The number of entries."""
    _new_folder(df.sparkSession, path)
    ranged = df.select(*columns).repartitionByRange(*columns).distinct().sortWithinPartitions(*columns)

    def run(batches):
        from pyspark import TaskContext

        held, n, files, part = [], 0, 0, TaskContext.get().partitionId()

        def out():
            nonlocal held, n, files
            whole = pa.Table.from_batches(held).combine_chunks()
            _put(path, f"part-{part:05d}-{files:05d}", encode(*(_whole_numbers(whole.column(c)) for c in columns)))
            held, n, files = [], 0, files + 1
            return pa.RecordBatch.from_pydict({"n": [whole.num_rows]})

        for b in batches:
            while b.num_rows:
                some = b.slice(0, entries_a_file - n)
                held.append(some)
                b, n = b.slice(some.num_rows), n + some.num_rows
                if n == entries_a_file:
                    yield out()
        if n:
            yield out()

    total = ranged.mapInArrow(run, "n long").agg(F.sum("n")).first()[0]
    if total is None:  # no task had rows: one file that announces none
        _put(path, "part-00000-00000", encode(*(np.zeros(0, np.uint64) for _ in columns)))
    return int(total or 0)


def write_tags(tags: DataFrame, path: str, k: int, density: int, stop: bool = False, entries_a_file: int = ENTRIES_A_FILE) -> int:
    """tags: (kmer). Returns how many were written."""
    return _write_sorted(tags, path, ["kmer"], lambda x: S.encode_tags(k, x, density, stop), entries_a_file)


def write_entries(entries: DataFrame, path: str, kind: int, k: int, entries_a_file: int = ENTRIES_A_FILE) -> int:
    """entries: (kmer, partition_id) for S.PARTITIONS, (kmer, label) for S.LABELS. Returns how many were written."""
    names = list(S.ENTRIES[kind].names)

    def encode(*columns):
        rows = np.empty(len(columns[0]), S.ENTRIES[kind])
        for name, x in zip(names, columns, strict=True):
            if len(x) and int(x.max()) > np.iinfo(S.ENTRIES[kind][name]).max:
                raise ValueError(f"{name} {x.max()} is too large for the format")
            rows[name] = x
        return S.encode_entries(kind, k, rows)

    return _write_sorted(entries, path, names, encode, entries_a_file)


def read_tags(spark: SparkSession, path: str, stop: bool = False) -> DataFrame:
    """(file, ksize, density, kmer) of all files of a path."""
    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")

    def run(batches):
        for b in batches:
            for name, data in zip(b.column("file").to_pylist(), b.column("content").to_pylist(), strict=True):
                k, density, tags = S.decode_tags(data, stop)
                for a in range(0, len(tags), 1 << 16):
                    own = tags[a : a + (1 << 16)]
                    n = len(own)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array([k] * n, pa.int32()), pa.array([density] * n, pa.int32()), pa.array(own, pa.decimal128(20, 0))], names=["file", "ksize", "density", "kmer"])

    return files.mapInArrow(run, "file string, ksize int, density int, kmer decimal(20,0)")


def write_presence(bins: DataFrame, path: str, k: int, sizes: list[int], bins_a_block: int = BINS_A_BLOCK) -> int:
    """bins: (sample, tab, bin), the bins that are set. A file a sample, as the format asks for; returns how many. Blocks of bins
    become bits first, so what meets in a sample's task is the bits of its file, not its rows."""
    _new_folder(bins.sparkSession, path)
    own = bins.select("sample", F.col("tab").cast("int").alias("tab"), F.col("bin").cast("long").alias("bin")).distinct()
    dealt = own.withColumn("block", F.floor(F.col("bin") / bins_a_block).cast("long"))

    def pack(key, rows):
        bits = np.zeros(bins_a_block, np.uint8)
        bits[rows.column("bin").to_numpy() - key[2].as_py() * bins_a_block] = 1
        raw = np.packbits(bits, bitorder="little").tobytes()
        return pa.table({"sample": [key[0].as_py()], "tab": pa.array([key[1].as_py()], pa.int32()), "block": pa.array([key[2].as_py()], pa.int64()), "bits": pa.array([raw], pa.binary())})

    packed = dealt.groupBy("sample", "tab", "block").applyInArrow(pack, "sample string, tab int, block long, bits binary")

    def one(key, rows):
        tables = [np.zeros(s // 8 + 1, np.uint8) for s in sizes]
        for tab, block, bits in zip(rows.column("tab").to_pylist(), rows.column("block").to_pylist(), rows.column("bits"), strict=True):
            at, own = block * bins_a_block // 8, np.frombuffer(bits.as_py(), np.uint8)
            n = min(len(own), len(tables[tab]) - at)
            if own[n:].any():
                raise ValueError(f"a bin of table {tab} is beyond its size {sizes[tab]}")
            tables[tab][at : at + n] = own[:n]
        name = key[0].as_py()
        _put(path, f"{name}.pt", S.encode_presence_bits(k, sizes, tables))
        return pa.table({"n": pa.array([1], pa.int64())})

    return int(packed.groupBy("sample").applyInArrow(one, "n long").agg(F.sum("n")).first()[0] or 0)


def read_presence(spark: SparkSession, path: str) -> DataFrame:
    """(file, ksize, tab, bin) of the bins set in all files of a path."""
    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")

    def run(batches):
        for b in batches:
            for name, data in zip(b.column("file").to_pylist(), b.column("content").to_pylist(), strict=True):
                held = S.decode_presence(data)
                for tab, bins in enumerate(held["bins"]):
                    for a in range(0, len(bins), 1 << 16):
                        own = bins[a : a + (1 << 16)]
                        n = len(own)
                        yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array([held["k"]] * n, pa.int32()), pa.array([tab] * n, pa.int32()), pa.array(own.astype(np.int64))], names=["file", "ksize", "tab", "bin"])

    return files.mapInArrow(run, "file string, ksize int, tab int, bin long")
