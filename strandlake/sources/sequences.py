"""Reads from FASTA and FASTQ files (plain, gzip or bzip2 by extension), pairs of reads, and reads back to text.

Reads: (sample, read_idx, name, sequence, quality). FASTA is split by Spark between records. FASTQ records cannot be told apart from
any place in a file, but by the number of lines before it: files with four lines a record are split too, others are one task each."""

from __future__ import annotations

import bz2
import gzip

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidRead, InvalidReadPair
from ..functions import kmers as K
from ..operators.order import numbered
from ..session import written

READS = "sample string, read_idx long, name string, sequence string, quality string"


def read_fasta(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Records start with > at the start of a line; the rest of that line is the name. read_idx rises in file order."""
    raw = spark.read.option("lineSep", "\n>").text(path).select("value", K.sample_name(F.col("_metadata.file_path")).alias("sample"), F.monotonically_increasing_id().alias("read_idx"))
    text = F.regexp_replace("value", "^>", "")
    name = F.regexp_replace(F.substring_index(text, "\n", 1), "\r$", "")
    body = F.when(F.instr(text, "\n") > 0, F.regexp_replace(F.expr("substring(regexp_replace(value, '^>', ''), instr(regexp_replace(value, '^>', ''), '\n') + 1)"), r"\s", "")).otherwise("")
    rows = raw.where(F.trim("value") != "").select("sample", "read_idx", name.alias("name"), body.alias("sequence"), F.lit(None).cast("string").alias("quality"))
    checked = F.when(F.length("sequence") == 0, F.raise_error(F.concat(F.lit("empty sequence: "), "name")).cast("string")).otherwise(F.col("sequence"))
    return rows.withColumn("sequence", checked)


def parse_fastq(text: str):
    """(name, sequence, quality) of every record; sequences and qualities may wrap."""
    lines = iter(text.splitlines())
    for line in lines:
        if not line.strip():
            continue
        if not line.startswith("@"):
            raise InvalidRead(f"expected @, found {line[:40]!r}")
        name, seq = line[1:], []
        for line in lines:
            if line.startswith("+"):
                break
            seq.append("".join(line.split()))
        else:
            raise InvalidRead(f"{name}: no quality")
        if line[1:] not in ("", name):
            raise InvalidRead(f"{name}: the + line names another read")
        sequence, quality = "".join(seq), ""
        while len(quality) < len(sequence):
            more = next(lines, None)
            if more is None:
                break
            quality += "".join(more.split())
        if not sequence:
            raise InvalidRead(f"{name}: empty sequence")
        if len(quality) != len(sequence):
            raise InvalidRead(f"{name}: {len(sequence)} bases, {len(quality)} qualities")
        yield name, sequence, quality


def unpacked(data: bytes) -> bytes:
    """By the first bytes: gzip, bzip2 or plain."""
    return gzip.decompress(data) if data[:3] == b"\x1f\x8b\x08" else bz2.decompress(data) if data[:3] == b"BZh" else data


def _splits(spark: SparkSession, path) -> DataFrame:
    """(file, block, value): the lines of text files, in order within the splits that Spark cuts files into; block is where a split starts."""
    where = [F.col(f"_metadata.{c}").alias(n) for c, n in (("file_path", "file"), ("file_block_start", "block"))]
    return spark.read.text(path).select(*where, "value")


def _filled(columns):
    """(file, block, line) of the lines that are not blank."""
    for file, block, line in columns:
        if line.strip():
            yield file, block, line


def _rows(b: pa.RecordBatch):
    return _filled(zip(b.column("file").to_pylist(), b.column("block").to_pylist(), b.column("value").to_pylist(), strict=True))


def fits(lines: list[str], at: int) -> bool:
    """Whether up to four lines may be the lines at, at + 1, ... of records of four lines each."""
    n = (at + len(lines) - 1) % 4
    last = lines[-1]
    if n == 0:
        return last.startswith("@")
    if n == 2:
        return last.startswith("+")
    return n != 3 or len(lines) < 3 or len(last.strip()) == len(lines[-3].strip())


def split_lines(lines: DataFrame) -> DataFrame:
    """(file, block, n, first, plain) of every split: its number of lines, the first one's first letter, and for each of the four places in a record
    that its first line may have, whether its lines are then those of records of four lines."""

    def run(batches):
        now, n, first, plain, tail = None, 0, "", [True] * 4, []

        def out():
            return pa.RecordBatch.from_arrays([pa.array([now[0]]), pa.array([now[1]], pa.int64()), pa.array([n], pa.int64()), pa.array([first]), pa.array([plain], pa.list_(pa.bool_()))], names=["file", "block", "n", "first", "plain"])

        for b in batches:
            for file, block, line in _rows(b):
                if (file, block) != now:
                    if now is not None:
                        yield out()
                    now, n, first, plain, tail = (file, block), 0, line.lstrip()[0], [True] * 4, []
                tail = [*tail[-2:], line]
                plain = [ok and fits(tail, (p + n + 1 - len(tail)) % 4) for p, ok in enumerate(plain)]
                n += 1
        if now is not None:
            yield out()

    return lines.mapInArrow(run, "file string, block long, n long, first string, plain array<boolean>")


def _four_line_records(lines: DataFrame, places: DataFrame) -> DataFrame:
    """(file, record, name, sequence, plus, quality): records within a split are put together where they are read, the few lines of
    records that two splits share are shuffled. places: (file, block, before), the lines of a file before each split."""

    def run(batches):
        now, at, held = None, 0, []

        def batch(rows):
            kinds = (pa.string(), pa.int64(), pa.int32(), *([pa.string()] * 4))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["file", "record", "whole", "name", "sequence", "plus", "quality"])

        def loose(file, last, lines):
            """Lines of a record that is not whole here; last: the place of the last of them."""
            for i, line in enumerate(lines):
                place = last - len(lines) + 1 + i
                yield (file, place // 4, 0, *(line if place % 4 == c else None for c in range(4)))

        for b in batches:
            rows = []
            for (file, block, line), before in zip(_rows(b), _before(b), strict=True):
                if (file, block) != now:
                    if held:
                        rows += loose(now[0], at - 1, held)
                    now, at, held = (file, block), before, []
                held.append(line)
                if at % 4 == 3:
                    rows += [(file, at // 4, 1, *held)] if len(held) == 4 else loose(file, at, held)
                    held = []
                at += 1
            if rows:
                yield batch(rows)
        if held:
            yield batch(list(loose(now[0], at - 1, held)))

    def _before(b):
        return (n for n, line in zip(b.column("before").to_pylist(), b.column("value").to_pylist(), strict=True) if line.strip())

    # a row a split, some 100 bytes: broadcast, since a shuffle would lose the order of lines
    told = lines.join(F.broadcast(places), ["file", "block"])
    names = ["name", "sequence", "plus", "quality"]
    rows = told.mapInArrow(run, "file string, record long, whole int, " + ", ".join(f"{c} string" for c in names))
    shared = rows.where("whole = 0").groupBy("file", "record").agg(*(F.max(c).alias(c) for c in names))
    return rows.where("whole = 1").select("file", "record", *names).unionByName(shared)


def _whole_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """FASTQ files whose records wrap, or are packed without saying so in their name: a file is parsed by one task."""

    def run(batches):
        for b in batches:
            for sample, data in zip(b.column("sample").to_pylist(), b.column("content"), strict=True):
                rows = [(sample, i, *r) for i, r in enumerate(parse_fastq(unpacked(data.as_py()).decode()))]
                if not rows:
                    raise InvalidRead(f"{sample}: no reads")
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["sample", "read_idx", "name", "sequence", "quality"])

    files = spark.read.format("binaryFile").load(paths)
    return files.select(K.sample_name(F.col("path")).alias("sample"), "content").mapInArrow(run, READS)


def _described(spark: SparkSession, path) -> tuple[DataFrame, DataFrame]:
    """The lines of files, and a written row a split with the number of the file's lines before it."""
    from pyspark.sql import Window

    lines = _splits(spark, path)
    w = Window.partitionBy("file").orderBy("block")  # a row a split
    sized = split_lines(lines).withColumn("before", F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return lines, written(sized.withColumn("head", F.first("first").over(w)))


def _names(files: DataFrame) -> list[str]:
    return [r["file"] for r in files.select("file").distinct().orderBy("file").collect()]


def read_fastq(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Records of four lines are read by as many tasks as Spark cuts splits (of files that are not packed, or packed by bzip2): a first pass
    counts the lines of each split and sees at which places they fit records, a second one puts records together. Files whose
    records wrap, or which do not fit, are parsed by one task each, which says what is wrong with them. read_idx counts a file's records."""
    empty = spark.read.format("binaryFile").load(path).where("length = 0").select("path").first()
    if empty:
        raise InvalidRead(f"{empty['path']}: no reads")
    lines, splits = _described(spark, path)
    sound = F.get("plain", (F.col("before") % 4).cast("int"))
    files = splits.groupBy("file").agg(F.bool_and(sound).alias("sound"), (F.sum("n") % 4 == 0).alias("even"))
    odd = _names(files.where("NOT (sound AND even)"))
    if not odd and files.isEmpty():
        raise InvalidRead(f"{path}: no reads")
    good = files.where("sound AND even").select("file")
    places = splits.join(good, "file", "left_semi").select("file", "block", "before")
    found = _four_line_records(lines, places)
    name, sequence, quality = F.substring("name", 2, 1 << 30), F.regexp_replace("sequence", r"\s", ""), F.regexp_replace("quality", r"\s", "")
    wrong = (
        F.when(~F.col("name").startswith("@") | ~F.col("plus").startswith("+"), "no record")
        .when(~F.substring("plus", 2, 1 << 30).isin(F.lit(""), name), "the + line names another read")
        .when(F.length(sequence) != F.length(quality), "as many bases as qualities are needed")
        .when(F.length(sequence) == 0, "empty sequence")
    )
    checked = F.when(F.coalesce(wrong, F.lit("")) != "", F.raise_error(F.concat(F.coalesce("name", F.lit("?")), F.lit(": "), wrong)).cast("string")).otherwise(sequence)
    out = found.select(K.sample_name(F.col("file")).alias("sample"), F.col("record").alias("read_idx"), name.alias("name"), checked.alias("sequence"), quality.alias("quality"))
    if odd:
        rest = _whole_files(spark, odd)
        return rest if len(odd) == files.count() else out.unionByName(rest)
    return out


def read_sequences(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Every file by its first letter, @ for FASTQ and > for FASTA: a folder may hold both."""
    _, splits = _described(spark, path)
    heads = splits.where("before = 0").select("file", "head")
    if heads.isEmpty():
        raise InvalidRead(f"{path}: empty")
    packed = heads.where(~F.col("head").isin("@", ">"))
    wrong = packed.first()
    if wrong:
        raise InvalidRead(f"{wrong['file']}: neither FASTA nor FASTQ")
    fastq, fasta = (_names(heads.where(F.col("head") == c)) for c in "@>")
    if not fasta:
        return read_fastq(spark, fastq)
    return read_fasta(spark, fasta).unionByName(read_fastq(spark, fastq)) if fastq else read_fasta(spark, fasta)


def pairs(reads: DataFrame, mode: str = "error") -> DataFrame:
    """(sample, first, second) of pairs of reads that follow each other in a sample.

    'error': reads 2i and 2i + 1 are a pair or an error is raised. 'ignore': reads are taken in turn; one that is not marked as a first read is passed
    over; one that is takes the next read as its second, which is used up by that, and both are left out where they are no pair. So of a run of reads marked as
    first ones every other takes its follower."""
    if mode not in ("error", "ignore"):
        raise ValueError(f"unknown pair mode {mode!r}")
    r = F.struct("name", "sequence", "quality")
    rows = numbered(reads.select("sample", "read_idx", r.alias("r")), ["sample", "read_idx"])
    follower = rows.select((F.col("read_no") - 1).alias("read_no"), F.col("sample").alias("own"), F.col("r").alias("second"))
    both = rows.join(follower, "read_no", "left").withColumn("second", F.when(F.col("own") == F.col("sample"), F.col("second")))
    ok = F.coalesce(K.valid_pair(F.col("r.name"), F.col("second.name")), F.lit(False))
    if mode == "error":
        begin = rows.groupBy("sample").agg(F.min("read_no").alias("begin"))
        told = F.when(ok, F.col("second")).otherwise(F.raise_error(F.concat(F.lit("no pair: "), F.col("r.name"))).cast(both.schema["second"].dataType))
        return both.join(begin, "sample").where((F.col("read_no") - F.col("begin")) % 2 == 0).select("sample", F.col("r").alias("first"), told.alias("second"))
    stops = _last_stop(rows.select("sample", "read_no", K.first_of_pair(F.col("r.name")).alias("marked")))
    turn = stops.where("marked AND (read_no - stop) % 2 = 1").select("read_no")
    return both.join(turn, "read_no", "left_semi").where(ok).select("sample", F.col("r").alias("first"), "second")


def _last_stop(rows: DataFrame, chunk: int = 1_000_000) -> DataFrame:
    """rows (sample, read_no, marked) with stop: the number of the last read of the sample up to it that is not marked, or the one before the sample's first.
    The last one of each chunk of reads is found first, so that a window spans a chunk's reads or a sample's chunks."""
    from pyspark.sql import Window

    own = rows.withColumn("chunk", F.floor(F.col("read_no") / chunk)).withColumn("own", F.when(~F.col("marked"), F.col("read_no")))
    ends = own.groupBy("sample", "chunk").agg(F.max("own").alias("last"), F.min("read_no").alias("begin"))
    over = Window.partitionBy("sample").orderBy("chunk")
    first = F.first("begin").over(over) - 1
    ends = ends.select("sample", "chunk", F.coalesce(F.max("last").over(over.rowsBetween(Window.unboundedPreceding, -1)), first).alias("earlier"))
    here = F.max("own").over(Window.partitionBy("sample", "chunk").orderBy("read_no"))
    return own.withColumn("here", here).join(ends, ["sample", "chunk"]).select("sample", "read_no", "marked", F.coalesce("here", "earlier").alias("stop"))


def as_text(reads: DataFrame) -> DataFrame:
    """One column value: FASTQ where there is a quality, else FASTA."""
    fastq = F.concat_ws("\n", F.concat(F.lit("@"), "name"), "sequence", F.lit("+"), "quality")
    return reads.select(F.when(F.coalesce(F.length("quality"), F.lit(0)) > 0, fastq).otherwise(F.concat_ws("\n", F.concat(F.lit(">"), "name"), "sequence")).alias("value"))


__all__ = ["InvalidReadPair", "as_text", "pairs", "parse_fastq", "read_fasta", "read_fastq", "read_sequences"]
