"""Whole comparisons, from reads or sketches to matrices, and their command line."""

from __future__ import annotations

import argparse
import logging
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import __version__
from ..functions import kmers as K
from ..operators import counting, kernels, matrix, population, stats
from ..sources import sequences, sketch_file, sketch_table, weights

log = logging.getLogger(__name__)


def kernel_of(counts: DataFrame, tabs: int, weighted: bool = True, given: DataFrame | None = None) -> DataFrame:
    return kernels.pairwise_kernel(counts, tabs, "entropy" if weighted else "unweighted", given)


def compare_reads(reads: DataFrame, k: int, sizes: list[int], weighted: bool = True) -> tuple[DataFrame, DataFrame]:
    """(kernel, distance) of the samples of reads."""
    counts = counting.sketch(counting.explode_kmers(reads, k), sizes)
    kernel = kernel_of(counts, len(sizes), weighted)
    return kernel, kernels.distance(kernel)


def _sketches(spark: SparkSession, files: list[str], least: int = 2) -> tuple[DataFrame, list[int]]:
    """Counts and table sizes of sketch files and of folders that `sketch` wrote."""
    folders = [f for f in files if sketch_table.is_table(spark, f)]
    parts = [sketch_table.read(spark, f) if f in folders else sketch_file.read_sketches(spark, f) for f in files]
    counts, described = parts[0]
    for c, d in parts[1:]:
        counts, described = counts.unionByName(c), described.unionByName(d)
    if (described.count() if folders else len(files)) < least:
        raise SystemExit(f"at least {least} samples are needed")
    counting.check_compatible(described)
    return counts, list(described.first()["tablesizes"])


def _write(text: str, to: str | None) -> None:
    if to in (None, "-"):
        sys.stdout.write(text)
    else:
        with open(to, "w") as f:
            f.write(text)


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """dist: kernel and distance of sketches (-U unweighted, -w given weights, -C only calculate these); weights: entropy weights to
    a file; stats; cap: a sketch with counts held at 1..255; sketch: reads to a folder that the others read, -b with a sketch
    file a sample in it, -B with counts above 255."""
    p = argparse.ArgumentParser(prog="strandlake")
    p.add_argument("-V", "--version", action="version", version=f"%(prog)s {__version__}")
    sub = p.add_subparsers(dest="do", required=True)
    d = sub.add_parser("dist")
    d.add_argument("-U", "--unweighted", action="store_true")
    d.add_argument("-w", "--weights")
    d.add_argument("-C", "--calc-weights", action="store_true")
    d.add_argument("-k", "--kernel")
    d.add_argument("-d", "--distance", default="-")
    w = sub.add_parser("weights")
    w.add_argument("-w", "--weights", required=True)
    s = sub.add_parser("stats")
    s.add_argument("-o", "--output", default="-")
    c = sub.add_parser("cap")
    c.add_argument("-c", "--cap", type=int, required=True)
    k = sub.add_parser("sketch")
    k.add_argument("-k", "--ksize", type=int, required=True)
    k.add_argument("-x", "--sizes", type=int, nargs="+", required=True)
    k.add_argument("-o", "--output", required=True)
    k.add_argument("-b", "--binary", action="store_true")
    k.add_argument("-B", "--bigcount", action="store_true")
    for q in (d, w, s, c, k):
        q.add_argument("-t", "--threads", type=int, help="local threads of a session that is started here")
        q.add_argument("-v", "--verbose", action="store_true")
        q.add_argument("-q", "--quiet", action="store_true")
        q.add_argument("files", nargs="+")
    a = p.parse_args(args)
    logging.getLogger("strandlake").setLevel(logging.ERROR if a.quiet else logging.INFO if a.verbose else logging.WARNING)
    if a.do == "dist" and a.calc_weights:
        if not a.weights:
            raise SystemExit("-C needs -w")
        a.do = "weights"
    from ..session import session

    spark = spark or (session(spark__master=f"local[{a.threads}]") if a.threads else session())
    if a.do == "sketch":
        reads = sequences.read_sequences(spark, a.files)
        kmers = counting.explode_kmers(reads, a.ksize)
        big = counting.big_counts(kmers, a.sizes, ["read_idx", "pos"]) if a.bigcount else None
        counts, _ = sketch_table.write(counting.sketch(kmers, a.sizes), a.ksize, a.sizes, a.output, big, reads.select("sample").distinct())
        if a.binary:
            for r in sketch_file.sketch_bytes(counts, a.ksize, a.sizes, True, None if big is None else sketch_table.read_big(spark, a.output)).toLocalIterator():
                with open(f"{a.output}/{r['sample']}.ct.gz", "wb") as f:
                    f.write(r["content"])
        log.info("sketches are in %s", a.output)
        return 0
    if a.do == "cap":
        if len(a.files) != 1 or not 1 <= a.cap <= 255:
            raise SystemExit("one file and a cap of 1..255")
        with open(a.files[0], "rb") as f:
            got = sketch_file.decode_counts(f.read())
        with open(a.files[0] + ".capped.gz", "wb") as f:
            f.write(sketch_file.encode_counts(got["k"], [t.clip(max=a.cap) for t in got["tables"]], got["bigcounts"], got["use_bigcount"], True))
        return 0
    counts, sizes = _sketches(spark, a.files)
    if a.do == "stats":
        counts = counts.withColumn("sample", K.stats_name(F.col("sample")))
    counts = counts.persist()
    log.info("%s samples, tables of %s bins", len(a.files), sizes)
    names = kernels.sample_ids(counts)
    if a.do == "weights":
        rows = weights.weights_to_text(population.entropy_weights(counts, len(names)), sizes[0]).orderBy("line")
        _write("\n".join(r["value"] for r in rows.toLocalIterator()) + "\n", a.weights)
    elif a.do == "stats":
        rows = stats.sample_stats(counts, sizes, len(names)).orderBy("sample").collect()
        _write("".join(["Sample\tSampleSum\tWeightedSampleSum\tEntropy\n", *(f"{r[0]}\t{r[1]}\t{r[2]:g}\t{r[3]:g}\n" for r in rows)]), a.output)
    else:
        given = weights.weights_from_text(spark, a.weights) if a.weights else None
        kernel = kernel_of(counts, len(sizes), not a.unweighted, given).persist()
        labels, m = matrix.dense(kernel)
        if not matrix.is_positive_semidefinite(m):
            log.warning("the kernel matrix is not positive semi-definite")
        if a.kernel:
            _write(matrix.to_text(labels, m), a.kernel)
        _write(matrix.to_text(*matrix.dense(kernels.distance(kernel))), a.distance)
    return 0


if __name__ == "__main__":
    sys.exit(main())
