"""N-gram Jaccard join by vertical partitioning, down to connected components.

Texts with the same n-gram set are one class. The global n-gram order runs from rare to frequent by a table of document
counts in hash buckets, as many as the input's size asks for up to 2**MOST_BITS (any order is exact; this one keeps common
passages out of prefixes). Two sets that link share an n-gram in
their prefixes; the places of the first shared one and the sizes bound the overlap. Candidates come in two rounds, so that
no group of near copies is expanded into its pairs: first every class meets, for each n-gram of its prefix, only the class
that has it earliest; then, with the components so found, only classes of different components meet. What prefixes hold of both sets bounds the
overlap of a candidate again. The n-gram order is cut into FRAGMENTS fragments of like weight; overlaps are counted fragment by fragment and summed for each pair.

Defined cases: null text and texts without words have an empty set and link with nothing; fewer words than n make one
n-gram; rows that repeat a doc_id are rows of their own; null ids take no part in a smallest doc_id; empty tables give
empty results; other columns are ignored. Words: A-Z lower-cased, ASCII white space.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_tables, few, shared_table, ship, texts, tidy
from .components import components
from .runs import with_heads
from .words import prefix_sums, run_hashes, word_hashes

BLOCK_BITS, MOST_BITS, BYTES_A_BUCKET, FRAGMENTS = 16, 25, 64, 4


def ngrams(text: str, n: int) -> np.ndarray:
    """The sorted distinct hashes of the word n-grams."""
    h = word_hashes(text)
    if not len(h):
        return np.zeros(0, np.uint64)
    m = min(n, len(h))
    return np.unique(run_hashes(prefix_sums(h), np.arange(len(h) - m + 1), m))


def class_of(grams: np.ndarray) -> bytes | None:
    import xxhash

    return xxhash.xxh3_128_digest(grams.tobytes()) if len(grams) else None


def table_bits(docs: DataFrame) -> int:
    """The order table's size: about a bucket for every BYTES_A_BUCKET bytes that Spark expects of docs."""
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return 22 if size > 1 << 60 else min(MOST_BITS, max(BLOCK_BITS, (size // BYTES_A_BUCKET).bit_length()))  # 22: unknown


def describe(docs: DataFrame, n: int, bits: int) -> DataFrame:
    """A row for each document (doc_id, k, n, cls) and, from each task, its blocks of the table of document counts."""
    schema = pa.schema([("doc_id", pa.int64()), ("k", pa.int64()), ("n", pa.int32()), ("cls", pa.binary()), ("block", pa.int32()), ("counts", pa.binary())])

    def run(batches):
        counts = np.zeros(1 << bits, np.uint16)
        for b in batches:
            sizes, classes, buckets = [], [], [np.zeros(0, np.int32)]
            for text in b.column("text"):
                g = ngrams(text.as_py(), n)
                sizes.append(len(g))
                classes.append(class_of(g))
                buckets.append((g >> np.uint64(64 - bits)).astype(np.int32))
            met, times = np.unique(np.concatenate(buckets), return_counts=True)
            counts[met] = np.minimum(counts[met] + times, 65535)  # the order needs only magnitudes
            none = pa.nulls(b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("k"), pa.array(sizes, pa.int32()), pa.array(classes, pa.binary()), none.cast(pa.int32()), none.cast(pa.binary())], schema=schema)
        for block, part in enumerate(counts.reshape(-1, 1 << BLOCK_BITS)):
            if part.any():
                row = (None, None, None, None, block, zlib.compress(part.astype("<u2").tobytes(), 1))
                yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, schema, strict=True)], schema=schema)

    return shared_table(docs.select("doc_id", "k", "text").mapInArrow(tidy("words", run), "doc_id long, k long, n int, cls binary, block int, counts binary"))


def order_table(described: DataFrame, bits: int) -> np.ndarray:
    """For each bucket of n-grams a level that grows with its document count (one byte each: 2**MOST_BITS bytes at most)."""

    def add(key, batches):
        total = np.zeros(1 << BLOCK_BITS, np.int64)
        for b in batches:
            for c in b.column("counts"):
                raw = zlib.decompress(c.as_py())
                total += np.frombuffer(raw, f"<u{len(raw) >> BLOCK_BITS}")
        return total

    def first(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([zlib.compress(np.minimum(add(key, batches), 2**32 - 1).astype("<u4").tobytes(), 1)])], names=["block", "counts"])

    def last(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = np.minimum(255, 8 * np.log2(1.0 + add(key, batches))).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([level.tobytes()], pa.binary())], names=["block", "level"])

    parts = described.where("block is not null").select("block", "counts", F.pmod(F.xxhash64("counts"), F.lit(16)).alias("turn"))
    some = parts.groupBy("block", "turn").applyInArrow(first, "block int, counts binary")
    table = np.zeros((1 << bits - BLOCK_BITS, 1 << BLOCK_BITS), np.uint8)
    for r in some.groupBy("block").applyInArrow(last, "block int, level binary").collect():
        table[r["block"]] = np.frombuffer(r["level"], np.uint8)
    return table.reshape(-1)


def order_key(g: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The place of an n-gram in the global order: its level, then 56 bits of its hash."""
    shift = np.uint64(64 - (len(table).bit_length() - 1))
    return (table[(g >> shift).astype(np.int64)].astype(np.uint64) << np.uint64(56)) | (g << np.uint64(8) >> np.uint64(8))


def fragment_cuts(table: np.ndarray, fragments: int) -> np.ndarray:
    """Places in the global order that part it into fragments of about equal document counts."""
    weight = np.bincount(table, np.maximum(0.0, 2.0 ** (table / 8.0) - 1), minlength=256)
    total = np.concatenate([[0.0], np.cumsum(weight)])
    cuts = []
    for f in range(1, fragments):
        want = total[-1] * f / fragments
        level = min(255, int(np.searchsorted(total, want, side="right")) - 1)
        inside = (want - total[level]) / weight[level] if weight[level] else 0.0
        cuts.append((level << 56) | int(inside * ((1 << 56) - 1)))
    return np.array(cuts, np.uint64)


def _at_least(over: str, a: str, b: str, percent: int):
    """100 * I >= percent * (a + b - I), for an overlap or a bound of one."""
    return F.expr(f"({over}) * {100 + percent}L >= {percent}L * (cast({a} as long) + {b})")


def prefixes(docs: DataFrame, table, n: int, percent: int) -> DataFrame:
    """(cls, n, keys): the places in the global order of every set's prefix, rarest first (as signed numbers in that order)."""
    schema = pa.schema([("cls", pa.binary()), ("n", pa.int32()), ("keys", pa.list_(pa.int64()))])

    def run(batches):
        for b in batches:
            out = []
            for text in b.column("text"):
                g = ngrams(text.as_py(), n)
                if len(g):
                    take = len(g) - -(-percent * len(g) // 100) + 1
                    o = order_key(g, table.value)
                    first = np.sort(np.partition(o, take - 1)[:take] if take < len(g) else o)
                    out.append((class_of(g), len(g), (first ^ np.uint64(1 << 63)).view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)] if out else [pa.array([], f.type) for f in schema], schema=schema)

    return shared_table(docs.select("text").mapInArrow(tidy("words", run), "cls binary, n int, keys array<long>"))


def _classes_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("cls")).union(pairs.select(F.col("b").alias("cls"))).distinct()


def bounded(pairs: DataFrame, prefix: DataFrame, percent: int) -> DataFrame:
    """Of pairs those that their prefixes still allow: what both hold up to the nearer end of the two prefixes is known."""
    asked = shared_table(_classes_of(pairs))
    own = prefix.join(few(asked), "cls", "left_semi").dropDuplicates(["cls"]).select("cls", "keys")
    both = pairs.join(own.select(F.col("cls").alias("a"), F.col("keys").alias("ka")), "a").join(own.select(F.col("cls").alias("b"), F.col("keys").alias("kb")), "b")
    both = both.withColumn("end", F.least(F.element_at("ka", -1), F.element_at("kb", -1))).withColumn("c", F.size(F.array_intersect("ka", "kb")))
    rest = lambda k, n: F.col(n) - F.size(F.filter(k, lambda x: x <= F.col("end")))
    found = shared_table(both.withColumn("most", F.col("c") + F.least(rest("ka", "na"), rest("kb", "nb"))).where(_at_least("most", "na", "nb", percent)).select("a", "na", "b", "nb"))
    drop_tables(asked)
    return found


def verified(docs: DataFrame, pairs: DataFrame, class_rows: DataFrame, table, cuts: np.ndarray, n: int, percent: int) -> DataFrame:
    """Of pairs (a, na, b, nb) of classes those that link, by partial overlaps summed over the fragments."""
    asked = shared_table(class_rows.join(_classes_of(pairs), "cls").select("k").distinct())
    some = docs.join(few(asked), "k", "left_semi")
    schema = pa.schema([("cls", pa.binary()), ("fragment", pa.int32()), ("grams", pa.list_(pa.int64()))])

    def run(batches):
        for b in batches:
            out = []
            for text in b.column("text"):
                g = ngrams(text.as_py(), n)
                cls, where = class_of(g), np.searchsorted(cuts, order_key(g, table.value), side="right")
                out += [(cls, f, g[where == f].view(np.int64)) for f in np.unique(where).tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)] if out else [pa.array([], f.type) for f in schema], schema=schema)

    parts = some.select("text").mapInArrow(tidy("words", run), "cls binary, fragment int, grams array<long>")
    apart = pairs.withColumn("fragment", F.explode(F.sequence(F.lit(0), F.lit(len(cuts)))))
    left = apart.join(parts.select(F.col("cls").alias("a"), "fragment", F.col("grams").alias("ga")), ["a", "fragment"])
    both = left.join(parts.select(F.col("cls").alias("b"), "fragment", F.col("grams").alias("gb")), ["b", "fragment"])
    partial = both.select("a", "b", "na", "nb", "fragment", F.size(F.array_intersect("ga", "gb")).alias("overlap")).distinct()  # repeated rows count once
    summed = partial.groupBy("a", "b", "na", "nb").agg(F.sum("overlap").alias("overlap"))
    found = shared_table(summed.where(_at_least("overlap", "na", "nb", percent)).select("a", "b"))
    drop_tables(asked)
    return found


def _candidates(rows: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a, na, b, nb) of rows that carry (cls, n, pos) and (h_cls, h_n, h_pos) at one shared n-gram."""
    ok = F.expr("cls <> h_cls") & F.expr(f"least(n, h_n) * 100L >= greatest(n, h_n) * {percent}L") & _at_least("least(n - pos, h_n - h_pos)", "n", "h_n", percent)
    first = F.col("cls") < F.col("h_cls")
    pick = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))
    return rows.where(ok).select(pick("cls", "h_cls").alias("a"), pick("n", "h_n").alias("na"), pick("h_cls", "cls").alias("b"), pick("h_n", "n").alias("nb")).distinct()


def ngram_components(docs: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """(k, doc_id, n_shingles, component_id, root) of every row: the smallest doc_id linked with it, directly or not, and a
    name of the component (null without words). k is the hash of doc_id and text. Sets link when 100 * overlap >= percent * union."""
    spark = docs.sparkSession
    ship(spark)
    rows = texts(docs).withColumn("k", F.xxhash64("doc_id", "text"))
    bits = table_bits(docs)
    described = describe(rows, n, bits)
    each = shared_table(described.where("block is null").select("doc_id", "k", "n", "cls"))
    table = order_table(described, bits)
    drop_tables(described)
    cuts, carried = fragment_cuts(table, FRAGMENTS), spark.sparkContext.broadcast(table)  # 2**MOST_BITS bytes at most
    classes = shared_table(each.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("least"), F.min("k").alias("k")))

    copies = shared_table(each.where("n > 0").select("k", "cls").distinct().join(classes.select("cls", F.col("k").alias("k0")), "cls").where("k <> k0").select("k"))
    prefix = prefixes(rows.join(few(copies), "k", "left_anti"), carried, n, percent)
    places = prefix.select("cls", "n", F.posexplode("keys").alias("pos", "g"))
    met = with_heads(places, "g", ["pos", "cls"])  # only n-grams that two rows share
    drop_tables(copies)

    def check(pairs):
        left = bounded(pairs, prefix, percent)
        linked = verified(rows, left, classes, carried, cuts, n, percent)
        drop_tables(pairs, left)
        return linked

    links = check(shared_table(_candidates(met, percent)))
    root = components(links)
    members = met.select("g", "cls", "n", "pos").union(met.select("g", "h_cls", "h_n", "h_pos")).distinct()
    members = members.join(root.select(F.col("node").alias("cls"), "root"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    mixed = members.groupBy("g").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("g")
    open_ = shared_table(members.join(mixed, "g", "left_semi"))
    drop_tables(met)
    other = open_.select("g", *(F.col(c).alias(f"h_{c}") for c in ("cls", "n", "pos", "root")))
    bound = F.expr(f"root <> h_root and cls < h_cls and least(n, h_n) * 100L >= greatest(n, h_n) * {percent}L and least(n - pos, h_n - h_pos) * {100 + percent}L >= {percent}L * (cast(n as long) + h_n)")
    asked = shared_table(_candidates(open_.join(other, "g").where(bound), percent))
    drop_tables(open_)
    more = check(asked)
    drop_tables(prefix)
    carried.unpersist()

    whole = components(links.unionByName(more))
    found = classes.join(whole.select(F.col("node").alias("cls"), "root"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    least = found.groupBy("root").agg(F.min("least").alias("component_id"))
    of = found.join(least, "root").select("cls", "component_id", "root")
    return each.join(of, "cls", "left").select("k", "doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "root")


def op6_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return ngram_components(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id")
