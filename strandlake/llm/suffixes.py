"""Repeated passages by sparse suffix arrays.

Of all suffixes of all texts (in words), those that start at content-selected positions stay: the minimisers of GRAM-word
grams over windows that span MIN_WORDS words, so any two equal runs of MIN_WORDS words hold the same selected gram.
The selected grams are sorted over the whole corpus, where equal ones form runs that point to their first suffix (a run may
span any number of partitions). Every run of MIN_WORDS words around a gram that two documents share is then a key of its own:
these keys are sorted likewise, and each one meets the first document that has it, so no holder of a gram hides another.

A passage of a document counts as repeated when at least MIN_WORDS words of it stand in another document before it (by
doc_id, then by hash). Texts that are word for word equal are matched as a whole. Words: A-Z lower-cased, ASCII white space.

All words of such passages are found, and no others: runs are equal when two 64-bit hashes of their words are.

Defined cases: null and short texts have no passages; rows that repeat doc_id and text are one document; a repetition
inside one document does not count; ids may be null (first in order); empty tables give empty results.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_tables, few, fresh, shared_table, ship, tidy
from .runs import with_heads
from .words import prefix_sums, run_hashes, word_hashes

MIN_WORDS, GRAM, BLOCK_WORDS = 50, 25, 4096
OTHER = np.uint64(0xD6E8FEB86659FD93)  # for the second hash of a run
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def selected(s: np.ndarray, n: int, gram: int, least: int) -> np.ndarray:
    """Starts of the grams that are the leftmost minimum of some window of grams spanning least words."""
    g = run_hashes(s, np.arange(n - gram + 1), gram)
    x = (g & ~np.uint64(0xFFFFFF)) | (np.arange(len(g)).astype(np.uint64) & np.uint64(0xFFFFFF))
    width, have = least - gram + 1, 1
    while 2 * have <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    if have < width:
        x = np.minimum(x[: len(x) - (width - have)], x[width - have :])
    first = np.arange(len(x)).astype(np.uint64)
    low = x & np.uint64(0xFFFFFF)
    return np.unique((first & ~np.uint64(0xFFFFFF)) + low + np.where(low < (first & np.uint64(0xFFFFFF)), np.uint64(1 << 24), np.uint64(0))).astype(np.int64)


def _by_id(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("k", F.xxhash64("doc_id", "text"))


def describe(docs: DataFrame, gram: int, least: int) -> DataFrame:
    """k, doc_id, n, the hash of all words, and the keys of the selected grams of every text of least words and more."""
    schema = pa.schema([("k", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int32()), ("whole", pa.int64()), ("start", pa.list_(pa.int32())), ("key", pa.list_(pa.int64()))])

    def run(batches):
        for b in batches:
            out = []
            for k, doc_id, text in zip(b.column("k").to_pylist(), b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                h = word_hashes(text.as_py())
                if len(h) >= least:
                    s = prefix_sums(h)
                    at = selected(s, len(h), gram, least)
                    whole = run_hashes(s, np.array([0]), len(h)).view(np.int64)[0]
                    out.append((k, doc_id, len(h), whole, at.astype(np.int32), run_hashes(s, at, gram).view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)] if out else [pa.array([], f.type) for f in schema], schema=schema)

    return docs.select("k", "doc_id", "text").mapInArrow(tidy("words", run), "k long, doc_id long, n int, whole long, start array<int>, key array<long>")


def shared_grams(described: DataFrame) -> DataFrame:
    """(k, grams): for each document, the keys of the selected grams that another document has as well."""
    rows = described.select("doc_id", "k", F.explode(F.arrays_zip("start", "key")).alias("s")).select("s.key", "doc_id", "k", "s.start")
    met = with_heads(rows, "key", ["doc_id", "k", "start"], "k <> h_k")
    found = shared_table(met.select("key", F.explode(F.array("k", "h_k")).alias("k")).groupBy("k").agg(F.collect_set("key").alias("grams")))  # of a text's own grams
    drop_tables(met)
    return found


def whole_runs(asked: DataFrame, gram: int, least: int) -> DataFrame:
    """(key, check, doc_id, k, start): every run of least words that holds one of its document's grams, by two hashes."""
    schema = pa.schema([("key", pa.int64()), ("check", pa.int64()), ("doc_id", pa.int64()), ("k", pa.int64()), ("start", pa.int32())])

    def run(batches):
        for b in batches:
            for k, doc_id, text, grams in zip(b.column("k").to_pylist(), b.column("doc_id").to_pylist(), b.column("text"), b.column("grams"), strict=True):
                h = word_hashes(text.as_py())
                s = prefix_sums(h)
                hits = np.concatenate([[0], np.cumsum(np.isin(run_hashes(s, np.arange(len(h) - gram + 1), gram).view(np.int64), grams.values.to_numpy()))])
                at = np.flatnonzero(hits[least - gram + 1 :] > hits[: len(h) - least + 1])
                keys = [run_hashes(x, at, least).view(np.int64) for x in (s, prefix_sums(h ^ OTHER))]
                yield pa.RecordBatch.from_arrays([*map(pa.array, keys), pa.array([doc_id] * len(at), pa.int64()), pa.array(np.full(len(at), k)), pa.array(at, pa.int32())], schema=schema)

    return asked.select("k", "doc_id", "text", "grams").mapInArrow(tidy("words", run), "key long, check long, doc_id long, k long, start int")


def _texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """One (k, text) for each id asked for."""
    return docs.select("k", "text").join(few(ids), "k", "left_semi").dropDuplicates(["k"])


def covered(met: DataFrame, least: int) -> DataFrame:
    """(k, doc_id, start, end, source_id): maximal spans of runs (k, doc_id, start, h_doc_id) of least words. Runs are joined by
    blocks of BLOCK_WORDS words of a text first, so a long text's runs meet in one task only as the spans of its blocks."""
    schema = pa.schema([("k", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("source_id", pa.int64())])

    def join(batches):
        for b in batches:
            out = []
            for k, doc_id, q in zip(b.column("k").to_pylist(), b.column("doc_id").to_pylist(), b.column("q"), strict=True):
                start, end, doc0 = (q.values.field(x) for x in ("start", "end", "doc0"))
                start, end = start.to_numpy(), end.to_numpy()
                order = np.argsort(start, kind="stable")
                start, reach = start[order], np.maximum.accumulate(end[order])
                new = np.flatnonzero(np.concatenate([[True], start[1:] > reach[:-1]]))
                last = np.concatenate([new[1:], [len(start)]]) - 1
                out += [(k, doc_id, start[i], reach[j], doc0[order[i]].as_py()) for i, j in zip(new, last, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)] if out else [pa.array([], f.type) for f in schema], schema=schema)

    def spans(rows, *by):
        found = rows.groupBy("k", *by).agg(F.first("doc_id").alias("doc_id"), F.collect_list(F.struct("start", "end", "doc0")).alias("q"))
        return found.select("k", "doc_id", "q").mapInArrow(tidy("words", join), "k long, doc_id long, start int, end int, source_id long")

    runs = met.select("k", "doc_id", "start", (F.col("start") + least).alias("end"), F.col("h_doc_id").alias("doc0"), F.floor(F.col("start") / BLOCK_WORDS).alias("block"))
    return spans(spans(runs, "block").withColumnRenamed("source_id", "doc0"))


def passages(docs: DataFrame, least: int = MIN_WORDS, gram: int = GRAM) -> DataFrame:
    """(k, doc_id, n, start, end, source_id): maximal repeated passages in words [start, end) with the document that has
    them before (of several, the smallest for the first word). k is the hash of doc_id and text."""
    ship(docs.sparkSession)
    rows = _by_id(docs)
    described = shared_table(describe(rows, gram, least))
    firsts = described.groupBy("whole", "n").agg(F.min(F.struct("doc_id", "k")).alias("first"), F.count_distinct("k").alias("size"))
    copies = described.select("whole", "n", "doc_id", "k").distinct().join(firsts.where("size > 1"), ["whole", "n"]).where(F.col("k") != F.col("first.k"))
    copies = shared_table(copies.select("k", "doc_id", "n", F.lit(0).alias("start"), F.col("n").alias("end"), F.col("first.doc_id").alias("source_id")))
    sizes = shared_table(described.select("k", "n").distinct())
    own = described.join(few(copies.select("k")), "k", "left_anti").dropDuplicates(["k"])
    grams = shared_grams(own)
    drop_tables(described)
    held = _texts_of(rows.withColumn("text", F.struct("doc_id", "text")), grams.select("k")).select("k", "text.doc_id", "text.text")
    met = with_heads(whole_runs(held.join(grams, "k"), gram, least), "key", ["doc_id", "k", "start"], "k <> h_k AND check = h_check")
    drop_tables(grams)
    found = shared_table(covered(met, least))
    drop_tables(met)
    return copies.unionByName(found.join(sizes, "k").select("k", "doc_id", "n", "start", "end", "source_id"))


def cut(docs: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """docs without their repeated passages: the first document that has a passage keeps it. Texts of which nothing is
    left go; n_chars, where there is such a column, follows the text. All other rows and columns stay as they are, whatever
    their names; rows that repeat doc_id and text are cut alike."""
    found = shared_table(passages(docs, least).groupBy("k").agg(F.collect_list(F.struct("start", "end")).alias("spans")))

    @F.arrow_udf("string")
    def without(text: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for t, sp in zip(text, spans, strict=True):
            t, sp = t.as_py(), sp.as_py()
            if sp is None or t is None:
                out.append(t)
                continue
            at = [m.start() for m in WORD.finditer(t)] + [len(t)]
            kept, last = [], 0
            for s in sorted((x["start"], x["end"]) for x in sp):
                kept.append(t[last : at[s[0]]])
                last = at[s[1]]
            left = "".join([*kept, t[last:]])
            out.append(left.rstrip() if left.strip() else None)
        return pa.array(out, pa.string())

    names = docs.columns
    key, spans, new = (fresh(docs, x) for x in ("__k", "__spans", "__text"))
    found = found.select(F.col("k").alias(key), F.col("spans").alias(spans))
    many = found.agg(F.sum(F.size(spans))).first()[0] or 0
    keyed = docs.withColumn(key, F.xxhash64(F.col("doc_id").cast("long"), F.coalesce("text", F.lit(""))))
    joined = keyed.join(F.broadcast(found) if many <= 1_000_000 else found, key, "left")  # a span is a few bytes
    hit = F.col(spans).isNotNull()
    out = joined.withColumn(new, F.when(hit, without("text", spans)).otherwise(F.col("text"))).where(~hit | F.col(new).isNotNull())
    out = out.withColumn("text", F.col(new))
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(hit, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*(f"`{c}`" for c in names))


def op7_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    found = passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.col("start").alias("start_word"), (F.col("end") - F.col("start")).alias("n_words"), "source_id")
