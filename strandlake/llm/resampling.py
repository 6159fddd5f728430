"""Importance resampling towards a target: documents whose hashed features are likelier in the target than in the corpus weigh more, and
a seeded Gumbel draw takes the highest scores.

1. Postings: a document's words (A-Z lower-cased, runs of letters, digits and characters beyond ASCII) and the runs of them that are
   asked for become (bucket, document, count), bucket the crc32 of the feature's bytes modulo BUCKETS. The postings of a document that
   fall into one of SHARDS groups of buckets travel as one row with two arrays.
2. Postings are written once and shuffled once, by group of buckets and salt: SALTS tasks may share a group, so a bucket that every
   document has is in no single task. The sum of each bucket comes from partial sums, at most BUCKETS rows a task.
3. Sums of corpus and target meet by bucket and give its gain; the gains of a group of buckets, an array, go to the tasks that hold its postings.
4. Tasks emit a contribution a document and group of buckets, which are reduced by document.
5. Scores of documents with enough words are sorted by ranges, counted by range and numbered; the share asked for is drawn.

Defined cases: null text has no words, no features, weight 0; documents of too few words are returned undrawn; a null doc_id is
drawn by the empty text's hash and comes after all ids in ties; rows that repeat doc_id and text have the same score and ranks that follow each other; empty
tables: no corpus gives no rows, without a target every t and T is 0; other columns are not read.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cache, drop_tables, shared_table, ship, tidy

BUCKETS, SHARDS, SALTS, CACHE_WORDS, BATCH_ROWS = 10_000, 16, 256, 300_000, 50_000
WORDS = re.compile(rb"[0-9a-z\x80-\xff]+").findall


def postings(docs: DataFrame, runs: int, buckets: int) -> DataFrame:
    """(shard, salt, k1, k2, doc_id, own, words, features, at, counts) of docs (doc_id, text): a row for each shard that a
    document has features in, one at least; at: buckets over SHARDS. own is 1, with words, features and doc_id, in one row of each."""
    ship(docs.sparkSession)

    def run(batches):
        known = cache("buckets")
        out = [[] for _ in range(8)]
        held = 0

        def flush():
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=["shard", "k1", "k2", "doc_id", "own", "words", "at", "counts"])

        for b in batches:
            columns = (b.column(c).to_pylist() for c in ("doc_id", "k1", "k2"))
            for doc_id, k1, k2, text in zip(*columns, b.column("text"), strict=True):
                words = WORDS(text.as_py().encode("utf-8", "surrogatepass").lower())
                features = words if runs == 1 else [b" ".join(words[i : i + n]) for n in range(1, runs + 1) for i in range(len(words) - n + 1)]
                new = set(features).difference(known)
                if new:
                    if len(known) > CACHE_WORDS:
                        known.clear()
                        new = set(features)
                    for f in new:
                        known[f] = zlib.crc32(f) % buckets
                found, n = np.unique(np.fromiter(map(known.__getitem__, features), np.int32, len(features)), return_counts=True)
                shard = found % SHARDS
                order = np.argsort(shard, kind="stable")
                found, n, shard = found[order] // SHARDS, n[order], shard[order]
                starts = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])) if len(shard) else np.zeros(1, int)
                ends = [*starts[1:], len(shard)]
                for i, (s, e) in enumerate(zip(starts, ends, strict=True)):
                    row = (int(shard[s]) if len(shard) else k1 % SHARDS, k1, k2, doc_id if i == 0 else None, int(i == 0), len(words) if i == 0 else 0, found[s:e], n[s:e])
                    for c, v in zip(out, row, strict=True):
                        c.append(v)
                held += len(starts)
                if held >= BATCH_ROWS:
                    yield flush()
                    out, held = [[] for _ in range(8)], 0
        if held:
            yield flush()

    text = F.coalesce(F.col("text"), F.lit(""))
    doc_id = F.col("doc_id").cast("long")
    rows = docs.select(doc_id.alias("doc_id"), text.alias("text"), F.xxhash64(doc_id, text).alias("k1"), F.xxhash64(F.lit(1), doc_id, text).alias("k2"))
    found = rows.mapInArrow(tidy("buckets", run), "shard int, k1 long, k2 long, doc_id long, own int, words long, at array<int>, counts array<int>")
    return found.withColumn("salt", F.pmod("k2", F.lit(SALTS)).cast("int"))


def bucket_sums(posted: DataFrame) -> DataFrame:
    """(bucket, n) of the features of all documents: at most as many rows as buckets."""
    pairs = posted.select("shard", F.explode(F.arrays_zip("at", "counts")).alias("x"))
    return pairs.groupBy((F.col("x.at") * SHARDS + F.col("shard")).alias("bucket")).agg(F.sum("x.counts").alias("n"))


def weigh(docs: DataFrame, target: DataFrame, runs: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, k1, k2, rows, n_words, n_features, weight) of the different (doc_id, text) of docs, each with its number of rows. A written table."""
    spark = docs.sparkSession
    posted = shared_table(postings(docs, runs, buckets))
    own = bucket_sums(posted).withColumnRenamed("n", "s")
    wanted = bucket_sums(postings(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), runs, buckets)).withColumnRenamed("n", "t")
    sums = shared_table(spark.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(own, "bucket", "left").join(wanted, "bucket", "left").na.fill(0))
    all_s, all_t = sums.agg(F.sum("s"), F.sum("t")).first()
    s, t = F.col("s").cast("double"), F.col("t").cast("double")
    gain = F.floor(1000 * F.log((t + 1) * F.lit(float(all_s + buckets)) / ((s + 1) * F.lit(float(all_t + buckets))))).cast("long")
    gains = sums.groupBy((F.col("bucket") % SHARDS).cast("int").alias("shard")).agg(F.transform(F.sort_array(F.collect_list(F.struct("bucket", gain.alias("gain")))), lambda x: x["gain"]).alias("gains"))
    gains = gains.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).hint("shuffle_hash")
    given = F.aggregate(F.arrays_zip("at", "counts"), F.lit(0).cast("long"), lambda a, x: a + F.get("gains", x["at"]) * x["counts"])
    total = F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)
    met = posted.repartition("shard", "salt").join(gains, ["shard", "salt"]).select("k1", "k2", "doc_id", "own", "words", total.alias("features"), given.alias("given"))
    each = lambda c: F.floor(F.sum(c) / F.sum("own")).cast("long")  # noqa: E731  # equal rows have equal sums
    out = shared_table(met.groupBy("k1", "k2").agg(F.max("doc_id").alias("doc_id"), F.sum("own").alias("rows"), each("words").alias("n_words"), each("features").alias("n_features"), each("given").alias("weight")))
    drop_tables(posted, sums)
    return out


def draw(weighed: DataFrame, seed: int = 2024, percent: int = 10, least_words: int = 20) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of all rows: of those with enough words the given share of highest scores is ranked."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    score = F.col("weight") + F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")
    scored = weighed.withColumn("score", score)
    fit = F.col("n_words") >= least_words
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("k1"), F.asc("k2")]
    ranged = scored.where(fit).repartitionByRange(*order).sortWithinPartitions(*order)

    def number(batches):
        from pyspark import TaskContext

        part, before = TaskContext.get().partitionId(), 0
        for b in batches:
            rows = b.column("rows").to_numpy()
            ends = before + np.cumsum(rows)
            names = ["part", "first", *b.schema.names]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), part), pa.int32()), pa.array(ends - rows), *b.columns], names=names)
            before = int(ends[-1]) if len(rows) else before

    sorted_ = shared_table(ranged.select("doc_id", "rows", "n_features", "weight", "score").mapInArrow(number, "part int, first long, doc_id long, rows long, n_features long, weight long, score long"))
    sizes = sorted_.groupBy("part").agg(F.sum("rows").alias("n")).orderBy("part").collect()  # a row a partition
    base, at = [], 0
    for r in sizes:
        base.append((r["part"], at))
        at += r["n"]
    start = F.broadcast(weighed.sparkSession.createDataFrame(base, "part int, base long"))
    drawn = percent * at // 100
    copy = lambda rows: F.explode(F.sequence(F.lit(1).cast("long"), rows))
    numbered = sorted_.join(start, "part").withColumn("i", copy(F.col("rows"))).withColumn("place", F.col("base") + F.col("first") + F.col("i"))
    names = ["doc_id", "n_features", "weight", "score"]
    rest = scored.where(~fit).withColumn("i", copy(F.col("rows"))).select(*names, F.lit(None).cast("long").alias("rank"))
    return numbered.select(*names, F.when(F.col("place") <= drawn, F.col("place")).alias("rank")).unionByName(rest)


def op13_target_resampling(spark, sf_dir: str) -> DataFrame:
    docs, target = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return draw(weigh(docs, target))


OP13_SQL = r"""
WITH bits AS (
  SELECT i, 0 AS round, i AS c FROM range(256) AS r(i)
), crc_table AS (
  WITH RECURSIVE step(i, round, c) AS (
    SELECT i, 0, CAST(i AS BIGINT) FROM range(256) AS r(i)
    UNION ALL SELECT i, round + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END FROM step WHERE round < 8
  ) SELECT list(c ORDER BY i) AS tab FROM step WHERE round = 8
), own AS (
  SELECT doc_id, 'd' AS side, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM documents
  UNION ALL
  SELECT NULL, 'b', unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark
), counted AS (
  SELECT side, doc_id, w, count(*) AS n FROM own GROUP BY ALL
), hexed AS (
  SELECT w, hex(encode(w)) AS x FROM (SELECT DISTINCT w FROM counted)
), bytes AS (
  SELECT w, list_transform(range(1, len(x), 2), lambda i: CAST(instr('0123456789ABCDEF', x[i]) - 1 AS BIGINT) * 16 + instr('0123456789ABCDEF', x[i + 1]) - 1) AS b FROM hexed
), hashed AS (
  SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, y: xor(c // 256, tab[xor(c % 256, y) + 1])), 4294967295::BIGINT) % 10000 AS bucket FROM bytes, crc_table
), sums AS (
  SELECT bucket, sum(CASE WHEN side = 'd' THEN n ELSE 0 END) AS s, sum(CASE WHEN side = 'b' THEN n ELSE 0 END) AS t FROM counted JOIN hashed USING (w) GROUP BY bucket
), gains AS (
  SELECT bucket, CAST(floor(1000 * ln((t + 1)::DOUBLE * ((SELECT sum(s) FROM sums) + 10000)::DOUBLE / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM sums) + 10000)::DOUBLE))) AS BIGINT) AS gain FROM sums
), weighed AS (
  SELECT doc_id, sum(n) AS n, sum(n * gain) AS weight FROM counted JOIN hashed USING (w) JOIN gains USING (bucket) WHERE side = 'd' GROUP BY doc_id
), scored AS (
  SELECT documents.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
    CAST(coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || documents.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS BIGINT) AS score
  FROM documents LEFT JOIN weighed USING (doc_id)
), ranked AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS fit FROM scored WHERE n_features >= 20
)
SELECT scored.*, CASE WHEN place <= 10 * fit // 100 THEN place END AS rank FROM scored LEFT JOIN ranked USING (doc_id)
"""
