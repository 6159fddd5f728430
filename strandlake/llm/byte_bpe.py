"""Byte-level BPE by rank files: Spark higher-order functions fold the ranked merges over the byte arrays of distinct words.

1. All texts are cut into words by the vocabulary's pattern, once: cells of texts are written as numbers in the cell's own
   list of distinct words. The lists are counted over the corpus; the most frequent words (at most DICTIONARY of them,
   whole count levels at a time) form a dictionary.
2. A word that is a piece itself is that piece, as in the library. In each other word fold_words merges the pair of least
   rank, first from the left, until no pair has a rank: an aggregate over arrays beside a constant rank table (pair of
   pieces -> rank of their concatenation, in hash buckets).
3. A cell's words that the dictionary lacks are folded beside the cell by the same expression, so every id comes from the fold
   or is a whole word's piece, and nothing of the texts is shuffled. The words' ids, put in the order of the texts, are the result.
4. A fold step copies its word, so words of more than LONG bytes take another way to the same ids: merge_long, a heap of the
   word's pairs by rank and place, in n log n. Such words are in no dictionary; the worker that holds the cell merges them.
5. Decoding concatenates the binary pieces of the ids.

The dictionary goes to the workers as hashes and ids, at most about 20 bytes a word, and a hit is accepted only if its pieces
spell the word. Defined cases: null text is empty and has no ids; every row is encoded, repeated ones too; ids of documents
may be null; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_tables, shared_table, ship, texts, tidy
from .tokens import PATTERNS, PLAIN

DICTIONARY, BUCKETS, WORDS_A_ROW, CELL_WORDS, LONG = 2_500_000, 1 << 17, 2048, 2_000_000, 512


@lru_cache(2)
def load_ranks(path: str | None = None) -> dict[bytes, int]:
    import public_tokenizers as P

    with open(path or P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(2)
def _cutter(pattern: str | None):
    import public_tokenizers as P
    import regex

    full = regex.compile(pattern or P.PATTERN).findall
    if pattern:
        return full
    plain, odd = re.compile(PATTERNS["byte"]).findall, re.compile(f"[^{PLAIN}]").search
    return lambda text: full(text) if odd(text) else plain(text)


def rank_table(spark: SparkSession, ranks: dict[bytes, int]) -> DataFrame:
    """One constant row: buckets of (left rank * 2**20 + right rank -> rank of both)."""
    buckets: list[dict[int, int]] = [{} for _ in range(BUCKETS)]
    for piece, rank in ranks.items():
        for cut in range(1, len(piece)):
            a, b = ranks.get(piece[:cut]), ranks.get(piece[cut:])
            if a is not None and b is not None:
                buckets[(a * 40503 + b) % BUCKETS][a << 20 | b] = rank
    table = pa.table({"one": pa.array([1], pa.int32()), "ranks": pa.array([[list(b.items()) for b in buckets]], pa.list_(pa.map_(pa.int64(), pa.int32())))})
    return spark.createDataFrame(table)


def fold_words(df: DataFrame, words: str, out: str, ranks: DataFrame) -> DataFrame:
    """Adds out: of each array of single-byte ranks in the array column words, the ids left after all merges."""

    def let(value, body):
        """body of value, which is computed once: names in lambdas are not shared otherwise."""
        return F.element_at(F.transform(F.array(value), body), 1)

    def rank_of(a, b):
        bucket = F.get("ranks", F.pmod(a.cast("long") * 40503 + b, F.lit(BUCKETS)).cast("int"))
        return F.element_at(bucket, a.cast("long") * (1 << 20) + b)

    def merge(state, _):
        ids, rs = state["ids"], state["rs"]
        none = F.slice(rs, 1, 0)

        def join(low, p):
            left = F.when(p > 1, F.array(rank_of(F.element_at(ids, p - 1), low))).otherwise(none)
            right = F.when(p < F.size(rs), F.array(rank_of(low, F.element_at(ids, p + 2)))).otherwise(none)
            n = F.size(ids)
            return F.struct(
                F.concat(F.slice(ids, F.lit(1), p - 1), F.array(low), F.slice(ids, p + 2, n)).alias("ids"),
                F.concat(F.slice(rs, F.lit(1), F.greatest(p - 2, F.lit(0))), left, right, F.slice(rs, p + 2, n)).alias("rs"),
            )

        def at(low):
            return let(F.array_position(rs, low).cast("int"), lambda p: join(low, p))

        return let(F.array_min(rs), lambda low: F.when(low.isNull(), state).otherwise(at(low)))

    def fold(word):
        pairs = F.zip_with(F.slice(word, 1, F.size(word) - 1), F.slice(word, 2, F.size(word)), rank_of)
        start = F.struct(word.alias("ids"), pairs.alias("rs"))
        return F.when(F.size(word) < 2, word).otherwise(F.aggregate(F.sequence(F.lit(1), F.size(word) - 1), start, merge, lambda s: s["ids"]))

    names = df.columns
    beside = df.withColumn("one", F.lit(1)).join(F.broadcast(ranks), "one")  # the constant row
    return beside.select(*names, F.transform(words, fold).alias(out))


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of a word of any length: the pair of least rank is merged, first from the left, until no pair has a rank."""
    if word in ranks:
        return [ranks[word]]
    end, before = list(range(1, len(word) + 1)), list(range(-1, len(word) - 1))  # of the piece that begins at a place; -1: none, or merged
    heap: list[tuple[int, int, int]] = []

    def offer(a: int) -> None:
        b = end[a]
        if b < len(word) and (rank := ranks.get(word[a : end[b]])) is not None:
            heapq.heappush(heap, (rank, a, end[b]))

    for a in range(len(word)):
        offer(a)
    while heap:
        _, a, z = heapq.heappop(heap)
        b = end[a]
        if b < 0 or b == len(word) or end[b] != z:
            continue  # one of the two was merged since
        end[a], end[b] = z, -1
        if z < len(word):
            before[z] = a
        offer(a)
        if before[a] >= 0:
            offer(before[a])
    ids, a = [], 0
    while a < len(word):
        ids.append(ranks[word[a : end[a]]])
        a = end[a]
    return ids


CELL = "doc_ids array<long>, size binary, ids binary, words array<string>, c array<int>"


def cells(docs: DataFrame, pattern: str | None = None) -> DataFrame:
    """Texts cut into words, as a written table of CELL rows: documents, words of each, their numbers in the cell's list of
    words (packed), this list and how often the cell has each."""
    schema = pa.schema([("doc_ids", pa.list_(pa.int64())), ("size", pa.binary()), ("ids", pa.binary()), ("words", pa.list_(pa.string())), ("c", pa.list_(pa.int32()))])

    def run(batches):
        import zstandard

        find, local, ids, doc_ids, size = _cutter(pattern), {}, array("i"), [], array("i")

        def out():
            own = np.array(ids, np.int32)
            c = np.bincount(own, minlength=len(local))
            order = np.argsort(-c, kind="stable")  # small numbers for frequent words pack well
            rank = np.empty(len(local), np.int32)
            rank[order] = np.arange(len(local), dtype=np.int32)
            planes = np.ascontiguousarray(rank[own].astype("<u4").view(np.uint8).reshape(-1, 4).T)
            words = pa.array(list(local), pa.string()).take(pa.array(order))
            row = [doc_ids], [size.tobytes()], [zstandard.ZstdCompressor(level=1).compress(planes.tobytes())], None, [c[order]]
            rb = pa.RecordBatch.from_arrays([pa.ListArray.from_arrays([0, len(words)], words) if x is None else pa.array(x, f.type) for x, f in zip(row, schema, strict=True)], schema=schema)
            local.clear()
            doc_ids.clear()
            del ids[:], size[:]
            return rb

        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                words = find(text.as_py())
                for w in set(words).difference(local):
                    local[w] = len(local)
                ids.extend(map(local.__getitem__, words))
                doc_ids.append(doc_id)
                size.append(len(words))
                if len(ids) >= CELL_WORDS:
                    yield out()
        if doc_ids:
            yield out()

    return shared_table(docs.select("doc_id", "text").mapInArrow(tidy("bytes", run), CELL))


def count_words(made: DataFrame) -> DataFrame:
    pairs = made.select(F.explode(F.arrays_zip("words", "c")).alias("x"))
    return pairs.groupBy(F.col("x.words").alias("word")).agg(F.sum("x.c").alias("c"))


class Dictionary:
    """Word hashes in order, with the ids of each: found by binary search, accepted only if the pieces spell the word."""

    def __init__(self, hashes: np.ndarray, sizes: np.ndarray, ids: np.ndarray):
        order = np.argsort(hashes, kind="stable")
        ends = np.cumsum(sizes)
        starts = ends - sizes
        self.hashes = hashes[order]
        self.ends = np.cumsum(sizes[order]).astype(np.uint32)
        at = np.repeat(starts[order] - (self.ends - sizes[order]), sizes[order]) + np.arange(len(ids))
        self.ids = ids[at].astype(np.uint16 if not len(ids) or ids.max() < 1 << 16 else np.uint32)

    def find(self, words: list[bytes], pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which of words it holds, how many ids each of these has, and their ids one after the other."""
        import xxhash

        h = np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)
        if not len(self.hashes) or not len(h):
            return np.zeros(len(h), bool), np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        hit = self.hashes[at] == h
        while True:
            ends = self.ends[at[hit]].astype(np.int64)
            sizes = ends - np.where(at[hit] > 0, self.ends[at[hit] - 1], 0)
            ids = self.ids[spans(ends - sizes, sizes)].astype(np.int64)
            spelled = [pieces[i] for i in ids.tolist()]
            own = [w for w, ok in zip(words, hit.tolist(), strict=True) if ok]
            lengths = np.concatenate([[0], np.cumsum([len(x) for x in spelled])])
            same = np.diff(lengths[np.concatenate([[0], np.cumsum(sizes)])]) == np.array([len(w) for w in own], np.int64)
            if same.all() and b"".join(spelled) == b"".join(own):
                return hit, sizes, ids
            cuts = np.concatenate([[0], np.cumsum(sizes)]).tolist()  # a word of another's hash
            hit[np.flatnonzero(hit)[[b"".join(spelled[a:z]) != w for a, z, w in zip(cuts[:-1], cuts[1:], own, strict=True)]]] = False


def spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places starts[0], starts[0] + 1, ... of each run of that size, one run after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


def with_long(words: list[bytes], hit: np.ndarray, sizes: np.ndarray, ids: np.ndarray, ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What Dictionary.find gives, and the words of more than LONG bytes as well."""
    far = [i for i, w in enumerate(words) if len(w) > LONG]
    if not far:
        return hit, sizes, ids
    own = [merge_long(words[i], ranks) for i in far]
    at = np.searchsorted(np.flatnonzero(hit), far)  # none of them is hit
    between = np.split(ids, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)[at])
    ids = np.concatenate([x for pair in zip(between, [*own, []], strict=True) for x in pair]).astype(np.int64)
    hit[far] = True
    return hit, np.insert(sizes, at, [len(x) for x in own]), ids


def _pieces(ranks: dict[bytes, int]) -> list[bytes]:
    out = [b""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        out[rank] = piece
    return out


def encode(docs: DataFrame, vocabulary: str | None = None, pattern: str | None = None, dictionary: int = DICTIONARY, digest: bool = False) -> DataFrame:
    """(doc_id, ids) of every row of docs (doc_id, text): ids as little-endian unsigned 32-bit numbers. digest: DIGESTS of
    these instead, in the same pass."""
    spark = docs.sparkSession
    ship(spark)
    ranks = load_ranks(vocabulary)
    single = [ranks[bytes([b])] for b in range(256)]
    constant = rank_table(spark, ranks)

    made = cells(docs, pattern)
    counts = shared_table(count_words(made).where(F.octet_length("word") <= LONG))
    levels = sorted(((r["c"], r["n"]) for r in counts.groupBy("c").agg(F.count("*").alias("n")).where("c < 1000").collect()), reverse=True)  # under 1000 rows
    many, least = counts.where("c >= 1000").count(), 1000  # at most a thousandth of all words
    for c, n in levels:
        if many + n > dictionary:
            break
        many, least = many + n, c
    if levels and least == levels[-1][0]:
        least = 1

    def rows(batches):
        import xxhash

        known, hashes, words = load_ranks(vocabulary), [], []

        def out():
            rb = pa.RecordBatch.from_arrays([pa.array([hashes], pa.list_(pa.int64())), pa.array([words], pa.list_(pa.list_(pa.int32())))], names=["hashes", "words"])
            hashes.clear()
            words.clear()
            return rb

        for b in batches:
            for w in b.column("word").to_pylist():
                w = w.encode()
                hashes.append(int(np.uint64(xxhash.xxh3_64_intdigest(w)).astype(np.int64)))
                words.append([known[w]] if w in known else [single[x] for x in w])
                if len(words) == WORDS_A_ROW:
                    yield out()
        if words:
            yield out()

    kept = counts.where(F.col("c") >= least).select("word").mapInArrow(rows, "hashes array<long>, words array<array<int>>")
    folded = shared_table(fold_words(kept, "words", "ids", constant).select("hashes", F.transform("ids", lambda w: F.size(w)).alias("sizes"), F.flatten("ids").alias("ids")))
    own = folded.toArrow()  # at most dictionary words of a few numbers
    flat = lambda name, kind: np.concatenate([np.asarray(c.flatten()) for c in own.column(name).chunks] or [np.zeros(0)]).astype(kind)
    carried = spark.sparkContext.broadcast(Dictionary(flat("hashes", np.int64).view(np.uint64), flat("sizes", np.int64), flat("ids", np.uint32)))
    del own

    drop_tables(counts, folded)

    def known_words(batches):
        known, pieces = load_ranks(vocabulary), _pieces(load_ranks(vocabulary))
        for b in batches:
            for i in range(b.num_rows):
                words = [w.encode() for w in b.column("words")[i].as_py()]
                hit, sizes, ids = with_long(words, *carried.value.find(words, pieces), known)
                missing = [words[j] for j in np.flatnonzero(~hit).tolist()]
                spelled = [[known[w]] if w in known else [single[x] for x in w] for w in missing]
                held = [hit.astype(np.uint8).tobytes(), sizes.astype("<u4").tobytes(), ids.astype("<u4").tobytes()]
                yield pa.RecordBatch.from_arrays([*(b.column(x).slice(i, 1) for x in ("doc_ids", "size", "ids")), *(pa.array([x], pa.binary()) for x in held), pa.array([spelled], pa.list_(pa.list_(pa.int32())))], names=["doc_ids", "size", "ids", "hit", "sizes", "known", "words"])

    def whole(batches):
        import zstandard

        pieces = _pieces(load_ranks(vocabulary)) if digest else []
        decimal = [str(i).encode() for i in range(len(pieces))]
        for b in batches:
            for row in range(b.num_rows):
                of = lambda name, kind: np.frombuffer(b.column(name)[row].as_py(), kind)  # noqa: E731, B023
                hit, folded = of("hit", np.uint8).astype(bool), b.column("folded")[row].values
                sizes = np.empty(len(hit), np.int64)
                sizes[hit], sizes[~hit] = of("sizes", "<u4"), folded.value_lengths().to_numpy(zero_copy_only=False)
                starts = np.cumsum(sizes) - sizes
                table = np.empty(int(sizes.sum()), np.uint32)
                table[spans(starts[hit], sizes[hit])], table[spans(starts[~hit], sizes[~hit])] = of("known", "<u4"), folded.flatten().to_numpy()
                planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(b.column("ids")[row].as_py()), np.uint8).reshape(4, -1)
                words = np.ascontiguousarray(planes.T).view("<u4").reshape(-1)
                ends, doc_ids = np.cumsum(of("size", "<i4").astype(np.int64)), b.column("doc_ids")[row].values
                at, step = 0, 1
                while at < len(ends):  # some documents at a time
                    first = int(ends[at - 1]) if at else 0
                    step = max(1, int(np.searchsorted(ends, first + 250_000, side="right")) - at)
                    own = words[first : ends[at + step - 1]]
                    n = sizes[own]
                    ids = table[spans(starts[own], n)]
                    cuts = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[first], ends[at : at + step]]) - first].tolist()
                    raws = [ids[i:j] for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
                    yield _digested(doc_ids.slice(at, step), raws, pieces, decimal) if digest else pa.RecordBatch.from_arrays([doc_ids.slice(at, step), pa.array([x.astype("<u4").tobytes() for x in raws], pa.binary())], names=["doc_id", "ids"])
                    at += step

    kept = made.select("doc_ids", "size", "ids", "words").mapInArrow(tidy("bytes", known_words), "doc_ids array<long>, size binary, ids binary, hit binary, sizes binary, known binary, words array<array<int>>")
    given = fold_words(kept, "words", "folded", constant).select("doc_ids", "size", "ids", "hit", "sizes", "known", "folded")
    return given.mapInArrow(tidy("bytes", whole), DIGESTS if digest else "doc_id long, ids binary")


DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def decode(ids: list[int], pieces: list[bytes]) -> bytes:
    return b"".join([pieces[i] for i in ids])


def _digested(doc_ids: pa.Array, raws: list[np.ndarray], pieces: list[bytes], decimal: list[bytes]) -> pa.RecordBatch:
    n, own, back = [], [], []
    for raw in raws:
        ids = raw.tolist()
        n.append(len(ids))
        own.append(hashlib.sha256(b" ".join([decimal[i] for i in ids])).hexdigest())
        back.append(hashlib.sha256(decode(ids, pieces)).hexdigest())
    return pa.RecordBatch.from_arrays([doc_ids, pa.array(n, pa.int64()), pa.array(own, pa.string()), pa.array(back, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def digests(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), the last from the decoded ids."""

    def run(batches):
        pieces = _pieces(load_ranks(vocabulary))
        decimal = [str(i).encode() for i in range(len(pieces))]
        for b in batches:
            yield _digested(b.column("doc_id"), [np.frombuffer(x.as_py(), "<u4") for x in b.column("ids")], pieces, decimal)

    return encoded.mapInArrow(tidy("bytes", run), DIGESTS)


def op5_byte_bpe(spark, sf_dir: str) -> DataFrame:
    return encode(texts(spark.read.parquet(f"{sf_dir}/documents.parquet")), digest=True)
