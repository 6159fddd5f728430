"""DNA column functions. Bases A, T, C, G are the digits 0, 1, 2, 3; a k-mer (k up to 32) is a base-4 number, its canonical
form the smaller of both strands. Up to 31 bases the number is a BIGINT, for 32 a DECIMAL(20, 0)."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def kmer_type(k: int) -> str:
    if not 1 <= k <= 32:
        raise ValueError("k must be 1..32")
    return "bigint" if k < 32 else "decimal(20,0)"


def normalise(seq: Column, n_as_a: bool = False) -> Column:
    up = F.upper(seq)
    return F.translate(up, "N", "A") if n_as_a else up


def is_valid(seq: Column, k: int) -> Column:
    """Whether an upper-case read is long enough and holds only A, C, G and T."""
    return F.coalesce((F.length(seq) >= k) & seq.rlike("^[ACGT]+$"), F.lit(False))


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGT", "TGCA"))


def _number(digits: Column, k: int) -> Column:
    return F.conv(digits, 4, 10).cast(kmer_type(k))


def forward_hash(kmer: Column, k: int) -> Column:
    return _number(F.translate(kmer, "ATCG", "0123"), k)


def reverse_hash(kmer: Column, k: int) -> Column:
    """The number of the other strand."""
    return _number(F.reverse(F.translate(kmer, "ATCG", "1032")), k)


def kmer_hash(kmer: Column, k: int, canonical: bool = True) -> Column:
    own = forward_hash(kmer, k)
    return F.least(own, reverse_hash(kmer, k)) if canonical else own


def build_kmer(kmer: Column, k: int) -> Column:
    """Struct of both strands and the canonical one."""
    f, r = forward_hash(kmer, k), reverse_hash(kmer, k)
    return F.struct(f.alias("f"), r.alias("r"), F.least(f, r).alias("u"))


def decode(number: Column, k: int) -> Column:
    return F.translate(F.lpad(F.conv(number.cast("string"), 10, 4), k, "0"), "0123", "ATCG")


def kmers(seq: Column, k: int) -> Column:
    """All overlapping k-mers of a valid read, in order (an empty array for shorter ones)."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(seq) - k + 1, F.lit(1)))
    return F.when(F.length(seq) >= k, F.transform(starts, lambda i: F.substring(seq, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))


CHUNK = 1 << 18  # bases that are numbered at once

#: The digit of each base's byte (the order of bases is a fixed value).
DIGITS = np.zeros(256, np.int64)
DIGITS[np.frombuffer(b"ATCG", np.uint8)] = range(4)


def _rolling(digits: np.ndarray, k: int, high_first: bool) -> np.ndarray:
    """The numbers of all stretches of k digits, put together from stretches of 1, 2, 4 ... digits."""
    out, have, part, width = None, 0, digits, 1
    join = lambda a, n, b, m: (a << 2 * m) | b if high_first else a | (b << 2 * n)
    while k:
        if k & 1:
            n = len(part) - have
            out = part if out is None else join(out[:n], have, part[have:], width)
            have += width
        k >>= 1
        if k:
            part = join(part[:-width], width, part[width:], width)
            width *= 2
    return out


def numbers_of(reads: pa.Array, k: int, canonical: bool = True) -> pa.ListArray:
    """The k-mer numbers of each of an array of valid reads, k up to 31. CHUNK bases are worked on at once, so what a batch takes besides
    its numbers does not grow with it."""
    reads = pc.fill_null(reads, "").cast(pa.binary())
    at = np.frombuffer(reads.buffers()[1], np.int32)[reads.offset : reads.offset + len(reads) + 1].astype(np.int64)
    sizes = np.diff(at)
    own = np.maximum(sizes - k + 1, 0)
    ends = np.concatenate([[0], np.cumsum(own)])
    out, i = np.empty(ends[-1], np.int64), 0
    while i < len(reads):
        j = max(i + 1, int(np.searchsorted(at, at[i] + CHUNK, "right")) - 1)
        if own[i:j].any():
            digits = DIGITS[np.frombuffer(reads.buffers()[2], np.uint8)[at[i] : at[j]]]
            found = _rolling(digits, k, True)
            if canonical:
                found = np.minimum(found, _rolling(digits ^ 1, k, False))
            inside = np.repeat(at[i + 1 : j + 1] - at[i], sizes[i:j]) - np.arange(len(digits)) >= k  # no k-mer reaches into the next read
            out[ends[i] : ends[j]] = found[inside[: len(found)]]
        i = j
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(out))


def kmer_hashes(seq: Column, k: int, canonical: bool = True) -> Column:
    """The numbers of all overlapping k-mers of a valid read, in order (an empty array for shorter ones and null). The bases of a
    batch of reads are numbered together; for k of 32, whose numbers are decimals, by expressions."""
    if k > 31:
        return _wide_hashes(seq, k, canonical)

    @F.arrow_udf("array<bigint>")
    def numbers(reads: pa.Array) -> pa.Array:
        return numbers_of(reads, k, canonical)

    return numbers(seq)


def _wide_hashes(seq: Column, k: int, canonical: bool) -> Column:
    def pick(x):
        at = lambda digits, i: _number(F.substring(digits, i, F.lit(k)), k)
        n = F.length(x["f"])
        one = lambda i: F.least(at(x["f"], i), at(x["r"], n - k + 2 - i)) if canonical else at(x["f"], i)
        return F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), one)

    both = F.struct(F.translate(seq, "ATCG", "0123").alias("f"), F.reverse(F.translate(seq, "ATCG", "1032")).alias("r"))
    once = F.element_at(F.transform(F.array(both), pick), 1)  # a name in a lambda is computed once
    return F.when(F.length(seq) >= k, once).otherwise(F.array().cast(f"array<{kmer_type(k)}>"))


def reverse_number(number: Column, k: int) -> Column:
    """The number of the other strand from a strand's, k up to 31: digits in reverse order, each with its last bit turned."""
    if k > 31:
        raise ValueError("integers hold k up to 31")
    digits = F.lpad(F.conv(number.cast("string"), 10, 4), k, "0")
    return _number(F.reverse(F.translate(digits, "0123", "1032")), k)


def neighbours(f: Column, r: Column, k: int, side: str) -> Column:
    """Canonical numbers of the four k-mers one base to the left or right of (forward, reverse) numbers, k up to 31."""
    if k > 31:
        raise ValueError("neighbours by integers need k up to 31")
    mask, top = (1 << 2 * k) - 1, 2 * (k - 1)
    out = []
    for base in range(4):
        mate = base ^ 1
        if side == "right":
            nf, nr = F.shiftleft(f, 2).bitwiseAND(F.lit(mask)).bitwiseOR(F.lit(base)), F.shiftright(r, 2).bitwiseOR(F.lit(mate << top))
        else:
            nf, nr = F.shiftright(f, 2).bitwiseOR(F.lit(base << top)), F.shiftleft(r, 2).bitwiseAND(F.lit(mask)).bitwiseOR(F.lit(mate))
        out.append(F.least(nf, nr))
    return F.array(*out)


def binary_entropy(present: Column, total: Column) -> Column:
    """-p log2 p - (1 - p) log2 (1 - p) of p = present / total; 0 where p is 0 or 1."""
    p = present.cast("double") / total
    return F.when((present > 0) & (present < total), -p * F.log2(p) - (1 - p) * F.log2(1 - p)).otherwise(F.lit(0.0))


def sample_name(path: Column) -> Column:
    """Base name, cut at the first of .kh, .ct, .cg and .countgraph (tried in this order) that occurs in it."""
    base = F.element_at(F.split(path, "/"), -1)  # the suffixes and their order are fixed values
    cut = F.coalesce(*(F.when(F.instr(base, s) > 0, F.substring_index(base, s, 1)) for s in (".kh", ".ct", ".cg", ".countgraph")))
    return F.coalesce(cut, base)


def stats_name(path: Column) -> Column:
    return F.substring_index(F.element_at(F.split(path, "/"), -1), ".", 1)


def partition_of_name(name: Column) -> Column:
    """The integer after the last tab of a read name; a name without one is an error."""
    part = F.when(F.instr(name, "\t") > 0, F.element_at(F.split(name, "\t"), -1).try_cast("int"))
    return F.coalesce(part, F.raise_error(F.concat(F.lit("no partition id in "), name)).cast("int"))


def first_of_pair(name: Column) -> Column:
    """Whether a name is marked as that of a pair's first read (the pattern is a fixed value)."""
    return F.coalesce(name.rlike("^.+(/1| 1:[YN]:[0-9]+:[A-Za-z]+)"), F.lit(False))


def valid_pair(name1: Column, name2: Column) -> Column:
    """Names that end in /1 and /2, or whose second words start with 1: and 2:, after the same beginning."""
    by_slash = name1.rlike("/1$") & name2.rlike("/2$") & (F.regexp_replace(name1, "/1$", "") == F.regexp_replace(name2, "/2$", ""))
    word = r"^(\S+)\s+([12]):[YN]:\d+:[ACGTN0-9]+.*$"
    by_word = (F.regexp_extract(name1, word, 2) == "1") & (F.regexp_extract(name2, word, 2) == "2") & (F.regexp_extract(name1, word, 1) == F.regexp_extract(name2, word, 1))
    return by_slash | by_word


def _murmur(words: np.ndarray) -> np.ndarray:
    """The low half of the 128-bit MurmurHash3 (x64, seed 0) of each row of bytes."""
    u = np.uint64
    c1, c2 = u(0x87C37B91114253D5), u(0x4CF5AD432745937F)  # fixed values of the hash, as are the shifts and sums below
    turn = lambda x, n: (x << u(n)) | (x >> u(64 - n))
    count, size = words.shape
    padded = np.zeros((count, (size // 16 + 1) * 16), np.uint8)
    padded[:, :size] = words
    lanes = np.ascontiguousarray(padded).view("<u8")
    h1, h2 = np.zeros(count, u), np.zeros(count, u)
    with np.errstate(over="ignore"):
        for block in range(size // 16):
            h1 = h1 ^ turn(lanes[:, 2 * block] * c1, 31) * c2
            h1 = (turn(h1, 27) + h2) * u(5) + u(0x52DCE729)
            h2 = h2 ^ turn(lanes[:, 2 * block + 1] * c2, 33) * c1
            h2 = (turn(h2, 31) + h1) * u(5) + u(0x38495AB5)
        h1 = h1 ^ turn(lanes[:, -2] * c1, 31) * c2 ^ u(size)
        h2 = h2 ^ turn(lanes[:, -1] * c2, 33) * c1 ^ u(size)
        h1 = h1 + h2
        h2 = h2 + h1
        for m in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            h1, h2 = ((h ^ (h >> u(33))) * u(m) for h in (h1, h2))
        return (h1 ^ (h1 >> u(33))) + (h2 ^ (h2 >> u(33)))


def murmur_hash(kmer: Column) -> Column:
    """The 64 bits, as a BIGINT, of a k-mer's murmur hash and that of its other strand, by exclusive or."""

    def run(words: pd.Series) -> pd.Series:
        out = np.zeros(len(words), np.int64)
        sizes = words.str.len().fillna(-1).to_numpy()
        for size in np.unique(sizes[sizes >= 0]).astype(int):
            rows = np.flatnonzero(sizes == size)
            own = np.frombuffer("".join(words.iloc[rows]).encode("latin-1"), np.uint8).reshape(-1, size)
            mate = np.zeros(256, np.uint8)
            mate[np.frombuffer(b"ACGT", np.uint8)] = np.frombuffer(b"TGCA", np.uint8)
            out[rows] = (_murmur(own) ^ _murmur(mate[own][:, ::-1])).view(np.int64)
        return pd.Series(pd.arrays.IntegerArray(out, sizes < 0))  # not floats beside nulls

    return F.pandas_udf(run, "long")(kmer)
