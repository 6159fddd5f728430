"""Hidden Markov language model: Baum-Welch counts summed by Spark, exact likelihood by the scaled forward recursion.

Words: A-Z lower-cased, cut at ASCII white space, then one end. The states emit every word; a state's emission is its expected
count of the word plus STRENGTH times its share of the unigram (c + 0.1), so a word that training lacks is emitted as well.

1. Texts are tokenised once, where they are read, into cells of up to CELL_TOKENS tokens: ids in the cell's own word list, which
   is sorted by 128-bit hashes of the words. Blocks are ranges of these hashes, so a cell's list is a row of block slices.
2. For each block the slices of all cells are numbered in the block's words and their training counts summed, once.
3. A round has two steps: cells meet their slices of the emissions, run forward and backward over their training texts and
   write slices of expected counts; then the blocks add the counts up and cut the next emissions for the cells. Slices
   are 32-bit floats. No worker and no driver holds the table of all words, and what is gathered grows with the corpus.
   Each step goes over one of up to RUNS shares of the cells (of the blocks) after the other; what a share has read is deleted, with
   its shuffle, before the next one starts, so the disk holds little more than the slices once.
4. After PLAIN rounds a step is over-relaxed: new = old * (re-estimated / old) ** RELAX, normalised. It has the fixed points of the
   plain step and converges where that does for any factor below 2, in fewer rounds.
5. Rounds end when the log likelihood a token rises by less than TOLERANCE a round over two rounds (an over-relaxed step may
   swing); no count ends them (the likelihood is bounded, so they do end). One more round makes the emissions that score.

Training and scores run over whole texts: the forward operators (K x K, scaled) of a long text's chunks are computed side by
side and chained, and so transitions across the borders of chunks count like all others.

Defined cases: null text is empty (one end token); without training rows counts are zero and the model is the base
score; every row is scored, repeated ones too; ids may be null; an empty table gives an empty result; other columns stay.
"""

from __future__ import annotations

from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_remainder, drop_folders, drop_tables, shared_parts, shared_runs, ship, texts, tidy

STATES, PLAIN, RELAX, TOLERANCE, CELL_TOKENS, BLOCK_PAIRS = 6, 2, 1.8, 0.005, 4_000_000, 131_072
END = " end"  # holds a space, so no word equals it
STRENGTH, STICK, BATCH_TOKENS, TURNS, RUNS, RUN_CELLS = 0.1, 20.0, 200_000, 64, 4, 20


def words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


class Model:
    """start (K), move (K, K), emit (words + 1, K); the last row of emit is the class of all other tokens."""

    def __init__(self, start, move, emit):
        self.start, self.move, self.emit = start, move, emit

    @staticmethod
    def first(p: np.ndarray, k: int, seed: int = 11) -> Model:
        """Unigram shares shaken word by word, and states that last: segments of like words soon share a state."""
        emit = p[:, None] * np.random.default_rng(seed).gamma(0.7, 1.0, (len(p), k))
        return Model(np.full(k, 1 / k), lasting(k), emit / np.maximum(emit.sum(axis=0), 1e-300))


def lasting(k: int) -> np.ndarray:
    return np.full((k, k), 0.02 / max(1, k - 1)) + np.eye(k) * (0.98 - 0.02 / max(1, k - 1))


def operators(model: Model, ids: np.ndarray, begin: np.ndarray, size: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """The forward operators (K x K, scaled) of ids[begin : begin + size]; the ones inside a text begin with a move."""
    k = len(model.start)
    order = np.argsort(-size, kind="stable")
    live = np.searchsorted(-size[order], -np.arange(size.max()), side="left")
    op = np.where(inside[order, None, None], model.move, np.eye(k)) * model.emit[ids[begin[order]]][:, None, :]
    for t in range(1, len(live)):
        n = live[t]
        x = (op[:n].reshape(-1, k) @ model.move).reshape(-1, k, k) * model.emit[ids[begin[order[:n]] + t]][:, None, :]
        op[:n] = x / x.sum(axis=(1, 2))[:, None, None]
    out = np.empty_like(op)
    out[order] = op
    return out


def expect(model: Model, ids: np.ndarray, begin: np.ndarray, size: np.ndarray, start: np.ndarray, move: np.ndarray, emit: np.ndarray, whole: int = 4096, chunk: int = 256) -> float:
    """Adds the expected counts of the texts ids[begin : begin + size] to start, move and emit; returns their log likelihood.
    Texts of more than whole ids are taken in chunks, each with what the chained operators bring to both of its ends.
    All texts take a step at once: the rows of a step follow each other, longest texts first, so texts of like sizes are quick.
    Shares of states are kept in the type of emit (a share is no less than a move's pseudo-count gives it), sums in the types given."""
    k = len(model.start)
    parts = np.where(size > whole, -(-size // chunk), 1)
    row, first = np.repeat(np.arange(len(size)), parts), np.cumsum(parts) - parts
    nth = np.arange(len(row)) - first[row]
    begin, size = begin[row] + nth * chunk, np.where(parts[row] > 1, np.minimum(chunk, size[row] - nth * chunk), size[row])
    enter, leave, before = np.tile(model.start, (len(row), 1)), np.ones((len(row), k)), np.zeros((len(row), k))
    cut = np.flatnonzero(parts[row] > 1)
    if len(cut):
        op = dict(zip(cut.tolist(), operators(model, ids, begin[cut], size[cut], nth[cut] > 0), strict=True))
        for d in np.flatnonzero(parts > 1):
            x, y, own = model.start, np.ones(k), range(first[d], first[d] + parts[d])
            for j in own[:-1]:
                x = x @ op[j]
                x = x / x.sum()
                before[j + 1], enter[j + 1] = x, x @ model.move
            for j in own[:0:-1]:
                y = op[j] @ y
                y = y / y.max()
                leave[j - 1] = y
    order = np.argsort(-size, kind="stable")
    begin, size, enter, leave, before, opens = begin[order], size[order], enter[order], leave[order], before[order], nth[order] == 0
    longest = int(size[0])
    live = np.append(np.searchsorted(-size, -np.arange(longest), side="left"), 0)  # chunks longer than t
    at = np.append(0, np.cumsum(live))
    step = np.repeat(np.arange(longest), live[:-1])
    w = ids[begin[np.arange(len(step)) - at[step]] + step]
    back, live, at = model.emit.take(w, axis=0), live.tolist(), at.tolist()
    kind = back.dtype
    a, beta, scale = np.empty_like(back), np.empty_like(back), np.empty(len(w), kind)
    across, enter, leave, ones = model.move.astype(kind), enter.astype(kind), leave.astype(kind), np.ones(k, kind)
    for t in range(longest):
        i, j = at[t], at[t + 1]
        x = a[i:j]
        if t:
            np.matmul(a[at[t - 1] : at[t - 1] + j - i], across, out=x)
            x *= back[i:j]
        else:
            np.multiply(enter, back[:j], out=x)
        np.matmul(x, ones, out=scale[i:j])
        x /= scale[i:j, None]
    back /= scale[:, None]
    for t in range(longest - 1, -1, -1):
        i, j, n, m = at[t], at[t + 1], live[t + 1], live[t]
        np.matmul(back[j : j + n], across.T, out=beta[i : i + n])
        if n < m:
            beta[i + n : j] = leave[n:m] / (a[i + n : j] * leave[n:m]).sum(axis=1, keepdims=True)
        back[i:j] *= beta[i:j]
    before = np.concatenate([before.astype(kind), *(a[i : i + n] for i, n in zip(at, live[1:-1], strict=False))])
    move += (before.T @ back) * model.move
    a *= beta
    start += a[: live[0]][opens].sum(axis=0, dtype=float)
    np.add.at(emit.reshape(-1), (w.astype(np.int64)[:, None] * k + np.arange(k)).reshape(-1), a.reshape(-1).astype(float))
    return float(np.log(scale, dtype=float).sum())


def log_likelihood(model: Model, docs: list[np.ndarray], whole: int = 4096, chunk: int = 256) -> np.ndarray:
    """Natural log of the probability of each whole sequence of ids, by the scaled forward recursion. Sequences of up to
    whole ids go side by side; the full chunks of longer ones are K x K operators, all computed side by side, then chained."""
    k = len(model.start)
    flat = np.concatenate(docs)
    size = np.array([len(d) for d in docs])
    begin = np.cumsum(size) - size
    total, state = np.zeros(len(docs)), np.broadcast_to(model.start, (len(docs), k)).copy()
    full = np.where(size > whole, size // chunk, 0)
    if full.any():
        owner = np.repeat(np.arange(len(docs)), full)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(full) - full, full)
        at = begin[owner] + nth * chunk
        logs = np.zeros(len(owner))
        op = np.where((nth == 0)[:, None, None], np.eye(k)[None], model.move[None]) * model.emit[flat[at]][:, None, :]
        for t in range(1, chunk):
            op = (op.reshape(-1, k) @ model.move).reshape(-1, k, k) * model.emit[flat[at + t]][:, None, :]
            s = op.sum(axis=(1, 2))
            op /= s[:, None, None]
            logs += np.log(s)
        for j, i in enumerate(owner.tolist()):
            x = state[i] @ op[j]
            s = x.sum()
            state[i], total[i] = x / s, total[i] + np.log(s) + logs[j]
    done = full * chunk
    left = size - done
    order = np.flatnonzero(left > 0)
    order = order[np.argsort(-left[order], kind="stable")]
    if len(order):
        live = np.searchsorted(-left[order], -np.arange(left[order[0]]), side="left")
        at = begin[order] + done[order]
        x = np.where((done[order] > 0)[:, None], state[order] @ model.move, state[order]) * model.emit[flat[at]]
        for t in range(len(live)):
            n = live[t]
            if t:
                x = (x[:n] @ model.move) * model.emit[flat[at[:n] + t]]
            s = x.sum(axis=1)
            total[order[:n]] += np.log(s)
            x = x / s[:, None]
    return total


def cells(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Texts dealt to cells, as two tables written at once, with a folder for each share of the cells: (cell, ids, size, learn, rows, place), the ids of the texts one after the
    other, ranked by frequency and packed, sizes, which texts train, docs' other columns, and the ids of the cell's words in
    order of their hashes; and (cell, hashes, c), these hashes and the counts in the cell's training texts."""
    from pyspark.sql.pandas.types import to_arrow_schema

    kept = docs.drop("text")
    kind = pa.struct(list(to_arrow_schema(kept.schema)))
    schema = pa.schema([("part", pa.int32()), ("share", pa.int32()), ("cell", pa.int64()), ("ids", pa.binary()), ("size", pa.binary()), ("learn", pa.binary()), ("rows", pa.list_(kind)), ("place", pa.binary()), ("hashes", pa.binary()), ("c", pa.binary())])

    def run(batches):
        import xxhash
        import zstandard
        from pyspark import TaskContext

        local: dict[bytes, int] = {}
        ids, size, held, nth = array("i"), array("i"), [], TaskContext.get().partitionId() << 32

        def out():
            nonlocal nth
            own, lengths = np.array(ids, np.int32), np.array(size, np.int32)
            learn = np.array([bool(r["learn"]) for r in held], np.uint8)
            by_rank = np.argsort(-np.bincount(own, minlength=len(local)), kind="stable")
            rank = np.empty(len(local), np.int32)
            rank[by_rank] = np.arange(len(local), dtype=np.int32)
            own = rank[own]
            digest = xxhash.xxh3_128_digest
            hashes = np.frombuffer(b"".join([digest(w) for w in local]), ">u8").reshape(-1, 2)
            order = np.lexsort((hashes[:, 1], hashes[:, 0]))
            place = rank[order]
            c = np.bincount(own[np.repeat(learn, lengths).astype(bool)], minlength=len(local))[place].astype("<i4")
            pack = zstandard.ZstdCompressor(level=1).compress
            planes = np.ascontiguousarray(own.astype("<u4").view(np.uint8).reshape(-1, 4).T)
            share = ((nth >> 32) + (nth & 0xFFFFFFFF)) % RUNS
            rows = ((0, share, nth, pack(planes.tobytes()), lengths.tobytes(), learn.tobytes(), held, place.astype("<i4").tobytes(), None, None), (1, share, nth, None, None, None, None, None, hashes[order].tobytes(), c.tobytes()))
            both = [pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, schema, strict=True)], schema=schema) for row in rows]
            local.clear()
            held.clear()
            del ids[:], size[:]
            nth += 1
            return both

        for b in batches:
            for row in b.to_pylist():
                w = [*words(row.pop("text")), END.encode()]
                ids.extend([local.setdefault(x, len(local)) for x in w])
                size.append(len(w))
                held.append(row)
                if len(ids) >= CELL_TOKENS:
                    yield from out()
        if size:
            yield from out()

    made = docs.mapInArrow(tidy("hmm", run), f"part int, share int, cell long, ids binary, size binary, learn binary, rows array<{kept.schema.simpleString()}>, place binary, hashes binary, c binary")
    return shared_parts(made, ["part", "share"], [["cell", "ids", "size", "learn", "rows", "place", "share"], ["cell", "hashes", "c", "share"]])


def unpacked(cell: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ids, sizes, learn and place of the one row of a cell."""
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(cell.column("ids")[0].as_py()), np.uint8).reshape(4, -1)
    ids = np.ascontiguousarray(raw.T).view("<u4").reshape(-1).astype(np.int32)
    of = lambda name, kind: np.frombuffer(cell.column(name)[0].as_py(), kind)
    return ids, of("size", "<i4").astype(np.int64), of("learn", np.uint8).astype(bool), of("place", "<i4")


@dataclass
class Trained:
    """lists: the cells' words (deleted once the index is made, unless train is told to keep it). emissions (block, cell, em): the slices of
    all cells, 32-bit floats (word, state), and c, the words' counts; runs: the shares of cells that are gone over one after the other; the emission of a word is its float over total. tokens and types: of the training rows. likelihoods: natural logs a token, round by round."""

    made: DataFrame
    lists: DataFrame | None
    emissions: DataFrame
    tokens: int
    types: int
    start: np.ndarray
    move: np.ndarray
    total: np.ndarray
    likelihoods: list[float]
    runs: list[list[int]]


def index(lists: DataFrame) -> DataFrame:
    """(block, cell, at, hashes, c, share of the blocks): for each block and cell the places of the cell's words in the block's; where cell is -1,
    the block's words and their training counts."""
    pairs = lists.agg(F.sum(F.length("c") / 4)).first()[0] or 0
    bits = max(0, int(pairs // BLOCK_PAIRS).bit_length())

    def slices(batches):
        for b in batches:
            for cell, hashes, c in zip(*(b.column(x).to_pylist() for x in ("cell", "hashes", "c")), strict=True):
                top = np.frombuffer(hashes, ">u8").reshape(-1, 2)[:, 0] >> np.uint64(64 - bits) if bits else np.zeros(len(c) // 4, np.uint64)
                cuts = np.concatenate([[0], np.flatnonzero(np.diff(top.astype(np.int64))) + 1, [len(top)]]).tolist()
                for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                    yield pa.RecordBatch.from_arrays([pa.array([int(top[i])], pa.int64()), pa.array([cell], pa.int64()), pa.array([hashes[16 * i : 16 * j]], pa.binary()), pa.array([c[4 * i : 4 * j]], pa.binary())], names=["block", "cell", "hashes", "c"])

    def number(key, rows):
        raw = rows.column("hashes").to_pylist()
        sizes = np.array([len(x) // 16 for x in raw])
        word, where = np.unique(np.frombuffer(b"".join(raw), "V16"), return_inverse=True)
        c = np.bincount(where, np.frombuffer(b"".join(rows.column("c").to_pylist()), "<i4"), minlength=len(word)).astype("<i8")
        ends = np.cumsum(sizes)
        at = [where[e - n : e].astype("<i4").tobytes() for e, n in zip(ends, sizes, strict=True)]
        none = [None] * len(at)
        return pa.table({"block": pa.array([key[0].as_py()] * (len(at) + 1), pa.int64()), "cell": pa.array([*rows.column("cell").to_pylist(), -1], pa.int64()), "at": pa.array([*at, None], pa.binary()), "hashes": pa.array([*none, word.tobytes()], pa.binary()), "c": pa.array([*none, c.tobytes()], pa.binary())})

    dealt = lists.mapInArrow(tidy("hmm", slices), "block long, cell long, hashes binary, c binary")
    return shared_runs([dealt.groupBy("block").applyInArrow(number, "block long, cell long, at binary, hashes binary, c binary").withColumn("share", block_share())], "share")


EMISSIONS = "block long, cell long, em binary, c binary, sums array<double>"


def block_share():
    return F.pmod(F.col("block"), F.lit(RUNS)).cast("int")


def cell_share():
    """The share that the cell was written with; RUNS for the blocks' own rows."""
    nth = F.shiftright("cell", 32) + F.col("cell").bitwiseAND(F.lit(0xFFFFFFFF))
    return F.when(F.col("cell") < 0, RUNS).otherwise(F.pmod(nth, F.lit(RUNS))).cast("int")


def in_shares(count: int) -> list[list[int]]:
    """The shares that are gone over at once, run after run: few cells are one run."""
    n = next(n for n in (RUNS, 2, 1) if n == 1 or count >= n * RUN_CELLS)
    return [list(range(i * RUNS // n, (i + 1) * RUNS // n)) for i in range(n)]


def relaxed(new: np.ndarray, old: np.ndarray, power: float) -> np.ndarray:
    """new where power is 1, beyond it (seen from old) where it is more; factors common to a state's values may differ."""
    return new if power == 1 else new * (new / old) ** (power - 1)


def emissions(indexed: DataFrame, found: DataFrame | None, k: int, tokens: int, types: int, last: bool, power: float = 1.0, runs: list[list[int]] | None = None) -> DataFrame:
    """EMISSIONS rows for all cells from the expected counts found (block, cell, em), which are deleted share by share, or first ones. In the rows of cell -1, em is a
    block's whole table and sums are the sums by state of its training words, in those of cell -2 the sums of the start, of moves, and
    of the log likelihood. found holds the rows of cell -1 of the round before as well where power is not 1."""
    strength = STRENGTH * max(tokens, 1) / k
    schema = pa.schema([("block", pa.int64()), ("cell", pa.int64()), ("em", pa.binary()), ("c", pa.binary()), ("sums", pa.list_(pa.float64()))])

    def give(block, rows, sent):
        out = []
        if block < 0:
            total = np.sum([np.frombuffer(x, "<f8") for x in sent.column("em").to_pylist()], axis=0)
            out.append((block, -2, None, None, total))
        else:
            cell, at = rows.column("cell").to_pylist(), rows.column("at").to_pylist()
            own = cell.index(-1)
            c = np.frombuffer(rows.column("c")[own].as_py(), "<i8")
            sums = np.zeros((len(c), k))
            if sent is None:  # unigram shares shaken word by word
                h = np.frombuffer(rows.column("hashes")[own].as_py(), "<u8").reshape(-1, 2)
                for j in range(k):
                    with np.errstate(over="ignore"):
                        x = (h[:, 0] ^ np.uint64(j + 1)) * np.uint64(0x9E3779B97F4A7C15) ^ h[:, 1]
                        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                    sums[:, j] = c / k * -np.log(((x >> np.uint64(11)) + np.uint64(1)) / float((1 << 53) + 1))
            else:
                places = dict(zip(cell, at, strict=True))
                for who, em in zip(sent.column("cell").to_pylist(), sent.column("em").to_pylist(), strict=True):
                    em = np.frombuffer(em, "<f4").reshape(-1, k)
                    if who < 0:
                        old = em
                    else:
                        sums[np.frombuffer(places[who], "<i4")] += em
            table = sums + (strength * (c + 0.1) / (tokens + 0.1 * (types + 1)))[:, None]
            if power != 1:
                table = relaxed(table, old, power)
            kept, table = table[c > 0].sum(axis=0), table.astype("<f4")
            out.append((block, -1, table.tobytes(), None, kept))
            for who, x in zip(cell, at, strict=True):
                if who >= 0:
                    x = np.frombuffer(x, "<i4")
                    out.append((block, who, table[x].tobytes(), c[x].tobytes() if last else None, None))
        return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    def made():
        for shares in runs or in_shares(0):
            own = indexed.where(F.col("share").isin(shares)).drop("share").groupBy("block")
            if found is None:
                new = own.applyInArrow(lambda key, rows: give(key[0].as_py(), rows, None), EMISSIONS)
            else:
                met = own.cogroup(found.where(F.col("share").isin(shares)).drop("share").groupBy("block"))
                new = met.applyInArrow(lambda key, rows, sent: give(key[0].as_py(), rows, sent), EMISSIONS)
            yield new.withColumn("share", cell_share())
            if found is not None:
                drop_folders(found, "share", shares)

    return shared_runs(made(), "share")


def totals(table: DataFrame, cell: int) -> np.ndarray:
    """The sums of the rows of that cell, added up by Spark: as many numbers as one row has."""
    rows = table.where((F.col("share") == RUNS) & (F.col("cell") == cell)).select(F.posexplode("sums").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x"))
    return np.array([r["x"] for r in sorted(rows.collect(), key=lambda r: r["i"])])


def meet(made: DataFrame, table: DataFrame, shares: list[int], k: int, model, run, schema: str, *columns: str) -> DataFrame:
    """run(Model of a cell's words, slices, cell) for all cells of the shares."""
    start, move, total = model

    def task(key, slices, cell):
        slices = slices.take(np.argsort(slices.column("block").to_numpy()))
        raw = slices.column("em").to_pylist()
        em = np.concatenate([np.frombuffer(x, "<f4") for x in raw]).reshape(-1, k) / total
        return run(em, start, move, slices, cell)

    cells_ = made.where(F.col("share").isin(shares)).select("cell", "ids", "size", "learn", "place", *columns)
    return table.where(F.col("share").isin(shares)).drop("share").groupBy("cell").cogroup(cells_.groupBy("cell")).applyInArrow(task, schema)


def spread(size: np.ndarray):
    """Runs of texts (from, to) of about BATCH_TOKENS tokens."""
    ends, a = np.cumsum(size), 0
    while a < len(size):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + BATCH_TOKENS, side="right")))
        yield a, b
        a = b


def train(docs: DataFrame, states: int = STATES, rounds: int | None = None, tolerance: float = TOLERANCE, relax: float = RELAX, keep_lists: bool = False) -> Trained:
    """Baum-Welch over the rows of docs (text, learn, ...) whose learn is true, until the tolerance is met or, if given, for that many
    rounds; the other rows can be scored with them. relax 1 takes plain steps only."""
    ship(docs.sparkSession)
    k, (made, lists) = states, cells(docs)
    indexed = index(lists)
    if not keep_lists:
        drop_tables(lists)
    words_ = indexed.where("cell = -1").select("c").mapInArrow(_count, "tokens long, types long")
    tokens, types = (int(x or 0) for x in words_.agg(F.sum("tokens"), F.sum("types")).first())
    start, move, likelihoods = np.full(k, 1 / k), lasting(k), []
    unseen = np.full(k, STRENGTH * max(tokens, 1) / k * 0.1 / (tokens + 0.1 * (types + 1)))  # a word that training lacks
    other, rounds = unseen, rounds if tokens else 0
    runs = in_shares(made.count())
    table = emissions(indexed, None, k, tokens, types, rounds == 0, 1.0, runs)

    def run(em, start, move, slices, cell):
        ids, size, learn, place = unpacked(cell)
        emit = np.empty_like(em, dtype="f4")
        emit[place] = em
        begin = np.cumsum(size) - size
        by_size = np.argsort(-size, kind="stable")
        by_size = by_size[learn[by_size]]
        begin, size = begin[by_size], size[by_size]
        s, m, e, like = np.zeros(k), np.zeros((k, k)), np.zeros((len(em), k)), 0.0
        for a, b in spread(size):
            like += expect(Model(start, move, emit), ids, begin[a:b], size[a:b], s, m, e)
        e = e[place]
        blocks, who = slices.column("block").to_pylist(), slices.column("cell")[0].as_py()
        ends = np.cumsum([len(x) // (4 * k) for x in slices.column("em").to_pylist()])
        parts = [e[a:b].astype("<f4").tobytes() for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        scalars = np.concatenate([s, m.reshape(-1), [like]]).astype("<f8").tobytes()
        return pa.table({"block": pa.array([*blocks, -1 - who % TURNS], pa.int64()), "cell": pa.array([who] * (len(parts) + 1), pa.int64()), "em": pa.array([*parts, scalars], pa.binary())})

    def counts(table, model, power):
        """The cells' expected counts, run by run; what a run's cells were sent is deleted when it is through, with its shuffle."""
        for shares in runs:
            yield meet(made, table, shares, k, model, run, "block long, cell long, em binary").withColumn("share", block_share())
            drop_folders(table, "share", shares)
        if power != 1:
            yield table.where((F.col("share") == RUNS) & (F.col("cell") == -1)).select("block", "cell", "em", block_share().alias("share"))

    settled = False
    while rounds is None or len(likelihoods) < rounds:
        last, power = settled or len(likelihoods) + 1 == rounds, relax if len(likelihoods) >= PLAIN else 1.0
        found = shared_runs(counts(table, (start, move, totals(table, -1) + other), power), "share")
        drop_tables(table)
        new = emissions(indexed, found, k, tokens, types, last, power, runs)
        sums = totals(new, -2)
        likelihoods.append(float(sums[-1]) / tokens)
        start = relaxed((1 + sums[:k]) / (1 + sums[:k]).sum(), start, power)
        start = start / start.sum()
        moved = np.eye(k) * STICK + 1.0 + sums[k:-1].reshape(k, k)
        move = relaxed(moved / moved.sum(axis=1, keepdims=True), move, power)
        move, other = move / move.sum(axis=1, keepdims=True), relaxed(unseen, other, power)
        drop_tables(found)
        table = new
        if last:
            break
        settled = len(likelihoods) > 2 and likelihoods[-1] - likelihoods[-3] < 2 * tolerance  # one more round, whose emissions score
    total = (totals(table, -1) if tokens else np.zeros(k)) + other
    drop_tables(indexed)
    return Trained(made, lists if keep_lists else None, table, tokens, types, start, move, total, likelihoods, runs)


def _count(batches):
    for b in batches:
        c = [np.frombuffer(x, "<i8") for x in b.column("c").to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([int(x.sum()) for x in c], pa.int64()), pa.array([int((x > 0).sum()) for x in c], pa.int64())], names=["tokens", "types"])


def score(m: Trained) -> DataFrame:
    """All rows that train was given: their columns but text and learn, with n_tokens, n_known, train_tokens, base_score and score."""
    kept = m.made.schema["rows"].dataType.elementType
    names = [f.name for f in kept.fields if f.name != "learn"]
    below, k, n_all = float(np.log10(m.tokens + 0.1 * (m.types + 1))), len(m.start), m.tokens

    def run(em, start, move, slices, cell):
        ids, size, _, place = unpacked(cell)
        emit, c = np.empty_like(em, dtype=float), np.empty(len(em))
        emit[place] = em
        c[place] = np.concatenate([np.frombuffer(x, "<i8") for x in slices.column("c").to_pylist()])
        begin, logs = np.cumsum(size) - size, np.log10(c + 0.1)
        per = lambda x: np.add.reduceat(x[ids], begin)
        model = Model(start, move, emit)
        hmm = np.concatenate([log_likelihood(model, [ids[i : i + n] for i, n in zip(begin[a:b], size[a:b], strict=True)]) for a, b in spread(size)])
        rows, base = cell.column("rows").combine_chunks().values, per(logs) - size * below
        hmm = np.minimum(hmm / np.log(10), 0.0) if n_all else base  # no rounding above certainty
        cols = [*(rows.field(x) for x in names), pa.array(size), pa.array(per((c > 0).astype(np.int64))), pa.array(np.full(len(size), n_all)), pa.array(base), pa.array(hmm)]
        return pa.Table.from_arrays(cols, names=[*names, "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.fields if f.name != "learn"), "n_tokens long, n_known long, train_tokens long, base_score double, score double"])
    return shared_runs((meet(m.made, m.emissions, shares, k, (m.start, m.move, m.total), run, schema, "rows") for shares in m.runs))


def op10_hmm_scores(spark, sf_dir: str) -> DataFrame:
    docs = texts(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumn("held_out", crc_remainder(F.col("doc_id"), 10) == 0)
    return score(train(docs.withColumn("learn", ~F.col("held_out"))))
