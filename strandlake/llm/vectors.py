"""Vector search: vantage-point trees (approximate cosine) and a pivot-distance index (exact inner product).

Layout shared by both: vectors belong to the cell of their nearest pivot (the pivots are a bounded sample, the cells all
rows); large cells are dealt to shards of bounded size by a hash. A query first meets its own cell. The k-th best found there
bounds what other cells must offer: by the triangle inequality a cell whose span of distances, or whose border, is farther than that
is never sent the query. Queries of a cell are dealt to blocks of bounded size. A ranked window with a map-side limit
merges what the shards return. Tables smaller than two shards are one cell.

Defined cases: null, non-finite or (cosine) zero vectors take no part; vectors only meet vectors of the
same length; a vec_id never meets itself; a row repeated with the same vec_id and vector counts once; ties
go to the smaller vec_id; whole-number scores beyond 64 bits count as the largest or least long; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_tables, few, shared_table, ship

#: Rows of a shard, queries of a block, rows sampled as pivots, pivots.
SHARD, QUERY_BLOCK, SAMPLE, MAX_CELLS = 8192, 4096, 4096, 1024
LARGEST = 2**63 - 1


def valid_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", zero_ok: bool = True) -> DataFrame:
    x = F.transform(F.col(vec_col), lambda v: v.cast("double"))
    finite = F.forall("v", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    out = df.select(F.col(id_col).cast("long").alias("id"), x.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & finite)
    return out if zero_ok else out.where(F.exists("v", lambda v: v != 0))


def _matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    ids = table.column("id").to_numpy()
    flat = table.column("v").combine_chunks()
    flat = np.asarray((flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat).flatten(), dtype=np.float64)
    m = flat.reshape(len(ids), -1)
    order = np.argsort(ids, kind="stable")
    ids, m = ids[order], m[order]
    same = np.concatenate([[False], (ids[1:] == ids[:-1]) & (m[1:] == m[:-1]).all(axis=1)]) if len(ids) else np.zeros(0, bool)
    return ids[~same], np.ascontiguousarray(m[~same])


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    sq = np.einsum("ij,ij->i", a, a)[:, None] + np.einsum("ij,ij->i", b, b)[None] - 2.0 * (a @ b.T)
    return np.sqrt(np.maximum(0.0, sq))


class Cosine:
    """Directions: the nearest by angle are the nearest points of the unit sphere."""

    def points(self, m, dim):
        return m / np.sqrt(np.einsum("ij,ij->i", m, m))[:, None]

    queries = points

    def reach(self, scores, q, dim):
        """The distance within which a point has at least that score, with a slack above rounding."""
        return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * scores)) + 1e-6


class Product:
    """One more coordinate makes all vectors of a length as long as the longest, so the largest product is the nearest."""

    def __init__(self, longest: dict[int, float]):
        self.longest = longest

    def points(self, m, dim):
        return np.concatenate([m, np.sqrt(np.maximum(0.0, self.longest[dim] - np.einsum("ij,ij->i", m, m)))[:, None]], axis=1)

    def queries(self, m, dim):
        return np.concatenate([m, np.zeros((len(m), 1))], axis=1)

    def reach(self, scores, q, dim):
        own = np.einsum("ij,ij->i", q, q) + self.longest[dim]
        near = np.sqrt(np.maximum(0.0, own - 2.0 * scores)) + 1e-6 * (1.0 + np.sqrt(own))
        return np.where(np.abs(scores) >= float(LARGEST), np.inf, near)


def _by_length(batch: pa.RecordBatch):
    """(length, rows, matrix) of the vectors of each length."""
    column = batch.column("v")
    sizes, flat = column.value_lengths().to_numpy(zero_copy_only=False), column.flatten().to_numpy(zero_copy_only=False)
    start = np.cumsum(sizes) - sizes
    for dim in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == dim)
        yield dim, rows, flat[start[rows][:, None] + np.arange(dim)].astype(np.float64)


def _pivots(vectors: DataFrame, n: int, cells: int) -> dict[int, np.ndarray]:
    """Different vectors of a sample of about SAMPLE rows, for each length in proportion; none for a single cell."""
    if cells < 2:
        return {}
    wide = 1 << 40
    share = F.pmod(F.xxhash64("id", "v"), F.lit(wide)) < F.lit(max(1, wide * min(n, SAMPLE) // n))
    drawn: dict[int, dict[bytes, np.ndarray]] = {}
    for row in vectors.where(share).select("v").toArrow().to_batches():
        for dim, _, m in _by_length(row):
            drawn.setdefault(dim, {}).update((x.tobytes(), x) for x in m)
    total = sum(map(len, drawn.values()))
    rng = np.random.default_rng(7)
    out = {}
    for dim, found in sorted(drawn.items()):
        m = np.array([found[key] for key in sorted(found)])
        want = min(len(m), -(-cells * len(m) // total))
        out[dim] = m[np.sort(rng.permutation(len(m))[:want])]
    return out


def _place(rows: DataFrame, pivots: dict[int, np.ndarray], space, asked: bool) -> DataFrame:
    """(id, v, dim, cell, away): the nearest pivot and its distance; cell -1 for lengths without pivots."""

    def run(batches):
        for b in batches:
            cell, away = np.full(b.num_rows, -1, np.int32), np.zeros(b.num_rows)
            for dim, at, m in _by_length(b):
                if dim in pivots:
                    d = _distances((space.queries if asked else space.points)(m, dim), space.points(pivots[dim], dim))
                    cell[at] = d.argmin(axis=1)
                    away[at] = d[np.arange(len(at)), cell[at]]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("id", "v", "dim")), pa.array(cell), pa.array(away)], names=["id", "v", "dim", "cell", "away"])

    placed = rows.select("id", "v", F.size("v").alias("dim"))
    if not pivots:
        return placed.withColumns({"cell": F.lit(-1), "away": F.lit(0.0)})
    return placed.mapInArrow(run, "id long, v array<double>, dim int, cell int, away double")


def _route(asked: DataFrame, pivots: dict[int, np.ndarray], spans: dict[int, np.ndarray], space, relax: float) -> DataFrame:
    """(id, v, dim, cell) of the cells beside a query's own that can still hold one of its k best. asked: (id, v, least),
    least: the k-th best score so far or null; spans: least and largest distance from each pivot (NaN for empty cells)."""

    def run(batches):
        for b in batches:
            least = b.column("least").to_numpy(zero_copy_only=False).astype(np.float64)
            for dim, at, m in _by_length(b):
                if dim not in pivots:
                    continue
                q, (low, high) = space.queries(m, dim), spans[dim]
                d = _distances(q, space.points(pivots[dim], dim))
                own = d.argmin(axis=1)
                tau = np.where(np.isnan(least[at]), np.inf, space.reach(least[at], m, dim))
                border = (d - d.min(axis=1)[:, None]) / 2
                gap = np.maximum(border, np.maximum(d - high[None], low[None] - d))
                meets = ~(gap * relax > tau[:, None]) & ~np.isnan(high)[None]
                meets[np.arange(len(at)), own] = False
                for a in range(0, len(at), 64):  # bounds the vectors that a batch repeats
                    row, cell = np.nonzero(meets[a : a + 64])
                    if len(row):
                        take = pa.array(at[a + row])
                        yield pa.RecordBatch.from_arrays([*(b.column(c).take(take) for c in ("id", "v")), pa.array(np.full(len(row), dim, np.int32)), pa.array(cell.astype(np.int32))], names=["id", "v", "dim", "cell"])

    return asked.mapInArrow(run, "id long, v array<double>, dim int, cell int")


def search(vectors: DataFrame, queries: DataFrame, k: int, score_type: str, make, space=None, relax: float = 1.0, cells: int | None = None) -> DataFrame:
    """vectors, queries: (id, v). make(ids, matrix) -> find(query ids, query matrix, k) -> rows, ids, scores. space: Cosine or
    Product, by default the products of these vectors. Gaps between a query and a cell count relax times. cells: about how many."""
    spark = vectors.sparkSession
    ship(spark)
    vectors, queries = vectors.dropDuplicates(["id", "v"]), queries.dropDuplicates(["id", "v"])
    n = vectors.count()
    pivots = _pivots(vectors, n, min(MAX_CELLS, n // SHARD) if cells is None else cells)
    if space is None:
        square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
        longest = vectors.where(F.size("v").isin(list(pivots))).groupBy(F.size("v").alias("dim")).agg(F.max(square).alias("most")).collect() if pivots else []
        space = Product({r["dim"]: r["most"] for r in longest})
    on = ["dim", "cell"]
    placed = shared_table(_place(vectors, pivots, space, False))
    shards = F.ceil(F.count("*") / SHARD).cast("int").alias("shards")
    sizes = shared_table(placed.groupBy(on).agg(shards, F.min("away").alias("low"), F.max("away").alias("high")))
    tables = [placed, sizes]
    out_type = pa.int64() if score_type == "long" else pa.float64()
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", out_type)])

    def run(points: pa.Table, asked: pa.Table) -> pa.Table:
        if not points.num_rows or not asked.num_rows:
            return schema.empty_table()
        qids, q = _matrix(asked)
        rows, ids, scores = make(*_matrix(points))(qids, q, k)
        return pa.table([pa.array(qids[rows], pa.int64()), pa.array(ids, pa.int64()), pa.array(scores, out_type)], schema=schema)

    def meet(routed: DataFrame) -> DataFrame:
        """(query_id, vec_id, score) of the k best of each shard for the queries that are sent to its cell."""
        blocks = shared_table(routed.groupBy(on).agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("blocks")))
        tables.append(blocks)
        deal = lambda rows: rows.join(few(sizes.select(*on, "shards")), on).join(few(blocks), on)
        key = lambda m: F.pmod(F.xxhash64("id", "v"), F.col(m)).cast("int")
        every = lambda m: F.explode(F.sequence(F.lit(0), F.col(m) - 1))
        left = deal(placed.drop("away")).select("id", "v", *on, key("shards").alias("shard"), every("blocks").alias("block"))
        right = deal(routed).select("id", "v", *on, key("blocks").alias("block"), every("shards").alias("shard"))
        by = [*on, "shard", "block"]
        return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(run, f"query_id long, vec_id long, score {score_type}")

    def ranked(found: DataFrame) -> DataFrame:
        w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    best = ranked(meet(_place(queries, pivots, space, True).drop("away")))
    if pivots:
        best = shared_table(best)
        tables.append(best)
        spans = {dim: np.full((2, len(m)), np.nan) for dim, m in pivots.items()}
        for r in sizes.where("cell >= 0").collect():  # a row a pivot
            spans[r["dim"]][:, r["cell"]] = r["low"], r["high"]
        least = best.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").cast("double").alias("least"))
        others = meet(_route(queries.join(least, "id", "left").select("id", "v", "least"), pivots, spans, space, relax))
        best = ranked(best.drop("rank").unionByName(others))
    best = shared_table(best)
    drop_tables(*tables)
    return best


def _best(rows, ids, scores, k):
    """Of parallel (query row, id, score) arrays: the k best of each row, ties to the smaller id."""
    order = np.lexsort((ids, -scores, rows))
    rows, ids, scores = rows[order], ids[order], scores[order]
    start = np.searchsorted(rows, rows, side="left")
    keep = np.arange(len(rows)) - start < k
    return rows[keep], ids[keep], scores[keep]


class VantageTree:
    """A vantage-point tree over unit vectors; each child keeps the span of distances from its parent's point."""

    def __init__(self, ids: np.ndarray, m: np.ndarray, relax: float = 1.0, leaf: int = 48, seed: int = 7):
        self.ids, self.m, self.relax, self.leaf = ids, m, relax, leaf
        self.norm = np.sqrt(np.einsum("ij,ij->i", m, m))
        self.unit = m / self.norm[:, None]
        self.rng = np.random.default_rng(seed)
        self.root = self._build(np.arange(len(ids)))

    def _build(self, points):
        if len(points) <= self.leaf:
            return points
        pick = int(self.rng.integers(len(points)))
        d = self._dist(self.unit[points[pick]][None], self.unit[points])[0]
        mu = float(np.median(d))
        inner = d <= mu
        if inner.all():
            inner = d < mu
            if not inner.any():
                return points
        kids = [(float(d[s].min()), float(d[s].max()), self._build(points[s])) for s in (inner, ~inner)]
        return (points[pick], kids)

    @staticmethod
    def _dist(a, b):
        return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (a @ b.T)))

    def __call__(self, qids, q, k):
        qn = np.sqrt(np.einsum("ij,ij->i", q, q))
        unit = q / qn[:, None]
        best = np.full((len(q), k), -np.inf)
        got = np.full((len(q), k), np.iinfo(np.int64).max)

        def scan(points, act):
            rough = unit[act] @ self.unit[points].T  # which queries this leaf can still help; the rest costs more
            act = act[rough.max(axis=1) >= best[act, -1] - 1e-9]
            if not len(act):
                return
            s = np.einsum("ik,jk->ij", q[act], self.m[points]) / (qn[act][:, None] * self.norm[points][None])
            s[qids[act][:, None] == self.ids[points][None]] = -np.inf
            s = np.concatenate([best[act], s], axis=1)
            i = np.concatenate([got[act], np.broadcast_to(self.ids[points], (len(act), len(points)))], axis=1)
            order = np.lexsort((i, -s), axis=1)[:, :k]
            best[act], got[act] = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)

        def visit(node, act):
            if not len(act):
                return
            if isinstance(node, np.ndarray):
                return scan(node, act)
            point, kids = node
            d = self._dist(unit[act], self.unit[point][None])[:, 0]
            low = np.stack([np.maximum(0.0, np.maximum(lo - d, d - hi)) for lo, hi, _ in kids])
            middle = np.stack([np.abs(d - (lo + hi) / 2) - (hi - lo) / 2 for lo, hi, _ in kids])
            near = np.argmin(middle, axis=0)
            for turn in (0, 1):
                for c in (0, 1):
                    mine = near == c if turn == 0 else near != c
                    tau = np.where(np.isfinite(best[act, -1]), np.sqrt(np.maximum(0.0, 2.0 - 2.0 * best[act, -1])), np.inf)
                    visit(kids[c][2], act[mine & (low[c] * self.relax <= tau + 1e-9)])

        visit(self.root, np.arange(len(q)))
        rows, col = np.nonzero(np.isfinite(best))
        return rows, got[rows, col], best[rows, col]


def vantage_knn(vectors: DataFrame, queries: DataFrame, k: int = 5, relax: float = 4.0, cells: int | None = None) -> DataFrame:
    """The k nearest by cosine. relax divides the distance within which far sides of a tree are still visited;
    1 gives exact search, larger values prune more."""
    return search(vectors, queries, k, "double", lambda ids, m: VantageTree(ids, m, relax), Cosine(), relax, cells)


class PivotIndex:
    """Vectors keyed by (nearest pivot, distance to it), after the reduction of largest inner product to least
    distance (one more coordinate makes all lengths equal). Bounds carry a slack above rounding; scores are exact."""

    def __init__(self, ids: np.ndarray, m: np.ndarray, pivots: int = 16, seed: int = 7):
        self.ids, self.m = ids, m
        top = float(np.abs(m).max()) if m.size else 0.0
        self.top = top
        sq = np.einsum("ij,ij->i", m, m)
        self.cap = float(sq.max())
        self.aug = np.concatenate([m, np.sqrt(np.maximum(0.0, self.cap - sq))[:, None]], axis=1)
        self.pivot = self._pivots(min(pivots, len(ids)), np.random.default_rng(seed))
        d = self._dist(self.aug, self.pivot)
        own = d.argmin(axis=1)
        key = d[np.arange(len(ids)), own]
        order = np.lexsort((key, own))
        self.order, self.key = order, key[order]
        self.start = np.searchsorted(own[order], np.arange(len(self.pivot) + 1))

    def _pivots(self, n, rng):
        """Far-apart points, each the farthest of a few draws from those before it."""
        chosen = [self.aug[int(rng.integers(len(self.aug)))]]
        while len(chosen) < n:
            draw = self.aug[rng.integers(len(self.aug), size=32)]
            chosen.append(draw[self._dist(draw, np.array(chosen)).min(axis=1).argmax()])
        return np.array(chosen)

    _dist = staticmethod(_distances)

    def _scores(self, at, x):
        if self.m.shape[1] * float(np.abs(x).max()) * self.top < 2.0**52:
            return (self.m[at] @ x).astype(np.int64)  # whole numbers below 2**52: exact in any order
        exact = (sum(int(a) * int(b) for a, b in zip(row, x, strict=True)) for row in self.m[at])
        return np.array([max(-LARGEST, min(LARGEST, v)) for v in exact], dtype=np.int64)

    def __call__(self, qids, q, k):
        dq = self._dist(np.concatenate([q, np.zeros((len(q), 1))], axis=1), self.pivot)
        rows, ids, scores = [], [], []
        for i, x in enumerate(q):
            own = float(x @ x) + self.cap
            slack = 1e-6 * (1.0 + own**0.5)
            best_s, best_i, tau = np.zeros(0, np.int64), np.zeros(0, np.int64), np.inf

            def take(lo, hi):
                nonlocal best_s, best_i, tau
                at = self.order[lo:hi]
                at = at[self.ids[at] != qids[i]]
                if not len(at):
                    return
                s = self._scores(at, x)
                if len(best_s) == k:
                    at, s = at[s >= best_s[-1]], s[s >= best_s[-1]]
                s, j = np.concatenate([best_s, s]), np.concatenate([best_i, self.ids[at]])
                keep = np.lexsort((j, -s))[:k]
                best_s, best_i = s[keep], j[keep]
                if len(best_s) == k:
                    tau = max(0.0, own - 2.0 * float(best_s[-1])) ** 0.5 + slack

            for p in np.argsort(dq[i], kind="stable"):
                a, b, d = self.start[p], self.start[p + 1], dq[i, p]
                keys = self.key[a:b]
                mid = int(np.searchsorted(keys, d))
                left = right = mid
                width = 64
                while a < b:  # widen the annulus on both sides until the bound ends it
                    floor, roof = int(np.searchsorted(keys, d - tau)), int(np.searchsorted(keys, d + tau, side="right"))
                    to_left, to_right = max(left - width, floor), min(right + width, roof)
                    if to_left >= left and to_right <= right:
                        break
                    if to_left < left:
                        take(a + to_left, a + left)
                        left = to_left
                    if to_right > right:
                        take(a + right, a + to_right)
                        right = to_right
                    width *= 4
            rows.append(np.full(len(best_s), i))
            ids.append(best_i)
            scores.append(best_s)
        return np.concatenate(rows), np.concatenate(ids), np.concatenate(scores)


def pivot_top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, cells: int | None = None) -> DataFrame:
    """The k largest inner products of whole-number vectors, exactly."""
    return search(vectors, queries, k, "long", PivotIndex, cells=cells)


def embeddings(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def op1_vantage_ann(spark, sf_dir: str) -> DataFrame:
    v = valid_vectors(embeddings(spark, sf_dir), zero_ok=False)
    return vantage_knn(v, v.where(F.pmod("id", F.lit(50)) == 0))


def op9_pivot_top_k(spark, sf_dir: str) -> DataFrame:
    v = valid_vectors(embeddings(spark, sf_dir)).select("id", F.transform("v", lambda x: F.floor(x * 256).cast("double")).alias("v"))
    return pivot_top_k(v, v.where(F.pmod("id", F.lit(50)) == 0))


OP9_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(CAST(q.x AS DOUBLE[]), CAST(c.x AS DOUBLE[])) AS BIGINT) AS score
  FROM v q, v c WHERE q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
