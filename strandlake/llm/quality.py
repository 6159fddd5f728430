"""Quality of whole texts by pairwise ranking (Bradley-Terry): a text's worth is a weighed sum of its features, and the logistic loss of
differences of worth is least where good documents rank above bad ones.

1. Features of a text: counts and shares of words, letters, signs, lines and repetitions (FEATURES of them); none of labels, lang, source, doc_id.
2. Preference pairs: all labelled training rows, in order of a hash of doc_id, are dealt to blocks of about BLOCK rows of the more frequent label; each
   block meets one of the other label, of LEAST rows at least where there are so many, and every row is paired with PAIRS rows of the other label.
3. Weights by Newton's method on the logistic loss of the pairs' differences of features, with a ridge; no constant, since it cancels out.
   Blocks give their slopes and curvatures, which are summed in the order of blocks.
4. Threshold: the quantile of all training rows' worth at the share of bad ones. The score is the logistic function of the worth's distance from
   it, moved so that the quantile scores THRESHOLD.

Defined cases: null text is empty and scored; without good or without bad training rows every score is the smoothed share of good rows;
labels that are neither 0 nor 1 are not used, of several labels of a document the least is; repeated rows are kept; empty tables give empty results.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_remainder, drop_tables, shared_table, ship, texts, tidy

BLOCK, LEAST, HELD, PAIRS, WINDOW, THRESHOLD, FEATURES = 20_000, 2_000, 100_000, 8, 100, 0.7, 16
SIGNS = re.compile(r"[^\w\s.,;:'\"()?!-]").findall
ODD = re.compile(r"[^\W\d_][^\w\s'’-]+$|^\W+$").search
UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]").findall


def features(text: str) -> list[float]:
    """Logs of shares, so that a first odd word tells more than a hundredth."""
    words, lines = text.split(), text.split("\n")
    n, size = max(1, len(words)), max(1, len(text))
    windows = [words[i : i + WINDOW] for i in range(0, len(words), WINDOW)]
    distinct = sum(len(set(w)) for w in windows) / n
    low = [w.lower().strip(".,;:!?") for w in words]
    again = sum(a == b for a, b in zip(low, low[1:], strict=False)) / n
    odd = {w for w in set(words) if ODD(w)}
    shares = [
        len(SIGNS(text)) / size, text.count("|") / n, text.count("!") / n, again, 1 - distinct, len(UPPER(text)) / size,
        sum(map(str.isupper, words)) / n, sum(w in odd for w in words) / n, sum(map(str.isdigit, text)) / size,
        1 - len(set(lines)) / len(lines), sum(text.count(c) for c in ".?") / n, text.count(",") / n, sum(len(w) < 4 for w in words) / n,
    ]
    return [*(float(np.log1p(100 * s)) for s in shares), float(np.log1p(len(words))), float(np.log1p(size / n)), float(np.log1p(max(map(len, words), default=0)))]


def differences(good: np.ndarray, bad: np.ndarray, pairs: int = PAIRS) -> np.ndarray:
    """Of pairs of rows of good and bad: the k-th pair of row i meets row i * pairs + k of the other side."""
    a, b = np.arange(len(good)).repeat(pairs), np.arange(len(bad)).repeat(pairs)
    left = np.concatenate([a, np.arange(len(b)) % len(good)])
    right = np.concatenate([np.arange(len(a)) % len(bad), b])
    return good[left] - bad[right]


def slope(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The loss's slope and curvature over differences x, as one row of numbers."""
    p = 1 / (1 + np.exp(np.clip(x @ w, -30, 30)))  # how far the pair is from its order
    return np.concatenate([x.T @ p, ((x * (p * (1 - p) + 1e-9)[:, None]).T @ x).ravel()])


def newton(total, size: int, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Weights at which the loss is least. total: weights to the sum of slope() over all pairs."""
    w = np.zeros(size)
    for _ in range(rounds):
        got = total(w)
        step = np.linalg.solve(got[size:].reshape(size, size) + ridge * np.eye(size), got[:size] - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit_pairs(good: np.ndarray, bad: np.ndarray, pairs: int = PAIRS, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Weights of standardised features from pairs of rows of good and bad."""
    x = differences(good, bad, pairs)
    return newton(lambda w: slope(x, w), x.shape[1], ridge, rounds)


def quantile(values: DataFrame, n: int, share: float) -> float:
    """The exact quantile of the n rows (v), between the two nearest as numpy's: counted in ever narrower bins until at most HELD rows are left."""
    place = (n - 1) * share
    low, high = values.agg(F.min("v"), F.max("v")).first()
    under, left = 0, n
    while left > HELD and low < high:
        width = (high - low) / 1000
        bins = values.where(F.col("v").between(low, high)).groupBy(F.least(F.floor((F.col("v") - low) / width), F.lit(999)).alias("b"))
        found = bins.agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).orderBy("b").collect()  # at most 1000 rows
        held = []
        for r in found:
            if under + r["n"] <= np.floor(place) and not held:
                under += r["n"]
            elif not held or under + sum(h["n"] for h in held) <= np.ceil(place):
                held.append(r)
        if len(found) == len(held):
            break
        low, high, left = held[0]["low"], held[-1]["high"], sum(h["n"] for h in held)
    near = values.where(F.col("v").between(low, high)).groupBy("v").agg(F.count("*").alias("n")).orderBy("v").collect()  # at most about HELD rows
    ends = np.cumsum([r["n"] for r in near]) + under
    at = lambda i: near[int(np.searchsorted(ends, i, "right"))]["v"]
    first, last = at(np.floor(place)), at(np.ceil(place))
    return float(first + (last - first) * (place - np.floor(place)))


def learn(docs: DataFrame, labels: DataFrame, block: int = BLOCK, least: int = LEAST) -> dict:
    """{weights, middle (the threshold's worth), prior} from all labelled rows whose crc32 remainder by 4 is not 2."""
    ship(docs.sparkSession)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (crc_remainder(F.col("doc_id"), 4) != 2))
    known = shared_table(known.groupBy("doc_id").agg(F.min("quality").alias("quality")))

    def table(batches):
        for b in batches:
            f = [features(t.as_py()) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(f, pa.list_(pa.float64()))], names=["doc_id", "f"])

    rows, small = texts(docs).select("doc_id", "text"), known.count() <= 1_000_000
    if small:  # else features are joined, which are far smaller than texts
        rows = rows.join(F.broadcast(known.select("doc_id")), "doc_id")
    got = rows.mapInArrow(tidy("quality", table), "doc_id long, f array<double>")
    got = got.join(F.broadcast(known) if small else known, "doc_id").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("f").alias("f"))
    got = shared_table(got.select("doc_id", "quality", "f", F.xxhash64("doc_id").alias("h")))
    size = {r["quality"]: r["n"] for r in got.groupBy("quality").agg(F.count("*").alias("n")).collect()}  # two rows
    n, n_good = sum(size.values()), size.get(1, 0)
    prior = (n_good + 0.5) / (n + 1)
    if len(size) < 2:
        drop_tables(known, got)
        return {"weights": None, "middle": 0.0, "prior": prior}
    moments = lambda v: [r["m"] for r in got.select(F.posexplode("f").alias("i", "x")).groupBy("i").agg(v.alias("m")).orderBy("i").collect()]
    scale = np.maximum(np.array(moments(F.stddev_pop("x"))), 1e-6)
    often = int(n_good * 2 >= n)
    blocks = max(1, round(size[often] / block))
    others = min(blocks, max(1, size[1 - often] // least))
    deal = lambda label, parts, name: got.where(F.col("quality") == label).groupBy(F.pmod("h", F.lit(parts)).alias("part")).agg(F.array_sort(F.collect_list(F.struct("h", "doc_id", "f")))["f"].alias(name))
    first = deal(often, blocks, "often").select(F.col("part").alias("block"), F.pmod("part", F.lit(others)).alias("part"), "often")
    dealt = shared_table(first.join(deal(1 - often, others, "rare"), "part").select("block", "often", "rare"))

    def total(w: np.ndarray) -> np.ndarray:
        def run(batches):
            for b in batches:
                sums = []
                for x, y in zip(b.column("often"), b.column("rare"), strict=True):
                    x, y = (np.array(v.values.flatten()).reshape(-1, FEATURES) / scale for v in (x, y))
                    sums.append(slope(differences(x, y) if often else differences(y, x), w))
                yield pa.RecordBatch.from_arrays([b.column("block"), pa.array(sums, pa.list_(pa.float64()))], names=["block", "s"])

        return np.sum([r["s"] for r in dealt.mapInArrow(run, "block long, s array<double>").orderBy("block").collect()], axis=0)  # a row of fixed length a block

    weights = (newton(total, FEATURES) / scale).tolist()
    worth = F.aggregate(F.arrays_zip("f", F.array(*map(F.lit, weights)).alias("w")), F.lit(0.0), lambda acc, x: acc + x["f"] * x["w"])
    values = shared_table(got.select(worth.alias("v")))
    middle = quantile(values, n, 1 - n_good / n)
    drop_tables(known, got, dealt, values)
    return {"weights": weights, "middle": middle, "prior": prior}


def probability(model: dict, threshold: float = THRESHOLD):
    """A function of a text column: the score, threshold at the model's quantile."""

    @F.arrow_udf("double")
    def worth(text: pa.Array) -> pa.Array:
        if model["weights"] is None:
            return pa.array(np.full(len(text), model["prior"]))
        f = np.array([features(t.as_py() or "") for t in text]).reshape(len(text), FEATURES)
        return pa.array(1 / (1 + np.exp(-np.clip(f @ np.array(model["weights"]) - model["middle"] + np.log(threshold / (1 - threshold)), -30, 30))))

    return worth


def score(docs: DataFrame, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    """All columns of docs, with score and predicted (columns of these names are replaced)."""
    ship(docs.sparkSession)
    scored = docs.withColumn("score", probability(model, threshold)("text"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op12_quality_ranking(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held = (crc_remainder(F.col("doc_id"), 4) == 2).alias("held_out")
    return score(texts(docs), model).select("doc_id", held, "score", "predicted")
