"""Toxicity of whole texts: a lexicon learnt from labelled rows, met through a Levenshtein automaton run over the
lexicon's trie, with every hit weighed by the window of words around it.

1. Lexicon: of at most TRAIN_ROWS labelled training rows (those first by a hash of doc_id), words and word beginnings
   that toxic documents hold far more often than others.
2. Matching: the automaton for one edit and the trie are intersected and made deterministic as they are walked, so a
   word costs one step a letter. Terms of five letters and more may be misspelled by one edit after their first letter; beginnings may not.
3. Window: a hit between quotation marks or after a word of report counts little; one near an address to the reader
   or near other hits counts more.
4. A logistic model on the weighed hits, fitted to the same rows, gives the score.

Defined cases: null text is empty and scored; without toxic or without clean training rows every score is the smoothed
share of toxic rows; labels, lang, source and doc_id are no inputs of a score; repeated rows are kept.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cache, crc_remainder, ship, texts, tidy

BEGIN = (4, 5, 6, 7, 8)
TRAIN_ROWS, MIN_RATIO, WINDOW, CACHE_WORDS = 20_000, 25.0, 8, 120_000
WORD = re.compile(r"[^\W_]+")
QUOTES = '"“”„«»'
#: Words of report before a quotation and words that address a reader.
REPORT = frozenset("said says quote quoted quotes quoting word words term called reported wrote citing slur sagte zitat wort dit citation mot dijo cita palabra".split())
ADDRESS = frozenset("you your youre yourself u ur du dich dein ihr euch tu toi vous tes ton usted tú te".split())


class Lexicon:
    """Trie of terms ('word' or 'beginning*') met by a one-edit Levenshtein automaton, determinised lazily."""

    def __init__(self, terms: dict[str, float], fuzzy_from: int = 5):
        self.terms, self.fuzzy_from = terms, fuzzy_from
        self.kids: list[dict[str, int]] = [{}]
        self.word: dict[int, str] = {}
        self.begin: dict[int, str] = {}
        for t in sorted(terms):
            node = 0
            for c in t.rstrip("*"):
                if c not in self.kids[node]:
                    self.kids[node][c] = len(self.kids)
                    self.kids.append({})
                node = self.kids[node][c]
            (self.begin if t.endswith("*") else self.word)[node] = t
        deep = [0] * len(self.kids)  # the longest term through a node: whether an edit there can be of use
        for t in terms:
            node = 0
            deep[0] = max(deep[0], 0 if t.endswith("*") else len(t))
            for c in t.rstrip("*"):
                node = self.kids[node][c]
                deep[node] = max(deep[node], 0 if t.endswith("*") else len(t))
        self.deep = deep
        self.states: list[tuple] = []
        self.index: dict[frozenset, int] = {}
        self.steps: list[dict[str, int]] = []
        self.ends: list[tuple[str, int] | None] = []
        self.start = self._state({(0, 0)})
        self.cache: dict[str, tuple[str, int] | None] = cache(f"lexicon {id(self)}")

    def _state(self, items: set) -> int:
        todo = list(items)
        while todo:  # a letter of the term left out of the text
            node, e = todo.pop()
            if e == 0 and node:
                for k in self.kids[node].values():
                    if self.deep[k] >= self.fuzzy_from and (k, 1) not in items and (k, 0) not in items:
                        items.add((k, 1))
        key = frozenset(items)
        if key not in self.index:
            self.index[key] = len(self.states)
            self.states.append(tuple(items))
            self.steps.append({})
            hits = [(e, self.word[n]) for n, e in items if n in self.word and (e == 0 or len(self.word[n]) >= self.fuzzy_from)]
            self.ends.append((min(hits)[1], min(hits)[0]) if hits else None)
        return self.index[key]

    def _step(self, state: int, c: str) -> int:
        to = set()
        for node, e in self.states[state]:
            if c in self.kids[node]:
                to.add((self.kids[node][c], e))
            if e == 0 and node:
                to.update((k, 1) for k in self.kids[node].values() if self.deep[k] >= self.fuzzy_from)
                if self.deep[node] >= self.fuzzy_from:
                    to.add((node, 1))
        to = {(n, e) for n, e in to if e == 0 or (n, 0) not in to}
        nxt = self._state(to) if to else -1
        self.steps[state][c] = nxt
        return nxt

    def find(self, word: str) -> tuple[str, int] | None:
        """The term that a word spells, with its edits: exact before beginning before misspelled."""
        node, begun = 0, None
        for c in word:
            node = self.kids[node].get(c, -1)
            if node < 0:
                break
            begun = self.begin.get(node, begun)
        if node > 0 and node in self.word:
            return self.word[node], 0
        if begun:
            return begun, 0
        state = self.start
        for c in word:
            nxt = self.steps[state].get(c)
            state = self._step(state, c) if nxt is None else nxt
            if state < 0:
                return None
        return self.ends[state]

    def hits(self, words: list[str]) -> list[tuple[int, str, int]]:
        cache = self.cache
        new = set(words).difference(cache)
        if new:
            if len(cache) > CACHE_WORDS:
                cache.clear()
                new = set(words)
            for w in new:
                cache[w] = self.find(w)
        return [(i, *cache[w]) for i, w in enumerate(words) if cache[w]]


FEATURES = 6
FREE = [3, 6]  # weights that may be negative: quoted hits and the constant


def features(text: str, lexicon: Lexicon) -> list[float]:
    """Logs of: weighed well-spelled hits, distinct terms among them, weighed misspelled hits, quoted hits, hits near
    an address to the reader, well-spelled hits a hundred words."""
    low = text.lower()
    words = WORD.findall(low)
    hits = lexicon.hits(words)
    if not hits:
        return [0.0] * FEATURES
    spans = [m.span() for m in WORD.finditer(low)]
    at = [h[0] for h in hits]
    sums, quoted, near = [0.0, 0.0], 0, 0
    for n, (i, term, edits) in enumerate(hits):
        a, b = max(0, i - WINDOW), min(len(words), i + WINDOW + 1)
        before, after = low[spans[a][0] : spans[i][0]], low[spans[i][1] : spans[b - 1][1] + 1]
        is_quoted = any(q in before for q in QUOTES) and any(q in after for q in QUOTES) or bool(REPORT.intersection(words[a:i]))
        addressed = bool(ADDRESS.intersection(words[a:b]))
        crowd = (n > 0 and i - at[n - 1] <= WINDOW) + (n + 1 < len(at) and at[n + 1] - i <= WINDOW)
        sums[edits] += lexicon.terms[term] * (0.25 if is_quoted else 1.0) * (1 + 0.5 * addressed + 0.25 * crowd)
        quoted, near = quoted + is_quoted, near + addressed
    plain = [h for h in hits if not h[2]]
    return [float(np.log1p(v)) for v in (sums[0], len({h[1] for h in plain}), sums[1], quoted, near, 100 * len(plain) / len(words))]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, rounds: int = 40) -> np.ndarray:
    """Weights by Newton's method; the last is the constant. Evidence of abuse never counts against it: a weight that
    comes out negative, but for those in FREE, is left out and the rest fitted anew."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    used = np.ones(x.shape[1], bool)
    while True:
        w, z = np.zeros(used.sum()), x[:, used]
        keep = np.full(len(w), ridge)
        keep[-1] = 1e-6
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(keep), z.T @ (y - p) - keep * w)
            w += step
            if np.abs(step).max() < 1e-8:
                break
        full = np.zeros(len(used))
        full[used] = w
        drop = [i for i in np.flatnonzero(full < 0) if i not in FREE]
        if not drop:
            return full
        used[drop] = False


def learn(docs: DataFrame, labels: DataFrame, max_rows: int = TRAIN_ROWS):
    """(terms with their log ratios, weights) from labelled rows whose crc32 remainder by 4 is not 2."""
    ship(docs.sparkSession)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (crc_remainder(F.col("doc_id"), 4) != 2))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    n = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    bad, good = n.get(1, 0), n.get(0, 0)
    prior = float(np.log((bad + 0.5) / (good + 4.5)))
    if not bad or not good:
        return {}, [0.0] * FEATURES + [prior]
    rows = texts(docs).join(F.broadcast(known), "doc_id")  # at most max_rows rows of two numbers

    def words(batches):
        for b in batches:
            out_t, out_y = [], []
            for text, y in zip(b.column("text"), b.column("toxic").to_pylist(), strict=True):
                own = set(WORD.findall(text.as_py().lower()))
                own |= {w[:k] + "*" for w in own for k in BEGIN if len(w) > k}
                out_t += own
                out_y += [y] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(out_t, pa.string()), pa.array(out_y, pa.int32())], names=["term", "toxic"])

    counts = rows.select("text", "toxic").mapInArrow(tidy("terms", words), "term string, toxic int").groupBy("term").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good"))
    ratio = ((F.col("bad") + 0.5) / (bad + 1)) / ((F.col("good") + 0.5) / (good + 1))
    least = max(3, round(0.008 * bad))
    top = counts.where(F.col("bad") >= least).select("term", "bad", ratio.alias("ratio")).where(F.col("ratio") >= MIN_RATIO)
    found = top.collect()  # each is in at least 1 of 125 toxic rows of at most max_rows: bounded by their texts' length
    bad_of = {r["term"]: r["bad"] for r in found}
    ratio_of = {r["term"]: float(np.log(r["ratio"])) for r in found}
    terms: dict[str, float] = {}
    for t in sorted(bad_of, key=lambda t: (-bad_of[t], t)):
        if not any(t.rstrip("*")[:k] + "*" in terms for k in BEGIN):
            terms[t] = ratio_of[t]  # a term adds nothing beside a beginning of it
    for t in [t for t in terms if t.endswith("*")]:  # a beginning that is nearly always one word is that word
        whole = [w for w in bad_of if not w.endswith("*") and w.startswith(t[:-1]) and bad_of[w] >= 0.8 * bad_of[t]]
        if whole:
            terms.pop(t)
            terms |= {w: ratio_of[w] for w in whole}
    seen: dict[str, float] = dict(terms)

    def table(batches):
        lexicon = Lexicon(seen)
        for b in batches:
            f = [features(t.as_py(), lexicon) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([pa.array(f, pa.list_(pa.float64())), b.column("toxic")], names=["f", "toxic"])

    got = rows.select("text", "toxic").mapInArrow(tidy("features", table), "f array<double>, toxic int").collect() if terms else []  # at most max_rows short rows
    if not got:
        return terms, [0.0] * FEATURES + [prior]
    return terms, fit_logistic(np.array([r["f"] for r in got]), np.array([r["toxic"] for r in got], float)).tolist()


def probability(model):
    """A function of a text column: the model's probability that the text is toxic."""
    terms, weights = model

    @F.arrow_udf("double")
    def toxic(text: pa.Array) -> pa.Array:
        lexicon = _lexicon(terms)
        w = np.array(weights)
        f = np.array([features(t.as_py() or "", lexicon) for t in text]).reshape(len(text), FEATURES)
        return pa.array(1 / (1 + np.exp(-np.clip(f @ w[:-1] + w[-1], -30, 30))))

    return toxic


def score(docs: DataFrame, model, threshold: float = 0.3) -> DataFrame:
    """All columns of docs, with score and predicted (columns of these names are replaced)."""
    ship(docs.sparkSession)
    scored = docs.withColumn("score", probability(model)("text"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


_LEXICONS: dict[tuple, Lexicon] = {}


def _lexicon(terms: dict[str, float]) -> Lexicon:
    key = tuple(sorted(terms.items()))
    if key not in _LEXICONS:
        _LEXICONS.clear()
        _LEXICONS[key] = Lexicon(terms)
    cache(f"lexicon {id(_LEXICONS[key])}", _LEXICONS[key].cache)
    return _LEXICONS[key]


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held = (crc_remainder(F.col("doc_id"), 4) == 2).alias("held_out")
    return score(texts(docs), model).select("doc_id", held, "score", "predicted")
