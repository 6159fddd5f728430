"""The operators against brute force on small tables with the awkward cases."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from strandlake.llm import byte_bpe, hmm, html_text, jaccard, packing, pfor, suffixes, toxicity, vectors

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, k long"


def documents():
    rng = random.Random(5)
    vocab = ["".join(rng.choice("abcdeéñ") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    passage, base = text(70), text(120).split()
    rows = [None, "", " \t\n", "one", "Two words", text(6000), "a " * 400, "漢字 🎉 \x1c x²"]
    rows += ["a <|endoftext|> b <|startoftext|><|endoftext|>", "y" * 3000 + " " + "xyz" * 700]
    rows += [text(30) + " " + passage + " " + text(30) for _ in range(6)]
    for _ in range(25):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        rows.append(" ".join(w))
    rows += [rows[9]] * 12 + [text(rng.randint(1, 200)) for _ in range(40)]
    return [(i, t, "en", "src0", len(t or ""), 0.0, 1) for i, t in enumerate(rows)]


ROWS = documents()
TEXT = {r[0]: r[1] or "" for r in ROWS}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(ASCII))


def vector_table(spark):
    rng = np.random.default_rng(3)
    m = rng.normal(size=(400, 8)).astype("float32")
    m[100:160] = m[7]
    rows = [(i, v.tolist()) for i, v in enumerate(m)]
    rows += [(1000, None), (1001, [0.0] * 8), (1050, [float("nan")] * 8), (1100, [None] * 8), (7, m[7].tolist())]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<float>")


@pytest.mark.parametrize("cells", [None, 12])
@pytest.mark.parametrize("exact_product", [True, False])
def test_vector_search(spark, exact_product, cells):
    rows, df = vector_table(spark)
    v = vectors.valid_vectors(df, zero_ok=exact_product)
    if exact_product:
        from pyspark.sql import functions as F

        v = v.select("id", F.transform("v", lambda x: F.floor(x * 256).cast("double")).alias("v"))
        got = vectors.pivot_top_k(v, v.where("id % 50 = 0"), cells=cells)
    else:
        got = vectors.vantage_knn(v, v.where("id % 50 = 0"), relax=1.0, cells=cells)
    got = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in got.collect())
    keep = {i: np.array(x, float) for i, x in rows if x and None not in x and np.isfinite(x).all() and (exact_product or any(x))}
    prepare = (lambda x: np.floor(256 * x)) if exact_product else (lambda x: x / np.sqrt((x * x).sum()))
    u = {i: prepare(x) for i, x in keep.items()}
    want = []
    for q in sorted(i for i in u if i % 50 == 0):
        score = {i: round(float((u[q] * x).sum()), 9) for i, x in u.items() if i != q}
        want += [(q, r + 1, i) for r, i in enumerate(sorted(score, key=lambda i: (-score[i], i))[:5])]
    assert got == want
    assert vectors.pivot_top_k(v.where("id < 0"), v.where("id < 0")).count() == 0


@pytest.mark.parametrize("exact_product", [True, False])
def test_queries_meet_few_cells(spark, monkeypatch, exact_product):
    """Clustered vectors of two lengths, one vector on a third of the rows, one vec_id on many: cells that bounds rule out are not
    sent the query, no shard outgrows its bound, and the result is that of brute force."""
    rng = np.random.default_rng(11)
    centre = np.floor(rng.normal(size=(20, 6)) * 200)
    m = np.concatenate([np.floor(centre[rng.integers(20, size=800)] + rng.normal(size=(800, 6)) * 8), np.repeat(centre[:1], 400, axis=0)])
    rows = [(i, x.tolist()) for i, x in enumerate(m)] + [(50, x.tolist()) for x in m[800:]] + [(5000 + i, x[:3].tolist()) for i, x in enumerate(m[:60])]
    v = vectors.valid_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    sent, met = [], vectors._route
    monkeypatch.setattr(vectors, "SHARD", 100)
    monkeypatch.setattr(vectors, "_route", lambda *a: sent.append(met(*a)) or sent[-1])
    search = (lambda v, q: vectors.pivot_top_k(v, q, cells=20)) if exact_product else (lambda v, q: vectors.vantage_knn(v, q, relax=1.0, cells=20))
    monkeypatch.setattr(vectors, "drop_tables", lambda *t: None)
    got = {}
    for r in search(v, v.where("id % 50 = 0")).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], round(float(r["score"]), 9)))
    pairs, asked = sent[0].count(), {i for i, _ in rows if i % 50 == 0}
    assert pairs <= 0.5 * 20 * sum(1 for i, x in {(i, tuple(x)) for i, x in rows} if i in asked)
    every = sorted({(i, tuple(x)) for i, x in rows})
    for q in asked:
        found = []
        for x in (x for i, x in every if i == q):
            for i, y in every:
                if i != q and len(x) == len(y):
                    s = float(np.dot(x, y))
                    found.append((-round(s if exact_product else s / np.sqrt(np.dot(x, x) * np.dot(y, y)), 9), i))
        assert sorted(got[q]) == [(n + 1, i, -s) for n, (s, i) in enumerate(sorted(found)[:5])]


def test_products_beyond_64_bits():
    m = np.array([[9e18, 9e18], [-9e18, -9e18], [9e18, 1.0], [3.0, 4.0]])
    rows, ids, scores = vectors.PivotIndex(np.arange(4), m)(np.array([0]), m[:1], 5)
    assert rows.tolist() == [0, 0, 0] and ids.tolist() == [2, 3, 1] and scores.tolist() == [vectors.LARGEST, 2**63 - 1, -vectors.LARGEST]


def test_packing(docs, empty):
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    got = packing.pack_pieces(packing.cut(docs)).toPandas()
    for i, own in got.groupby("doc_id"):
        ids = t.encode(TEXT[i], add_special_tokens=False).ids + [0]
        own = own.sort_values("piece")
        assert own.length.sum() == len(ids) and (own.length[:-1] == 2048).all()
        assert all(zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes()) == c for s, n, c in zip(own.start, own.length, own.ids_crc32))
    for _, seq in got.groupby("sequence_id"):
        seq = seq.sort_values("offset")
        assert seq.offset.tolist() == [0, *seq.length.cumsum()][:-1] and seq.length.sum() <= 2048
    assert set(got.doc_id) == set(TEXT) and packing.pack_pieces(packing.cut(empty)).count() == 0


def test_local_search_empties_bins():
    sizes = np.array([6, 4, 5, 3, 2, 7, 3])
    bins = packing.improve(sizes, [[0], [1], [2], [3], [4], [5], [6]], 10)
    assert len(bins) == 3 and sorted(x for b in bins for x in b) == list(range(7))


def test_pfor(docs, empty):
    rng = np.random.default_rng(1)
    for n in (0, 1, 128, 1000):
        v = rng.integers(0, 2**32, n, dtype=np.uint64).astype(np.uint32) >> rng.integers(0, 32, n).astype(np.uint32)
        assert (pfor.unpack(pfor.pack(v)) == v).all()
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    at = 0
    for r in pfor.read_segments(pfor.write_segments(docs)).orderBy("doc_id").collect():
        ids = t.encode(TEXT[r["doc_id"]], add_special_tokens=False).ids + [0]
        assert (r["start"], r["n_tokens"], bytes(r["ids"])) == (at, len(ids), np.array(ids, "<u4").tobytes())
        at += len(ids)
    assert pfor.read_segments(pfor.write_segments(empty)).count() == 0


@pytest.mark.parametrize("size", [0, 20, 10**6])
def test_byte_bpe(docs, empty, size):
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.load_ranks(), special_tokens={})
    got = byte_bpe.digests(byte_bpe.encode(byte_bpe.texts(docs), dictionary=size)).collect()
    assert len(got) == len(ROWS)
    for r in got:
        ids = enc.encode_ordinary(TEXT[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(TEXT[r["doc_id"]].encode()).hexdigest()
    at_once = byte_bpe.encode(byte_bpe.texts(docs), dictionary=size, digest=True)
    assert sorted(at_once.collect()) == sorted(got) and byte_bpe.encode(byte_bpe.texts(empty)).count() == 0


@pytest.mark.parametrize("size", [0, 10**6])
def test_byte_bpe_of_very_long_words(spark, size):
    """Words of 100 000 letters, of one letter, beside LONG and among short ones, give the library's ids."""
    rng = random.Random(2)
    text = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    at = byte_bpe.LONG
    rows = [text("etaoinshrdlu", 100_000), "a" * 50_000, text("éñ漢字", 20_000), *(text("abc", n) for n in (at - 1, at, at + 1)), f"two {text('xyz', at)} {text('xyz', 3 * at)} {text('xyz', 2 * at)} and one"]
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.load_ranks(), special_tokens={})
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    for r in byte_bpe.encode(df, dictionary=size).collect():
        assert np.frombuffer(r["ids"], "<u4").tolist() == enc.encode_ordinary(rows[r["doc_id"]])


def test_long_words_merge_as_in_the_library():
    ranks = byte_bpe.load_ranks()
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(3)
    for n in [*range(1, 40), 700, 5000]:
        for letters in ("a", "ab", "etaoin", "é字"):
            w = "".join(rng.choice(letters) for _ in range(n))
            assert byte_bpe.merge_long(w.encode(), ranks) == enc.encode_ordinary(w)


def test_dictionary_refuses_words_of_another_hash():
    import xxhash

    pieces = [b"a", b"b", b"ab"]
    hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in (b"ab", b"xy", b"bb")], np.uint64)  # as if "xy" had the hash of "ba"
    own = byte_bpe.Dictionary(hashes, np.array([1, 2, 2]), np.array([2, 1, 0, 1, 1]))
    hit, sizes, ids = own.find([b"bb", b"xy", b"no", b"ab"], pieces)
    assert hit.tolist() == [True, False, False, True] and sizes.tolist() == [2, 1] and ids.tolist() == [1, 1, 2]


def test_jaccard(docs, empty):
    def grams(t):
        w = words(t)
        return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} or ({tuple(w)} if w else set())

    s = {i: grams(t) for i, t in TEXT.items()}
    comp = {i: i for i in s}
    for a in s:
        for b in s:
            if a < b and s[a] and s[b] and 100 * len(s[a] & s[b]) >= 90 * len(s[a] | s[b]):
                x, y = comp[a], comp[b]
                comp = {i: min(x, y) if c in (x, y) else c for i, c in comp.items()}
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.ngram_components(docs).collect()}
    assert got == {i: (len(s[i]), comp[i]) for i in s}
    assert jaccard.ngram_components(empty).count() == 0


def test_suffixes(docs, empty):
    def covered(size):
        seen, out = {}, {}
        for i in sorted(TEXT):
            w = words(TEXT[i])
            runs = [tuple(w[p : p + size]) for p in range(len(w) - size + 1)]
            cover = {q for p, g in enumerate(runs) if g in seen for q in range(p, p + size)}
            for g in runs:
                seen.setdefault(g, i)
            if cover:
                out[i] = cover
        return out

    want = covered(50)
    got = {}
    for r in suffixes.passages(docs).collect():
        assert r["source_id"] < r["doc_id"]
        got.setdefault(r["doc_id"], set()).update(range(r["start"], r["end"]))
    assert set(covered(75)) <= set(got) <= set(want) and all(got[i] <= want[i] for i in got)
    assert sum(map(len, got.values())) >= 0.95 * sum(map(len, want.values()))
    left = suffixes.cut(docs)
    assert left.columns == docs.columns and all(r["n_chars"] == len(r["text"] or "") for r in left.collect() if r["doc_id"] in got)
    assert suffixes.cut(empty).count() == 0 and suffixes.passages(empty).count() == 0


@pytest.mark.parametrize("place", [10, 25, 50])
def test_suffixes_behind_an_edited_first_holder(spark, place):
    """Passages of 60 words in D1 and D2, and in D0 with one word changed: D0 must not hide the rest from D2."""
    rng, rows, want = random.Random(place), [], {}
    text = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    for i in range(0, 240, 3):
        passage, lead = text(60), text(20)
        edited = [*passage[: place - 1], "changed", *passage[place:]]
        rows += [(i, " ".join(text(20) + edited + text(20))), (i + 1, " ".join(lead + passage + text(20))), (i + 2, " ".join(text(20) + passage + text(20)))]
        tail = {20 + q for q in (range(place, 60) if place < 11 else range(place - 1) if place > 50 else ())}
        want |= {i + 2: set(range(20, 80))} | ({i + 1: tail} if tail else {})
    got = {}
    for r in suffixes.passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect():
        got.setdefault(r["doc_id"], set()).update(range(r["start"], r["end"]))
    assert got == want


def test_html():
    tree = html_text.labelled_tree()
    page = "<html><head><title>T</title></head><body><nav><a href=/>Home</a></nav><div class='ad'>Buy now this thing today for less</div><article><h1>A &amp; B</h1><p>First  para\n&quot;x&quot;<p>Second</article><div class=comments><p>A reader says many things here about it</div><footer>&copy; all</footer>"
    assert html_text.main_text(page, tree) == 'A & B\nFirst para "x"\nSecond'
    for odd in (None, "", "<", "<p", "<script>never closed", "<article>" * 500, "text only"):
        assert isinstance(html_text.main_text(odd, tree), str)


def test_toxicity(spark, empty):
    rng = random.Random(2)
    clean = lambda n: " ".join(rng.choice(["river", "stone", "cloud", "paper", "green"]) for _ in range(n))
    rows = [(i, clean(20) + (" you vileword horrid " + clean(9) if i % 5 == 0 else ""), "en", "s", 1, 0.0, 1) for i in range(400)]
    rows += [(1000, "you vilewrd " + clean(12), "en", "s", 1, 0.0, 1), (1001, None, "en", "s", 1, 0.0, 1), (1002, "", "en", "s", 1, 0.0, 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(400)], "doc_id long, quality int, toxic int")
    model = toxicity.learn(df, labels)
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score(df, model).collect()}
    assert all(got[i] == int(i % 5 == 0) for i in range(400)) and got[1001] == got[1002] == 0
    assert toxicity.Lexicon(model[0]).find("vilewrd") == ("vileword", 1)
    none = toxicity.learn(df, labels.limit(0))
    assert toxicity.score(df, none).where("predicted = 1").count() == 0 and toxicity.score(empty, model).count() == 0


def test_hmm(docs, empty):
    rng = np.random.default_rng(0)
    m = hmm.Model.first(np.full(10, 0.1), 3)
    m.move, m.start = rng.dirichlet(np.ones(3), 3), rng.dirichlet(np.ones(3))
    seqs = [rng.integers(0, 10, n) for n in (1, 7, 256, 4096, 4097, 9000)]

    def plain(d):
        x, total = m.start * m.emit[d[0]], 0.0
        for w in [*d[1:], None]:
            total, x = total + np.log(x.sum()), x / x.sum()
            x = x if w is None else (x @ m.move) * m.emit[w]
        return total

    assert np.allclose(hmm.log_likelihood(m, seqs), [plain(d) for d in seqs])
    own = docs.select("doc_id", "text").fillna("")
    for learn in ("doc_id % 3 <> 0", "false"):
        c = Counter(w for i, t in TEXT.items() if learn != "false" and i % 3 for w in [*words(t), hmm.END])
        n, v = sum(c.values()), len(c)
        got = hmm.score(hmm.train(own.selectExpr("*", f"{learn} AS learn"), states=2, rounds=2)).collect()
        assert len(got) == len(ROWS)
        for r in got:
            w = [*words(TEXT[r["doc_id"]]), hmm.END]
            base = sum(np.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
            assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(x in c for x in w), n) and np.isclose(r["base_score"], base)
            assert r["score"] < 0 if n else r["score"] == r["base_score"]
    assert hmm.score(hmm.train(empty.selectExpr("doc_id", "text", "true AS learn"))).count() == 0


def test_hmm_rounds_against_plain_baum_welch(docs, monkeypatch):
    """Two rounds by cells and blocks, from the same first model, against plain sums over all texts; then the scores."""
    import xxhash

    monkeypatch.setattr(hmm, "BLOCK_PAIRS", 100)
    own, k = docs.select("doc_id", "text").fillna("").selectExpr("*", "doc_id % 3 <> 0 AS learn"), 2
    every = {i: [*words(t), hmm.END] for i, t in TEXT.items()}

    def emitted(m):
        table = {}
        for cell in m.lists.collect():
            rows = sorted((r["block"], r["em"]) for r in m.emissions.where(f"cell = {cell['cell']}").collect())
            em = np.concatenate([np.frombuffer(x, "<f4") for _, x in rows]).reshape(-1, k) / m.total
            table |= {bytes(cell["hashes"])[16 * i : 16 * i + 16]: e for i, e in enumerate(em)}
        return {w: table[xxhash.xxh3_128_digest(w.encode())] for t in every.values() for w in t}

    m = hmm.train(own, states=k, rounds=0, keep_lists=True)
    start, move, emit = m.start, m.move, emitted(m)
    c = Counter(w for i, t in every.items() if i % 3 for w in t)
    n, v = sum(c.values()), len(c)
    share = {w: (c[w] + 0.1) / (n + 0.1 * (v + 1)) for w in emit}
    assert np.allclose(sum(emit[w] for w in emit) + hmm.STRENGTH * n / k / m.total * (1 - sum(share.values())), 1, atol=1e-5)
    for _ in range(2):
        s, mv, e = np.zeros(k), np.zeros((k, k)), {w: np.zeros(k) for w in emit}
        for i, t in every.items():
            if not i % 3:
                continue
            alpha, beta = [start * emit[t[0]]], [np.ones(k)]
            alpha[0] = alpha[0] / alpha[0].sum()
            for w in t[1:]:
                alpha.append(alpha[-1] @ move * emit[w])
                alpha[-1] = alpha[-1] / alpha[-1].sum()
            for w in t[:0:-1]:
                beta.insert(0, move @ (emit[w] * beta[0]))
                beta[0] = beta[0] / beta[0].sum()
            for x, w in enumerate(t):
                g = alpha[x] * beta[x] / (alpha[x] @ beta[x])
                e[w] += g
                if not x:
                    s += g
                else:
                    pair = np.outer(alpha[x - 1], emit[w] * beta[x]) * move
                    mv += pair / pair.sum()
        total = sum(e.values()) + hmm.STRENGTH * n / k
        emit = {w: (e[w] + hmm.STRENGTH * n / k * share[w]) / total for w in emit}
        start, mv = (1 + s) / (1 + s).sum(), mv + 1 + np.eye(k) * hmm.STICK
        move = mv / mv.sum(axis=1, keepdims=True)
    m = hmm.train(own, states=k, rounds=2, tolerance=-1, keep_lists=True)
    got = emitted(m)
    assert np.allclose(m.start, start, rtol=1e-4) and np.allclose(m.move, move, rtol=1e-4) and all(np.allclose(got[w], emit[w], rtol=1e-4) for w in emit)
    assert m.likelihoods[1] > m.likelihoods[0]
    for r in hmm.score(m).collect():
        x, want = m.start, 0.0
        for j, w in enumerate(every[r["doc_id"]]):
            x = (x @ m.move if j else x) * got[w]
            want, x = want + np.log10(x.sum()), x / x.sum()
        assert np.isclose(r["score"], want, rtol=1e-6)


def test_hmm_trains_until_the_tolerance_is_met(docs):
    own = docs.select("doc_id", "text").fillna("").selectExpr("*", "doc_id % 3 <> 0 AS learn")
    m = hmm.train(own, states=2, tolerance=0.02)
    rise = np.diff(m.likelihoods)
    assert len(rise) > 3 and rise[-3:-1].sum() < 0.04 and all(rise[i : i + 2].sum() >= 0.04 for i in range(len(rise) - 3))
    for r in hmm.score(m).collect():
        assert np.isfinite(r["score"]) and r["score"] <= 0
    plain = hmm.train(own, states=2, rounds=len(m.likelihoods), tolerance=-1, relax=1.0)
    assert m.likelihoods[:3] == pytest.approx(plain.likelihoods[:3], rel=1e-5) and m.likelihoods[-1] > plain.likelihoods[-1] - 0.04


def test_relaxed_steps_keep_fixed_points():
    x = np.array([0.2, 0.3, 0.5])
    assert np.allclose(hmm.relaxed(x, x, 1.8), x) and hmm.relaxed(x, 2 * x, 1.0) is x
    beyond = hmm.relaxed(np.array([0.3, 0.7]), np.array([0.2, 0.8]), 1.8)
    assert beyond[0] > 0.3 and beyond[1] < 0.7


def test_hmm_expected_counts_over_whole_texts():
    rng = np.random.default_rng(1)
    m = hmm.Model.first(np.full(10, 0.1), 3)
    m.move, m.start, m.emit = rng.dirichlet(np.ones(3), 3), rng.dirichlet(np.ones(3)), rng.dirichlet(np.ones(10), 3).T
    size = np.array([1, 8, 9, 100, 57])
    ids, begin = rng.integers(0, 10, size.sum()), np.cumsum(size) - size
    want = [np.zeros(3), np.zeros((3, 3)), np.zeros((10, 3))]
    for b, n in zip(begin, size, strict=True):  # plain forward and backward sums
        d, beta = ids[b : b + n], [np.ones(3)]
        alpha = [m.start * m.emit[d[0]]]
        for w in d[1:]:
            alpha.append((alpha[-1] @ m.move) * m.emit[w])
        for w in d[:0:-1]:
            beta.insert(0, m.move @ (m.emit[w] * beta[0]))
        p = alpha[-1].sum()
        want[0] += alpha[0] * beta[0] / p
        for t in range(n):
            want[2][d[t]] += alpha[t] * beta[t] / p
            if t:
                want[1] += np.outer(alpha[t - 1], m.emit[d[t]] * beta[t]) * m.move / p
    for whole in (8, 1000):
        got = [np.zeros(3), np.zeros((3, 3)), np.zeros((10, 3))]
        hmm.expect(m, ids, begin, size, *got, whole=whole, chunk=7)
        assert all(np.allclose(x, y) for x, y in zip(got, want, strict=True))


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    docs = spark.createDataFrame(ROWS, SCHEMA).drop("score", "k")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns
    kept = {r["doc_id"] for r in now.collect()}
    assert {0, 1, 2, 3, 4, 5} <= kept and len(kept) < len(ROWS)
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").collect()} == kept


def test_vantage_recall_as_shipped():
    """One shard of all sf0.1 vectors, searched with the default factor, against brute force."""
    import inspect

    import pyarrow.parquet as pq

    t = pq.read_table("/root/testdata/sf0.1/embeddings.parquet").to_pylist()
    ids, m = np.array([r["vec_id"] for r in t]), np.array([r["embedding"] for r in t], float)
    asked = ids % 50 == 0
    relax = inspect.signature(vectors.vantage_knn).parameters["relax"].default
    rows, got, _ = vectors.VantageTree(ids, m, relax)(ids[asked], m[asked], 5)
    u = m / np.sqrt((m * m).sum(axis=1))[:, None]
    hits = 0
    for i, q in enumerate(np.flatnonzero(asked)):
        s = u @ u[q]
        s[q] = -np.inf
        hits += len(set(ids[np.argsort(-s)[:5]]) & set(got[rows == i]))
    assert hits >= 0.9 * 5 * asked.sum()


def test_toxicity_of_held_out_rows(spark):
    """Labels of rows that learning never sees, on the sf0.1 tables."""
    d = "/root/testdata/sf0.1"
    got = toxicity.op4_toxicity(spark, d).where("held_out").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").groupBy("toxic", "predicted").count().collect()
    n = {(r["toxic"], r["predicted"]): r["count"] for r in got}
    caught, spared = n.get((1, 1), 0), n.get((0, 0), 0)
    assert caught >= 0.9 * (caught + n.get((1, 0), 0)) > 0 and spared >= 0.98 * (spared + n.get((0, 1), 0)) > 0
