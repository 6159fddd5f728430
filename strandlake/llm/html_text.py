"""Main text of web pages: flat text blocks, described by their own and their neighbours' word count and link density
and by the kind of place they stand in, classified by a decision tree trained on a small labelled table.

Defined cases: null html is empty; a page without main text has an empty string; cut-off pages, unclosed tags and
bad markup give what was read so far; repeated rows are kept; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import ship

TAG = re.compile(r"""<!--.*?(?:-->|$)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|$)|<[!?/][^>]*+(?:>|$)""", re.S)
NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
#: Elements of the HTML standard.
UNSEEN = {"script", "style", "head", "title", "noscript", "template", "svg", "iframe", "object", "textarea", "select", "math", "canvas", "audio", "video"}
RAW = {"script", "style", "title", "textarea", "iframe", "noscript"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
AROUND = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "fieldset", "label", "address"}
MAIN = {"article", "main"}
AROUND_WORDS = set("ad ads advert advertisement advertising adverts banner sponsor sponsored promo promotion menu nav navbar navigation breadcrumb breadcrumbs sidebar side aside widget footer foot header masthead topbar cookie cookies consent notice notices alert gdpr popup modal newsletter subscribe subscription signup login form search share sharing social related recommended more comment comments reply replies respond disqus discussion reader readers tags pagination pager toolbar complementary contentinfo".split())
MAIN_WORDS = set("article content post entry story body main text".split())

#: The labelled table: words, link density, words and link density of the block before and after, place (-1 around the
#: article, 0 unknown, 1 in it), naming (-1, 0, 1), main text or not.
LABELLED = """
1 1.0 0 0.0 1 1.0 -1 0 0|1 1.0 1 1.0 1 1.0 -1 0 0|2 1.0 1 1.0 12 0.0 -1 0 0|3 1.0 2 1.0 40 0.0 -1 -1 0|9 0.0 1 1.0 14 0.0 0 -1 0
22 0.0 1 1.0 11 0.0 0 -1 0|35 0.1 2 1.0 12 0.0 0 -1 0|4 0.0 60 0.0 9 0.0 0 -1 0|16 0.2 0 0.0 5 1.0 -1 0 0|60 0.0 40 0.0 0 0.0 -1 -1 0
15 0.0 90 0.0 0 0.0 -1 0 0|8 0.4 120 0.0 0 0.0 -1 0 0|30 0.0 8 0.0 0 0.0 -1 0 0|110 0.0 12 0.0 9 0.0 -1 0 0|75 0.05 60 0.0 20 0.0 0 -1 0
12 0.0 20 0.0 35 0.0 1 0 1|10 0.0 9 0.0 50 0.0 1 0 1|1 0.0 30 0.0 40 0.0 1 0 1|2 0.0 12 0.0 15 0.0 1 0 1|4 0.0 80 0.0 14 0.0 1 0 1
45 0.0 12 0.0 60 0.0 1 0 1|120 0.0 45 0.0 30 0.0 1 0 1|300 0.1 120 0.0 10 0.0 1 0 1|25 0.2 80 0.0 15 0.0 1 0 1|18 0.4 40 0.0 60 0.0 1 0 1
6 0.0 5 0.0 30 0.0 1 1 1|55 0.0 6 0.0 20 0.0 1 1 1|90 0.1 50 0.0 70 0.0 1 1 1|14 0.0 70 0.0 9 0.0 1 1 1|5 0.5 40 0.0 22 0.0 1 0 1
2 1.0 50 0.0 2 1.0 1 0 0|3 1.0 3 1.0 4 1.0 1 0 0|5 1.0 40 0.0 5 1.0 1 0 0|12 0.0 40 0.0 60 0.0 1 -1 0|30 0.0 50 0.0 4 1.0 1 -1 0
70 0.0 8 0.0 65 0.0 0 0 1|40 0.05 60 0.0 80 0.0 0 0 1|22 0.0 35 0.0 45 0.0 0 0 1|15 0.1 50 0.0 30 0.0 0 0 1|150 0.02 10 0.0 90 0.0 0 0 1
3 1.0 2 1.0 4 1.0 0 0 0|2 0.5 4 1.0 2 1.0 0 0 0|5 0.8 30 0.0 3 1.0 0 0 0|4 0.0 2 1.0 3 1.0 0 0 0|7 0.9 6 0.9 8 1.0 0 0 0
25 0.9 5 1.0 4 1.0 0 0 0|60 0.95 10 0.5 8 0.9 0 0 0|12 0.7 40 0.0 3 1.0 0 0 0|3 0.0 0 0.0 2 1.0 0 0 0|6 0.0 3 1.0 0 0.0 0 0 0
8 0.0 60 0.0 75 0.0 0 0 1|5 0.0 45 0.0 50 0.0 0 0 1|11 0.0 2 1.0 65 0.0 0 0 1|50 0.0 6 0.0 40 0.0 0 1 1|9 0.0 40 0.0 35 0.0 0 1 1
4 0.0 8 0.0 70 0.0 0 1 1|20 0.3 60 0.0 35 0.0 0 1 1|3 1.0 45 0.0 3 1.0 0 1 0|33 0.1 20 0.2 0 0.0 0 1 1|45 0.0 90 0.0 3 1.0 0 0 1
80 0.0 9 0.0 9 0.0 -1 1 0|6 0.0 4 0.0 3 0.0 -1 1 0|2 0.0 3 0.0 2 0.0 -1 0 0|10 0.0 7 0.0 14 0.0 0 -1 0|200 0.0 30 0.0 20 0.0 0 -1 0
"""


def fit_tree(x: np.ndarray, y: np.ndarray, depth: int = 7):
    """A classification tree by Gini impurity: nested (feature, threshold, low, high), leaves are labels."""
    if depth == 0 or len(set(y.tolist())) < 2:
        return int(y.mean() >= 0.5)
    best = None
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, t = x[order, f], y[order]
        n = np.arange(1, len(t))
        left, total = np.cumsum(t)[:-1], t.sum()
        p, q = left / n, (total - left) / (len(t) - n)
        impurity = n * p * (1 - p) + (len(t) - n) * q * (1 - q)
        impurity[v[1:] == v[:-1]] = np.inf
        if len(impurity) and np.isfinite(impurity.min()) and (best is None or impurity.min() < best[0] - 1e-12):
            k = int(impurity.argmin())
            best = (impurity[k], f, (v[k] + v[k + 1]) / 2)
    if best is None:
        return int(y.mean() >= 0.5)
    _, f, at = best
    low = x[:, f] <= at
    return (f, float(at), fit_tree(x[low], y[low], depth - 1), fit_tree(x[~low], y[~low], depth - 1))


def labelled_tree():
    """The tree of LABELLED. Where place, naming, length or links settle a label, the row also stands beside other
    neighbours and, where the first two do, with other lengths."""
    near = [(0, 0.0), (3, 1.0), (12, 0.0), (60, 0.0), (200, 0.0)]
    rows = []
    for n, k, n0, k0, n1, k1, place, called, y in (map(float, r.split()) for line in LABELLED.strip().splitlines() for r in line.split("|")):
        rows.append((place, called, n, k, n0, k0, n1, k1, y))
        if place or called < 0 or (n >= 15 if y else k >= 0.5):
            rows += [(place, called, n, k, *a, *b, y) for a in near for b in near]
        if (place < 0 or called < 0) if not y else (place > 0 and k <= 0.5):
            rows += [(place, called, w, k, *a, *b, y) for w in (1, 4, 11, 30, 120) for a in near for b in near]
    rows = np.array(rows)
    return fit_tree(rows[:, :-1], rows[:, -1].astype(int))


def decide(tree, row) -> int:
    while not isinstance(tree, int):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def naming(attributes: str) -> int:
    words = {w for m in NAMED.finditer(attributes) for w in re.split(r"[^a-z0-9]+", (m[1] or m[2] or m[3] or "").lower())}
    return -1 if words & AROUND_WORDS else 1 if words & MAIN_WORDS else 0


def blocks(page: str) -> list[tuple[str, int, int, int, int]]:
    """Flat blocks in page order: text, words, words in links, place, naming."""
    out, text, linked, in_link = [], [], 0, 0
    open_: list[tuple[str, int, int]] = [("", 0, 0)]  # element, place, naming of what it holds
    at, end = 0, len(page)

    def close():
        nonlocal text, linked
        words = "".join(text).split()
        if words:
            out.append((" ".join(words), len(words), min(linked, len(words)), *open_[-1][1:]))
        text, linked = [], 0

    def add(raw: str):
        nonlocal linked
        if raw:
            t = html.unescape(raw) if "&" in raw else raw
            text.append(t)
            linked += len(t.split()) if in_link else 0

    while at < end:
        m = TAG.search(page, at)
        if not m:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        ending, attributes = m[1] or m[4], m[3] or m[6] or ""
        if name == "a":
            in_link = 0 if ending else 1
        if name in INLINE:
            if name in ("br", "img", "wbr"):
                text.append(" ")
            if name != "span" or not ending:
                continue
            continue
        if name in UNSEEN:
            if not ending and not attributes.rstrip().endswith("/"):
                if name in RAW:
                    stop = re.compile(rf"</{name}\b[^>]*(?:>|$)", re.I).search(page, at)
                    at = stop.end() if stop else end
                else:
                    shut = re.compile(rf"</{name}\b[^>]*(?:>|$)" + (r"|<body\b" if name == "head" else ""), re.I).search(page, at)
                    at = (shut.start() if shut[0].lower().startswith("<body") else shut.end()) if shut else end
            text.append(" ")
            continue
        close()
        in_link = 0
        if ending:
            for k in range(len(open_) - 1, 0, -1):
                if open_[k][0] == name:
                    del open_[k:]
                    break
            continue
        if name in VOID or name in ("html", "body"):
            continue
        if open_[-1][0] == "p" or open_[-1][0] == name and name in ("li", "td", "th", "tr", "dt", "dd", "option"):
            open_.pop()
        _, place, called = open_[-1]
        own = naming(attributes) if attributes else 0
        if name in MAIN and own >= 0 and (place >= 0 or all(e[0] == "form" or e[1] >= 0 for e in open_)):
            place = 1
        elif name in AROUND and not (name == "header" and place == 1):
            place = -1
        open_.append((name, place, own if called >= 0 and own else called))
    close()
    return out


def main_text(page: str | None, tree) -> str:
    found = blocks(page or "")
    sizes = [(0, 0.0), *((n, k / n) for _, n, k, _, _ in found), (0, 0.0)]
    return "\n".join(t for i, (t, *_, place, called) in enumerate(found) if decide(tree, (place, called, *sizes[i + 1], *sizes[i], *sizes[i + 2])))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row."""
    ship(pages.sparkSession)
    tree = labelled_tree()

    def run(batches):
        for b in batches:
            found = [main_text(h.as_py(), tree) for h in b.column("html")]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kinds = dict(pages.dtypes)
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds['page_id']}, url string, text string, n_chars long")


def op3_html_text(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
