"""Whole-text tokenisation with public vocabularies, as bytes of little-endian unsigned 32-bit ids.

A text is cut by the tokenizer's own pattern into words, each of which the tokenizers library encodes once and
a bounded cache keeps. A text with any character outside a plain set (where two Unicode tables, or composition,
could differ), or with the string of an added token (which the library makes that token's id), goes to the library whole.
"""

from __future__ import annotations

import os
import re
from array import array

from .common import cache

PLAIN = "\\t\\n\\r -~\u00a1-\u00ac\u00ae-\u00b1\u00b4-\u00b8\u00ba\u00bb\u00bf-\u017e\u2010-\u2027\u2030-\u203a\u20ac"
CACHE_WORDS = {"byte": 700_000, "word": 200_000}  # "word": for packing, whose workers have other stages behind them
END = b"\0\0\0\0"
#: The vocabularies' own word patterns, written for the standard library; on plain characters they cut alike.
PATTERNS = {
    "byte": r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+",
    "word": r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+",
}


def byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: printable bytes stand for themselves,
    the others follow from U+0100 on in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


class Encoder:
    def __init__(self, path: str, kind: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.find = re.compile(PATTERNS[kind]).findall
        self.odd = re.compile(f"[^{PLAIN}]").search
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.lower, self.letters, self.cache, self.most = kind == "word", byte_letters(), {}, CACHE_WORDS[kind]

    def encode(self, text: str) -> bytes:
        if self.odd(text) or any(a in text for a in self.added):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        words = self.find(text.lower() if self.lower else text)
        new = set(words).difference(self.cache)
        if new:
            if len(self.cache) > self.most:
                self.cache.clear()
                new = set(words)
            tokenize, letters = self.model.tokenize, self.letters
            for w in new:
                tokens = tokenize(w.encode().decode("latin-1").translate(letters))
                self.cache[w] = array("I", [t.id for t in tokens]).tobytes()
        return b"".join(map(self.cache.__getitem__, words))


def encoder(kind: str, path: str | None = None) -> Encoder:
    """The worker's encoder of a kind ('byte' or 'word'); path: another vocabulary file of that kind."""
    import public_tokenizers as P

    path = path or P.path({"byte": "byte_bpe_50k.json", "word": "word_bpe_49k.json"}[kind])
    held = cache("tokens")  # goes, vocabulary and all, when the worker turns to another kind of stage
    if (kind, path) not in held:
        held[kind, path] = Encoder(path, kind)
    return held[kind, path]
