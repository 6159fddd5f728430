"""Words of a text (A-Z lower-cased, cut at ASCII white space) as arrays of 64-bit hashes, and hashes of word runs."""

from __future__ import annotations

from array import array

import numpy as np

from .common import cache

CACHE_WORDS = 60_000
_CACHE: dict[bytes, int] = cache("words")
BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_POWERS: dict[str, np.ndarray] = {}


def word_hashes(text: str) -> np.ndarray:
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()
    new = set(words).difference(_CACHE)
    if new:
        if len(_CACHE) > CACHE_WORDS:
            _CACHE.clear()
            new = set(words)
        digest = xxhash.xxh3_64_intdigest
        for w in new:
            _CACHE[w] = digest(w)
    return np.frombuffer(array("Q", map(_CACHE.__getitem__, words)), np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A full avalanche of 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        size = max(4096, 1 << (n - 1).bit_length())
        for name, base in (("up", int(BASE)), ("down", pow(int(BASE), -1, 1 << 64))):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            with np.errstate(over="ignore"):
                _POWERS[name] = np.multiply.accumulate(x)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def prefix_sums(h: np.ndarray) -> np.ndarray:
    """s with: run_hashes(s, starts, size) is a hash of the size words at each start."""
    _, down = _powers(len(h) + 1)
    s = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(mix(h) * down[: len(h)], out=s[1:])
    return s


def run_hashes(s: np.ndarray, starts: np.ndarray, size: int, salt: int = 0) -> np.ndarray:
    up, _ = _powers(len(s))
    return mix((s[starts + size] - s[starts]) * up[starts] + np.uint64(size * 1000 + salt))
