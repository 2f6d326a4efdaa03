"""Sets of hashed word shingles, computed inside tasks with numpy."""

from __future__ import annotations

import numpy as np
import xxhash

from runlens.llm.common import claim, keeps

#: Odd multipliers of a polynomial over word hashes, and the constants of the 64-bit finaliser.
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

#: Words whose hashes a worker keeps at once.
_KEPT_WORDS = 150_000


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if not self:
            claim("words")
        if len(self) >= _KEPT_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_hashes = _WordHashes()
keeps("words", _hashes.clear)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def word_shingles(text: str | None, k: int = 5) -> np.ndarray:
    """The sorted distinct hashes of a text's k-word shingles.

    A-Z are lower-cased and words are split at ASCII white space, as bytes do
    it; a text of fewer words is one shingle, an empty or null one has none.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    n = min(k, len(h))
    s = h[: len(h) - n + 1].copy()
    for i in range(1, n):
        s *= _STEP
        s += h[i : len(h) - n + 1 + i]
    return np.unique(_mixed(s + np.uint64(n)))


def set_key(tokens: np.ndarray) -> int:
    """A signed 64-bit key of the whole set."""
    return xxhash.xxh3_64_intdigest(tokens.tobytes()) - (1 << 63)


def parity_sketch(tokens: np.ndarray) -> bytes:
    """Parities of the tokens' counts in 256 to 8192 buckets, about two to a token."""
    size = 1 << min(13, max(8, (2 * len(tokens) - 1).bit_length()))
    return np.packbits(np.bincount((tokens & np.uint64(size - 1)).astype(np.int64), minlength=size).astype(np.uint8) & 1, bitorder="little").tobytes()


def fewest_apart(a: bytes, b: bytes) -> int:
    """A lower bound on the number of tokens that only one of two sketched sets has.

    A token in one set only flips one parity, so the parities that differ are
    never more than those tokens. The larger sketch is folded to the smaller.
    """
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum()) if len(a) and len(b) else 0
