"""Word shingles and MinHash values in numpy."""

from __future__ import annotations

import re

import numpy as np
import xxhash

WORD = re.compile(r"\w+")
WIDTH = 5
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class WordHashes(dict):
    """63-bit hashes of words (lower case, without punctuation) by the tokens of white space that hold them, kept up to a bound.

    A token of one word has its hash; one of none or several has a negative number, -1 - its place in `several`.
    """

    def __init__(self, most: int = 250_000):
        super().__init__()
        self.most = most
        self.several: list[list[int]] = []

    def __missing__(self, token: str) -> int:
        found = [xxhash.xxh64_intdigest(w) >> 1 for w in WORD.findall(token.lower())]
        if len(found) == 1:
            out = found[0]
        else:
            self.several.append(found)
            out = -len(self.several)
        self[token] = out
        return out

    def trim(self) -> None:
        if len(self) > self.most:
            self.clear()
            self.several.clear()


def word_hashes(text: str, known: WordHashes) -> np.ndarray:
    known.trim()
    tokens = text.split()
    h = np.fromiter(map(known.__getitem__, tokens), np.int64, len(tokens))
    odd = np.flatnonzero(h < 0)
    if len(odd):
        parts, last = [], 0
        for i in odd.tolist():
            parts += [h[last:i], np.array(known.several[-1 - int(h[i])], dtype=np.int64)]
            last = i + 1
        h = np.concatenate([*parts, h[last:]])
    return h.astype(np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingles(words: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Hashes of each run of `width` words, in order; a text of fewer words has one shingle of them all, one of none has none."""
    if len(words) == 0:
        return words
    n = max(1, len(words) - width + 1)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(min(width, len(words))):
        out = mix(out + words[k : k + n] + np.uint64(k + 1))
    return out


def coefficients(k: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    a, b = (rng.integers(0, 1 << 32, k, dtype=np.uint64).astype(np.uint32) | np.uint32(1) for _ in range(2))
    return a, b


def hash_rows(x: np.ndarray, k: int, seed: int = 1) -> np.ndarray:
    """k x len(x) values of 32 bits: row i is a hash function of its own, linear in the halves of the (already mixed) shingle hashes."""
    a, b = coefficients(k, seed)
    low, high = (x & np.uint64(0xFFFFFFFF)).astype(np.uint32), (x >> np.uint64(32)).astype(np.uint32)
    v = a[:, None] * low[None, :]
    v += b[:, None] * high[None, :]
    return v


def signature(x: np.ndarray, k: int, seed: int = 1, step: int = 4096) -> np.ndarray:
    """The k least hash values of a non-empty set, step by step so that long texts take bounded memory."""
    out = np.full(k, 0xFFFFFFFF, dtype=np.uint32)
    for i in range(0, len(x), step):
        np.minimum(out, hash_rows(x[i : i + step], k, seed).min(axis=1), out=out)
    return out
