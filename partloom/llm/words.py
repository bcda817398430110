"""Words of UTF-8 texts, their hashes, and hashes of word windows, vectorised over a batch.

A word is a run of bytes other than space and \\x09-\\x0D. ``bytes.split`` cuts
at exactly those bytes and ``bytes.lower`` changes A-Z only.
"""

from __future__ import annotations

import numpy as np
import xxhash

from partloom.llm.runtime import worker_store

U = np.uint64
#: Entries a worker's word table holds before it starts anew: about 50 MB.
WORD_TABLE = 300_000
#: Words hashed in one vectorised step.
STEP = 1 << 18
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)


class WordHashes(dict):
    """word -> 64-bit hash, remembered; bounded by starting anew."""

    seed = 0

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_TABLE:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word, self.seed)
        return h


def word_table(seed: int = 0) -> WordHashes:
    table = worker_store(f"word_hashes {seed}", WordHashes, large=True)
    table.seed = seed
    return table


def hash_words(words: list[bytes], table: WordHashes) -> np.ndarray:
    return np.fromiter(map(table.__getitem__, words), dtype=U, count=len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the splitmix64 finaliser)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=U)
    out[0] = 1
    return np.cumprod(out, dtype=U)


def _power_pair(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(STEP * 2, 1 << (n + 1).bit_length())
    held = worker_store("powers", dict)
    if which not in held or len(held[which][0]) < n:
        base = BASES[which]
        held[which] = (_powers(base, size), _powers(pow(base, -1, 1 << 64), size))
    return held[which]


class WindowHasher:
    """Hash of any window of a word-hash sequence in constant time.

    The base is odd, so it has an inverse modulo 2**64 and prefix sums of
    w[i] * base**i give every window's polynomial after one multiplication.
    """

    def __init__(self, w: np.ndarray, which: int = 0):
        power, self.inverse = _power_pair(which, len(w) + 1)
        self.prefix = np.zeros(len(w) + 1, dtype=U)
        np.cumsum(w * power[: len(w)], out=self.prefix[1:])

    def __call__(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        raw = (self.prefix[stop] - self.prefix[start]) * self.inverse[start]
        return mix(raw + (stop - start).astype(U))


def shingle_sets(hashed: list[np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed k-word shingles of each document, laid end to end, and their number per document.

    A document with fewer words than k has its whole sequence as one shingle; one without words has none.
    """
    sets = []
    lengths = np.array([len(w) for w in hashed], dtype=np.int64)
    if not len(lengths) or not lengths.sum():
        return np.zeros(0, dtype=U), np.zeros(len(hashed), dtype=np.int64)
    all_words = np.concatenate(hashed)
    hasher = WindowHasher(all_words)
    ends = np.cumsum(lengths)
    counts = np.zeros(len(hashed), dtype=np.int64)
    for i, (end, n) in enumerate(zip(ends.tolist(), lengths.tolist(), strict=True)):
        if n:
            start = np.arange(end - n, max(end - k, end - n) + 1)
            one = np.unique(hasher(start, np.minimum(start + k, end)))
            sets.append(one)
            counts[i] = len(one)
    return np.concatenate(sets), counts


def in_steps(texts, hash_of, budget: int = STEP):
    """Yield (positions, hashed words) of texts in groups of about ``budget`` words; one text is never cut."""
    at, group, total = [], [], 0
    for i, text in enumerate(texts):
        w = hash_of(text)
        at.append(i)
        group.append(w)
        total += len(w)
        if total >= budget:
            yield at, group
            at, group, total = [], [], 0
    if at:
        yield at, group
