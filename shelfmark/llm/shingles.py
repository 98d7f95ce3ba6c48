"""Word shingles of whole texts as sorted 64-bit hashes, for use inside tasks."""

from __future__ import annotations

import numpy as np
import xxhash

#: Odd multipliers of the mixing steps.
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
#: Bytes that are cut and hashed at once, and bytes from which a word is hashed by itself.
PIECE, LONG_WORD = 1 << 20, 512


class WordHashes(dict):
    """Hashes of words, remembered up to a bounded number of words."""

    def __init__(self, bound: int = 1 << 20):
        super().__init__()
        self.bound = bound

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.bound:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def text_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX[1]
    x = (x ^ (x >> np.uint64(27))) * MIX[2]
    return x ^ (x >> np.uint64(31))


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whether a byte belongs to a word, its 64-bit code (the same for A-Z and a-z), and the weights of places in a word."""
    code = mixed((np.arange(256, dtype=np.uint64) + np.uint64(1)) * MIX[0]) | np.uint64(1)
    code[65:91] = code[97:123]
    held = np.ones(256, bool)
    held[[9, 10, 11, 12, 13, 32]] = False
    weights = np.full(LONG_WORD, MIX[2], np.uint64)
    weights[0] = 1
    return held, code, np.multiply.accumulate(weights)


HELD, CODE, WEIGHTS = _tables()


def byte_hashes(data: np.ndarray) -> np.ndarray:
    """One hash per word of some bytes: its bytes' codes, weighed by their places, added up and mixed."""
    held = np.zeros(len(data) + 2, bool)
    np.take(HELD, data, out=held[1:-1], mode="clip")
    edges = np.flatnonzero(held[1:] != held[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64)
    size = ends - starts
    first = np.cumsum(size) - size
    place = np.arange(first[-1] + size[-1]) - np.repeat(first, size)
    weighed = np.take(CODE, data[held[1:-1]], mode="clip")
    weighed *= np.take(WEIGHTS, place, mode="clip")
    value = mixed(np.add.reduceat(weighed, first) + size.astype(np.uint64) * MIX[1])
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        value[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes().lower())
    return value


def word_hashes(text: str | None) -> np.ndarray:
    """One 64-bit hash per word of a text, in pieces that end between words."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    if len(data) <= PIECE:
        return byte_hashes(data)
    gaps = np.flatnonzero(~HELD[data])
    cuts = gaps[np.minimum(np.searchsorted(gaps, np.arange(PIECE, len(data), PIECE)), len(gaps) - 1)] if len(gaps) else []
    return np.concatenate([byte_hashes(x) for x in np.split(data, np.unique(cuts).astype(np.int64))])


def shingle_sequence(hashes: np.ndarray, size: int = 5) -> np.ndarray:
    """One hash per shingle in text order; the whole sequence as one if there are fewer words."""
    n = len(hashes)
    if n == 0:
        return hashes
    size = min(size, n)
    value = np.full(n - size + 1, size, np.uint64)
    for j in range(size):
        value = (value ^ (value >> np.uint64(29))) * MIX[0] + hashes[j : n - size + 1 + j]
    return mixed(value)


def shingle_set(text: str | None, size: int = 5) -> np.ndarray:
    """Sorted distinct shingles."""
    found = np.sort(shingle_sequence(word_hashes(text), size))
    return found[np.concatenate([[True], found[1:] != found[:-1]])] if len(found) else found
