"""Word-shingle sets of texts as sorted 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

MIX = np.uint64(0x9E3779B97F4A7C15)
STEP = np.uint64(0xD6E8FEB86659FD93)


class WordHashes(dict):
    """Word bytes to a 64-bit hash, kept between texts; bounded, as it starts afresh when it is full."""

    def __init__(self, most: int = 250_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * STEP
    return h ^ (h >> np.uint64(29))


def rolled(words: np.ndarray, width: int) -> np.ndarray:
    """A hash for each window of width words; order matters."""
    n = len(words) - width + 1
    h = words[:n].copy()
    for k in range(1, width):
        h = h * MIX + words[k : k + n]
    return mixed(h)


def split_words(text: str, lower: bool = False) -> list[bytes]:
    """Words of a text as UTF-8; lower turns A-Z to a-z and leaves other letters. bytes.split() parts at exactly the six
    white-space characters of WORD."""
    raw = text.encode("utf-8", "surrogatepass")
    return (raw.lower() if lower else raw).split()


def shingle_set(text: str, width: int, cache: WordHashes) -> np.ndarray:
    """Sorted distinct shingle hashes; a text with fewer words is one shingle, one without words the empty set."""
    words = cache.of(split_words(text, lower=True))
    if not len(words):
        return words
    return np.unique(rolled(words, min(width, len(words))))
