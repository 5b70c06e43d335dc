"""Words and hashed word shingles of whole texts."""

from __future__ import annotations

import numpy as np
import xxhash

WORD_CACHE = 200_000
_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """Word bytes to 64-bit hashes; the cache starts anew when it is full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def words_of(text: str | None) -> list[bytes]:
    """Runs outside space and U+0009-U+000D, A-Z in lower case, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingle_set(words: list[bytes], hashes: WordHashes, n: int = 3) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles; fewer words count as one shingle."""
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    width = min(n, len(words))
    out = mix(h[: len(h) - width + 1] + np.uint64(width))
    for i in range(1, width):
        out = mix(out * _ODD + h[i : len(h) - width + 1 + i])
    return np.unique(out)
