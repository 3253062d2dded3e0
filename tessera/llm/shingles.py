"""Word shingles as 64-bit hashes, per text, inside tasks."""

from __future__ import annotations

import numpy as np
import xxhash

WIDTH = 5
_CACHE_WORDS = 500_000
_words: dict[bytes, int] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser on unsigned 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hash of each word; a bounded cache spares hashing the common ones again."""
    if len(_words) > _CACHE_WORDS:
        _words.clear()
    try:
        return np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    except KeyError:
        for w in set(words):
            if w not in _words:
                _words[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))


def rolled(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` word hashes, in text order; of the whole if it is shorter."""
    n = len(hashes)
    if n == 0:
        return hashes
    width = min(width, n)
    out = np.full(n - width + 1, np.uint64(width), np.uint64)
    for j in range(width):
        out = mix64(out + hashes[j:n - width + 1 + j])
    return out


def split_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space (\\x20, \\x09-\\x0D) with A-Z lower-cased; null has none."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct shingle hashes of a whole text."""
    return np.unique(rolled(word_hashes(split_words(text)), width))
