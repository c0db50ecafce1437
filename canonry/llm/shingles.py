"""Hashed word shingles of whole texts, many texts at a time."""

from __future__ import annotations

import numpy as np
import xxhash

#: Words a worker remembers the hashes of before it starts over.
CACHE_WORDS = 500_000

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(word) > 256:
            return xxhash.xxh64_intdigest(word)
        got = self[word] = xxhash.xxh64_intdigest(word)
        return got


_hashes = _Hashes()


def forget() -> None:
    _hashes.clear()


def word_hashes(words: list[bytes]) -> np.ndarray:
    if len(_hashes) > CACHE_WORDS:
        _hashes.clear()
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def split_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


_TO_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def lower_words(text: str | None) -> list[bytes]:
    """Words with A-Z, and nothing else, in lower case."""
    return text.encode("utf-8", "surrogatepass").translate(_TO_LOWER).split() if text else []


def shingle_hashes(texts: list[str | None], width: int, split=split_words) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of all texts, one after another, repeated ones
    too, and the number of each text.  A text with fewer words than ``width``
    has one shingle, its whole word sequence; one without words has none."""
    words = list(map(split, texts))
    n = np.fromiter(map(len, words), np.int64, len(words))
    flat = word_hashes([w for ws in words for w in ws])
    out = np.full(max(len(flat) - width + 1, 0), width, np.uint64)
    for k in range(width):
        out = mix(out * _MULTIPLIER + flat[k : k + len(out)])
    # Shingles that begin in one text and end in the next are none.
    ends = np.cumsum(n)
    count = np.where(n >= width, n - width + 1, (n > 0).astype(np.int64))
    keep = np.repeat(ends - n, np.maximum(n - width + 1, 0)) + _ramp(np.maximum(n - width + 1, 0))
    long = out[keep]
    short = np.flatnonzero((n > 0) & (n < width))
    if not len(short):
        return long, count
    starts = np.cumsum(count) - count
    full = np.zeros(int(count.sum()), np.uint64)
    is_short = np.zeros(len(full), bool)
    is_short[starts[short]] = True
    full[~is_short] = long
    for i in short:
        h = np.uint64(n[i])
        for w in flat[ends[i] - n[i] : ends[i]]:
            h = _step(h, w)
        full[starts[i]] = h
    return full, count


def _step(h: np.uint64, w: np.uint64) -> np.uint64:
    return mix((np.array([h], np.uint64) * _MULTIPLIER + np.array([w], np.uint64)))[0]


def _ramp(n: np.ndarray) -> np.ndarray:
    """0..n[0]-1, 0..n[1]-1, ..."""
    total = int(n.sum())
    return np.arange(total) - np.repeat(np.cumsum(n) - n, n)
