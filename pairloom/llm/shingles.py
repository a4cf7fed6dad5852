"""Word shingles of many texts at once, as arrays."""

from __future__ import annotations

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
_STEP = np.uint64(0xC2B2AE3D27D4EB4F)


def mixed(x: np.ndarray) -> np.ndarray:
    """A scrambled 64-bit number for each number."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (runs without ASCII white space, A-Z in lower case), and the number of words of each text."""
    data = _LOWER[np.frombuffer(b" ".join(texts) + b" ", np.uint8)]
    ends = np.cumsum([len(t) + 1 for t in texts])
    edge = np.flatnonzero(np.diff(np.concatenate(([False], ~_SPACE[data], [False])).astype(np.int8)))
    first, last = edge[::2], edge[1::2]
    with np.errstate(over="ignore"):
        up = np.cumprod(np.full(len(data) + 1, _BASE, np.uint64))
        down = np.cumprod(np.full(len(data) + 1, pow(_BASE, -1, 1 << 64), np.uint64))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1])))
        h = mixed((sums[last] - sums[first]) * down[first] + (last - first).astype(np.uint64))
    return h, np.diff(np.searchsorted(first, np.concatenate(([0], ends))))


def shingle_sets(texts: list[bytes], words: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of all texts: text number, hash (ordered by both), and how often it occurs there.

    A text of fewer words has one shingle of all its words; a text without words has none.
    """
    h, counts = word_hashes(texts)
    start = np.concatenate(([0], np.cumsum(counts)))[:-1]
    made = np.where(counts >= words, counts - words + 1, (counts > 0).astype(counts.dtype))
    text = np.repeat(np.arange(len(texts)), made)
    at = np.arange(len(text)) - np.repeat(np.cumsum(made) - made, made) + start[text]
    long = counts[text] >= words
    with np.errstate(over="ignore"):
        s = np.zeros(len(text), np.uint64)
        for j in range(words):
            here = long | (j < counts[text])
            s = np.where(here, (s + h[np.minimum(at + j, max(len(h) - 1, 0))]) * _STEP, s) if len(h) else s
        s = mixed(s + np.minimum(counts[text], words).astype(np.uint64))
    order = np.lexsort((s, text))
    text, s = text[order], s[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (text[1:] != text[:-1])
    places = np.flatnonzero(new)
    return text[places], s[places], np.diff(np.concatenate((places, [len(s)])))
