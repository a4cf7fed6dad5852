"""Words of many texts at once, as arrays: byte classes cut them, and equal words are found by their bytes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_PRIME = 0x9E3779B97F4A7C15


@dataclass
class Words:
    """Occurrences in text order: number in ``known``, text, and pieces before it; ``known`` holds each distinct word once."""

    word: np.ndarray
    text: np.ndarray
    piece: np.ndarray
    known: pa.Array


def words_of(texts: list[bytes], member: np.ndarray, breaks: np.ndarray, lower: bool = True) -> Words:
    """Runs of bytes that ``member`` marks; a new piece starts after each byte that ``breaks`` marks, and with each text.

    No byte of a character outside ASCII is below 128, so that ASCII marks never cut a character.
    """
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    inside = member[data]
    ends = np.cumsum(np.array([len(t) + 1 for t in texts], np.int64))
    inside[ends - 1] = False  # the joining line ends
    if not texts:
        inside[:] = False
    edges = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
    first, last = edges[::2], edges[1::2]
    text = np.searchsorted(ends, first, side="right")
    piece = np.searchsorted(np.flatnonzero(breaks[data]), first) + text
    body = data[inside]
    offsets = np.concatenate(([0], np.cumsum(last - first))).astype(np.int32)
    if lower:
        body = LOWER[body]
    column = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(body))])
    coded = column.dictionary_encode()
    return Words(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), text, piece, coded.dictionary)


def bytes_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary array and its offsets."""
    offsets = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1, words.offset * 4).astype(np.int64)
    data = words.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data and data.size else np.empty(0, np.uint8)), offsets


def hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit number for each word, the same in every task; not for telling words apart, but for sketches."""
    data, offsets = bytes_of(words)
    with np.errstate(over="ignore"):
        up = np.cumprod(np.full(len(data) + 1, _PRIME, np.uint64))
        down = np.cumprod(np.full(len(data) + 1, pow(_PRIME, -1, 1 << 64), np.uint64))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1])))
        h = (sums[offsets[1:]] - sums[offsets[:-1]]) * down[offsets[:-1]] + np.diff(offsets).astype(np.uint64)
    return mixed(h)


def mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def joined_hashes(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A number for each pair of numbers."""
    with np.errstate(over="ignore"):
        return mixed(left * np.uint64(_PRIME) + right)
