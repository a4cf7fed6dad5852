"""BPE encoding and decoding with content-defined chunk reuse.

Each text is cut where a rolling hash of the last 16 bytes says so, so that a passage is cut alike wherever it stands.
A chunk that turns up again, in this or another document of the task, is not encoded again: its tokens are kept. Cuts
fall anywhere, also inside words, so each join of two chunks is repaired: the piece around the join is taken out of
both chunks and encoded anew, and grows (over as many chunks as it needs) until its two ends agree with what the
chunks hold there. Both agree exactly where the end is ASCII white space: the tokenizers served here drop white space
and have no token, normal form, special token or pre-token that reaches over it (``check_tokenizer`` refuses others).
Inside a chunk the same argument lets distinct words be encoded once.

Chunks are shared within a task, not over the network: tokens of the whole corpus weigh more than its text, and to
move them costs more than the few per cent of chunks that other tasks encode as well. No step shuffles.

Memory: both caches keep two generations of a fixed size, what is in use and what was before it; texts are taken in slices
of a few MB (a longer text alone). Recovery: a task depends on its input rows only.

Defined results: null text is empty text; empty text gives no ids and the empty string. Repeated rows are encoded each.
Columns other than the text pass through; the new columns get underscores where a name is taken.
"""

from __future__ import annotations

import ctypes
import os
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, types as T

from pairloom.llm.common import free_name

WINDOW = 16
#: A cut where this many bits of the hash are zero: chunks of about 512 bytes.
CUT_BITS = 9
LEAST_CHUNK = 64
SLICE_BYTES = 2 << 20
#: Of one generation each.
CACHED_WORDS = 150_000
CACHED_CHUNK_BYTES = 4 << 20
LONGEST_CACHED_WORD = 64


def gear_table() -> np.ndarray:
    """A mixed 32-bit number for each byte value."""
    x = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(32)).astype(np.uint32)


def cut_points(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Positions after which the rolling hash of the last ``WINDOW`` bytes asks for a cut."""
    h = table[data]
    step = 1
    while step < WINDOW:  # the hash over 2 * step bytes is that over step bytes, plus the one before, shifted
        h[step:] += h[:-step] << np.uint32(step)
        step *= 2
    return np.flatnonzero((h >> np.uint32(32 - CUT_BITS)) == 0) + 1


def check_tokenizer(tokenizer) -> None:
    """Refuse a tokenizer whose tokens depend on white space or reach over it."""
    ids = lambda text: tokenizer.encode(text, add_special_tokens=False).ids
    for left, right in (("ab", "cd"), ("don", "'t."), ("x1", "2"), ("é", "ß,")):
        for space in (" ", "\n", " \t  "):
            if ids(left + space + right) != ids(left) + ids(right) or ids(space + left + space) != ids(left):
                raise ValueError("this tokenizer's tokens depend on white space")


class ChunkCoder:
    """Encodes texts chunk by chunk; one for each Python worker."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        check_tokenizer(self.tokenizer)
        self.table = gear_table()
        # two generations: what is used moves up, and the older one goes when the younger is full
        self.words: dict[bytes, tuple[bytes, bytes]] = {}
        self.old_words: dict[bytes, tuple[bytes, bytes]] = {}
        self.chunks: dict[bytes, tuple[bytes, list, bytes, bool]] = {}
        self.old_chunks: dict[bytes, tuple[bytes, list, bytes, bool]] = {}
        self.chunk_bytes = self.made = self.reused = 0

    def learn(self, words: set[bytes]) -> dict[bytes, tuple[bytes, bytes]]:
        """Encode the words that aren't known: ids as little-endian bytes, and the decoded text with a blank after it."""
        if len(self.words) > CACHED_WORDS:
            self.old_words, self.words = self.words, {}
        new = []
        for w in words:
            if w not in self.words:
                if (known := self.old_words.get(w)) is None:
                    new.append(w)
                else:
                    self.words[w] = known
        found = self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in new], add_special_tokens=False)
        ids = [x.ids for x in found]
        texts = self.tokenizer.decode_batch(ids, skip_special_tokens=False)
        long: dict[bytes, tuple[bytes, bytes]] = {}
        for w, i, t in zip(new, ids, texts, strict=True):
            (self.words if len(w) <= LONGEST_CACHED_WORD else long)[w] = (np.array(i, "<u4").tobytes(), t.encode() + b" " if i else b"")
        return long

    def code(self, texts: list[bytes]) -> tuple[list[bytes], list[bytes]]:
        """The ids and the decoded text of each text, as bytes."""
        if self.chunk_bytes > CACHED_CHUNK_BYTES:
            self.old_chunks, self.chunks, self.chunk_bytes = self.chunks, {}, 0
        plans, need = self._plan(texts)
        long = self.learn(need)
        at = (lambda w: self.words.get(w) or long[w]) if long else self.words.__getitem__
        ids, decoded = [], []
        for plan in plans:
            found = []
            for piece in plan:
                if isinstance(piece, bytes):  # a word around a join
                    found.append(at(piece))
                else:
                    if piece[1] is None:
                        inner = [at(w) for w in piece[0]]
                        piece[0], piece[1] = None, (b"".join([x[0] for x in inner]), b"".join([x[1] for x in inner]))
                    found.append(piece[1])
            ids.append(b"".join([x[0] for x in found]))
            decoded.append(b"".join([x[1] for x in found])[:-1])
        return ids, decoded

    def _plan(self, texts: list[bytes]) -> tuple[list[list], set[bytes]]:
        """For each text its chunks' inner parts and the repaired joins between them, in order; and all words they need."""
        whole = b"".join(texts)
        cuts = cut_points(np.frombuffer(whole, np.uint8), self.table) if whole else np.empty(0, np.int64)
        need: set[bytes] = set()
        plans, start = [], 0
        for text in texts:
            end, plan, carry, last = start + len(text), [], b"", start
            own = cuts[np.searchsorted(cuts, start + WINDOW) : np.searchsorted(cuts, end)].tolist()
            for cut in [*own, end]:
                if cut - last < LEAST_CHUNK and cut < end:
                    continue
                chunk = whole[last:cut]
                last = cut
                part = self.chunks.get(chunk)
                if part is None:
                    part = self.old_chunks.get(chunk)
                    if part is None:
                        part = self._split(chunk, need)
                        self.made += 1
                    else:
                        self.reused += 1
                    self.chunks[chunk] = part
                    self.chunk_bytes += len(chunk)
                else:
                    self.reused += 1
                head, inner, tail, open_ = part
                if open_:  # no white space: the join's piece goes on into the next chunk
                    carry += head
                    continue
                if carry := carry + head:
                    need.add(carry)
                    plan.append(carry)
                plan.append(inner)
                carry = tail
            if carry:
                need.add(carry)
                plan.append(carry)
            plans.append(plan)
            start = end
        return plans, need

    @staticmethod
    def _split(chunk: bytes, need: set[bytes]) -> tuple[bytes, list, bytes, bool]:
        """What stands before the first and after the last white space, and the words between."""
        words = chunk.split()
        if not words:
            return b"", [words, None], b"", not chunk
        head = b"" if chunk[:1].isspace() else words.pop(0)
        if not words and len(head) == len(chunk):
            return head, [[], None], b"", True
        tail = b"" if chunk[-1:].isspace() or not words else words.pop()
        need.update(words)
        return head, [words, None], tail, False


_coders: dict[str, ChunkCoder] = {}


def coder(path: str) -> ChunkCoder:
    if path not in _coders:
        _coders[path] = ChunkCoder(path)
    return _coders[path]


@cache
def _c_library():
    return ctypes.CDLL(None)


def give_back() -> None:
    """Return freed memory to the machine; workers outlive their stage, and allocators keep what was freed."""
    pa.default_memory_pool().release_unused()
    if hasattr(_c_library(), "malloc_trim"):  # glibc only
        _c_library().malloc_trim(0)


def forget_coders() -> None:
    """Drop this worker's tokenizers and caches. Called by tasks of other operators: the encoding stage is over then."""
    if _coders:
        _coders.clear()
        give_back()


def slices(batch: pa.RecordBatch, column: int, size: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Parts of a batch with about ``size`` bytes of text each, at least one row, and their texts (null: empty)."""
    column = batch.column(column).cast(pa.binary())
    sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    first = total = 0
    for i, n in enumerate([*sizes, size + 1]):
        if i > first and (total + n > size or i == len(sizes)):
            yield batch.slice(first, i - first), [x or b"" for x in column.slice(first, i - first).to_pylist()]
            first, total = i, 0
        total += n
    pa.default_memory_pool().release_unused()  # workers outlive their stage


def encode(docs: DataFrame, tokenizer_path: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``ids`` (token ids as little-endian unsigned 32-bit integers) and ``decoded`` (their text).

    ``tokenizer_path`` names a file that every executor can open.
    """
    at = docs.columns.index(text_col)
    ids, decoded = free_name(docs, "ids"), free_name(docs, "decoded")
    schema = T.StructType([*docs.schema.fields, T.StructField(ids, T.BinaryType()), T.StructField(decoded, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(tokenizer_path)
        for batch in batches:
            for part, texts in slices(batch, at):
                i, d = own.code(texts)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(i, pa.binary()), pa.array(d, pa.binary()).cast(pa.string())], names=[*part.schema.names, ids, decoded])

    return docs.mapInArrow(run, schema)
