"""Class-based bigram language model with Brown classes found by exchange clustering.

Model: P(w | v) = L * P(class(w) | class(v)) * P(w | class(w)) + (1 - L) * P0(w), with P0 the smoothed unigram base. A text's
tokens follow the mark that ends texts and end with it. Words not seen in training have P0 only, and so has what follows them.

Exchange clustering: the ``TOP`` most frequent tokens begin dealt over ``CLASSES`` classes in order of frequency. Sweeps take one
word after the other out of its class and put it where the likelihood of the class bigrams is greatest, until a sweep
moves none (or ``SWEEPS`` are done). This needs the bigram counts among these tokens and the classes of all others only: a
table bounded by TOP + CLASSES. All other words are first placed by their neighbours among the frequent words (dealt over the classes where
there are none) and then exchanged in rounds, all of them in parallel, by all their neighbours in the corpus; after each round the frequent words are
exchanged against the new classes. The rounds end when one doesn't raise the likelihood (it is undone), or after ``ROUNDS``.

Scale: no row a token ever leaves a task. A task turns texts into blocks: a block has its own word list and its texts as numbers into it.
Shuffled are one entry a block and distinct word: once to the word's bucket with its count and back with its total and place there (a bucket also
names its ``TOP`` most frequent words, of which those of the corpus are taken); in each round
to the bucket with its neighbours' classes and back with its own. Entries travel packed, an array a block and bucket; blocks lie in buckets
by their number, so that no round moves them, and number their words in the order in which these travel. Tables and shuffle files go when nothing reads them any more. Per-word totals are exact sums over all
training texts. Blocks and buckets are bounded by settings, not by the corpus; the table of class bigrams has WIDTH**2 entries.

Training texts: those whose id's crc32 leaves a remainder by 10. Words: ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case.

Defined results: null text is empty text, which is the end mark alone. A null id counts as the empty id. Repeated rows count and are scored each.
Without training texts N and V are 0 and every token has P0 = 1. An empty table gives no row.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from pairloom.llm.bpe_chunks import slices
from pairloom.llm.common import crc_of, whole_text
from pairloom.session import materialize, materialize_bucketed, release

CLASSES = 64
TOP = 512
SWEEPS = 10
#: Exchanges of all other words at most, the first of them their placing.
ROUNDS = 4
MIX = 0.9
BASE = 0.1
BLOCK_BYTES = 2 << 20
BLOCKS_A_BATCH = 1
#: Entries of a block and word that a bucket gets, about.
BUCKET_WORDS = 1 << 18
#: Counts of a neighbour for which gains are looked up; larger ones are computed.
SMALL = 64
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Every step writes a table, so the shuffle files that led to it are never read again.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: The class of the end mark, and that of words outside TOP before their placing.
END, OTHER = CLASSES, CLASSES + 1
WIDTH = CLASSES + 2

_BLOCK = "block bigint, ids {id}, held binary, lengths binary, tokens binary, words string, counts binary"


def _numbers(column: pa.Array, i: int, kind: str) -> np.ndarray:
    return np.frombuffer(column[i].as_buffer(), kind)


def _counts(column: pa.Array, i: int, size: int) -> np.ndarray:
    """So many counts; they are written in four bytes where their largest allows it."""
    held = column[i].as_buffer()
    return np.frombuffer(held, "<i4" if len(held) == 4 * size else "<i8")


def _in_few(counts: np.ndarray) -> np.ndarray:
    return counts.astype("<i4" if counts.max(initial=0) < 1 << 31 else "<i8")


def _tokens(column: pa.Array, i: int, lengths: np.ndarray) -> np.ndarray:
    """A block's tokens; they are written in two bytes where its word list allows it."""
    held = column[i].as_buffer()
    return np.frombuffer(held, "<u2" if len(held) == 2 * lengths.sum() else "<i4").astype(np.int32)


def words_of(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts one after the other, in lower case, and how many each text has."""
    low = pc.ascii_lower(pa.array(texts, pa.binary()).cast(pa.string(), safe=False))
    split = pc.ascii_split_whitespace(low)
    flat, sizes = split.flatten(), np.diff(split.offsets.to_numpy())
    filled = np.asarray(pc.greater(pc.binary_length(flat), 0))
    if not filled.all():  # empty pieces at either end of a text
        of = np.repeat(np.arange(len(texts)), sizes)
        sizes, flat = np.bincount(of[filled], minlength=len(texts)), flat.filter(pa.array(filled))
    return flat, sizes


def _joined(words: pa.Array, cuts: np.ndarray) -> pa.Array:
    """Words from each cut to the next as one text; no word is empty or holds a line end."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), words), "\n")


def _split(joined: pa.Array) -> pa.Array:
    """The words of all rows, one after the other."""
    return pc.list_flatten(pc.split_pattern(joined.filter(pc.greater(pc.binary_length(joined), 0)), "\n"))


def _blocks(docs: DataFrame) -> DataFrame:
    """Texts as numbers into a word list, a row a block; number 0 is the end mark."""
    id_type = docs.schema["id"].dataType
    schema = _BLOCK.format(id=f"array<{id_type.simpleString()}>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, 1, BLOCK_BYTES):
                ids = part.column(0)
                held = np.array(crc_of(ids.to_pylist())) % 10 == 0
                flat, sizes = words_of(texts)
                coded = flat.dictionary_encode()
                number = coded.indices.to_numpy().astype(np.int32) + 1
                tokens = np.zeros(len(number) + len(texts), np.int32)
                text = np.repeat(np.arange(len(texts)), sizes)
                tokens[np.arange(len(number)) + text] = number
                counts = np.bincount(number[~held[text]], minlength=len(coded.dictionary) + 1).astype(np.int32)
                counts[0] = (~held).sum()
                row = [pa.array([0], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)]
                if len(coded.dictionary) < 1 << 16:
                    tokens = tokens.astype("<u2")
                row += [pa.array([x.tobytes()], pa.binary()) for x in (held, (sizes + 1).astype(np.int32), tokens)]
                row += [_joined(coded.dictionary, [0, len(coded.dictionary)]), pa.array([counts.tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(row, names=["block", "ids", "held", "lengths", "tokens", "words", "counts"])

    return docs.mapInArrow(run, schema).withColumn("block", F.monotonically_increasing_id())


def _train_pairs(tokens: np.ndarray, lengths: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Neighbouring tokens of the training texts; the first of a text follows the end mark."""
    before = np.concatenate((np.zeros(1, np.int32), tokens[:-1]))
    keep = ~np.repeat(held, lengths)
    return before[keep], tokens[keep]


def frequent_words(counted: DataFrame, top: int) -> list[str]:
    """The most frequent training words, by sums over all rows' ``words`` and ``counts`` (the first count is the end mark's)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                words = _split(batch.column(0).slice(i, 1))
                counts = _counts(batch.column(1), i, len(words) + 1)[1:]
                seen = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([words.take(pa.array(seen)), pa.array(counts[seen].astype(np.int64))], names=["word", "n"])

    rows = counted.select("words", "counts").mapInArrow(run, "word string, n bigint")
    return [r.word for r in rows.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(top).collect()]


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def gains(rows: np.ndarray, columns: np.ndarray, table: np.ndarray, selves: np.ndarray) -> np.ndarray:
    """How much each class gains in sum of N log N over class bigrams, less the classes' own, by a word's coming to it.

    ``rows`` (words, classes): how often each class follows the word; ``columns``: precedes it; ``selves``: itself follows itself.
    ``table``: class bigrams without the word.
    """
    k = CLASSES
    across = np.ascontiguousarray(table.T)
    left, right, own = table.sum(1)[:k], table.sum(0)[:k], np.diag(table)[:k]
    n_out, n_in = (rows.sum(1) + selves)[:, None], (columns.sum(1) + selves)[:, None]
    row, column = _xlogx(table[:k] + rows[:, None]), _xlogx(across[:k] + columns[:, None])  # words, classes, classes beside them
    both = own + rows[:, :k] + columns[:, :k] + selves[:, None]
    c = np.arange(k)
    new = row.sum(2) - row[:, c, c] + column.sum(2) - column[:, c, c] + _xlogx(both)
    old = _xlogx(table[:k]).sum(1) + _xlogx(across[:k]).sum(1) - _xlogx(own)
    out_c, in_c = left + columns[:, :k], right + rows[:, :k]  # with what the class has to and from the word
    ends = _xlogx(out_c + n_out) - _xlogx(out_c) + _xlogx(in_c + n_in) - _xlogx(in_c)
    return new - old - ends


def exchange(bigrams: np.ndarray, sweeps: int = SWEEPS, classes: np.ndarray | None = None, words: int | None = None) -> np.ndarray:
    """Classes of the end mark, ``words`` words that move, and whatever follows them and doesn't (without ``classes``: the rest)."""
    n = len(bigrams)
    words = n - 2 if words is None else words
    counts = bigrams.astype(float)
    classes = np.concatenate(([END], np.arange(words) % CLASSES, [OTHER])) if classes is None else classes.copy()
    hot = np.eye(WIDTH)[classes]
    table = hot.T @ counts @ hot
    for _ in range(sweeps):
        moved = 0
        for w in range(1, words + 1):
            self_ = counts[w, w]
            row, column = (np.bincount(classes, x, WIDTH) for x in (counts[w], counts[:, w]))
            row[classes[w]] -= self_
            column[classes[w]] -= self_
            table[classes[w]] -= row
            table[:, classes[w]] -= column
            table[classes[w], classes[w]] -= self_
            best = int(np.argmax(gains(row[None], column[None], table, np.array([self_]))[0]))
            moved += best != classes[w]
            classes[w] = best
            table[best] += row
            table[:, best] += column
            table[best, best] += self_
        if not moved:
            break
    return classes


def likelihood(table: np.ndarray) -> float:
    """The part of the training texts' log likelihood that depends on the classes."""
    return float(_xlogx(table).sum() - _xlogx(table.sum(0)).sum() - _xlogx(table.sum(1)).sum())


def _to_words(buckets: int):
    """A block's words with their counts, an entry a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                words = _split(batch.column(1).slice(i, 1))
                counts = _numbers(batch.column(2), i, "<i4")[1:]
                bucket = (pd.util.hash_array(words.to_numpy(zero_copy_only=False), categorize=False) % np.uint64(buckets)).astype(np.int32)
                order = np.argsort(bucket, kind="stable")
                cuts = np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=np.int32))
                some = np.flatnonzero(np.diff(cuts))
                cuts = np.append(cuts[some], len(order))
                packed = [[x[i:j].tobytes() for i, j in itertools.pairwise(cuts)] for x in ((order + 1).astype("<i4"), counts[order])]
                block = batch.column(0).take(pa.array(np.full(len(some), i)))
                yield pa.RecordBatch.from_arrays([block, pa.array(some, pa.int32()), _joined(words.take(pa.array(order)), cuts), *map(pa.array, packed, [pa.binary()] * 2)], schema=_WORDS)

    return run


def _fields(**kinds: pa.DataType) -> pa.Schema:
    return pa.schema(list(kinds.items()))


_WORDS = _fields(block=pa.int64(), bucket=pa.int32(), words=pa.string(), numbers=pa.binary(), counts=pa.binary())
_TOTALS = _fields(block=pa.int64(), bucket=pa.int32(), numbers=pa.binary(), at=pa.binary(), totals=pa.binary(), distinct=pa.int64(), words=pa.string(), counts=pa.binary())
_PACKED = _fields(block=pa.int64(), bucket=pa.int32(), at=pa.binary(), classes=pa.binary(), entries=pa.binary(), entry_code=pa.binary(), entry_n=pa.binary())
_PLACED = _fields(block=pa.int64(), bucket=pa.int32(), classes=pa.binary())


def _sum_words(top: int):
    """Places in the bucket and totals of one bucket's words, sent back to their blocks; with the first, its ``top`` most frequent words."""

    def run(batch: pa.Table) -> pa.Table:
        batch = batch.combine_chunks().sort_by("block").combine_chunks()
        coded = _split(batch["words"].combine_chunks()).dictionary_encode()
        at, names = coded.indices.to_numpy(), coded.dictionary
        lists = [np.frombuffer(x, "<i4") for x in batch["counts"].to_pylist()]
        cuts = np.cumsum([len(x) for x in lists])[:-1]
        totals = np.bincount(at, np.concatenate(lists), len(names)).astype("<i8")
        packed = [[x.tobytes() for x in np.split(y, cuts)] for y in (at.astype("<i4"), _in_few(totals)[at])]
        least = np.partition(totals, -top)[-top] if len(totals) > top else 0
        some = np.flatnonzero(totals >= max(least, 1))
        most = pa.table({"word": names.take(pa.array(some)), "n": totals[some]}).sort_by([("n", "descending"), ("word", "ascending")]).slice(0, top).combine_chunks()
        words, counts = "\n".join(most["word"].to_pylist()), _in_few(np.concatenate(([0], most["n"].to_numpy()))).tobytes()
        once = [[x, *[None] * (len(lists) - 1)] for x in (int((totals > 0).sum()), words, counts)]
        return pa.table([batch["block"], batch["bucket"], batch["numbers"], *packed, *once], schema=_TOTALS)

    return run


def _places(names: list[str]):
    """Words out, their places among the frequent words in (from 1; 0: not among them)."""
    known = pa.array(names, pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                place = pc.fill_null(pc.index_in(_split(batch.column(5).slice(i, 1)), value_set=known), -1).to_numpy() + 1
                place = np.concatenate(([0], place)).astype("<i4").tobytes()
                yield pa.RecordBatch.from_arrays([*(batch.column(j).slice(i, 1) for j in range(5)), pa.array([place], pa.binary())], names=[*batch.schema.names[:5], "place"])

    return run


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A block with its words numbered anew: those that move by bucket and place in it, as they travel, then the frequent and the unknown ones.

    ``buckets``: those of the words that move, and how many each has; ``at``: their places; ``place``: of the words that don't.
    """
    for batch in batches:
        for i in range(len(batch)):
            lengths, place = (_numbers(batch.column(j), i, "<i4") for j in (3, 5))
            bucket, at, totals = np.zeros(len(place), "<i4"), np.zeros(len(place), "<i4"), np.zeros(len(place), "<i8")
            for x in batch.column(6)[i].as_py() or []:
                own = np.frombuffer(x["numbers"], "<i4")
                bucket[own], at[own] = x["bucket"], np.frombuffer(x["at"], "<i4")
                totals[own] = np.frombuffer(x["totals"], "<i4" if len(x["totals"]) == len(x["numbers"]) else "<i8")
            moves = (place == 0) & (totals > 0)
            own, rest = np.flatnonzero(moves), np.flatnonzero(~moves)  # the end mark doesn't move: it stays first
            own = own[np.argsort(bucket[own].astype(np.int64) << 32 | at[own])]
            order = np.concatenate((rest[:1], own, rest[1:]))
            number = np.empty(len(order), "<i4")
            number[order] = np.arange(len(order))
            tokens = number[_tokens(batch.column(4), i, lengths)]
            buckets = np.stack(np.unique(bucket[own], return_counts=True)).astype("<i4")
            columns = [tokens.astype("<u2") if len(order) <= 1 << 16 else tokens, place[rest[1:]], buckets, at[own], _in_few(totals[order])]
            yield pa.RecordBatch.from_arrays([*(batch.column(j).slice(i, 1) for j in range(4)), *(pa.array([x.tobytes()], pa.binary()) for x in columns)], names=[*batch.schema.names[:4], "tokens", "place", "buckets", "at", "totals"])


def _local(known: list | None, size: int) -> np.ndarray:
    """Classes of a block's words that move."""
    if known is None:
        return np.full(size, OTHER, np.uint8)
    return np.frombuffer(b"".join(x["classes"] for x in sorted(known, key=lambda x: x["bucket"])), np.uint8)


def in_bytes(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts from 1 as sums of bytes: which count each of them belongs to, and the bytes."""
    if counts.max(initial=0) < 256:
        return np.arange(len(counts)), counts.astype(np.uint8)
    times = (counts + 254) // 255
    n = np.full(times.sum(), 255, np.uint8)
    n[np.cumsum(times) - 1] = counts - 255 * (times - 1)
    return np.repeat(np.arange(len(counts)), times), n


def _evidence(top: int, entries: bool):
    """What stands beside each word that isn't frequent, packed by block and bucket, and a task's bigrams (bucket -1).

    Neighbours are given by code: 0 the end mark, then the frequent words, then the classes of the others. A word beside itself has a code of its own.
    """
    n = 1 + top + CLASSES + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(n * n, np.int64)
        for batch in batches:
            for i in range(len(batch)):
                held, lengths, place, buckets, at = (_numbers(batch.column(j), i, k) for j, k in ((1, "?"), (2, "<i4"), (4, "<i4"), (5, "<i4"), (6, "<i4")))
                m = len(at)
                classes = _local(batch.column(7)[i].as_py(), m)
                others = 1 + top + np.minimum(classes.astype(np.int64), CLASSES)
                code = np.concatenate(([0], others, np.where(place > 0, place, 1 + top + CLASSES)))
                a, b = _train_pairs(_tokens(batch.column(3), i, lengths), lengths, held)
                before, after = code[a], code[b]
                sums += np.bincount(before * n + after, minlength=n * n)
                if not entries:
                    continue
                kind = np.int32 if m * (2 * n + 1) < 1 << 31 else np.int64
                first = np.arange(-1, m, dtype=kind) * (2 * n + 1)  # of each word's keys
                i_b, i_a = np.flatnonzero((b > 0) & (b <= m)), np.flatnonzero((a > 0) & (a <= m) & (a != b))
                same = a[i_b] == b[i_b]
                keys = np.concatenate((first[b[i_b]] + np.where(same, 2 * n, before[i_b]).astype(kind), first[a[i_a]] + (n + after[i_a]).astype(kind)))
                keys.sort()
                at_key = np.flatnonzero(np.diff(keys, prepend=-1))
                keys, count = keys[at_key], np.diff(at_key, append=len(keys))
                of, count = in_bytes(count)
                word, beside = np.divmod(keys, 2 * n + 1)
                word, beside = word[of], beside.astype("<u2")[of]
                entries_of = np.bincount(word, minlength=m).astype("<i4")
                names, sizes = buckets.reshape(2, -1)
                cuts = np.concatenate(([0], np.cumsum(sizes)))
                entry_cuts = np.concatenate(([0], np.cumsum(entries_of)))[cuts]
                rows = {"block": [batch.column(0)[i].as_py()] * len(names), "bucket": names.tolist()}
                rows |= {x: [] for x in _PACKED.names[2:]}
                for j in range(len(names)):
                    some, e = slice(cuts[j], cuts[j + 1]), slice(entry_cuts[j], entry_cuts[j + 1])
                    for name, x in (("at", at[some]), ("classes", classes[some]), ("entries", entries_of[some]), ("entry_code", beside[e]), ("entry_n", count[e])):
                        rows[name].append(x.tobytes())
                yield pa.RecordBatch.from_pydict(rows, schema=_PACKED)
        at = np.flatnonzero(sums)
        empty = dict.fromkeys(_PACKED.names, [b""]) | {"block": [-1], "bucket": [-1]}
        yield pa.RecordBatch.from_pydict(empty | {"at": [at.astype("<i8").tobytes()], "entry_n": [sums[at].astype("<i8").tobytes()]}, schema=_PACKED)

    return run


def _bigram_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(len(batch)):
            yield pa.RecordBatch.from_arrays([pa.array(_numbers(batch.column(j), i, "<i8")) for j in (0, 1)], names=["at", "n"])


def _bigrams(packed: DataFrame, n: int) -> np.ndarray:
    rows = packed.where("bucket = -1").select("at", "entry_n").mapInArrow(_bigram_rows, "at bigint, n bigint")
    out = np.zeros(n * n, np.int64)
    for r in rows.groupBy("at").agg(F.sum("n").alias("n")).collect():
        out[r["at"]] = r["n"]
    return out.reshape(n, n)


def small_gains(table: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For the rows and the columns of ``table``: each class's bigrams with the classes, their N log N, and what that gains by 0 to ``SMALL`` more."""
    sides = [np.ascontiguousarray(t.T[:, :CLASSES]) for t in (table, table.T)]
    return [(t, _xlogx(t), np.concatenate([_xlogx(t + n) - _xlogx(t) for n in range(SMALL + 1)])) for t in sides]


def move_gains(rows: np.ndarray, columns: np.ndarray, selves: np.ndarray, own: np.ndarray, table: np.ndarray, small: list | None = None) -> np.ndarray:
    """``gains`` of many words at once, each taken out of its ``own`` class first; ``table`` counts them all in."""
    k = CLASSES
    out = np.zeros((len(rows), k))
    mine = np.flatnonzero(own < k)
    for beside, across, t, (all_bases, all_logs, looked_up) in zip((rows, columns), (columns, rows), (table, table.T), small or small_gains(table), strict=True):
        w, d = np.nonzero(beside != 0)
        if not len(w):
            continue
        n = beside[w, d]
        gain = looked_up.take(np.minimum(n, SMALL).astype(np.int64) * len(all_bases) + d, axis=0)
        many = np.flatnonzero(n > SMALL)
        gain[many] = _xlogx(all_bases[d[many]] + n[many, None]) - all_logs[d[many]]
        within = np.flatnonzero(d == own[w])
        base = all_bases[d[within]] - across[w[within], :k]
        gain[within] = _xlogx(base + n[within, None]) - _xlogx(base)
        e = np.flatnonzero(own[w] < k)
        base = t[own[w[e]], d[e]] - n[e]
        gain[e, own[w[e]]] = _xlogx(base + n[e]) - _xlogx(base)
        e = np.flatnonzero(d < k)
        gain[e, d[e]] = 0  # the class's bigrams with itself come below
        first = np.flatnonzero(np.diff(w, prepend=-1))
        out[w[first]] += np.add.reduceat(gain, first)
    both = rows[:, :k] + columns[:, :k] + selves[:, None]
    w, d = np.nonzero(both != 0)  # no bigram more: no gain
    more, base = both[w, d], np.diag(table)[d]
    base = np.where(d == own[w], base - more, base)
    out[w, d] += _xlogx(base + more) - _xlogx(base)
    for ends, n in ((table.sum(1)[:k], rows.sum(1) + selves), (table.sum(0)[:k], columns.sum(1) + selves)):
        each, of = np.unique(n, return_inverse=True)  # most words are rare: few different counts
        lost = (_xlogx(ends + each[:, None]) - _xlogx(ends)).take(of, axis=0)
        base = ends[own[mine]] - n[mine]
        lost[mine, own[mine]] = _xlogx(base + n[mine]) - _xlogx(base)
        out -= lost
    return out


def _place(table: np.ndarray, class_of: np.ndarray, first: bool):
    """Classes of one bucket's words by what stands beside them, sent back to their blocks."""
    codes = len(class_of)
    step = 512 if first else 256  # words whose neighbours are laid out at once

    def run(batch: pa.Table) -> pa.Table:
        batch = batch.combine_chunks()
        read = lambda name, kind: [np.frombuffer(x, kind) for x in batch[name].to_pylist()]
        places = read("at", "<i4")
        word = np.concatenate([np.repeat(x, y) for x, y in zip(places, read("entries", "<i4"), strict=True)])
        code, n = np.concatenate(read("entry_code", "<u2")).astype(np.int64), np.concatenate(read("entry_n", np.uint8))
        cuts = np.cumsum([len(x) for x in places])[:-1]
        at = np.concatenate(places)
        m = int(at.max(initial=-1)) + 1
        own = np.full(m, OTHER, np.int64)
        own[at] = np.concatenate(read("classes", np.uint8))
        beside = np.where(code == 2 * codes, 2 * WIDTH, code // codes * WIDTH + class_of[code % codes])
        order = np.argsort(word, kind="stable")
        word, beside, n = word[order], beside[order], n[order]
        ends = np.searchsorted(word, np.arange(0, m + step, step, dtype=word.dtype))
        chosen = np.zeros(m, np.uint8)
        small = None if first else small_gains(table)
        for low, i, j in zip(range(0, m, step), ends, ends[1:], strict=False):
            size = min(step, m - low)
            dense = np.bincount((word[i:j] - low) * (2 * WIDTH + 1) + beside[i:j], n[i:j], size * (2 * WIDTH + 1)).reshape(size, -1)
            columns, rows, selves = dense[:, :WIDTH], dense[:, WIDTH : 2 * WIDTH], dense[:, -1]
            if first:
                columns[:, OTHER] = rows[:, OTHER] = 0  # not placed yet, any of them
                found = np.where((columns.any(1) | rows.any(1)), _best(rows, columns, table), np.arange(low, low + size) % CLASSES)
            else:
                gain = move_gains(rows, columns, selves, own[low : low + size], table, small)
                found = np.argmax(gain, axis=1)
                stay = np.minimum(own[low : low + size], CLASSES - 1)
                found = np.where(gain[np.arange(size), stay] >= gain.max(1) - 1e-9, stay, found)
            chosen[low : low + size] = found
        return pa.table([batch["block"], batch["bucket"], [x.tobytes() for x in np.split(chosen[at], cuts)]], schema=_PLACED)

    return run


def _best(rows: np.ndarray, columns: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The class that gains most by a rare word's coming: the first-order gain, exact for small counts against large ones."""
    left, right = np.maximum(table.sum(1), 1), np.maximum(table.sum(0), 1)
    total = left.sum()
    bond = np.log((table + 0.5) * total / (np.outer(left, right) + total))[:, :]
    return np.argmax(rows @ bond[:CLASSES].T + columns @ bond[:, :CLASSES], axis=1).astype(np.uint8)


def _scorer(table: np.ndarray, frequent: np.ndarray, n: int, v: int, ends: int):
    moves = table / np.maximum(table.sum(1, keepdims=True), 1)
    held_by = np.maximum(table.sum(0), 1)  # tokens of each class

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                held, lengths, place = (_numbers(batch.column(j), i, k) for j, k in ((1, "?"), (2, "<i4"), (4, "<i4")))
                tokens = _tokens(batch.column(3), i, lengths)
                size = len(batch.column(6)[i].as_buffer()) // 4
                totals = _counts(batch.column(7), i, 1 + size + len(place)).astype(np.int64)
                totals[0] = ends
                known = _local(batch.column(8)[i].as_py(), size)
                classes = np.concatenate((np.zeros(1, np.uint8), known, np.where(place > 0, frequent[place], OTHER).astype(np.uint8)))
                classes[0] = END
                p0 = (totals + BASE) / (n + BASE * (v + 1))
                emitted = totals / held_by[classes]
                before = np.concatenate((np.zeros(1, np.int32), tokens[:-1]))
                p = p0[tokens]
                seen = totals[tokens] > 0
                model = np.where(seen, MIX * moves[classes[before], classes[tokens]] * emitted[tokens], 0.0) + (1 - MIX) * p
                model = np.where(totals[before] > 0, model, p)
                starts = np.cumsum(lengths) - lengths
                sums = [np.add.reduceat(x, starts) for x in (seen.astype(np.int64), np.log10(p), np.log10(model))]
                columns = [batch.column(0)[i].values, pa.array(held), pa.array(lengths.astype(np.int64)), *map(pa.array, sums)]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return run


def bucket_count(blocks: DataFrame, words: int) -> int:
    """So many buckets that each gets about ``words`` distinct words of blocks, however large the corpus."""
    entries = blocks.agg(F.coalesce(F.sum(F.octet_length("counts") / 4 - 1).cast("long"), F.lit(0))).first()[0]
    return max(1, int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-entries // words))


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{x.name} {({pa.int64(): 'bigint', pa.int32(): 'int'}).get(x.type, str(x.type))}" for x in schema)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", top: int = TOP) -> DataFrame:
    """One row a document: ``id, held_out, n_tokens, n_known, base_score, score, train_tokens``; log10 probabilities."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    # a row is a block of some MB from here on: an Arrow batch of the usual ten thousand would hold a task's whole input
    settings = {_BATCH: str(BLOCKS_A_BATCH), _CLEANUP: "true"}
    before = {x: spark.conf.get(x, None) for x in settings}

    def written(df: DataFrame, name: str) -> DataFrame:
        return materialize(df, name, "zstd")

    try:
        spark.conf.set(_CLEANUP, settings[_CLEANUP])
        blocks = written(_blocks(rows), "lm_blocks")
        spark.conf.set(_BATCH, settings[_BATCH])
        buckets = bucket_count(blocks, BUCKET_WORDS)
        totals = blocks.select("block", "words", "counts").mapInArrow(_to_words(buckets), _ddl(_WORDS)).groupBy("bucket").applyInArrow(_sum_words(top), _ddl(_TOTALS))
        totals = written(totals, "lm_totals")
        v = int(totals.agg(F.coalesce(F.sum("distinct"), F.lit(0))).first()[0])
        names = frequent_words(totals.where("distinct is not null"), top)
        own = totals.groupBy("block").agg(F.collect_list(F.struct("bucket", "numbers", "at", "totals")).alias("known"))
        texts = f"block bigint, ids array<{id_type}>, held binary, lengths binary, tokens binary, place binary"
        numbered = f"{texts}, buckets binary, at binary, totals binary"
        placed = blocks.select("block", "ids", "held", "lengths", "tokens", "words").mapInArrow(_places(names), texts)
        coded = placed.join(own, "block", "left").mapInArrow(_coded, numbered)
        coded = materialize_bucketed(coded, "lm_coded", "block", "zstd")
        release(blocks)
        release(totals)

        def with_classes(columns: list[str], placed: DataFrame | None) -> DataFrame:
            if placed is None:
                return coded.select(*columns, F.lit(None).cast("array<struct<bucket: int, classes: binary>>").alias("known"))
            known = placed.groupBy("block").agg(F.collect_list(F.struct("bucket", "classes")).alias("known"))
            return coded.join(known, "block", "left").select(*columns, "known")

        placed = best = None
        of_top = np.arange(len(names)) % CLASSES
        for turn in range(ROUNDS + 1):
            rows = with_classes(["block", "held", "lengths", "tokens", "place", "buckets", "at"], placed)
            packed = written(rows.mapInArrow(_evidence(len(names), turn < ROUNDS), _ddl(_PACKED)), "lm_evidence")
            bigrams = _bigrams(packed, len(names) + CLASSES + 2)
            class_of = exchange(bigrams, SWEEPS, np.concatenate(([END], of_top, np.arange(CLASSES), [OTHER])), len(names))
            hot = np.eye(WIDTH)[class_of]
            table = hot.T @ bigrams @ hot
            # words of all buckets move at once: a round that loses likelihood by it doesn't count and ends the rounds
            if best and turn > 1 and likelihood(table) <= best[0]:
                release(packed)
                release(placed)
                break
            if best and best[1] is not None:
                release(best[1])
            best = likelihood(table), placed, class_of, table
            of_top = class_of[1 : len(names) + 1]
            if turn < ROUNDS:
                moved = packed.where("bucket >= 0").groupBy("bucket").applyInArrow(_place(table, class_of, turn == 0), _ddl(_PLACED))
                placed = written(moved, "lm_classes")
            release(packed)
        _, placed, class_of, table = best
        n, ends = int(table.sum()), int(table[:, END].sum())  # every training token follows one
        rows = with_classes(["ids", "held", "lengths", "tokens", "place", "buckets", "at", "totals"], placed)
        out = rows.mapInArrow(_scorer(table, class_of[: len(names) + 1].astype(np.uint8), n, v + (ends > 0), ends), f"id {id_type}, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double")
        out = materialize(out.withColumn("train_tokens", F.lit(n).cast("long")), "lm_scores")
        release(coded)
        if placed is not None:
            release(placed)
        return out
    finally:
        for x, value in before.items():
            spark.conf.unset(x) if value is None else spark.conf.set(x, value)
