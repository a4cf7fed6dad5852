r"""Phrase collocations from count streams that are merged in order, without hash tables.

Words and phrases of up to three words are counted exactly for each language. Two streams hold the counts of all orders
together: in *prefix order* (first word, second, third; shorter phrases first) a phrase directly follows what it begins
with, in *suffix order* (last word, the one before it, the first) what it ends with. One lockstep pass over the first stream
therefore gives every phrase the counts of its beginnings, and every pair of words its most frequent extension to the right; one
pass over the second gives the counts of the ends and the extensions to the left. Streams are range-sorted and read by part: a task
keeps the last word and the last pair it has seen, no more. A hot word's phrases may lie in many parts; the word that is in force
where a part begins is handed on to it (one row a part passes the driver).

Before that, phrases that cannot reach the least count are left out, as a phrase is no more frequent than its parts. Three passes
over the text sum, by numbers instead of texts, the counts of words, then of pairs of words that both may be frequent, then of
triples of such pairs; after each a sketch of fixed size marks the numbers that reach the least count. A slice of text sends its numbers packed by ranges, four
bytes and a count each. A last pass counts, by their text, the words and phrases that the sketches let through. Numbers that
clash and full sketches err only towards letting through: results do not depend on them, only the amount of shuffled data does.

Counts are summed in each slice of text and again before the shuffle, so that no word's occurrences meet in one task.

Defined results: words, pieces and lower case go by ASCII, as the byte classes below say; null text is empty; a null lang is
``und``; repeated rows count each; ties in the ranking cannot be left open, as phrases of a language are distinct. Scores are exact
whatever the counts. An empty table gives no row. Columns other than the two named ones are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from pairloom.llm.bpe_chunks import slices
from pairloom.llm.common import whole_text
from pairloom.llm.words import hashes, joined_hashes, words_of
from pairloom.session import materialize

LEAST = 10
#: A phrase goes if a longer one that holds it has this many per cent of its count.
COVERS = 50
TOP = 2_000
SCALE = 1_000_000
#: Bits of a sketch; 27 are 16 MB, sent to the driver once and broadcast.
SKETCH_BITS = 27
#: Text whose numbers make up one range, on average: what a task sums at once.
RANGE_BYTES = 16 << 20
MOST_RANGE_BITS = 20
SLICE_BYTES = 4 << 20
UNKNOWN = "und"

BREAKS = np.zeros(256, bool)
BREAKS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
WORD = ~BREAKS
WORD[[0x20, 0x09]] = False

_STREAM = "lang string, a string, b string, c string, n bigint"


class Sketch:
    """A set of 64-bit numbers that may hold more than was put in, never less."""

    def __init__(self, bits: int, data: bytes):
        self.shift, self.data = np.uint64(64 - bits), np.frombuffer(data, np.uint8)

    def holds(self, h: np.ndarray) -> np.ndarray:
        at = h >> self.shift
        return (self.data[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def packed(h: np.ndarray, n: np.ndarray, least: int, range_bits: int) -> list[pa.Array]:
    """Numbers by range: the range, the next 32 bits of each number, and its count up to ``least``."""
    if not len(h):
        return [pa.array([], t) for t in (pa.int32(), pa.binary(), pa.binary())]
    of = (h >> np.uint64(32) >> np.uint64(32 - range_bits)).astype(np.int32)
    order = np.argsort(of, kind="stable")
    rest = ((h >> np.uint64(32 - range_bits)) & np.uint64(0xFFFFFFFF)).astype("<u4")[order]
    few = np.minimum(n, least).astype("<u4" if least > 255 else np.uint8)[order]
    kinds, first = np.unique(of[order], return_index=True)
    ends = [*first[1:].tolist(), len(h)]
    cut = [(i, j) for i, j in zip(first.tolist(), ends)]
    return [pa.array(kinds), pa.array([rest[i:j].tobytes() for i, j in cut], pa.binary()), pa.array([few[i:j].tobytes() for i, j in cut], pa.binary())]


def frequent_bits(rest: list[bytes], few: list[bytes], least: int, bits: int) -> bytes:
    """The part of the sketch that one range fills, ``2 ** bits`` bits."""
    rest, few = np.frombuffer(b"".join(rest), "<u4"), np.frombuffer(b"".join(few), "<u4" if least > 255 else np.uint8)
    order = np.argsort(rest)
    rest = rest[order]
    first = np.flatnonzero(np.concatenate(([True], rest[1:] != rest[:-1])))
    found = rest[first][np.add.reduceat(few[order].astype(np.int64), first) >= least]
    marks = np.zeros(1 << bits, np.uint8)
    marks[(found.astype(np.uint64) >> np.uint64(32 - bits)).astype(np.int64)] = 1
    return np.packbits(marks, bitorder="little").tobytes()


def sketch_of(numbers: DataFrame, least: int, bits: int, range_bits: int) -> bytes:
    """The sketch of numbers that reach ``least``, from ``packed`` rows; ``2 ** bits / 8`` bytes reach the driver."""
    parts = int(numbers.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rest, few = None, [], []

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([frequent_bits(rest, few, least, bits - range_bits)], pa.binary())], names=["range", "bits"])

        for batch in batches:
            for at, r, f in zip(*[c.to_pylist() for c in batch.columns]):
                if at != now:
                    if rest:
                        yield done()
                    now, rest, few = at, [], []
                rest.append(r)
                few.append(f)
        if rest:
            yield done()

    ordered = numbers.repartition(parts, "range").sortWithinPartitions("range")
    size = 1 << (bits - range_bits) >> 3
    data = bytearray(1 << bits >> 3)
    for r in ordered.mapInArrow(run, "range int, bits binary").collect():
        data[r.range * size : (r.range + 1) * size] = r.bits
    return bytes(data)


class Counted:
    """Distinct words and phrases of a slice of text and how often each occurs; ids are exact, not hashes."""

    def __init__(self, texts: list[bytes], langs: list[str], words: Sketch | None = None, pairs: Sketch | None = None, triples: Sketch | None = None):
        found = words_of(texts, WORD, BREAKS)
        lang_of, names = pd.factorize(np.array(langs, object))
        self.langs, self.tokens = names, np.bincount(lang_of[found.text], minlength=len(names))
        self.known = found.known
        code, self.unigrams = pd.factorize(lang_of[found.text] * max(len(found.known), 1) + found.word)
        self.n1 = np.bincount(code, minlength=len(self.unigrams))
        self.lang, self.word = np.divmod(self.unigrams, max(len(found.known), 1))
        lang_hash = hashes(pa.array([str(x).encode() for x in names], pa.binary()))
        self.h1 = joined_hashes(lang_hash[self.lang], hashes(found.known)[self.word])
        if words is None:
            return
        self.keep1 = words.holds(self.h1)
        frequent = self.keep1[code]
        at = np.flatnonzero((found.piece[1:] == found.piece[:-1]) & frequent[1:] & frequent[:-1])
        pair, self.pairs = pd.factorize(code[at] * len(self.unigrams) + code[at + 1])
        self.n2 = np.bincount(pair, minlength=len(self.pairs))
        self.first, self.second = np.divmod(self.pairs, max(len(self.unigrams), 1))
        self.h2 = joined_hashes(self.h1[self.first], self.h1[self.second])
        if pairs is None:
            return
        self.keep2 = pairs.holds(self.h2)
        frequent = self.keep2[pair]
        i = np.flatnonzero((at[1:] == at[:-1] + 1) & frequent[1:] & frequent[:-1])
        triple, self.triples = pd.factorize(pair[i] * len(self.unigrams) + code[at[i] + 2])
        self.n3 = np.bincount(triple, minlength=len(self.triples))
        of, third = np.divmod(self.triples, max(len(self.unigrams), 1))
        self.h3 = joined_hashes(self.h2[of], self.h1[third])
        if triples is not None:
            self.keep3 = triples.holds(self.h3)

    def rows(self) -> list[pa.Array]:
        """``gram`` (the words, a line end, the language) and ``n`` of what the sketches let through; without words: all tokens."""
        one = np.flatnonzero(self.keep1)
        two = np.flatnonzero(self.keep2)
        three, third = np.divmod(self.triples[self.keep3], max(len(self.unigrams), 1))
        names = pa.array([str(x) for x in self.langs], pa.string())
        first, second = self.first, self.second

        def words(of: np.ndarray) -> pa.Array:
            return self.known.take(pa.array(self.word[of])).cast(pa.string())

        grams = [pa.array([""] * len(names), pa.string()), words(one), pc.binary_join_element_wise(words(first[two]), words(second[two]), " "),
                 pc.binary_join_element_wise(words(first[three]), words(second[three]), words(third), " ")]
        lang = np.concatenate((np.arange(len(names)), self.lang[one], self.lang[first[two]], self.lang[third]))
        n = np.concatenate((self.tokens, self.n1[one], self.n2[two], self.n3[self.keep3]))
        return [pc.binary_join_element_wise(pa.concat_arrays(grams), names.take(pa.array(lang)), "\n"), pa.array(n.astype(np.int64))]


def _scan(docs: DataFrame, columns: str, made) -> DataFrame:
    """``made(texts, langs)`` of every slice of the text, as arrays."""
    names = [c.split()[0] for c in columns.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, 0, SLICE_BYTES):
                yield pa.RecordBatch.from_arrays(made(texts, part.column(1).to_pylist()), names=names)

    return docs.mapInArrow(run, columns)


def counts(docs: DataFrame, least: int = LEAST, bits: int = SKETCH_BITS, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, a, b, c, n): words and phrases that occur ``least`` times, and per language a row without words for all tokens."""
    spark = docs.sparkSession
    rows = docs.select(whole_text(text_col).alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"))

    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    range_bits = min(max(size // RANGE_BYTES, 1).bit_length(), MOST_RANGE_BITS, bits - 3)
    sketches: list = []  # broadcast, of words, pairs and triples

    for order in ("h1", "h2", "h3"):
        def numbers(texts: list[bytes], langs: list[str], order: str = order, before: tuple = tuple(sketches)) -> list[pa.Array]:
            found = Counted(texts, langs, *[Sketch(bits, x.value) for x in before])
            return packed(getattr(found, order), getattr(found, "n" + order[1]), least, range_bits)

        sent = _scan(rows, "range int, rest binary, few binary", numbers)
        sketches.append(spark.sparkContext.broadcast(sketch_of(sent, least, bits, range_bits)))

    def phrases(texts: list[bytes], langs: list[str], all_: tuple = tuple(sketches)) -> list[pa.Array]:
        return Counted(texts, langs, *[Sketch(bits, x.value) for x in all_]).rows()

    summed = _scan(rows, "gram string, n bigint", phrases).groupBy("gram").agg(F.sum("n").alias("n"))
    end = F.instr("gram", "\n")  # no word holds a line end, or a blank
    said, lang = F.substring("gram", F.lit(1), end - 1), F.substring("gram", end + 1, F.length("gram"))
    summed = summed.where((F.col("n") >= least) | F.startswith("gram", F.lit("\n")))
    word = F.split(said, " ")
    words = [F.when(said != "", word[0]).alias("a"), F.get(word, F.lit(1)).alias("b"), F.get(word, F.lit(2)).alias("c")]
    out = materialize(summed.select(lang.alias("lang"), *words, "n"), "phrase_counts")
    for sketch in sketches:
        sketch.unpersist()
    return out


def lockstep(stream: DataFrame, names: list[str]) -> DataFrame:
    """``stream`` (lang, a, b, c, n, ...) with, for each row, the counts of (a) and (a, b), and (a, b)'s best extension.

    The stream is sorted by lang, a, b, c, nulls first, in parts; a part is read in order, beginning with what the parts before it end with.
    """
    parts = int(stream.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["lang", "a", "b", "c"]
    # a pair and its extensions stay together; a word's pairs need not
    sorted_ = stream.repartitionByRange(parts, "lang", "a", "b").withColumn("_part", F.spark_partition_id())
    sorted_ = materialize(sorted_, "phrase_stream")
    last = sorted_.where("b IS NULL").groupBy("_part").agg(F.max(F.struct("lang", "a", "n")).alias("last")).orderBy("_part").collect()
    begins, at, word = {}, 0, None
    for part in range(parts):
        begins[part] = word
        if at < len(last) and last[at]["_part"] == part:
            word, at = tuple(last[at]["last"]), at + 1
    more = [c for c in stream.columns if c not in (*order, "n")]
    columns = ", ".join([_STREAM, *[f"{c} bigint" for c in (*more, *names)]])
    fields = [*order, "n", *more, *names]
    types = [pa.string()] * 4 + [pa.int64()] * (len(fields) - 4)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = one = two = None
        held: list | None = None  # the pair in force, until its extensions are through
        best = 0
        for batch in batches:
            out = []
            for now, lang, a, b, c, n, *rest in zip(*[batch.column(x).to_pylist() for x in ("_part", *order, "n", *more)]):
                if now != part:
                    part, one = now, begins[now]
                if held and c is None:
                    out.append([*held, best])
                    held = None
                if b is None:
                    one = (lang, a, n)
                    out.append([lang, a, b, c, n, *rest, None, None, None])
                    continue
                if one[:2] != (lang, a):
                    raise ValueError(f"stream out of order at {lang}, {a}, {b}, {c}")
                if c is None:
                    held, best, two = [lang, a, b, c, n, *rest, one[2], None], 0, n
                else:
                    best = max(best, n)
                    out.append([lang, a, b, c, n, *rest, one[2], two, None])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], names=fields)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip([*held, best], types)], names=fields)

    read = sorted_.repartitionByRange(parts, "_part").sortWithinPartitions("_part", *order)
    return read.mapInArrow(run, columns)


def cut_score(a: int, l: int, r: int) -> int:  # noqa: E741
    return SCALE * a * a // (l * r)


def collocations(docs: DataFrame, least: int = LEAST, covers: int = COVERS, top: int = TOP, bits: int = SKETCH_BITS,
                 lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """The ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    counted = counts(docs, least, bits, lang_col, text_col)
    streams = counted.where("a IS NOT NULL")
    prefix = lockstep(streams, ["l1", "l2", "right"])
    # suffix order: last word, the one before, the first
    backwards = prefix.select("lang", F.coalesce("c", "b", "a").alias("a"), F.when(F.col("c").isNotNull(), F.col("b")).when(F.col("b").isNotNull(), F.col("a")).alias("b"),
                              F.when(F.col("c").isNotNull(), F.col("a")).alias("c"), "n", "l1", "l2", "right")
    both = lockstep(backwards, ["r1", "r2", "left"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            phrase = pc.binary_join_element_wise(batch["c"], batch["b"], batch["a"], " ", null_handling="skip")
            best = []
            for c, n, l1, l2, r1, r2 in zip(*[batch[x].to_pylist() for x in ("c", "n", "l1", "l2", "r1", "r2")]):
                cuts = [(l1, r1)] if c is None else [(l1, r2), (l2, r1)]
                best.append(min(((cut_score(n, l, r), k, l, r) for k, (l, r) in enumerate(cuts))))
            yield pa.RecordBatch.from_arrays([batch["lang"], phrase, batch["n"], *[pa.array([x[i] for x in best], pa.int64()) for i in (2, 3, 0)]],
                                             names=["lang", "phrase", "a", "l", "r", "score"])

    covered = F.greatest("left", "right") * 100 >= F.col("n") * covers
    found = both.where(F.col("b").isNotNull() & (F.col("c").isNotNull() | ~covered))
    scored = found.mapInArrow(score, "lang string, phrase string, a bigint, l bigint, r bigint, score bigint")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    ranked = scored.withColumn("rank", place).where(F.col("rank") <= top)
    totals = counted.where("a IS NULL").select("lang", "n")
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
