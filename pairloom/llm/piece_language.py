"""Language identification by unigram pieces, summed over all segmentations.

Pieces are those strings of a fixed public vocabulary that consist of letters (a blank before a piece marks a word's beginning), in
lower case, and every single byte a word can hold. A language gives each piece a probability. A word's probability is the sum, over all
ways to cut it into pieces, of the products of the pieces' probabilities; the forward algorithm computes it along the word's lattice.
A text's score for a language is the product over its words, with the language's share of documents as a prior; the answer is the
language with the highest score and its posterior.

Learning: expectation-maximisation. A round counts, by the forward and backward sums of each word's lattice, how often every piece is
expected to be used in each language; Spark sums these counts and the driver turns them into probabilities. The first round counts
each occurrence of a piece as one. Words come from at most about ``SAMPLE`` training documents of each language, chosen by a hash of
the id (a documented bound); they are counted once by Spark, and the rounds read distinct words. What the driver holds is
bounded by vocabulary times languages, a few MB for four languages. All documents are scored whole, in one pass without a shuffle.

Words are runs of ASCII letters and bytes above 127, of 48 bytes at most: a longer run is read as several words, so that a sum
stays within a double's range. A lattice is worked on for all distinct words of a slice of text at once.

Defined results: null text, and text without any letter (``\\p{L}``), is ``und`` with score 0. So is every text if there is nothing to learn from.
Null languages, ids and texts teach nothing; an empty string is a language like others. Equal scores go to the first language by code point.
Repeated rows teach twice. An empty table gives no row. Language, source and id are no inputs of a prediction.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from pairloom.llm.bpe_chunks import slices
from pairloom.llm.common import free_name, id_crc
from pairloom.llm.words import bytes_of, words_of
from pairloom.session import materialize

UNKNOWN = "und"
#: Training documents of each language, about; more are thinned by a hash of their id.
SAMPLE = 2_000
ROUNDS = 4
#: Added to each piece's expected count.
SMOOTHING = 0.1
LONGEST_WORD = 48
SLICE_BYTES = 2 << 20
#: Numbers in the table of forward sums (lattice places times languages) that are held at once.
CELLS = 1 << 22

LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_NO_BREAK = np.zeros(256, bool)
BEGIN = 0x20


def letter_pieces(path: str) -> list[bytes]:
    """The vocabulary's pieces of letters, in lower case, a blank for the mark of a word's beginning; sorted."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    mark = b"\xe2\x96\x81"
    found = set()
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i):
            continue
        piece = model.id_to_piece(i).lower().encode()
        begins = piece.startswith(mark)
        body = piece[len(mark) :] if begins else piece
        if body and mark not in body and LETTER[list(body)].all():
            found.add(b" " + body if begins else body)
    single = {bytes([b]) for b in np.flatnonzero(LETTER).tolist() if not 65 <= b <= 90} | {bytes([BEGIN])}
    return sorted(found | single)


@dataclass
class Trie:
    """All pieces as a table of steps: ``step[place, class of the next byte]`` is the next place, 0 if there is none."""

    step: np.ndarray
    classes: np.ndarray
    piece: np.ndarray  # number of the piece that ends at a place, -1 if none does
    longest: int

    @staticmethod
    def of(pieces: list[bytes]) -> Trie:
        used = sorted({b for p in pieces for b in p})
        classes = np.zeros(256, np.uint8)
        classes[used] = np.arange(1, len(used) + 1)
        places: dict[bytes, int] = {b"": 1}
        for p in pieces:
            for i in range(1, len(p) + 1):
                places.setdefault(p[:i], len(places) + 1)
        step = np.zeros((len(places) + 1, len(used) + 1), np.uint16 if len(places) < 65_000 else np.int32)
        for prefix, at in places.items():
            if prefix:
                step[places[prefix[:-1]], classes[prefix[-1]]] = at
        piece = np.full(len(places) + 1, -1, np.int32)
        piece[[places[p] for p in pieces]] = np.arange(len(pieces))
        return Trie(step, classes, piece, max(map(len, pieces)))


@dataclass
class Lattice:
    """Edges (from, to, piece) between the places of many words; a word of n bytes has the places first to first + n."""

    start: np.ndarray
    end: np.ndarray
    piece: np.ndarray
    first: np.ndarray
    last: np.ndarray
    groups: np.ndarray  # edges are ordered by the offset of their start in the word; where each offset begins

    @staticmethod
    def of(words: pa.Array, trie: Trie) -> Lattice:
        data, offsets = bytes_of(words)
        lengths = np.diff(offsets) + 1  # with the mark of the beginning
        first = np.concatenate(([0], np.cumsum(lengths + 1)))[:-1]
        places = int((lengths + 1).sum())
        text = np.zeros(places, np.uint8)  # a zero ends each word: no piece holds it
        text[first] = BEGIN
        body = np.repeat(first + 1 - offsets[:-1], np.diff(offsets)) + np.arange(offsets[0], offsets[-1])
        text[body] = data[offsets[0] : offsets[-1]]
        byte = trie.classes[text]
        at = np.flatnonzero(byte)  # a word's last place begins nothing
        where, begin, reach = trie.step[1, byte[at]], at, at + 1
        found = []
        while True:
            alive = where > 0
            where, begin, reach = where[alive], begin[alive], reach[alive]
            if not len(where):
                break
            piece = trie.piece[where]
            ends = piece >= 0
            found.append((begin[ends], reach[ends], piece[ends]))
            where, reach = trie.step[where, byte[reach]], reach + 1
        start, end, piece = (np.concatenate([f[i] for f in found]) if found else np.empty(0, np.int64) for i in range(3))
        offset = np.arange(places) - np.repeat(first, lengths + 1)
        order = np.argsort(offset[start].astype(np.uint8), kind="stable")
        start, end, piece = start[order], end[order], piece[order]
        groups = np.searchsorted(offset[start], np.arange(LONGEST_WORD + 3))
        return Lattice(start, end, piece, first, first + lengths, groups)

    def forward(self, p: np.ndarray) -> np.ndarray:
        """Sums over all ways from a word's first place; ``p``: probabilities of the edges, a column a language."""
        a = np.zeros((int(self.last[-1]) + 1 if len(self.last) else 0, *p.shape[1:]))
        a[self.first] = 1
        for lo, hi in zip(self.groups[:-1], self.groups[1:]):
            if lo == hi:
                continue
            # of one offset, no two edges end in the same place
            a[self.end[lo:hi]] += a[self.start[lo:hi]] * p[lo:hi]
        return a

    def backward(self, p: np.ndarray) -> np.ndarray:
        b = np.zeros(int(self.last[-1]) + 1 if len(self.last) else 0)
        b[self.last] = 1
        for lo, hi in zip(self.groups[-2::-1], self.groups[:0:-1]):
            if lo < hi:
                np.add.at(b, self.start[lo:hi], b[self.end[lo:hi]] * p[lo:hi])
        return b


def text_words(texts: list[bytes]):
    """Words of texts that are in lower case already, long runs cut."""
    found = words_of(texts, LETTER, _NO_BREAK, lower=False)
    lengths = np.diff(bytes_of(found.known)[1])
    if not len(lengths) or lengths.max() <= LONGEST_WORD:
        return found
    whole = found.known.to_pylist()
    known: dict[bytes, int] = {}
    parts = [[known.setdefault(w[i : i + LONGEST_WORD], len(known)) for i in range(0, len(w), LONGEST_WORD)] for w in whole]
    size = np.array([len(x) for x in parts])
    at = np.repeat(np.concatenate(([0], np.cumsum(size)))[:-1][found.word], size[found.word])
    nth = np.arange(len(at)) - np.repeat(np.concatenate(([0], np.cumsum(size[found.word])))[:-1], size[found.word])
    found.text, found.piece = np.repeat(found.text, size[found.word]), np.repeat(found.piece, size[found.word])
    found.word = np.concatenate([np.array(x, np.int64) for x in parts])[at + nth]
    found.known = pa.array(list(known), pa.binary())
    return found


@dataclass
class Model:
    trie: Trie
    langs: list[str]
    p: np.ndarray  # pieces by languages
    prior: np.ndarray

    def word_scores(self, words: pa.Array) -> np.ndarray:
        """log of each word's sum over all segmentations, a column a language."""
        out = np.empty((len(words), len(self.langs)))
        sizes = np.cumsum(np.diff(bytes_of(words)[1]) + 2) * len(self.langs)
        at = 0
        while at < len(words):
            to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + CELLS, side="right")))
            lattice = Lattice.of(words.slice(at, to - at), self.trie)
            out[at:to] = np.log(lattice.forward(self.p[lattice.piece])[lattice.last])
            at = to
        return out

    def predict(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The number of the best language and its posterior, for each text (in lower case)."""
        found = text_words(texts)
        scores = self.word_scores(found.known)
        z = np.stack([np.bincount(found.text, scores[found.word, i], len(texts)) for i in range(len(self.langs))], 1) + np.log(self.prior)
        best = z.argmax(1)
        return best, 1 / np.exp(z - z.max(1, keepdims=True)).sum(1)


def expected(words: pa.Array, n: np.ndarray, lang: np.ndarray, trie: Trie, p: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Languages, pieces and how often the piece is expected in these words, each of which occurs ``n`` times in ``lang``."""
    lattice = Lattice.of(words, trie)
    word = np.searchsorted(lattice.first, lattice.start, side="right") - 1
    weight = n[word].astype(float)
    if p is not None:
        edge = p[lattice.piece, lang[word]]
        a, b = lattice.forward(edge), lattice.backward(edge)
        weight *= a[lattice.start] * edge * b[lattice.end] / a[lattice.last[word]]
    of = lang[word].astype(np.int64) * len(trie.piece) + lattice.piece
    kinds, at = np.unique(of, return_inverse=True)
    where, piece = np.divmod(kinds, len(trie.piece))
    return where, piece, np.bincount(at, weight, len(kinds))


def lower_text(column: str):
    return F.lower(F.coalesce(F.col(column).cast("string"), F.lit("")))


def training_words(docs: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, list[str], np.ndarray]:
    """(lang number, word, n) of the sample, the languages, and their numbers of training documents."""
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    known = rows.where(F.col("id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & (id_crc("id") % 4 != 2))
    share = sorted(tuple(r) for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect())  # a row a language
    langs = [x for x, _ in share]
    if not langs:
        return docs.sparkSession.createDataFrame([], "lang int, word binary, n bigint"), [], np.empty(0)
    # numbers and limits by language as literals: no text is shuffled
    at = F.create_map(*[F.lit(x) for i, (lang, _) in enumerate(share) for x in (lang, i)])[F.col("lang")]
    most = F.create_map(*[F.lit(x) for lang, n in share for x in (lang, min(2**63 - 1, int(2**63 * min(1.0, sample / n))))])[F.col("lang")]
    chosen = known.where(F.shiftrightunsigned(F.xxhash64("id"), 1) <= most.cast("long")).select(lower_text("text").alias("text"), at.cast("int").alias("at"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, 0, SLICE_BYTES):
                found = text_words(texts)
                key = part.column(1).to_numpy(zero_copy_only=False).astype(np.int64)[found.text] * max(len(found.known), 1) + found.word
                kinds, n = np.unique(key, return_counts=True)
                lang, word = np.divmod(kinds, max(len(found.known), 1))
                yield pa.RecordBatch.from_arrays([pa.array(lang.astype(np.int32)), found.known.take(pa.array(word)), pa.array(n)], names=["lang", "word", "n"])

    words = chosen.mapInArrow(split, "lang int, word binary, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    return materialize(words, "language_words"), langs, np.array([n for _, n in share], float)


def fit(docs: DataFrame, vocabulary_path: str, sample: int = SAMPLE, rounds: int = ROUNDS, **columns: str) -> Model | None:
    """A model from the documents whose id's crc32 leaves a remainder other than 2 by 4; None if none of them has a language."""
    pieces = letter_pieces(vocabulary_path)
    words, langs, share = training_words(docs, sample, **columns)
    if not langs:
        return None
    trie = Trie.of(pieces)
    shared = docs.sparkSession.sparkContext.broadcast(trie)  # the vocabulary is fixed
    p = None
    for _ in range(rounds + 1):
        def count(batches: Iterator[pa.RecordBatch], p: np.ndarray | None = p) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lang, n = (batch.column(i).to_numpy() for i in (0, 2))
                where, piece, c = expected(batch.column(1), n, lang, shared.value, p)
                yield pa.RecordBatch.from_arrays([pa.array(where.astype(np.int32)), pa.array(piece.astype(np.int32)), pa.array(c)], names=["lang", "piece", "c"])

        sums = words.mapInArrow(count, "lang int, piece int, c double").groupBy("lang", "piece").agg(F.sum("c").alias("c")).toArrow()
        table = np.full((len(pieces), len(langs)), SMOOTHING)
        table[sums["piece"].to_numpy(), sums["lang"].to_numpy()] += np.round(sums["c"].to_numpy(), 6)  # sums come in any order
        p = table / table.sum(0)
    shared.unpersist()
    return Model(trie, langs, p, (share + 1) / (share + 1).sum())


def predict(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``."""
    names = [free_name(docs, "lang_pred"), free_name(docs, "score")]
    if model is None:
        return docs.withColumns({names[0]: F.lit(UNKNOWN), names[1]: F.lit(0.0)})
    text = free_name(docs, "lower_text")
    rows = docs.withColumn(text, F.when(F.col(text_col).cast("string").rlike(r"\p{L}"), lower_text(text_col)))
    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        langs = pa.array(own.langs)
        for batch in batches:
            for part, texts in slices(batch, batch.num_columns - 1, SLICE_BYTES):
                best, score = own.predict(texts)
                said = part.column(part.num_columns - 1).is_valid().to_numpy(zero_copy_only=False)
                lang = pa.compute.if_else(pa.array(said), langs.take(pa.array(best)), UNKNOWN)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], lang, pa.array(np.where(said, score, 0.0))], names=[*part.schema.names[:-1], *names])

    return rows.mapInArrow(run, schema)
