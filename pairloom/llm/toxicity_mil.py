"""Toxicity by multiple-instance learning: labels are on documents, scores are on sentences.

A document is a bag of sentences (cut at . ! ? and line ends). A sentence with words W has the probability
q = sigmoid(bias + sum of the weights of W); the document is toxic if any sentence is: P = 1 - product of (1 - q), the
noisy-or. Bias and weights are fitted to document labels by gradient steps on the cross-entropy of P, so that
the label's weight flows to the sentences that explain it; these are reported for documents that score high.

Fit: on at most about ``SAMPLE`` labelled training rows (chosen by a hash of the id; the bound is a parameter). Words are
64-bit hashes; those kept are the ``FEATURES`` whose share of toxic documents departs most from the mean, counted over the
whole sample in Spark. What reaches the driver is bounded by these two parameters. All documents are then scored
whole, in one pass without a shuffle.

Words: runs of ASCII letters and of bytes above 127, with A-Z in lower case; their first bytes (``PREFIXES``) count too.
Labels, language, source and id are no inputs.

Defined results: null text is empty text; a text without words scores by its one empty sentence. Without labelled rows,
or with one class only, the score of every document is the smoothed share of label 1. A label row with null id or label is
no label; of repeated label rows the largest label holds; several documents of one id all have its label.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pairloom.llm.bpe_chunks import forget_coders, give_back, slices
from pairloom.llm.common import free_name, id_crc, whole_text
from pairloom.session import materialize

#: Labelled documents to fit on, about; more labelled rows are thinned by a hash of their id.
SAMPLE = 12_000
#: Words that may have a weight, and the least documents of the sample that hold one.
FEATURES = 2_000
LEAST_DOCS = 5
#: Standard errors by which a word's share of toxic documents must depart from the mean.
DEPARTS = 5.0
STEPS = 300
RATE = 0.1
#: Besides whole words, their first so many bytes are features too: inflected and compounded words share them.
PREFIXES = (4, 5, 6)
RIDGE = 1e-4
TOXIC = 0.7
#: Text that is split at once; its arrays take some fifty times as much.
SLICE_BYTES = 1 << 20
OFFENDING = 0.5

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_END = np.zeros(256, bool)
_END[list(b".!?\n")] = True
_PRIME = 0x9E3779B97F4A7C15 | 1


@dataclass
class Bags:
    """Words of a run of texts: hash, sentence number; and for each sentence its document and byte range."""

    words: np.ndarray
    sentence: np.ndarray
    document: np.ndarray
    start: np.ndarray
    end: np.ndarray


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        up = np.cumprod(np.full(n + 1, _PRIME, np.uint64))
        down = np.cumprod(np.full(n + 1, pow(_PRIME, -1, 1 << 64), np.uint64))
    return up, down


def bags(texts: list[bytes]) -> Bags:
    """Sentences and words of texts, by arithmetic on the whole byte run."""
    whole = b"\n".join(texts) + b"\n"  # a line end cuts a sentence, so no sentence spans two texts
    data = np.frombuffer(whole, np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    stops = np.flatnonzero(_END[data]) + 1
    start = np.concatenate(([0], stops[:-1])).astype(np.int64)
    letter = _LETTER[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], letter, [False])).astype(np.int8)))
    first, last = edge[::2], edge[1::2]
    up, down = _powers(len(data))
    with np.errstate(over="ignore"):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((_LOWER[data].astype(np.uint64) + np.uint64(1)) * up[:-1])))
        found, of = [], []
        for k in (0, *PREFIXES):  # whole words, and the beginnings of longer ones
            longer = last - first > k if k else slice(None)
            f, e = first[longer], first[longer] + k if k else last
            h = (sums[e] - sums[f]) * down[f] + np.uint64(k)  # independent of where the word stands
            found.append((h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93))
            of.append(np.searchsorted(stops, f, side="right"))
    order = np.argsort(np.concatenate(of), kind="stable") if PREFIXES else slice(None)
    return Bags(np.concatenate(found)[order].view(np.int64), np.concatenate(of)[order], np.searchsorted(ends, start, side="right"), start, stops)


@dataclass
class Model:
    words: np.ndarray  # sorted hashes
    weights: np.ndarray
    bias: float
    constant: float | None = None

    def sentence_scores(self, bag: Bags) -> np.ndarray:
        z = np.full(len(bag.start), self.bias)
        if len(self.words):
            at = np.minimum(np.searchsorted(self.words, bag.words), len(self.words) - 1)
            hit = self.words[at] == bag.words
            # a word counts once a sentence
            pairs = np.unique(np.stack([bag.sentence[hit], at[hit]], 1), axis=0)
            z += np.bincount(pairs[:, 0], self.weights[pairs[:, 1]], len(z))
        return z

    def documents(self, bag: Bags, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Noisy-or of each document, and each sentence's probability."""
        z = self.sentence_scores(bag)
        stay = -np.logaddexp(0, z)  # log(1 - q)
        return -np.expm1(np.bincount(bag.document, stay, n)), 1 / (1 + np.exp(-z))


def train(docs: list[list[np.ndarray]], labels: np.ndarray, features: int, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam steps; ``docs`` holds for each document the feature numbers of each sentence."""
    sizes = np.array([len(d) for d in docs])
    document = np.repeat(np.arange(len(docs)), sizes)
    lengths = np.array([len(s) for d in docs for s in d])
    sentence = np.repeat(np.arange(len(lengths)), lengths)
    word = np.concatenate([s for d in docs for s in d]) if lengths.sum() else np.empty(0, np.int64)
    y = labels.astype(float)
    share = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    w = np.zeros(features + 1)
    w[-1] = np.log(share / sizes.mean())  # at first every sentence is as likely
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        z = np.bincount(sentence, w[word], len(lengths)) + w[-1]
        q, stay = 1 / (1 + np.exp(-z)), -np.logaddexp(0, z)
        p = np.clip(-np.expm1(np.bincount(document, stay, len(docs))), 1e-12, 1.0)
        pull = np.where(y == 1, -(1 - p) / p, 1.0)[document] * q
        g = np.concatenate((np.bincount(word, pull[sentence], features), [pull.sum()])) / len(docs)
        g[:-1] += RIDGE * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, features: int = FEATURES, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model from the training rows: those whose id's crc32 leaves a remainder other than 1 by 3."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (id_crc() % 3 != 1))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n, positive = known.agg(F.count("*"), F.sum(F.col("toxic").cast("long"))).first()
    if not positive or positive == n:
        return Model(np.empty(0, np.int64), np.empty(0), 0.0, ((positive or 0) + 0.5) / (n + 1))
    # of all 64 bits: a share of any size is kept to, however many rows are labelled
    limit = -(1 << 63) + (sample << 64) // n
    chosen = F.lit(True) if n <= sample else F.xxhash64("doc_id") < F.lit(limit)
    texts = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text")).where(chosen)
    rows = texts.join(known.where(chosen), "doc_id").select("text", F.col("toxic").cast("int").alias("toxic"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_coders()
        for batch in batches:
            for part, texts in slices(batch, 0, SLICE_BYTES):
                bag, words, sentences = bags(texts), [], []
                cut = np.searchsorted(bag.document[bag.sentence], np.arange(len(texts) + 1))
                for i in range(len(texts)):
                    words.append(bag.words[cut[i] : cut[i + 1]].tolist())
                    sentences.append(bag.sentence[cut[i] : cut[i + 1]].tolist())
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array(words, pa.list_(pa.int64())), pa.array(sentences, pa.list_(pa.int64()))], names=["toxic", "words", "sentences"])
        give_back()

    rows = materialize(rows.mapInArrow(split, "toxic int, words array<bigint>, sentences array<bigint>"), "mil_sample")
    held = rows.select("toxic", F.explode(F.array_distinct("words")).alias("word")).groupBy("word").agg(F.count("*").alias("docs"), F.sum("toxic").alias("hits"))
    total, share = rows.agg(F.count("*"), F.avg("toxic")).first()
    if not total or share in (0.0, 1.0):
        return Model(np.empty(0, np.int64), np.empty(0), 0.0, (positive + 0.5) / (n + 1))
    departs = F.abs(F.col("hits") - F.col("docs") * share) / F.sqrt(F.col("docs") * (share * (1 - share)))
    best = held.where((F.col("docs") >= LEAST_DOCS) & (departs >= DEPARTS)).orderBy(departs.desc(), "word").limit(features).select("word").collect()
    words = np.sort(np.array([r.word for r in best], np.int64))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, at_sentence, count = [], [], []
            for w, s in zip(batch.column(1), batch.column(2), strict=True):
                w, s = w.values.to_numpy(), s.values.to_numpy()
                at = np.minimum(np.searchsorted(words, w), max(len(words) - 1, 0))
                hit = words[at] == w if len(words) else np.zeros(len(w), bool)
                found.append(at[hit].tolist())
                at_sentence.append(s[hit].tolist())
                count.append(len(np.unique(s)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64())), pa.array(at_sentence, pa.list_(pa.int64())), pa.array(count, pa.int64())], names=["toxic", "at", "sentence", "n"])

    sample_rows = rows.mapInArrow(pick, "toxic int, at array<bigint>, sentence array<bigint>, n bigint").collect()
    bags_, y = [], []
    for r in sorted(sample_rows, key=lambda r: (r.toxic, r.n, r.at, r.sentence)):  # in an order of their own: reruns agree
        by: dict[int, set[int]] = {}
        for f, s in zip(r.at, r.sentence, strict=True):
            by.setdefault(s, set()).add(f)
        empty = [np.empty(0, np.int64)] * max(1, r.n - len(by)) if r.n > len(by) or not by else []
        bags_.append([np.array(sorted(fs), np.int64) for _, fs in sorted(by.items())] + empty)
        y.append(r.toxic)
    weights, bias = train(bags_, np.array(y), len(words))
    return Model(words, weights, bias)


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score`` and ``offending``: byte ranges of sentences with a probability of ``OFFENDING`` or more."""
    at = docs.columns.index(text_col)
    names = [free_name(docs, "score"), free_name(docs, "offending")]
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    schema = docs.limit(0).selectExpr("*", f"CAST(0 AS double) AS `{names[0]}`", f"CAST(array() AS array<struct<start: bigint, end: bigint>>) AS `{names[1]}`").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_coders()
        for batch in batches:
            for part, texts in slices(batch, at, SLICE_BYTES):
                bag = bags(texts)
                p, q = model.documents(bag, len(texts))
                if model.constant is not None:
                    p, q = np.full(len(texts), model.constant), np.zeros(len(q))
                first = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
                offending: list[list] = [[] for _ in texts]
                for i in np.flatnonzero(q >= OFFENDING):
                    d = bag.document[i]
                    offending[d].append({"start": int(bag.start[i] - first[d]), "end": int(min(bag.end[i] - first[d], len(texts[d])))})
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(p), pa.array(offending, spans)], names=[*part.schema.names, *names])
        give_back()

    return docs.mapInArrow(run, schema)
