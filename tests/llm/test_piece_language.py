import math
import random
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings, strategies as st
from odd import documents, empty_documents, odd_documents
from pairloom.llm import piece_language as pl
from pyspark.sql import functions as F

PATH = public_tokenizers.path("piece_bpe_32k.model")
PIECES = [bytes([c]) for c in b" abcd"] + [b" a", b"ab", b"abc", b"bc", b"cd", b" abcd", b"dd"]


def held(doc_id):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 4 == 2


def every_way(word):
    if not word:
        return [()]
    return [(i, *rest) for i, p in enumerate(PIECES) if word.startswith(p) for rest in every_way(word[len(p) :])]


@settings(deadline=None, max_examples=60)
@given(st.lists(st.text("abcd", min_size=1, max_size=9), min_size=1, max_size=6), st.integers(0, 99))
def test_sums_and_expected_counts_over_all_segmentations(words, seed):
    trie = pl.Trie.of(sorted(PIECES))
    order = {i: sorted(PIECES).index(p) for i, p in enumerate(PIECES)}
    p = np.random.default_rng(seed).random((len(PIECES), 2)) + 0.01
    column = pa.array([w.encode() for w in words], pa.binary())
    model = pl.Model(trie, ["x", "y"], p, np.array([0.5, 0.5]))
    got = model.word_scores(column)
    lang, n = np.array([i % 2 for i in range(len(words))]), np.arange(1, len(words) + 1)
    want = Counter()
    for i, w in enumerate(words):
        ways = every_way(b" " + w.encode())
        for k in (0, 1):
            chance = [math.prod(p[order[x], k] for x in way) for way in ways]
            assert abs(got[i, k] - math.log(sum(chance))) < 1e-9
            if k == lang[i]:
                for way, c in zip(ways, chance):
                    for x in way:
                        want[k, order[x]] += n[i] * c / sum(chance)
    where, piece, c = pl.expected(column, n, lang, trie, p)
    found = dict(zip(zip(where.tolist(), piece.tolist()), c.tolist()))
    assert found.keys() == want.keys() and all(abs(found[k] - want[k]) < 1e-9 for k in want)


def test_long_runs_are_read_as_several_words():
    texts = [b"x" * 130 + b" ab", b"", b"ab", b"1 2"]
    found = pl.text_words(texts)
    assert [found.known[i].as_py() for i in found.word] == [b"x" * 48, b"x" * 48, b"x" * 34, b"ab", b"ab"]
    assert found.text.tolist() == [0, 0, 0, 0, 2]


def test_vocabulary_covers_every_word():
    pieces = pl.letter_pieces(PATH)
    assert len(pieces) > 20_000 and all(bytes([b]) in set(pieces) for b in range(128, 256)) and b" the" in pieces
    trie = pl.Trie.of(pieces)
    assert trie.step.nbytes < 20 << 20
    at = 1
    for b in b" the":
        at = trie.step[at, trie.classes[b]]
    assert pieces[trie.piece[at]] == b" the"


def plain_posterior(model, text):
    """A text's posterior word by word and place by place."""
    z = np.log(model.prior).copy()

    @lru_cache(None)
    def word_sum(word, k):
        a = [1.0] + [0.0] * len(word)
        for i in range(len(word)):
            at = 1
            for j in range(i, len(word)):
                at = int(model.trie.step[at, model.trie.classes[word[j]]])
                if not at:
                    break
                if model.trie.piece[at] >= 0:
                    a[j + 1] += a[i] * model.p[model.trie.piece[at], k]
        return math.log(a[-1])

    runs = "".join(chr(b) if pl.LETTER[b] else " " for b in text.lower().encode()).split()
    for w in (r.encode("latin-1") for r in runs):
        for i in range(0, len(w), 48):
            z += [word_sum(b" " + w[i : i + 48], k) for k in range(len(z))]
    return int(z.argmax()), 1 / np.exp(z - z.max()).sum()


def test_held_out_documents(spark):
    docs = documents(spark, "/root/testdata/sf0.01")
    model = pl.fit(docs, PATH)
    assert model.langs == ["de", "en", "es", "fr"] and np.allclose(model.p.sum(0), 1)
    got = {r.doc_id: r for r in pl.predict(docs, model).collect()}
    out = [r for r in got.values() if held(r.doc_id)]
    assert len(out) > 200 and np.mean([r.lang == r.lang_pred for r in out]) > 0.97
    for r in random.Random(1).sample(sorted(got.values(), key=lambda r: r.doc_id), 25):
        best, score = plain_posterior(model, r.text)
        assert r.lang_pred == model.langs[best] and abs(r.score - score) < 1e-9
    # the same model, however the rows lie
    assert np.allclose(pl.fit(docs.repartition(5), PATH).p, model.p, atol=1e-12)


def test_held_out_rows_teach_nothing(spark, sf_dir):
    docs = documents(spark, sf_dir)
    out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    one, other = pl.fit(docs, PATH, rounds=1), pl.fit(docs.withColumn("lang", F.when(out, "xx").otherwise(F.col("lang"))).withColumn("text", F.when(out, "qq").otherwise(F.col("text"))), PATH, rounds=1)
    assert one.langs == other.langs and np.array_equal(one.p, other.p)


def test_odd_rows(spark):
    docs = odd_documents(spark).unionByName(spark.createDataFrame([(50, "12 34 -- !", "en"), (51, "一", "en"), (52, "´ —", None)], "doc_id long, text string, lang string"), allowMissingColumns=True).withColumn("lang_pred", F.lit("x"))
    model = pl.fit(docs, PATH)
    rows = pl.predict(docs, model).collect()
    assert len(rows) == docs.count()
    for r in rows:
        silent = r.text is None or not any(c.isalpha() for c in r.text)
        assert (r["lang_pred_"] == "und") == silent and 0 <= r["score_"] <= 1 and (r["score_"] == 0) == silent
        assert silent or r["lang_pred_"] in model.langs
    assert pl.predict(empty_documents(spark), model).count() == 0
    nothing = pl.fit(docs.withColumn("lang", F.lit(None).cast("string")), PATH)
    assert nothing is None and {r["lang_pred_"] for r in pl.predict(docs, nothing).collect()} == {"und"}
    assert pl.fit(empty_documents(spark), PATH) is None
    one = pl.fit(docs.withColumn("lang", F.lit("en")), PATH)
    assert {(r["lang_pred_"], r["score_"]) for r in pl.predict(docs, one).collect()} == {("en", 1.0), ("und", 0.0)}
