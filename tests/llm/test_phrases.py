import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, strategies as st
from odd import documents, empty_documents, odd_documents
from pairloom.llm import phrases, words
from pyspark.sql import functions as F


def split(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [[w for w in re.split(r"[\x20\x09]+", piece) if w] for piece in re.split(r"[.,;:!?\x0A-\x0D]", low)]


def brute(rows, least=10, covers=50, top=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for w in split(text):
            n[lang] += len(w)
            f.update((lang, *w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    longest = Counter()  # of each pair, the most frequent longer phrase
    for (lang, *w), a in f.items():
        for part in ((lang, *w[:2]), (lang, *w[1:])) if len(w) == 3 else ():
            longest[part] = max(longest[part], a if a >= least else 0)
    scored = []
    for (lang, *w), a in f.items():
        if len(w) > 1 and a >= least and not (len(w) == 2 and 100 * longest[lang, *w] >= covers * a):
            s, _, l, r = min((10**6 * a * a // (f[lang, *w[:k]] * f[lang, *w[k:]]), k, f[lang, *w[:k]], f[lang, *w[k:]]) for k in range(1, len(w)))
            scored.append((lang, -s, -a, " ".join(w).encode(), l, r))
    rank = Counter()
    for lang, s, a, phrase, l, r in sorted(scored):
        rank[lang] += 1
        if rank[lang] <= top:
            yield lang, rank[lang], phrase.decode(), -a, l, r, n[lang], -s


def same(docs, **options):
    got = phrases.collocations(docs, **options).collect()
    options.pop("bits", None)
    want = brute([tuple(r) for r in docs.select("lang", "text").collect()], **options)
    assert sorted(map(tuple, got)) == sorted(want)
    return got


def test_phrases_equal_brute_force(spark, sf_dir):
    docs = documents(spark, sf_dir)
    assert len(same(docs)) > 100
    same(docs, bits=15, top=7)  # a sketch that is nearly full changes nothing
    same(odd_documents(spark))
    same(odd_documents(spark), least=2, covers=80)
    assert phrases.collocations(empty_documents(spark)).count() == 0


def test_hot_word_over_many_parts(spark):
    texts = [" ".join(f"the w{i % 37} of{' x' if i % 3 else ' y'}, the w{i % 41}\tthe THE" for i in range(s, s + 60)) for s in range(40)]
    docs = spark.createDataFrame([(i, t, None if i % 4 else "en") for i, t in enumerate(texts)] * 2, "doc_id long, text string, lang string").withColumn("n", F.lit("x"))
    got = same(docs)
    assert {r.lang for r in got} == {"en", "und"}


def test_exact_beyond_64_bits():
    assert phrases.cut_score(3 * 10**12, 4 * 10**12, 5 * 10**12) == 450_000
    assert phrases.cut_score(10**18 - 1, 10**18, 10**18 - 1) == 999_999


def test_a_stream_out_of_order_is_noticed(spark):
    stream = spark.createDataFrame([("en", "b", "c", None, 10)], phrases._STREAM)
    with pytest.raises(Exception, match="out of order|None"):
        phrases.lockstep(stream, ["l1", "l2", "right"]).collect()


@given(st.lists(st.binary(max_size=40), max_size=6))
def test_words_are_those_of_a_plain_split(texts):
    found = words.words_of(texts, phrases.WORD, phrases.BREAKS)
    want = []
    for t, text in enumerate(texts):
        for p, piece in enumerate(re.split(rb"[.,;:!?\x0A-\x0D]", text)):
            want += [(t, p, w.lower()) for w in re.split(rb"[\x20\x09]+", piece) if w]
    assert [w for _, _, w in want] == [found.known[i].as_py() for i in found.word.tolist()]
    assert found.text.tolist() == [t for t, _, _ in want]
    assert (np.diff(found.piece) > 0).tolist() == [a[:2] != b[:2] for a, b in zip(want, want[1:])]
    assert len(set(words.hashes(found.known).tolist())) == len(found.known)


def test_hashes_do_not_depend_on_the_place():
    a = words.hashes(pa.array([b"one", b"two"], pa.binary()))
    b = words.hashes(pa.array([b"x", b"two", b"", b"one"], pa.binary()).slice(1))
    assert a[0] == b[2] and a[1] == b[0]


@given(st.lists(st.lists(st.tuples(st.integers(0, 2**64 - 1), st.integers(1, 30)), max_size=20), min_size=1, max_size=5), st.integers(1, 5))
def test_packed_numbers_mark_their_bits(slices, range_bits):
    bits, least, sent, total = 12, 10, {}, Counter()
    for numbers in slices:
        numbers = dict(numbers)
        for h, n in numbers.items():  # numbers that agree in the bits that are sent count as one
            total[h >> (32 - range_bits)] += n
        h, n = np.array(list(numbers), np.uint64), np.array(list(numbers.values()), np.int64)
        for at, rest, few in zip(*[x.to_pylist() for x in phrases.packed(h, n, least, range_bits)]):
            sent.setdefault(at, []).append((rest, few))
    data = bytearray(1 << bits >> 3)
    size = 1 << (bits - range_bits) >> 3
    for at, rows in sent.items():
        data[at * size : (at + 1) * size] = phrases.frequent_bits(*zip(*rows), least, bits - range_bits)
    sketch = phrases.Sketch(bits, bytes(data))
    often = {h >> (20 + range_bits) for h, n in total.items() if n >= least}
    for h in total:
        assert sketch.holds(np.array([h << (32 - range_bits)], np.uint64))[0] == (h >> (20 + range_bits) in often)
