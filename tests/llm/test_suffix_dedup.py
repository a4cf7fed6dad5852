import random
from collections import Counter

import pytest
from odd import documents, empty_documents, odd_documents
from pairloom.llm import suffix_dedup


def brute(rows, length):
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(t[s : s + length] for _, t in texts for s in range(len(t) - length + 1))
    out = Counter()
    for i, t in texts:
        gone = bytearray(len(t))
        for s in range(len(t) - length + 1):
            if seen[t[s : s + length]] > 1:
                gone[s : s + length] = b"\1" * length
        spans, at = [], 0
        while at < len(t):
            end = at
            while end < len(t) and gone[end]:
                end += 1
            if end > at:
                spans.append((at, end))
            at = end + 1
        out[i, len(t), tuple(spans), bytes(x for x, g in zip(t, gone) if not g)] += 1
    return out


def ours(docs, **settings):
    rows = suffix_dedup.remove_repeats(docs, **settings).collect()
    return Counter((r["id"], r.n_bytes, tuple((x.start, x.end) for x in r.removed), bytes(r.kept)) for r in rows)


@pytest.mark.parametrize("piece,batch", [(20_000, 32_768), (3, 16)])
def test_equals_brute_force_on_small_alphabets(spark, piece, batch):
    rng = random.Random(3)
    passages = ["".join(rng.choice("abcdefgh ") for _ in range(90)) for _ in range(4)]
    rows = [(i, "".join(rng.choice([*passages, "".join(rng.choice("ab ") for _ in range(rng.randrange(60)))]) [rng.randrange(20) :] for _ in range(rng.randrange(5)))) for i in range(60)]
    rows += [(61, "a" * 300), (62, "ab" * 120), (63, None), (64, rows[5][1]), (64, rows[5][1]), (None, "é" * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for length in (12, 25):
        assert ours(docs, length=length, piece=piece, batch_rows=batch) == brute(rows, length)


def test_odd_rows_and_production_length(spark, sf_dir):
    for docs in (odd_documents(spark).where("length(text) < 100000 or text is null"), documents(spark, sf_dir)):
        rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        assert ours(docs) == brute(rows, 400)
    assert suffix_dedup.remove_repeats(empty_documents(spark)).count() == 0
