import math
import re
import zlib
from collections import Counter
from pathlib import Path
from urllib.parse import urlparse

import corpus_pipeline
import numpy as np
import pytest
from odd import CLASHING, documents, empty_documents, odd_documents
from pairloom.llm import brown_lm, queries, toxicity_mil
from pairloom.llm.cube_mix import mix
from pairloom.session import scratch_root
from pyspark.sql import functions as F
from test_exact_and_near import brute_classes, brute_groups
from test_topk_and_mix import brute_targets

MEDIUM = "/root/testdata/sf0.01"


def tokens(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [w for w in re.split(r"[\x20\x09-\x0d]+", low) if w] + [None]


def held(doc_id):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 10 == 0


def check_lm(docs):
    rows = docs.select("doc_id", "text").collect()
    counts = Counter(w for r in rows if not held(r.doc_id) for w in tokens(r.text))
    n, v = sum(counts.values()), len(counts)
    want = Counter()
    for r in rows:
        own = tokens(r.text)
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own)
        want[r.doc_id, held(r.doc_id), len(own), sum(counts[w] > 0 for w in own), n, round(base, 4)] += 1
    out = brown_lm.score(docs).collect()
    assert Counter((r["id"], r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in out) == want
    assert all(r.score < 1e-9 and math.isfinite(r.score) for r in out)
    return out


def test_language_model(spark, sf_dir):
    check_lm(odd_documents(spark))
    check_lm(odd_documents(spark).where(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10 == 0))
    assert brown_lm.score(empty_documents(spark)).count() == 0
    out = [r for r in check_lm(documents(spark, MEDIUM)) if r.held_out]
    assert sum(r.score for r in out) > 0.98 * sum(r.base_score for r in out)  # fewer digits a token on texts not seen; a small table gains less


def test_language_model_leaves_nothing_but_its_result(spark):
    # written tables and shuffle files of steps that are done were kept until the end
    root = Path(urlparse(scratch_root(spark)).path) / "pairloom"
    before = set(root.glob("*/lm_*"))
    docs = spark.createDataFrame([(i, " ".join(f"w{i * j % 40}" for j in range(50))) for i in range(1, 60)], "doc_id long, text string")
    assert brown_lm.score(docs, top=8).count() == 59
    assert [x.name for x in set(root.glob("*/lm_*")) - before] == ["lm_scores"]


def test_counts_travel_as_bytes():
    counts = np.array([1, 254, 255, 256, 510, 511, 70_000])
    of, n = brown_lm.in_bytes(counts)
    assert n.dtype == np.uint8 and n.all()
    assert np.array_equal(np.bincount(of, n), counts)


def test_frequent_words_do_not_depend_on_blocks(spark):
    # "wide" is never among a block's most frequent words, but is so over all of them
    texts = [" ".join([*[f"own{i}x{j}" for j in range(20)] * 2, "wide"]) for i in range(6)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts, 1) if not held(i)], "id long, text string")
    n = docs.count()
    assert n > 3
    for parts in (1, n):
        blocks = brown_lm._blocks(docs.repartitionByRange(parts, "id"))
        assert brown_lm.frequent_words(blocks, 1) == ["wide"]


def test_buckets_follow_the_corpus(spark):
    blocks = brown_lm._blocks(spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(1000)))], "id long, text string"))
    assert brown_lm.bucket_count(blocks, 10) == 100
    assert brown_lm.bucket_count(blocks, 1000) == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_frequent_words_are_found_among_those_of_the_buckets(spark):
    # all distinct words of all blocks were summed a second time for them
    rows = [(i, " ".join(f"w{j}" for j in range(40) for _ in range(1 + (i + j) % 3 + (j < 6)))) for i in range(1, 9)]
    blocks = brown_lm._blocks(spark.createDataFrame(rows, "id long, text string").repartition(3))
    sent = blocks.select("block", "words", "counts").mapInArrow(brown_lm._to_words(4), brown_lm._ddl(brown_lm._WORDS))
    for top in (1, 4, 7, 30, 100):
        totals = sent.groupBy("bucket").applyInArrow(brown_lm._sum_words(top), brown_lm._ddl(brown_lm._TOTALS)).where("distinct is not null")
        assert totals.count() == 4
        assert brown_lm.frequent_words(totals, top) == brown_lm.frequent_words(blocks, top)
        assert max(len(r.words.split("\n")) for r in totals.collect()) <= top


def test_gains_of_rare_words_take_few_logarithms(monkeypatch):
    # a word took six for every class, whatever stood beside it
    rng = np.random.default_rng(7)
    words = 4000
    rows, columns = np.zeros((2, words, brown_lm.WIDTH))
    for beside in (rows, columns):
        beside[np.arange(words), rng.integers(0, brown_lm.WIDTH, words)] = 1
    table = rng.integers(1000, 2000, (brown_lm.WIDTH, brown_lm.WIDTH)).astype(float)
    small, real, taken = brown_lm.small_gains(table), brown_lm._xlogx, []
    monkeypatch.setattr(brown_lm, "_xlogx", lambda x: taken.append(np.size(x)) or real(x))
    brown_lm.move_gains(rows, columns, np.zeros(words), rng.integers(0, brown_lm.CLASSES, words), table, small)
    assert sum(taken) < words * brown_lm.CLASSES / 2


def test_gains_of_many_words_equal_gains_of_one():
    rng = np.random.default_rng(5)
    n = 150
    counts = rng.poisson(0.3, (n, n)).astype(float)
    classes = rng.integers(0, brown_lm.CLASSES, n)
    classes[:10] = [brown_lm.END, brown_lm.OTHER, brown_lm.OTHER, *[3] * 7]
    hot = np.eye(brown_lm.WIDTH)[classes]
    table, selves = hot.T @ counts @ hot, np.diag(counts)
    rows, columns = counts @ hot - selves[:, None] * hot, counts.T @ hot - selves[:, None] * hot
    found = brown_lm.move_gains(rows[1:], columns[1:], selves[1:], classes[1:], table)
    for w in range(1, n):
        out = table.copy()
        out[classes[w]] -= rows[w]
        out[:, classes[w]] -= columns[w]
        out[classes[w], classes[w]] -= selves[w]
        assert np.allclose(found[w - 1], brown_lm.gains(rows[w][None], columns[w][None], out, selves[w : w + 1])[0], atol=1e-8)


def test_model_probabilities_sum_to_one():
    rng = np.random.default_rng(1)
    words = 30
    classes = np.concatenate(([brown_lm.END], rng.integers(0, 5, words))).astype(np.uint8)
    text = rng.integers(0, words + 1, 5000)
    totals = np.bincount(text, minlength=words + 1)
    before = np.concatenate(([0], text[:-1]))
    table = np.zeros((brown_lm.WIDTH, brown_lm.WIDTH))
    np.add.at(table, (classes[before], classes[text]), 1)
    n, v = len(text), int((totals > 0).sum())
    moves = table / np.maximum(table.sum(1, keepdims=True), 1)
    emitted = totals / np.maximum(table.sum(0), 1)[classes]
    p0 = (totals + 0.1) / (n + 0.1 * (v + 1))
    for c in set(classes.tolist()):
        known = brown_lm.MIX * moves[c, classes] * emitted + (1 - brown_lm.MIX) * p0
        assert abs(known.sum() + (1 - brown_lm.MIX) * 0.1 / (n + 0.1 * (v + 1)) - 1) < 1e-9


def test_exchange_separates_two_languages():
    rng = np.random.default_rng(2)
    n = 40
    counts = np.zeros((n + 2, n + 2))
    for low in (1, 21):
        counts[low : low + 20, low : low + 20] = rng.integers(20, 60, (20, 20))
    counts[0, 1:-1], counts[1:-1, 0] = 5, 5

    def likelihood(classes):
        hot = np.eye(brown_lm.WIDTH)[classes]
        t = hot.T @ counts @ hot
        x = lambda a: float((a * np.log(np.maximum(a, 1e-300))).sum())
        return x(t) - x(t.sum(0)) - x(t.sum(1))

    begin = np.concatenate(([brown_lm.END], np.arange(n) % brown_lm.CLASSES, [brown_lm.OTHER]))
    begin[1:-1] %= 4
    first = brown_lm.exchange(counts, 1)
    last = brown_lm.exchange(counts, 10)
    assert likelihood(last) >= likelihood(first) - 1e-6
    assert not set(last[1:21]) & set(last[21:41])


def test_toxicity_on_held_out_documents(spark):
    docs, labels = documents(spark, MEDIUM), spark.read.parquet(f"{MEDIUM}/labels.parquet")
    docs = docs.unionByName(spark.createDataFrame([(10_000 + i, f"Plain words here {i}. You idiot moron, you pathetic stupid clown! More plain words." if i % 2 else f"Plain words here {i}. More plain words.", "en", "s", 1) for i in range(200)], docs.schema))
    labels = labels.unionByName(spark.createDataFrame([(10_000 + i, 1, i % 2) for i in range(200)], labels.schema))
    out = toxicity_mil.score(docs, toxicity_mil.fit(docs, labels)).join(labels, "doc_id").collect()
    assert all(0 <= r.score <= 1 for r in out)
    test = [r for r in out if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    hits = [r for r in test if r.doc_id >= 10_000 and r.toxic]
    assert hits and np.mean([r.score >= 0.7 for r in hits]) > 0.9
    assert not [r for r in test if not r.toxic and r.score >= 0.7]
    for r in hits:
        if r.offending:
            assert any("idiot" in r.text.encode()[x.start : x.end].decode() for x in r.offending)


def test_toxicity_of_odd_rows(spark):
    docs = odd_documents(spark)
    labels = spark.createDataFrame([(1, 1, 1), (2, 1, 0), (None, 0, 1), (3, 1, None), (5, 1, 0), (5, 1, 1), (7, 0, 0), (9, 1, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")
    for known in (labels, labels.limit(0), labels.where("toxic = 1")):
        scored = toxicity_mil.score(docs, toxicity_mil.fit(docs, known))
        assert scored.columns[-2:] == ["score_", "offending_"]
        rows = scored.collect()
        assert len(rows) == docs.count() and all(0 <= r.score_ <= 1 for r in rows)
    assert toxicity_mil.score(empty_documents(spark), toxicity_mil.fit(empty_documents(spark), labels)).count() == 0


def test_sentences_and_words():
    bag = toxicity_mil.bags([b"One two. TWO!", b"", "Über two\nx".encode()])
    assert bag.document.tolist() == [0, 0, 0, 1, 2, 2]
    two = toxicity_mil.bags([b"two"]).words[0]
    assert bag.sentence[bag.words == two].tolist() == [0, 1, 4]


def test_pipeline_rows_equal_plain_definitions(spark):
    docs = documents(spark, MEDIUM)
    kept = corpus_pipeline.STAGES[0][1](spark, docs, MEDIUM)
    assert kept.columns == docs.columns
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    clean = {r.doc_id for r in spark.read.parquet(f"{MEDIUM}/labels.parquet").where("toxic = 0").collect()}
    assert clean & {r.doc_id for r in docs.collect()} <= {i for i, _ in rows}
    single = {i for i, _, _, k, _ in brute_groups(rows) if k}
    texts = {i: t for i, t in rows if i in single}
    classes = brute_classes(sorted(texts.items()))
    left = {i for i, c in classes if i == c}
    copies = {r["id"]: r.copies for r in mix(docs.where(F.col("doc_id").isin(list(left)))).collect()}
    got = Counter(r.doc_id for r in corpus_pipeline.run(spark, MEDIUM).collect())
    assert got == Counter({i: n for i, n in copies.items() if n})


def test_stages_stand_odd_rows(spark, tmp_path):
    labels = spark.createDataFrame([(1, 1, 1), (2, 1, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for docs in (odd_documents(spark), empty_documents(spark)):
        names = docs.columns
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            docs = stage(spark, docs, str(tmp_path))
            assert docs.columns == names or i == 4
        assert docs.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        docs.collect()
    assert CLASHING


@pytest.mark.parametrize("name", sorted(set(queries.SQL)))
def test_queries_equal_sql(spark, sf_dir, name):
    from compare import connect, difference

    assert difference(queries.QUERIES[name](spark, sf_dir), connect(sf_dir), queries.SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_queries_give_a_row_a_document(spark, sf_dir, name):
    assert queries.QUERIES[name](spark, sf_dir).count() == documents(spark, sf_dir).count()


def test_targets_helper():
    assert brute_targets({"a": 10, "b": 1}) == {"b": 3.0, "a": 8.0}
