import math
import random
from collections import Counter, defaultdict

import numpy as np
from odd import documents, empty_documents, odd_documents
from pairloom.llm import cube_mix, topk_threshold
from pyspark.sql import functions as F


def brute_top(rows, k):
    good = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    d = Counter(len(v) for _, v in good).most_common(1)[0][0]
    good = [(i, v) for i, v in good if len(v) == d]
    out = []
    for q, v in {(i, tuple(v)) for i, v in good if i % 10 == 0}:
        best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in good if i != q)[:k]
        out += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    return sorted(out)


def test_top_k_with_ties_nulls_and_small_blocks(spark):
    rng = random.Random(1)
    rows = [(i, [rng.choice([-0.5, 0.0, 0.25, rng.gauss(0, 1)]) for _ in range(6)]) for i in range(150)]
    rows += [(i, rows[7][1]) for i in range(150, 170)] + [(200, None), (201, [None] * 6), (202, [float("nan")] * 6), (203, [float("inf")] * 6), (None, [0.1] * 6), (210, [1.0, 2.0]), (220, [0.0] * 6), (20, rows[20][1])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("v", F.lit(1)).withColumn("query", F.lit("x"))
    stored = [(r.vec_id, r.embedding) for r in vectors.collect()]
    for block, queries in ((8192, 1024), (16, 4)):
        got = topk_threshold.top_k(vectors, F.col("vec_id") % 10 == 0, 5, block=block, queries=queries)
        assert sorted(tuple(r) for r in got.collect()) == brute_top(stored, 5)
    assert topk_threshold.top_k(vectors.limit(0), F.col("vec_id") % 10 == 0, 5).count() == 0
    few = topk_threshold.top_k(vectors.where("vec_id in (10, 11)"), F.col("vec_id") % 10 == 0, 5)
    assert few.count() == 1


def test_threshold_stops_early():
    x = np.zeros((5000, 4), np.int64)
    x[:, 0] = np.arange(5000)
    ids, scores, scored = topk_threshold.Block(np.arange(5000), x).top(-1, np.array([3, 0, 0, 0]), 10)
    assert ids.tolist() == list(range(4999, 4989, -1)) and scores[0] == 3 * 4999 and scored < 100


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, capped, left = {}, set(), sum(sizes.values())
    while True:
        free = [s for s in names if s not in capped]
        share = left / sum(weight[s] for s in free) if free else 0
        over = [s for s in free if share * weight[s] > 3 * sizes[s]]
        if not over:
            return target | {s: share * weight[s] for s in free}
        for s in over:
            target[s] = 3.0 * sizes[s]
            capped.add(s)
            left -= target[s]


def check_mix(docs, tolerance):
    rows = cube_mix.mix(docs, group=64).collect()
    assert sorted(map(tuple, rows), key=repr) == sorted(map(tuple, cube_mix.mix(docs.repartition(7), group=64).collect()), key=repr)
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in rows:
        sizes[r.source] += r["size"]
        taken[r.source] += r["size"] * r.copies
        assert 0 <= r.copies <= 3
    want = brute_targets(sizes)
    for r in rows:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) <= 1e-9 * max(1, want[r.source])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= tolerance, (s, taken[s], want[s])
    return rows


def test_mix_meets_targets(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 60)), rng.choice(["a", "b", "b", "b", "c", None])) for i in range(3000)]
    rows += [(5000 + i, "w", "Z") for i in range(3)] + [(6000, "", "nothing"), (7, rows[7][1], rows[7][2])]
    check_mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), 60)  # less than the largest document


def test_mix_of_odd_rows(spark, sf_dir):
    assert len(check_mix(odd_documents(spark), 100_000)) == odd_documents(spark).count()
    assert len(check_mix(documents(spark, sf_dir), 1200)) == documents(spark, sf_dir).count()
    assert cube_mix.mix(empty_documents(spark)).count() == 0


def test_mixed_rows_are_repeated(spark, sf_dir):
    for docs in (odd_documents(spark), documents(spark, sf_dir)):
        want = Counter()
        for r in cube_mix.mix(docs).collect():
            want[r["id"]] += r.copies
        mixed = cube_mix.mixed_documents(docs)
        assert mixed.columns == docs.columns
        assert Counter(r.doc_id for r in mixed.select("doc_id").collect()) == +want


def test_flight_keeps_both_sums():
    rng = np.random.default_rng(0)
    p, size = rng.random(500), rng.integers(1, 1000, 500).astype(float)
    new = cube_mix.fly(p, size, rng.random(600))
    assert ((new > 0) & (new < 1)).sum() <= 2
    assert abs(new.sum() - p.sum()) < 1e-6 and abs((new * size).sum() - (p * size).sum()) < 1e-3
    large = cube_mix.settle_largest(p, size, rng.random(600), 40)
    assert np.isin(large[np.argsort(-size)[:40]], (0, 1)).all()
    assert abs((large * size).sum() - (p * size).sum()) < 1e-3

    def settled(i, largest):
        own = np.random.default_rng(i)
        flown = cube_mix.fly(cube_mix.settle_largest(p[:20], size[:20], own.random(30), largest), size[:20], own.random(30))
        out = cube_mix.land(flown, size[:20], own.random(4))
        assert np.isin(out, (0, 1)).all()
        return out

    for largest in (0, 20):
        mean = np.mean([settled(i, largest) for i in range(800)], axis=0)
        assert np.abs(mean - p[:20]).max() < 0.08


def test_every_source_comes_near_its_target(spark):
    docs = documents(spark, "/root/testdata/sf0.01")
    rows = cube_mix.mix(docs).collect()
    off, sizes = defaultdict(float), defaultdict(list)
    for r in rows:
        off[r.source] += r["size"] * r.copies - r.target / sum(1 for x in rows if x.source == r.source)
        sizes[r.source].append(r["size"])
    assert all(abs(off[s]) <= max(sizes[s]) / 2 for s in off)
    assert np.mean([abs(off[s]) / np.median(sizes[s]) for s in off]) < 0.5


def test_repeated_rows_are_dealt_apart(spark):
    docs = spark.range(3000).selectExpr("cast(null as long) as doc_id", "'same words here' as text", "if(id < 2500, 'a', 'b') as source")
    rows = check_mix(docs, 4)
    assert len(rows) == 3000


def test_large_queries_are_scored_in_whole_numbers():
    x = np.array([[1024, 3], [1024, 2], [1024, 1]], np.int64)
    q = np.array([2**50 + 1, 1], np.int64)
    ids, scores, _ = topk_threshold.Block(np.array([5, 6, 7]), x).top(1, q, 3)
    assert list(zip(ids.tolist(), scores.tolist())) == [(i, 1024 * (2**50 + 1) + n) for i, n in ((5, 3), (6, 2), (7, 1))]
