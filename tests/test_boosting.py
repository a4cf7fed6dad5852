"""Second-order boosting against values worked out by hand and against exact greedy trees in plain numpy."""

import json

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from pairloom.operators import boosting
from pairloom.operators.boosting import BoostedTrees


def table(spark, x, y):
    rows = spark.createDataFrame([(i, *map(float, a), int(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))],
                                 "id long, " + ", ".join(f"x{i} double" for i in range(len(x[0]))) + ", label int")
    names = [f"x{i}" for i in range(len(x[0]))]
    return VectorAssembler(inputCols=names, outputCol="features", handleInvalid="keep").transform(rows)


def probabilities(model, rows):
    return np.array([r.probability_1 for r in model.transform(rows).orderBy("id").collect()])


def test_splits_and_weights_by_hand(spark):
    rows = table(spark, [[1], [2], [3], [4]], [0, 0, 1, 1])
    model = BoostedTrees(rounds=2, maxDepth=1, leastHessian=0.0).fit(rows)
    first, second = model.content()["trees"]
    # p = 1/2: G = 1, H = 1/2 on the left, so the gain is 2 * 1 / 1.5 and the leaf 0.3 * 1 / 1.5
    assert first["feature"] == [0, -1, -1] and model.content()["edges"][0][first["cut"][0] - 1] == 3.0
    assert first["gain"][0] == pytest.approx(4 / 3) and first["value"][1:] == pytest.approx([-0.2, 0.2])
    p = 1 / (1 + np.exp(0.2))
    assert second["value"][1:] == pytest.approx([-0.3 * 2 * p / (2 * p * (1 - p) + 1), 0.3 * 2 * p / (2 * p * (1 - p) + 1)])
    assert model.featureImportances.toArray() == pytest.approx([1.0])
    # a child needs a hessian of 1, four rows have it all together
    alone = BoostedTrees(rounds=1).fit(rows).content()["trees"][0]
    assert alone["feature"] == [-1] and alone["value"] == pytest.approx([0.0])
    # rows of one label: a leaf of -G / (H + 1) = 2 / (1 + 1) times the rate
    assert BoostedTrees(rounds=1).fit(rows.withColumn("label", F.lit(1))).content()["trees"][0]["value"] == pytest.approx([0.3])


def exact_greedy(x, y, rounds, depth, rate=0.3, l2=1.0, least=1.0):
    """Margins after boosting with all cuts between values tried, missing values both ways."""
    margin = np.zeros(len(y))

    def grow(rows, g, h, left_levels, out):
        total = g[rows].sum() ** 2 / (h[rows].sum() + l2)
        best = (1e-6, None)
        for f in range(x.shape[1]) if left_levels else ():
            v = x[rows, f]
            for cut in np.unique(v[~np.isnan(v)]):
                for missing in (False, True):
                    left = np.where(np.isnan(v), missing, v < cut)
                    a, b = rows[left], rows[~left]
                    if min(h[a].sum(), h[b].sum()) < least:
                        continue
                    gain = g[a].sum() ** 2 / (h[a].sum() + l2) + g[b].sum() ** 2 / (h[b].sum() + l2) - total
                    if gain > best[0] + 1e-9:
                        best = (gain, (a, b))
        if best[1] is None:
            out[rows] = -g[rows].sum() / (h[rows].sum() + l2) * rate
        else:
            for part in best[1]:
                grow(part, g, h, left_levels - 1, out)

    for _ in range(rounds):
        p, out = 1 / (1 + np.exp(-margin)), np.zeros(len(y))
        grow(np.arange(len(y)), p - y, p * (1 - p), depth, out)
        margin += out
    return margin


def test_equals_exact_greedy_trees(spark, monkeypatch):
    monkeypatch.setattr(boosting, "ROUNDS_A_TABLE", 2)  # so that margins are written on the way
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(300, 3)), 1)
    x[rng.random(x.shape) < 0.1] = np.nan
    y = (np.nan_to_num(x[:, 0]) + np.nan_to_num(x[:, 1]) ** 2 + np.isnan(x[:, 2]) + rng.normal(size=300) * 0.3 > 0.8).astype(int)
    rows = table(spark, x, y)
    model = BoostedTrees(rounds=5, maxDepth=3, bins=2000).fit(rows.repartition(7))
    expected = 1 / (1 + np.exp(-exact_greedy(x, y, 5, 3)))
    assert probabilities(model, rows) == pytest.approx(expected, abs=1e-6)
    again = BoostedTrees(rounds=5, maxDepth=3, bins=2000).fit(rows.coalesce(1))
    assert again.content() == model.content()  # no split depends on the partitions


def test_copies_weigh_and_coarse_bins_learn(spark):
    rng = np.random.default_rng(6)
    x = rng.random((400, 2))
    y = (x.sum(axis=1) > 1).astype(int)
    rows = table(spark, x, y)
    thrice = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(3))))
    options = {"rounds": 3, "maxDepth": 3, "bins": 16}
    tripled = BoostedTrees(l2=3.0, leastHessian=3.0, **options).fit(thrice)
    single = BoostedTrees(l2=1.0, leastHessian=1.0, **options).fit(rows)
    assert probabilities(tripled, rows) == pytest.approx(probabilities(single, rows), abs=1e-9)
    assert max(map(len, single.content()["edges"])) <= 15
    binned = boosting.binned_rows(thrice.selectExpr("array(x0, x1) as x", "label as y"), single.content()["edges"])
    assert binned.count() <= 2 * 16 * 16 and binned.agg(F.sum("w")).first()[0] == 1200
    found = probabilities(BoostedTrees(rounds=8).fit(rows), rows) > 0.5
    assert (found == y).mean() > 0.95


def test_saved_in_a_pipeline_and_degenerate_tables(spark, tmp_path):
    rows = table(spark, [[1, np.nan], [2, np.nan], [3, np.nan], [4, np.nan]] * 5, [0, 0, 1, 1] * 5)  # a feature without any value
    model = Pipeline(stages=[BoostedTrees(rounds=2)]).fit(rows)
    model.write().overwrite().save(str(tmp_path / "m"))
    loaded = PipelineModel.load(str(tmp_path / "m"))
    assert probabilities(loaded, rows).tolist() == probabilities(model, rows).tolist()
    assert json.loads(loaded.stages[0].getOrDefault("fitted"))["edges"][1] == []
    assert loaded.transform(rows.limit(0)).count() == 0
    with pytest.raises(ValueError, match="no rows"):
        BoostedTrees().fit(rows.limit(0))
    with pytest.raises(ValueError, match="bins"):
        BoostedTrees(bins=1)


def test_a_pass_is_one_short_job(spark):
    rng = np.random.default_rng(8)
    x = rng.random((500, 2))
    rows = table(spark, x, (x[:, 0] * x[:, 1] > 0.3).astype(int)).cache()
    rows.count()
    spark.sparkContext.setJobGroup("boost", "boost")
    trees = BoostedTrees(rounds=6, maxDepth=4, leastHessian=0.01).fit(rows).content()["trees"]
    spark.sparkContext.setJobGroup("after", "after")
    assert min(len(t["feature"]) for t in trees) > 10
    # 24 passes and a few jobs before them; a pass that was a query took two jobs or more
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("boost")) <= 24 + 14


def test_chunks_and_many_tasks_change_no_tree(spark, monkeypatch):
    rng = np.random.default_rng(9)
    x = np.round(rng.random((300, 2)), 2)
    rows = table(spark, x, (x.sum(axis=1) + rng.random(300) > 1.5).astype(int))
    expected = BoostedTrees(rounds=3, maxDepth=3).fit(rows).content()
    for name, value in (("CHUNK_ROWS", 1), ("DIRECT_TASKS", 1), ("ROUNDS_A_TABLE", 1)):
        monkeypatch.setattr(boosting, name, value)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert BoostedTrees(rounds=3, maxDepth=3).fit(rows).content() == expected
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
