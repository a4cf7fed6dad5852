"""Permutations, metrics, scaling, models, readers and writers."""

import time
from collections import Counter, defaultdict
from datetime import date

import pytest
from pyspark.sql import functions as F

from pairloom.operators import evaluate, models, standardise, synthetic
from pairloom.plans import match as matching, training as training_plan
from pairloom.sources import readers, writers


def test_permutation_keeps_every_group(spark):
    rows = [(i, f"t{i % 7}", str(i), f"e{i}", "x", "big" if i % 3 == 0 else None if i % 5 == 0 else f"c{i % 4}")
            for i in range(300)]
    df = spark.createDataFrame(rows, "m_id long, title string, default_price_cents string, eans string, "
                                     "sup_cat_id string, mas_cat_id string")
    made = synthetic.synthetic_pairs(df, iterations=3).collect()
    assert len(made) == 4 * 300
    own = {r[0]: r for r in rows}
    groups = defaultdict(Counter)
    for r in made:
        groups[r.iteration, r.mas_cat_id][r.eans] += 1
        assert r.match == int(r.iteration == 0 or r.eans == own[r.m_id][3])
    for (iteration, category), eans in groups.items():
        assert eans == groups[0, category]
    orders = {it: tuple(r.eans for r in sorted(made, key=lambda r: r.m_id) if r.iteration == it) for it in range(4)}
    assert len(set(orders.values())) == 4


def test_metrics(spark):
    pairs = [(1, 1)] * 6 + [(1, 0)] * 2 + [(0, 1)] * 1 + [(0, 0)] * 3
    df = spark.createDataFrame(pairs, "y_true int, y_pred int")
    row = evaluate.class_1_metrics(df).first()
    assert (row.precision, row.recall, row.accuracy) == (pytest.approx(6 / 7), 0.75, 0.75)
    report = {r.label: r for r in evaluate.classification_report(df).collect()}
    assert set(report) == {"0", "1", "accuracy", "macro avg", "weighted avg"}
    assert report["0"].precision == pytest.approx(0.6) and report["0"].support == 4
    assert report["macro avg"].recall == pytest.approx(0.75)
    assert report["accuracy"].f1 == 0.75 and report["accuracy"].precision is None
    none = evaluate.class_1_metrics(spark.createDataFrame([(0, 0)], "y_true int, y_pred int")).first()
    assert (none.precision, none.recall, none.f1, none.accuracy) == (0, 0, 0, 1)


def test_scaling(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0), (None, float("nan"))], "a double, b double")
    stats = standardise.fit_stats(df, ["a", "b"])
    assert stats == {"a": (2.0, 1.0), "b": (5.0, 1.0)}
    got = [(r.z_a, r.z_b) for r in standardise.scaling_stage(stats).transform(df).collect()]
    assert got == [(-1.0, 0.0), (1.0, 0.0), (0.0, 0.0)]


@pytest.fixture(scope="module")
def training(spark):
    return spark.range(400).selectExpr(
        "id as m_id", "0 as iteration", "if(id % 2 = 0, 0.9, 0.3) + (id % 10) * 0.005 as wg_sim_score",
        "cast(id % 50 as double) as price_diff", "cast(id % 4 = 0 as int) as ean_match_flag",
        "if(id % 9 = 0, null, cast(id % 6 as double)) as size_diff", "cast(id % 2 = 0 as int) as match")


def test_models_learn_save_and_load(spark, training, tmp_path):
    fitted, test = models.train_models(training, ["m_id"], rounds=3,
                                       names=["Logistic_Regression", "Decision_Trees", models.BOOSTED])
    metrics, report = models.evaluate_models(fitted, test)
    assert {r.model: r.f1 for r in metrics.collect()} == dict.fromkeys(fitted, 1.0)
    assert report.where("label = 'accuracy'").count() == 3
    assert models.feature_importance(fitted, spark).count() == 12
    writers.save_models(fitted, str(tmp_path))
    loaded = readers.load_model(f"{tmp_path}/{models.BOOSTED}")
    assert models.predict(loaded, training).where("match_pred <> match").count() == 0
    assert models.predict(loaded, training, refit=True).count() == 400


def test_training_gives_confusion_and_importances_of_all_models(training):
    fitted, _, report, confusion, importances = training_plan.train(training, rounds=2)
    assert len(fitted) == 4 and {r.model for r in confusion.collect()} == set(fitted)
    assert sorted(r.model for r in importances.collect()) == sorted([*fitted] * 4)
    rows = {r.support for r in report.where("label = 'accuracy'").collect()}
    assert {r.n for r in confusion.groupBy("model").agg(F.sum("n").alias("n")).collect()} == rows


def test_importances_of_all_models(spark, monkeypatch, training):
    from catalog import queries
    monkeypatch.setattr(queries, "training_rows", lambda *_: training)
    found = queries.ml_importance(spark, "")
    assert found.select("model").distinct().count() == 4 and found.count() == 16


def test_split_depends_on_values_only(training):
    first = {r.m_id for r in models.split_train_test(training, keys=["m_id"])[1].collect()}
    again = {r.m_id for r in models.split_train_test(training.repartition(5), keys=["m_id"])[1].collect()}
    assert first == again and 60 < len(first) < 140


def test_readers(spark, tmp_path):
    file = tmp_path / "Stock.CSV"
    file.write_text('title,default_price_cents,eans\n"Cola ""6x0,5""",99,"1,2"\nBier,50,3.0\n')
    rows = readers.read_supplier(spark, str(file)).collect()
    assert {r.title for r in rows} == {'Cola "6x0,5"', "Bier"} and len({r.sup_id for r in rows}) == 2
    with pytest.raises(ValueError, match="missing columns"):
        readers.read_master(spark, str(file))
    with pytest.raises(ValueError, match="unknown kind"):
        readers.read_table(spark, "stock.xlsx")


def test_latest_training(spark, training, tmp_path):
    writers.write_training(training.limit(3), str(tmp_path), date(2024, 1, 2))
    time.sleep(1.1)
    writers.write_training(training.limit(5), str(tmp_path), date(2024, 1, 1))
    assert readers.read_latest_training(spark, str(tmp_path)).count() == 5


def test_whole_job_from_files(spark, tmp_path):
    writers.write_table(spark.createDataFrame(
        [(1, "Cola Dose 6x0,33 l", "99", "11"), (2, "Bier Kiste 20x0,5 l", "50", "22.0")],
        "sup_id long, title string, default_price_cents string, eans string"), f"{tmp_path}/s.csv")
    writers.write_table(spark.createDataFrame(
        [(7, "Cola Dose 0,33 l", "95", "0.33", "a", "p7", "c7", "11", "", ""), (8, "Bier 0,5 l", "50", "nan", "b", "p8", "c8", "", "22", "")],
        "m_id long, mas_title string, mas_dpc string, mas_size string, mas_cat_id string, p_id string, cp_id string, "
        "p_eans string, cp_eans string, cp_un_eans string"), f"{tmp_path}/m.csv")
    results = matching.run(spark, f"{tmp_path}/s.csv", f"{tmp_path}/m.csv", f"{tmp_path}/results", "rule-based")
    assert set(results) == {"rule_based"}
    best = spark.read.csv(f"{tmp_path}/results/rule_based_automatch", header=True).collect()
    assert {(r.sup_id, r.p_id) for r in best} == {("1", "p7"), ("2", "p8")}
    saved = spark.read.csv(f"{tmp_path}/results/rule_based", header=True)
    assert {"jaro", "stfidf", "match_pred", "merge_eans", "size_diff"} <= set(saved.columns)
    assert {r.sup_id: r.ean_match_flag for r in saved.where("match_pred = '1'").collect()} == {"1": "1", "2": "1"}
    with pytest.raises(ValueError):
        matching.run(spark, "", "", "", "fuzzy")
    with pytest.raises(ValueError):
        matching.match(saved, "both")


SUPPLIER_ODD = [(1, "Cola Dose 6x0,33 l", "99", "11"), (2, "Bier Kiste 20x0,5 l", "50", "22.0"), (3, "Cola Dose 6x0,33 l", "90", None),
                (4, None, "5", "11"), (5, "  ", None, ""), (6, "Bier Kiste 20x0,5 l", " ", "22")]
MASTER_ODD = [(7, "Cola Dose 0,33 l", "95", "0.33", "a", "p7", "c7", "11", "", ""), (8, "Bier 0,5 l", "50", "nan", "b", " ", "c8", "", "22", ""),
              (9, "Cola Dose 0,33 l", "90", "0.33", "a", "p9", None, "", "", ""), (10, None, None, None, "a", "p10", "c10", "11", None, "")]


def odd_sides(spark):
    """Repeated, blank and missing titles and numbers; every pair a candidate."""
    supplier = spark.createDataFrame(SUPPLIER_ODD, "sup_id long, title string, default_price_cents string, eans string")
    master = spark.createDataFrame(
        MASTER_ODD, "m_id long, mas_title string, mas_dpc string, mas_size string, mas_cat_id string, p_id string, cp_id string, "
        "p_eans string, cp_eans string, cp_un_eans string")
    pairs = spark.createDataFrame([(s[0], m[0]) for s in SUPPLIER_ODD for m in MASTER_ODD], "sup_id long, m_id long")
    return supplier, master, pairs


@pytest.mark.parametrize("compat", [False, True])
def test_narrow_pairs_equal_the_wide_ones(spark, compat):
    supplier, master, pairs = odd_sides(spark)
    wide = matching.feature_pairs(supplier, master, compat=compat, names=["jwrink", "lev"], pairs=pairs)
    narrow = matching.narrow_pairs(supplier, master, compat=compat, pairs=pairs)
    assert narrow.columns == matching.NARROW
    assert sorted(map(repr, narrow.collect())) == sorted(map(repr, wide.select(*matching.NARROW).collect()))
    for rule_no in (1, 2, 3):
        best = matching.match(wide, "rule_based", rule_no)["rule_based"][1]
        late = matching.best_matches(matching.classified(narrow, "rule_based", rule_no)["rule_based"], supplier, master)
        assert late.columns == best.columns and late.collect() == best.collect() and (rule_no == 1 or late.count())


def test_titles_are_not_shuffled_for_pairs_that_lose(spark):
    """Scores are joined back by numbers, classes are found on the narrow table, titles come to the winners."""
    supplier, master, pairs = odd_sides(spark)
    narrow = matching.narrow_pairs(supplier, master, pairs=pairs)
    plan = narrow._jdf.queryExecution().optimizedPlan().toString()
    back = [line for line in plan.splitlines() if "Join LeftOuter" in line and "(s_title#" in line]
    assert len(back) == 1 and "mas_title" not in back[0]
    found = matching.classified(narrow, "rule_based")["rule_based"]
    assert not {"title", "mas_title", "p_id"} & set(found.columns)


def test_job_without_all_pairs_has_the_same_best_matches(spark, tmp_path):
    supplier, master, _ = odd_sides(spark)
    writers.write_table(supplier, f"{tmp_path}/s.csv")
    writers.write_table(master, f"{tmp_path}/m.csv")
    for all_pairs, folder in ((True, "wide"), (False, "narrow")):
        matching.run(spark, f"{tmp_path}/s.csv", f"{tmp_path}/m.csv", f"{tmp_path}/{folder}", "rule_based", all_pairs=all_pairs)
    wide, narrow = [spark.read.csv(f"{tmp_path}/{x}/rule_based_automatch", header=True) for x in ("wide", "narrow")]
    assert sorted(map(tuple, wide.collect()), key=repr) == sorted(map(tuple, narrow.collect()), key=repr) and wide.count()
    saved = spark.read.csv(f"{tmp_path}/narrow/rule_based", header=True)
    assert saved.columns == [*matching.NARROW, "wg_sim_score_max", "match_pred"]


def test_empty_tables_give_no_matches(spark):
    supplier, master, pairs = odd_sides(spark)
    narrow = matching.narrow_pairs(supplier.limit(0), master, pairs=pairs)
    assert matching.best_matches(matching.classified(narrow, "rule_based")["rule_based"], supplier, master).count() == 0


def test_ids_do_not_depend_on_splits(spark, tmp_path):
    rows = [(f"title {i}", "1", "2", "3") for i in range(5000)]
    frame = spark.createDataFrame(rows, "mas_title string, p_eans string, cp_eans string, cp_un_eans string")
    frame.coalesce(1).write.option("header", True).csv(f"{tmp_path}/master.csv")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("8k", "50k", "64m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = readers.read_master(spark, f"{tmp_path}/master.csv").select("m_id", "mas_title").collect()
            assert sorted((r.m_id, r.mas_title) for r in got) == [(i, f"title {i}") for i in range(5000)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_master_files_in_id_order(spark, tmp_path):
    from catalog import queries
    frame = spark.range(3000).selectExpr("(id * 7919) % 3000 as m_id", "concat('title ', (id * 7919) % 3000) as mas_title", "'1' as p_eans", "'2' as cp_eans", "'3' as cp_un_eans")
    writers.write_table(queries.in_id_order(frame), f"{tmp_path}/master.csv")
    assert len(list((tmp_path / "master.csv").glob("part-*.csv"))) > 1
    got = readers.read_master(spark, f"{tmp_path}/master.csv").select("m_id", "mas_title").collect()
    assert sorted((r.m_id, r.mas_title) for r in got) == [(i, f"title {i}") for i in range(3000)]


def test_training_csv_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0.5, 'a "b", c'), (2, None, "d")], "m_id int, price_diff double, title string")
    writers.write_training(rows, str(tmp_path), kind="csv")
    back = readers.read_latest_training(spark, str(tmp_path))
    assert sorted(map(tuple, back.select("m_id", "price_diff", "title").collect())) == sorted(map(tuple, rows.collect()))


def test_training_keeps_rows_without_titles_and_missing_numbers(spark):
    master = spark.createDataFrame(
        [(1, "red ale 6x0,33 l", None, "4001", "beer", "red ale", 199.0, 0.33, "beer", "4001", None, None),
         (2, None, 250.0, "4002", "beer", "brown ale", 250.0, None, "beer", "4002", None, None),
         (3, "stout 12er", 99.0, None, "beer", None, 99.0, 0.5, "beer", "4003", None, None)],
        "m_id long, title string, default_price_cents double, eans string, sup_cat_id string, mas_title string, mas_dpc double, "
        "mas_size double, mas_cat_id string, p_eans string, cp_eans string, cp_un_eans string")
    made = training_plan.training_set(master, iterations=2, names=["jwrink", "lev"]).where("iteration = 0").collect()
    by = {r.m_id: r for r in made}
    assert set(by) == {1, 2, 3}
    assert by[1].price_diff is None and by[1].wg_sim_score is not None
    assert by[2].wg_sim_score is None and by[3].wg_sim_score is None
