"""Article numbers, numbers, features, rules, ranking."""

import pytest
from pyspark.sql import functions as F

from pairloom.functions import ean, numeric
from pairloom.operators import features, rules
from pairloom.operators.pairs import rebuild_pairs
from pairloom.operators.ranking import automatch, top_per_item


def test_ean_lists(spark):
    df = spark.createDataFrame([("123.0",), ("1, 2",), (" 7 8 ",), (None,)], "eans string")
    got = [r[0] for r in df.select(ean.ean_list(F.col("eans"))).collect()]
    assert got == [["123"], ["1", "2"], ["7", "8"], []]
    kept = [r[0] for r in df.select(ean.ean_list(F.col("eans"), compat=True)).collect()]
    assert kept == [["123"], ["1", "", "2"], ["7", "8"], ["nan"]]


def test_merged_eans(spark):
    df = spark.createDataFrame([("12", "12 34.0", None)], "a string, b string, c string")
    columns = [F.col(c) for c in "abc"]
    assert df.select(ean.merged_eans(*columns)).first()[0] == ["12", "34"]
    assert df.select(ean.merged_eans(*columns, compat=True)).first()[0] == ["1", "2", "3", "4", "0"]


def test_numbers(spark):
    df = spark.createDataFrame([("1,234.5",), ("  ",), (None,), ("nan",)], "t string")
    assert [r[0] for r in df.select(numeric.repaired_number(F.col("t"))).collect()] == [1234.5, 0.0, 0.0, None]
    assert df.select(numeric.repaired_number(F.lit("0,75"), decimal_comma=True)).first()[0] == 0.75
    odd = spark.createDataFrame([(float("nan"),), (float("inf"),), (float("-inf"),), (None,), (2.0,)], "x double")
    largest = numeric.LARGEST_DOUBLE
    assert [r[0] for r in odd.select(numeric.finite(F.col("x"))).collect()] == [0.0, largest, -largest, 0.0, 2.0]


def test_text_that_is_no_number_raises(spark):
    df = spark.createDataFrame([("abc",)], "mas_dpc string")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        features.repair_types(df).collect()


PAIRS = [(1, m, 0.9 if m in (3, 4) else 0.5, float(m), 1) for m in range(1, 13)] + [(2, 1, 0.7, None, 0)]
SCHEMA = "sup_id long, m_id long, wg_sim_score double, price_diff double, ean_match_flag int"


def predicted(df):
    return {(r.sup_id, r.m_id) for r in df.where("match_pred = 1").collect()}


def test_rules(spark):
    df = spark.createDataFrame(PAIRS, SCHEMA)
    assert predicted(rules.classify_by_rule(df, 1)) == {(1, 3), (1, 4)}
    assert predicted(rules.classify_by_rule(df, 2)) == {(1, 3), (1, 4)}
    assert predicted(rules.classify_by_rule(df)) == {(1, 3), (1, 4), (2, 1)}
    found = {r.sup_id: r.price_knn for r in rules.add_rule_features(df).collect()}
    assert found == {1: [float(x) for x in range(1, 11)], 2: []}
    with pytest.raises(ValueError):
        rules.classify_by_rule(df, 4)


def test_rules_over_pairs_that_are_made_again(spark):
    """A lookup joined to a side of the pairs gives what joining it to the pairs gives; no pair is joined."""
    df = spark.createDataFrame(PAIRS, SCHEMA)
    sides = df.select("sup_id").distinct()
    again = lambda lookup: df.join(sides.join(lookup, "sup_id", "left"), "sup_id")
    for rule_no in (1, 2, 3):
        found = rules.classify_by_rule(df, rule_no, again)
        assert predicted(found) == predicted(rules.classify_by_rule(df, rule_no))
    found = {r.sup_id: r.price_knn for r in rules.add_rule_features(df, again).collect()}
    assert found == {1: [float(x) for x in range(1, 11)], 2: []}


def test_ranking(spark):
    df = spark.createDataFrame(PAIRS, SCHEMA)
    assert [(r.m_id, r.rank) for r in top_per_item(df.where("sup_id = 1"), 3).orderBy("rank").collect()] == [
        (3, 1), (4, 2), (1, 3)]
    full = rules.rule_3(df).selectExpr("*", "'t' as title", "'m' as mas_title", "'p' as p_id", "'c' as cp_id")
    assert [(r.sup_id, r.rank) for r in automatch(full).collect()] == [(1, 1), (1, 2), (2, 1)]


def test_rebuild_renames_clashes(spark):
    s = spark.createDataFrame([(1, "a")], "sup_id long, name string")
    m = spark.createDataFrame([(5, "b")], "m_id long, name string")
    row = rebuild_pairs(spark.createDataFrame([(1, 5)], "sup_id long, m_id long"), s, m).first()
    assert (row.name, row.m_name) == ("a", "b")
