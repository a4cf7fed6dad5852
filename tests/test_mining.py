"""Golden values of title mining, and agreement with plain Python regular expressions."""

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pairloom import fixed_values as fv
from pairloom.functions import mining
from pairloom.functions import text as tx
from pairloom.operators.titles import add_title_features, mine_titles

FIELDS = mining.CASCADE_FIELDS

# title, remaining text, pack_title, size, unit, pieces, pieces_count
GOLDEN = [
    ("Cola Dose 24x0,33 l", "Cola Dose ", None, "0,33", "l", "24", None),
    ("Bier 4*6*0.5L", "Bier ", "4*6", "0.5", "L", None, None),
    ("Wasser 6 x 4 x 1,5 Liter", "Wasser ", "6 x 4", "1,5", "Liter", None, None),
    ("Marlboro Rot 10x20", "Marlboro Rot ", None, "20", None, "10", None),
    ("Tee 20 Beutel 1,75 g", "Tee ", None, "1,75", "g", "20", None),
    ("Riegel 24 Stk 45 g", "Riegel ", None, "45", "g", "24", None),
    ("Wein 0,75 Liter 6er", "Wein ", None, "0,75", "Liter", None, "6"),
    ("Chips 175g x 12", "Chips ", None, "175", "g", "12", None),
    ("Papier 500 Blatt", "Papier ", None, "500", "Blatt", None, None),
    ("Servietten 100 Stück", "Servietten ", None, None, None, None, "100"),
    ("Servietten 100 STÜCK", "Servietten ", None, None, None, None, "100"),
    ("Haribo 30er", "Haribo ", None, None, None, None, "30"),
    ("Cola 3/4", "Cola ", None, "3", None, "4", None),
    ("blue bolt 12 x", "blue bolt ", None, None, None, None, "12"),
    ("Saft 0,75", "Saft ", None, "0,75", None, None, None),
    ("Wein 12x10,5", "Wein ", "12x1", "0,5", None, None, None),
    ("Cola 6x0,5", "Cola ", None, "0,5", None, "6", None),
    ("Pommes", "Pommes", None, None, None, None, None),
]


def cascade(spark, titles, tobacco=False):
    df = spark.createDataFrame([(t, t) for t in titles], "title string, term string")
    found = mining.extract_cascade(df, "term", fv.mining_patterns(tobacco))
    return {r.title: (r.term, *[r[f] for f in FIELDS]) for r in found.collect()}


def plain_cascade(term, tobacco=False):
    fields = {}
    for pattern in fv.mining_patterns(tobacco):
        compiled = re.compile(pattern, re.I)
        found = compiled.search(term)
        if found:
            fields.update(found.groupdict())
            term = compiled.sub("", term)
    return (term, *[fields.get(f) for f in FIELDS])


def test_golden(spark):
    found = cascade(spark, [g[0] for g in GOLDEN])
    for title, *expected in GOLDEN:
        assert found[title] == tuple(expected), title


PARTS = st.sampled_from(["Cola", "6", "24", "0,33", "1.5", "x", " x ", "*", "à", "/", "l", "ml", "kg", "er", "Stück",
                         "STK", "Pack.", "Beutel", "Blatt", " ", " ", "€", "I", "(", ".", "´", "Riegel", "10"])


@given(st.lists(st.lists(PARTS, max_size=9).map("".join), min_size=40, max_size=40), st.booleans())
@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
def test_cascade_equals_plain_regular_expressions(spark, titles, tobacco):
    found = cascade(spark, titles, tobacco)
    for title in titles:
        assert found[title] == plain_cascade(title, tobacco), title


def full(spark, title, tobacco=False):
    df = spark.createDataFrame([(title,)], "title string")
    return mine_titles(df, tobacco=tobacco).first().asDict()


def test_full_extraction(spark):
    found = full(spark, "Jack Daniels Whiskey 4x6/0,33 l 40 % DPG Kiste Dose")
    assert found["title"] == "Jack Daniels Whiskey"
    assert (found["alcohol"], found["dpg"], found["packaging"], found["format"]) == ("40 %", "DPG", "Kiste", "Dose")
    assert (found["size"], found["unit"]) == (0.33, "l")
    assert (found["pack_title"], found["pieces"], found["pieces_count"]) == ("4x6", "24", None)


def test_unit_key_matters(spark):
    assert full(spark, "Cola 6x0,5")["unit"] == "l"
    assert full(spark, "Saft 0,75")["unit"] is None
    assert full(spark, "Mehl 2,5 kg")["size"] == 2500.0 and full(spark, "Mehl 2,5 kg")["unit"] == "g"
    assert full(spark, "Rum 70cl")["size"] == pytest.approx(0.7) and full(spark, "Rum 70cl")["unit"] == "l"


def test_tobacco(spark):
    found = full(spark, "Marlboro Rot 10x20 7,00€", tobacco=True)
    assert (found["kvp"], found["kvp_unit"], found["pieces"], found["pieces_count"]) == ("7,00", "€", "10", "20")


def test_clash_and_missing_column(spark):
    df = spark.createDataFrame([("a 5 g", "old")], "title string, unit string")
    assert mine_titles(df).columns[:2] == ["title_original", "unit_original"]
    with pytest.raises(ValueError):
        mine_titles(df.drop("title"))


def test_title_features_keep_the_title(spark):
    row = add_title_features(spark.createDataFrame([("Cola 6x0,5 l",)], "title string")).first()
    assert (row.title, row.brand, row.pieces, row["size"], row.unit) == ("Cola 6x0,5 l", "Cola", "6", "0,5", "l")


@pytest.mark.parametrize("text", ["o'neill's  10er", "älter WEIN", " a-b c2d ", ""])
def test_title_case_equals_python(spark, text):
    got = spark.createDataFrame([(text,)], "t string").select(tx.title_case(F.col("t"))).first()[0]
    assert got == re.sub(r"\s+", " ", text.strip()).title()


def test_pack_pieces(spark):
    df = spark.createDataFrame([("4 x 6",), ("3/4",), ("7",)], "p string")
    assert [int(r[0]) for r in df.select(mining.pack_pieces(F.col("p"))).collect()] == [24, 12, 0]


def test_filters_stay_out_of_the_cascade(spark):
    """A filter moved into the chain would double at every pattern and never finish planning."""
    df = spark.createDataFrame([("Cola 6x0,5 l",), ("Pommes",)], "title string")
    mined = mine_titles(df, tobacco=False).where("size is not null and pieces = '6'")
    assert [r.title for r in mined.collect()] == ["Cola"]
