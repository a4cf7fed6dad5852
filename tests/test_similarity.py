"""Golden values of the similarity helpers, and their agreement with plain definitions."""

import random
from difflib import SequenceMatcher

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pairloom.functions import similarity as sim
from pairloom.operators.scoring import MIXED_LABELS, add_scores, score_pairs

SHORT = st.text(alphabet="abcä ", max_size=9)


def table(a, b, cell):
    rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            rows[i][j] = cell(rows, i, j)
    return rows[-1][-1]


def plain_alignment(a, b):
    def cell(d, i, j):
        if not i or not j:
            return i + j
        best = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
        if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
            best = min(best, d[i - 2][j - 2] + 1)
        return best
    return table(a, b, cell)


def plain_subsequence(a, b):
    def cell(d, i, j):
        if not i or not j:
            return 0
        return d[i - 1][j - 1] + 1 if a[i - 1] == b[j - 1] else max(d[i - 1][j], d[i][j - 1])
    return table(a, b, cell)


@given(SHORT, SHORT)
@settings(max_examples=500, deadline=None)
def test_bit_parallel_helpers_equal_the_tables(a, b):
    assert sim.alignment_distance(a, b) == plain_alignment(a, b)
    assert sim.common_subsequence(a, b) == plain_subsequence(a, b)


@given(st.text("ab ", max_size=14), st.text("ab ", max_size=14))
@settings(max_examples=500, deadline=None)
def test_gestalt_equals_the_matching_blocks(a, b):
    assert sim.gestalt(a, b) == pytest.approx(SequenceMatcher(None, a, b, autojunk=False).ratio())


@given(SHORT, SHORT)
@settings(max_examples=300, deadline=None)
def test_bounds_and_symmetry(a, b):
    for measure in (sim.jaro, sim.token_set_ratio, sim.normalised_distance):
        assert 0 <= measure(a, b) <= 1
        assert measure(a, b) == pytest.approx(measure(b, a))
    assert 0 <= sim.gestalt(a, b) <= 1
    # one token of b may serve several of a, so soft TF-IDF has no upper bound of 1
    assert sim.soft_tfidf(a.split(), b.split()) >= 0


def test_golden():
    assert sim.jaro("MARTHA", "MARHTA") == pytest.approx(0.944444, abs=1e-6)
    assert sim.with_prefix(sim.jaro("MARTHA", "MARHTA"), "MARTHA", "MARHTA") == pytest.approx(0.961111, abs=1e-6)
    assert sim.with_prefix(sim.jaro("abcd", "axyz"), "abcd", "axyz") == pytest.approx(0.55)
    assert sim.token_set_ratio("red bolt", "bolt RED") == 1.0
    assert sim.token_set_ratio("", "bolt") == 0.0
    assert sim.normalised_distance("CA", "ABC") == 1.0
    assert sim.gestalt("abcd", "bcde") == 0.75
    assert sim.monge_elkan(["red", "bolt"], ["bolt", "red"]) == 1.0
    assert sim.soft_tfidf(["red"], ["red"]) == 1.0


PAIRS = [("abc", "abd"), ("abc", "abcd"), ("red bolt", "bolt blue"), ("", ""), (None, "x"), ("Stück 10", "10 Stuck")]


def test_columns(spark):
    df = spark.createDataFrame(PAIRS, "title string, mas_title string")
    got = {r.title: r for r in add_scores(df).collect() if r.mas_title not in ("abcd",)}
    assert got["abc"].hamm == pytest.approx(2 / 3)
    assert got["red bolt"].jacrd == pytest.approx(1 / 3) and got["red bolt"].cos == pytest.approx(0.5)
    assert got[""].hamm == 1.0 and got[""].jacrd == 1.0 and got[""].jaro == 1.0
    assert got[None].jaro is None and got[None].lev is None
    by_length = df.where("mas_title = 'abcd'").select(sim.hamming(F.col("title"), F.col("mas_title"))).first()[0]
    assert by_length == 0.75


def test_scoring_distinct_titles_equals_scoring_rows(spark):
    df = spark.createDataFrame([p for p in PAIRS if p[0] is not None] * 3, "title string, mas_title string")
    once, each = score_pairs(df), add_scores(df)
    assert once.columns == each.columns
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, each.collect()))


def test_mixed_labels(spark):
    df = spark.createDataFrame([("red bolt x", "bolt blue")], "title string, mas_title string")
    plain, mixed = add_scores(df).first(), add_scores(df, compat=True).first()
    for label, measure in MIXED_LABELS.items():
        assert mixed[label] == plain[measure]
    assert mixed.jaro == plain.jaro


def test_jaro_columns_equal_the_plain_helper_without_python(spark):
    """Random short texts, shared and moved characters, code points beyond 16 bits, empty and long texts, nulls."""
    draw = random.Random(5)
    texts = ["".join(draw.choices("abcä😀 ", k=draw.randint(0, 12))) for _ in range(600)]
    pairs = list(zip(texts[::2], texts[1::2])) + [("", ""), ("", "a"), ("MARTHA", "MARHTA"), ("ab" * 700, "ba" * 650)]
    pairs += [(a, a[::-1]) for a in texts[:50]] + [("ab\U0010ffff", "abc")]
    df = spark.createDataFrame(pairs + [(None, "x"), ("x", None)], "title string, mas_title string")
    scored = add_scores(df, names=["jaro", "jwrink"])
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and plan.count("aggregate(") == 1
    for row in scored.collect():
        if row.title is None or row.mas_title is None:
            assert row.jaro is None and row.jwrink is None
        elif "\U0010ffff" not in row.title:
            expected = sim.jaro(row.title, row.mas_title)
            assert row.jaro == pytest.approx(expected, abs=1e-12), row
            assert row.jwrink == pytest.approx(sim.with_prefix(expected, row.title, row.mas_title), abs=1e-12)
        else:
            assert 0 < row.jaro < 1
