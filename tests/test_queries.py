"""Every registered query with SQL gives the rows DuckDB gives; the others give a stable schema."""

import pytest

import __spark_entry__ as entry
from compare import connect, difference

from catalog import oracle, queries as catalog_queries

QUERIES, SQL = catalog_queries.registered(), oracle.texts()
TRAINED = {"ml_train_eval", "ml_importance", "ml_predict", "match_both"}


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(SQL) <= set(QUERIES) <= set(entry.queries())


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, sf_dir, duck, name):
    assert difference(QUERIES[name](spark, sf_dir), duck, SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - TRAINED))
def test_gives_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).limit(1).count() == 1


def test_entry(spark):
    best = entry.entry(spark)
    assert best.columns == ["sup_id", "title", "mas_title", "p_id", "cp_id", "rank"]
    assert best.count() > 0
