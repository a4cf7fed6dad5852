"""Scratch tables: buckets that save shuffles, and their removal."""

from pathlib import Path

from pyspark.sql import functions as F

from pairloom.session import materialize, materialize_bucketed, release


def test_joins_of_a_bucketed_table_do_not_shuffle_it(spark):
    rows = spark.range(1000).select((F.col("id") % 50).alias("key"), F.col("id").alias("value"))
    kept = materialize_bucketed(rows, "kept", "key")
    found = kept.join(spark.range(50).withColumnRenamed("id", "key").groupBy("key").agg(F.count("*").alias("n")).hint("merge"), "key", "left")
    assert sorted(map(tuple, found.collect())) == sorted((i % 50, i, 1) for i in range(1000))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and plan.split("Final Plan")[-1].count("Exchange hashpartitioning") <= 2  # aggregate only, shown twice
    empty = materialize_bucketed(rows.limit(0), "kept", "key")
    assert empty.columns == ["key", "value"] and empty.count() == 0


def test_release_removes_scratch_tables_only(spark, tmp_path):
    rows = spark.range(10)
    table, bucketed = materialize(rows, "gone"), materialize_bucketed(rows, "gone", "id")
    folders = [Path(x.inputFiles()[0].removeprefix("file:")).parent for x in (table, bucketed)]
    rows.write.parquet(str(tmp_path / "given"))
    release(spark.read.parquet(str(tmp_path / "given")))
    release(rows)
    assert (tmp_path / "given").exists() and all(x.exists() for x in folders)
    release(table)
    release(bucketed)
    assert not any(x.exists() for x in folders)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("pairloom_gone")]
