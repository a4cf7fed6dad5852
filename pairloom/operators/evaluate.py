"""Classification metrics from (y_true, y_pred).

Everything derives from the confusion counts, so the labelled table is read and reduced once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def confusion(labelled: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts per (y_true, y_pred), optionally per group (AGG5)."""
    return labelled.groupBy(*(by or []), "y_true", "y_pred").agg(F.count("*").alias("n"))


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, 0.0).otherwise(part / whole)


def class_1_metrics(labelled: DataFrame, by: list[str] | None = None) -> DataFrame:
    """precision, recall, accuracy, f1 of class 1; 0 where undefined (AGG6)."""

    def cells(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))

    true, pred = F.col("y_true") == 1, F.col("y_pred") == 1
    counted = confusion(labelled, by).groupBy(*(by or [])).agg(
        cells(true & pred).alias("tp"), cells(pred).alias("predicted"), cells(true).alias("actual"),
        cells(F.col("y_true") == F.col("y_pred")).alias("right"), F.sum("n").alias("total"))
    return counted.select(
        *(by or []), _ratio(F.col("tp"), F.col("predicted")).alias("precision"),
        _ratio(F.col("tp"), F.col("actual")).alias("recall"), _ratio(F.col("right"), F.col("total")).alias("accuracy"),
        _ratio(2 * F.col("tp"), F.col("predicted") + F.col("actual")).alias("f1"))


def classification_report(labelled: DataFrame, by: list[str] | None = None) -> DataFrame:
    """precision, recall, f1, support per class, then accuracy, macro avg and weighted avg (AGG7).

    The accuracy row has its value under ``f1`` and no precision or recall.
    """
    by = by or []
    classes = (confusion(labelled, by)
               .withColumn("cls", F.explode(F.array_distinct(F.array("y_true", "y_pred"))))
               .groupBy(*by, "cls").agg(
                   F.sum(F.when((F.col("y_true") == F.col("cls")) & (F.col("y_pred") == F.col("cls")), F.col("n"))
                         .otherwise(0)).alias("tp"),
                   F.sum(F.when(F.col("y_pred") == F.col("cls"), F.col("n")).otherwise(0)).alias("predicted"),
                   F.sum(F.when(F.col("y_true") == F.col("cls"), F.col("n")).otherwise(0)).alias("support")))
    scored = classes.select(
        *by, "cls", "tp", "support", _ratio(F.col("tp"), F.col("predicted")).alias("p"),
        _ratio(F.col("tp"), F.col("support")).alias("r"),
        _ratio(2 * F.col("tp"), F.col("predicted") + F.col("support")).alias("f"))
    averages = [F.lit(name) for name in ("accuracy", "macro avg", "weighted avg")]
    lines = scored.withColumn("label", F.explode(F.array(F.col("cls").cast("string"), *averages)))

    def value(column: str) -> Column:
        weighted = F.sum(F.col(column) * F.col("support")) / F.sum("support")
        return F.when(F.col("label") == "weighted avg", weighted).otherwise(F.avg(column))

    accuracy = F.col("label") == "accuracy"
    return lines.groupBy(*by, "label").agg(
        F.when(accuracy, None).otherwise(value("p")).alias("precision"),
        F.when(accuracy, None).otherwise(value("r")).alias("recall"),
        F.when(accuracy, F.sum("tp") / F.sum("support")).otherwise(value("f")).alias("f1"),
        F.sum("support").alias("support"))
