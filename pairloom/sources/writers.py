"""Writing results, training data and models."""

from __future__ import annotations

from datetime import date

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _flat(df: DataFrame) -> DataFrame:
    """Arrays and structs as JSON text, which CSV can hold."""
    nested = {c for c, kind in df.dtypes if kind.startswith(("array", "struct", "map"))}
    return df.select([F.to_json(c).alias(c) if c in nested else F.col(c) for c in df.columns])


def write_table(df: DataFrame, path: str, kind: str = "csv", compression: str | None = None) -> None:
    """Write a result table, replacing an older one."""
    if kind == "csv":
        _flat(df).write.mode("overwrite").options(header=True, escape='"').csv(path, compression=compression)
    elif kind == "parquet":
        df.write.mode("overwrite").parquet(path)
    else:
        raise ValueError(f"unknown kind of table: {kind}")


def write_results(predictions: DataFrame, best: DataFrame, folder: str, method: str, kind: str = "csv") -> None:
    """All predictions (SNK1) and the best matches (SNK2) of a method.

    Predictions are a wide row for every candidate of every item; as CSV they are written with gzip.
    """
    write_table(predictions, f"{folder}/{method}", kind, "gzip")
    write_table(best, f"{folder}/{method}_automatch", kind)


def write_training(training: DataFrame, folder: str, day: date | None = None, kind: str = "parquet") -> str:
    """Training data under the day's partition directory (SNK3)."""
    path = f"{folder}/run_date={(day or date.today()).isoformat()}"
    write_table(training, path, kind)
    return path


def save_models(models: dict[str, PipelineModel], folder: str) -> None:
    """Every fitted model with its scaling under its name (SNK4)."""
    for name, model in models.items():
        model.write().overwrite().save(f"{folder}/{name}")
