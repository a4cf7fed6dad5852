"""From a master table with matched supplier columns to trained models."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom import fixed_values as fv
from pairloom.functions.text import strip
from pairloom.operators.evaluate import confusion
from pairloom.operators.features import add_master_features, add_pair_features, add_supplier_features
from pairloom.operators.models import evaluate_models, feature_importance, labelled_predictions, train_models
from pairloom.operators.scoring import score_pairs
from pairloom.operators.synthetic import synthetic_pairs
from pairloom.session import materialize
from pairloom.sources.writers import save_models

ROW_KEYS = ["m_id", "iteration"]


def training_set(master: DataFrame, iterations: int = fv.SHUFFLE_ITERATIONS, seed: int = fv.SPLIT_SEED,
                 names: list[str] = fv.SCORE_COLUMNS, tobacco: bool = False, compat: bool = False) -> DataFrame:
    """Synthetic pairs with scores, features and ``match`` (SYN2).

    What depends on one side only is derived on the master rows, and the supplier side's part moves
    with it through the shuffles, so a title is mined once and not once per iteration. Rows without a
    title stay, without scores, and missing numbers stay missing.
    """
    raw = master.withColumn("raw", F.struct(*fv.MASTER_SUPPLIER_COLUMNS)).withColumn("title", strip(F.col("title")))
    mined = add_supplier_features(add_master_features(raw, compat, keep_missing=True), tobacco, compat, keep_missing=True)
    derived = [c for c in mined.columns if c not in master.columns and c not in ("raw", "merge_eans")]
    derived += ["default_price_cents", "eans"]
    rows = mined.withColumn("derived", F.struct(*derived)).drop(*derived, *fv.MASTER_SUPPLIER_COLUMNS)
    # read three times below; and filters must not be moved into the cascade, where they would multiply
    rows = materialize(rows.select("*", "raw.*").drop("raw"), "training_rows")
    pairs = synthetic_pairs(rows, iterations, seed, carried=["derived"])
    flat = pairs.drop("default_price_cents", "eans").select("*", "derived.*").drop("derived")
    scored = score_pairs(flat, names=names, compat=compat)
    return add_pair_features(scored)


def train(training: DataFrame, model_folder: str | None = None,
          **options) -> tuple[dict[str, PipelineModel], DataFrame, DataFrame, DataFrame, DataFrame]:
    """Fit, evaluate and optionally save the four models: (models, metrics, report, confusion, importances) (ML9)."""
    models, test = train_models(training, [k for k in ROW_KEYS if k in training.columns], **options)
    if model_folder:
        save_models(models, model_folder)
    metrics, report = evaluate_models(models, test)
    counts = confusion(labelled_predictions(models, test), ["model"])
    return models, metrics, report, counts, feature_importance(models, training.sparkSession)
