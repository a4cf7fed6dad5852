"""Spark ML classifiers over the four pair features."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom import fixed_values as fv
from pairloom.operators.boosting import BoostedTrees
from pairloom.operators.evaluate import class_1_metrics, classification_report
from pairloom.operators.standardise import Stats, fit_stats, scaling_stage

BOOSTED = "XG_Boost"
LABEL = "match"


def split_train_test(df: DataFrame, test_share: float = fv.TEST_SHARE, seed: int = fv.SPLIT_SEED,
                     keys: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Train and test rows by a hash of ``keys``, all columns by default (ML1).

    The side of a row depends on its values and the seed only, not on partitioning or retries.
    """
    point = F.pmod(F.xxhash64(*(keys or df.columns), F.lit(seed)), F.lit(10_000))
    in_test = point < round(test_share * 10_000)
    return df.where(~in_test), df.where(in_test)


def estimators(n_train: int, seed: int = fv.SPLIT_SEED, max_depth: int = 30, rounds: int = 100) -> dict:
    """The four classifiers by name (ML2-ML5).

    The forest and the tree grow to depth 30, the deepest that Spark allows; the regression's penalty equals C = 1 over ``n_train`` rows; the boosted trees
    are of second order (``operators.boosting``).
    """
    columns = {"featuresCol": "features", "labelCol": LABEL}
    return {
        "Random_Forests": RandomForestClassifier(numTrees=100, maxDepth=max_depth, seed=seed, **columns),
        "Logistic_Regression": LogisticRegression(regParam=1.0 / max(n_train, 1), elasticNetParam=0.0,
                                                  standardization=False, **columns),
        "Decision_Trees": DecisionTreeClassifier(maxDepth=max_depth, seed=seed, **columns),
        BOOSTED: BoostedTrees(rounds=rounds, **columns),
    }


def training_columns(df: DataFrame, keys: list[str] = ()) -> DataFrame:
    """The four features and the label (PRJ3), with any key columns kept for the split."""
    return df.select(*[k for k in keys if k in df.columns], *fv.MODEL_FEATURES, F.col(LABEL).cast("int").alias(LABEL))


def _prepare(stats: Stats) -> list:
    """Scaling and assembling (PRJ4, ML8): everything in front of a classifier."""
    names = [f"z_{c}" for c in stats]
    return [scaling_stage(stats), VectorAssembler(inputCols=names, outputCol="features")]


def train_models(training: DataFrame, keys: list[str] = (), scale_before_split: bool = False,
                 names: list[str] | None = None, **options) -> tuple[dict[str, PipelineModel], DataFrame]:
    """Fit the named classifiers (all by default) and return them with the test rows (ML6, ML8, ML9).

    The scaler is fitted on the training rows; ``scale_before_split`` fits it on all rows instead.
    The prepared training rows are cached while the classifiers pass over them many times.
    """
    data = training_columns(training, keys)
    train, test = split_train_test(data, keys=list(keys) or None)
    stats = fit_stats(data if scale_before_split else train, fv.MODEL_FEATURES)
    front = Pipeline(stages=_prepare(stats)).fit(train)
    ready = front.transform(train).select("features", LABEL).cache()
    try:
        fitted = {}
        for name, estimator in estimators(ready.count(), **options).items():
            if names is None or name in names:
                fitted[name] = PipelineModel(stages=[*front.stages, estimator.fit(ready)])
    finally:
        ready.unpersist()
    return fitted, test


def predict(model: PipelineModel, df: DataFrame, refit: bool = False) -> DataFrame:
    """Add ``match_pred`` (ML10, ML11); ``refit`` takes the scaling statistics from ``df`` itself."""
    if refit:
        model = PipelineModel(stages=[scaling_stage(fit_stats(df, fv.MODEL_FEATURES)), *model.stages[1:]])
    scored = model.transform(df)
    return scored.select(*df.columns, F.col("prediction").cast("int").alias("match_pred"))


def labelled_predictions(models: dict[str, PipelineModel], test: DataFrame) -> DataFrame:
    """(model, y_true, y_pred) of all models over the test rows."""
    parts = [predict(m, test).select(F.lit(name).alias("model"), F.col(LABEL).alias("y_true"),
                                     F.col("match_pred").alias("y_pred")) for name, m in models.items()]
    united = parts[0]
    for part in parts[1:]:
        united = united.unionByName(part)
    return united


def evaluate_models(models: dict[str, PipelineModel], test: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Class-1 metrics and the per-class report, one group per model (ML9)."""
    labelled = labelled_predictions(models, test)
    return class_1_metrics(labelled, ["model"]), classification_report(labelled, ["model"])


def feature_importance(models: dict[str, PipelineModel], spark) -> DataFrame:
    """(model, feature, score): coefficients of the regression, importances of the trees (ML7)."""
    rows = []
    for name, model in models.items():
        last = model.stages[-1]
        values = last.coefficients if name == "Logistic_Regression" else last.featureImportances
        rows += [(name, feature, float(v)) for feature, v in zip(fv.MODEL_FEATURES, values.toArray())]
    return spark.createDataFrame(rows, "model string, feature string, score double")
