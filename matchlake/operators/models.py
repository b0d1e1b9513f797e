"""Tree models on feature tables: fitting, scoring, tuning.

Defaults of the plans are the full model sizes; every size is a parameter.
Trees do not change under scaling of their inputs, so features go in unscaled.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchlake.functions import columns as c
from matchlake.session import shared_dir


@dataclass(frozen=True)
class Size:
    """Number of trees, step size, depth."""

    trees: int
    step: float
    depth: int


# Full sizes per model (fixed values). Depth 6 stands for the boosting library's default.
FINAL_POINTS = Size(300, 0.05, 5)
GOALS = Size(100, 0.05, 6)
CORNERS = Size(100, 0.05, 6)
OUTCOME = Size(150, 0.1, 4)
OVER = Size(150, 0.1, 4)
PLAYER_GOALS = Size(150, 0.1, 4)
STAR = Size(100, 0.1, 4)
GOALKEEPER = Size(100, 0.1, 3)
CLUTCH = Size(100, 0.1, 3)
CARD_GRID = {"trees": [100, 200], "step": [0.01, 0.05, 0.1], "depth": [3, 4, 5]}


# A missing value gets a place of its own, far below all others, so that a tree can split it off.
MISSING = -1e9


def assemble(df: DataFrame, features: Sequence[str], out: str = "features") -> DataFrame:
    filled = [f"_f{i}" for i in range(len(features))]
    values = {
        new: F.coalesce(c.finite_or_null(F.col(f"`{name}`")), F.lit(MISSING)) for new, name in zip(filled, features)
    }
    return VectorAssembler(inputCols=filled, outputCol=out).transform(df.withColumns(values)).drop(*filled)


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows as stored in the shared folder, without their lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def training_rows(df: DataFrame, features: Sequence[str], *others: Column) -> DataFrame:
    """Feature vectors and the given columns, checkpointed.

    Boosting reads its input many times. The checkpoint keeps that independent of the
    feature lineage and of executors that get lost meanwhile.
    """
    return checkpointed(assemble(df, features).select("features", *others))


def _fit(estimator, df: DataFrame, features: Sequence[str], *others: str):
    return estimator.fit(training_rows(df, features, *[F.col(n).cast("double").alias(n) for n in others]))


def fit_regressor(df: DataFrame, features: Sequence[str], label: str, size: Size, seed: int = 42):
    estimator = GBTRegressor(labelCol=label, maxIter=size.trees, stepSize=size.step, maxDepth=size.depth, seed=seed)
    return _fit(estimator, df, features, label)


def fit_binary(df: DataFrame, features: Sequence[str], label: str, size: Size, seed: int = 42):
    estimator = GBTClassifier(labelCol=label, maxIter=size.trees, stepSize=size.step, maxDepth=size.depth, seed=seed)
    return _fit(estimator, df, features, label)


@dataclass(frozen=True)
class OneAgainstRest:
    """One boosted two-class model per class; their probabilities are brought to a sum of 1."""

    models: tuple


def fit_outcome(
    df: DataFrame, features: Sequence[str], label: str, weight: str, size: Size = OUTCOME, seed: int = 42,
    classes: int = 3,
) -> OneAgainstRest:
    """Boosted trees for several classes, with class weights. Spark boosts two classes, so each class has a model."""
    labels = [F.when(F.col(label) == k, 1.0).otherwise(0.0).alias(f"_is_{k}") for k in range(classes)]
    rows = training_rows(df.filter(F.col(label).isNotNull()), features, *labels, F.col(weight).cast("double").alias("_weight"))
    boost = lambda k: GBTClassifier(
        labelCol=f"_is_{k}", weightCol="_weight", maxIter=size.trees, stepSize=size.step, maxDepth=size.depth, seed=seed
    )
    return OneAgainstRest(tuple(boost(k).fit(rows) for k in range(classes)))


def predict(model, df: DataFrame, features: Sequence[str], out: str) -> DataFrame:
    """Add the prediction of a regressor. Narrow: no shuffle, several calls may be chained."""
    if hasattr(model, "score_into"):  # a forest given as a node table
        return model.score_into(df, features, out)
    scored = model.transform(assemble(df, features, "_x"), {model.featuresCol: "_x", model.predictionCol: out})
    return scored.drop("_x")


def _class_probabilities(model, df: DataFrame, out: str) -> DataFrame:
    params = {model.featuresCol: "_x", model.predictionCol: "_class", model.probabilityCol: "_p", model.rawPredictionCol: "_raw"}
    return model.transform(df, params).withColumn(out, vector_to_array("_p")).drop("_class", "_p", "_raw")


def predict_probability(model, df: DataFrame, features: Sequence[str], *out: str) -> DataFrame:
    """Add class probabilities: one name takes class 1, several take class 0, 1, ..."""
    if hasattr(model, "score_into"):  # a forest given as a node table
        return model.score_into(df, features, *out)
    rows = assemble(df, features, "_x")
    if isinstance(model, OneAgainstRest):
        parts = [f"_q{k}" for k in range(len(model.models))]
        for part, one in zip(parts, model.models):
            rows = _class_probabilities(one, rows, part)
        total = sum((F.col(part)[1] for part in parts[1:]), F.col(parts[0])[1])
        rows = rows.withColumn("_q", F.array(*[F.col(part)[1] / total for part in parts])).drop(*parts)
    else:
        rows = _class_probabilities(model, rows, "_q")
    first = 1 if len(out) == 1 else 0
    return rows.withColumns({name: F.col("_q")[first + i] for i, name in enumerate(out)}).drop("_x", "_q")


def tune_regressor(
    df: DataFrame, features: Sequence[str], label: str, keys: Sequence[str], grid: dict | None = None,
    folds: int = 3, parallelism: int = 4, seed: int = 42,
):
    """Grid search by mean absolute error; returns (best model, its mean error).

    Folds come from a hash of the row keys, so a recomputed partition keeps its folds.
    """
    grid = grid or CARD_GRID
    estimator = GBTRegressor(labelCol=label, seed=seed)
    settings = (
        ParamGridBuilder()
        .addGrid(estimator.maxIter, grid["trees"])
        .addGrid(estimator.stepSize, grid["step"])
        .addGrid(estimator.maxDepth, grid["depth"])
        .build()
    )
    search = CrossValidator(
        estimator=estimator,
        estimatorParamMaps=settings,
        evaluator=RegressionEvaluator(labelCol=label, metricName="mae"),
        numFolds=folds,
        foldCol="_fold",
        parallelism=parallelism,
    )
    fold = (c.stable_hash(seed, *keys) % folds).cast("int")
    fitted = search.fit(training_rows(df, features, F.col(label).cast("double").alias(label), fold.alias("_fold")))
    return fitted.bestModel, float(min(fitted.avgMetrics))


def feature_importances(model, features: Sequence[str], df: DataFrame) -> DataFrame:
    """(Feature, Importance), largest first; the mean over the classes. ``df`` only lends its session."""
    several = model.models if isinstance(model, OneAgainstRest) else (model,)
    means = sum(m.featureImportances.toArray() for m in several) / len(several)
    values = [(name, float(x)) for name, x in zip(features, means)]
    board = df.sparkSession.createDataFrame(values, "Feature string, Importance double")
    return board.orderBy(F.desc("Importance"), "Feature")
