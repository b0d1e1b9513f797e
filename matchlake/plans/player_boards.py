"""Player leaderboards from trained models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchlake.operators import metrics, models, players

NAMES = ["Player", "Squad"]


def fit_player_goals(features: DataFrame, size: models.Size = models.PLAYER_GOALS):
    return models.fit_regressor(features, players.GOAL_FEATURES, "GoalsPer90", size)


def predicted_goals(model, features: DataFrame) -> DataFrame:
    filled = features.na.fill(0, subset=players.GOAL_FEATURES)
    scored = models.predict(model, filled, players.GOAL_FEATURES, "PredictedGoalsPer90")
    return scored.select(*NAMES, "GoalsPer90", "PredictedGoalsPer90").orderBy(F.desc("PredictedGoalsPer90"), *NAMES)


def trained_board(
    labelled: DataFrame, features: Sequence[str], label: str, prob: str, pred: str, test_share: float, size: models.Size
):
    """Train on one part of each class, report on the other, score everybody.

    Returns (model, leaderboard, one-row report of AUC, precision, recall, F1).
    """
    rows = models.checkpointed(metrics.stratified_split(labelled, label, NAMES, test_share))
    model = models.fit_binary(rows.filter("is_test = 0"), features, label, size)
    scored = models.predict_probability(model, rows, features, prob)
    scored = scored.withColumn(pred, F.when(F.col(prob) > 0.5, 1).otherwise(0))
    report = metrics.binary_report(scored.filter("is_test = 1"), label, prob)
    board = scored.drop("is_test").orderBy(F.desc(prob), *NAMES)
    return model, board, report


def star_board(features: DataFrame, size: models.Size = models.STAR):
    return trained_board(
        players.star_label(features), players.STAR_FEATURES, "is_star", "StarProb", "StarPrediction", 0.2, size
    )


def gk_board(features: DataFrame, size: models.Size = models.GOALKEEPER):
    return trained_board(
        players.gk_label(features), players.GK_FEATURES, "is_top_gk", "TopGK_Prob", "TopGK_Pred", 0.25, size
    )


def clutch_board(features: DataFrame, size: models.Size = models.CLUTCH):
    return trained_board(
        players.clutch_label(features), players.CLUTCH_FEATURES, "is_clutch", "ClutchScore", "ClutchPrediction", 0.2, size
    )
