"""Final standings and card forecasts of a season."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchlake.operators import metrics, models, teams

SeasonLike = Column | str


def fit_final_points(
    matches: DataFrame, past: DataFrame, season: SeasonLike, cutoff_week: int = 34, season_length: int | None = None,
    size: models.Size = models.FINAL_POINTS,
):
    rows = teams.final_points_training(matches, past, season, cutoff_week, season_length)
    return models.fit_regressor(rows, teams.FINAL_POINTS_FEATURES, "RemainingPPG", size)


def final_points_fit(
    model, matches: DataFrame, past: DataFrame, season: SeasonLike, cutoff_week: int = 34, season_length: int | None = None
) -> DataFrame:
    """MAE and R2 of remaining points on the training rows."""
    rows = teams.final_points_training(matches, past, season, cutoff_week, season_length)
    scored = models.predict(model, rows, teams.FINAL_POINTS_FEATURES, "ppg")
    scored = scored.withColumn("points", F.col("ppg") * F.col("MatchesLeft"))
    return metrics.regression_metrics(scored, "RemainingPoints", "points")


def standings(model, matches: DataFrame, remaining: DataFrame, season: SeasonLike) -> DataFrame:
    rows = teams.partial_features(matches, remaining, season)
    scored = models.predict(model, rows, teams.FINAL_POINTS_FEATURES, "RemainingPPG")
    return teams.final_table(scored)


def form_standings(matches: DataFrame, remaining: DataFrame, season: SeasonLike) -> DataFrame:
    """Standings if every team keeps the points per game of its recent form."""
    return teams.final_table(teams.partial_features(matches, remaining, season), "RecentFormPPG")


def fit_cards(
    matches: DataFrame, season: SeasonLike, cutoff_week: int = 34, season_length: int | None = None,
    grid: dict | None = None, parallelism: int = 4,
):
    """Tuned regressors for yellow and red cards: ((model, error), (model, error))."""
    rows = teams.discipline_training(matches, season, cutoff_week, season_length)
    return tuple(
        models.tune_regressor(rows, teams.CARD_FEATURES, target, teams.TEAM, grid, parallelism=parallelism)
        for target in ("RemainingYellowCards", "RemainingRedCards")
    )


def card_forecast(yellow_model, red_model, psych: DataFrame) -> DataFrame:
    rows = psych.withColumnsRenamed(
        {"FoulsPerGame": "Fouls", "YellowCardsPerGame": "YellowCards", "RedCardsPerGame": "RedCards"}
    ).na.fill(0, subset=teams.CARD_FEATURES)
    rows = models.predict(yellow_model, rows, teams.CARD_FEATURES, "yellow")
    rows = models.predict(red_model, rows, teams.CARD_FEATURES, "red")
    return teams.predicted_cards(rows)
