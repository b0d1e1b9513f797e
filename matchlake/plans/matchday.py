"""Forecasts per fixture: outcome, goals, over/under, corners."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchlake.operators import cleaning, forecasts, metrics, models, teams

SeasonLike = Column | str


def fit_outcome(matches: DataFrame, season: SeasonLike, cutoff_week: int = 34, size: models.Size = models.OUTCOME, as_of: bool = False):
    rows = outcome_rows(matches, season, cutoff_week, as_of)
    return models.fit_outcome(rows, forecasts.OUTCOME_FEATURES, "Label", "Weight", size)


def outcome_rows(matches: DataFrame, season: SeasonLike, cutoff_week: int = 34, as_of: bool = False) -> DataFrame:
    history = cleaning.training_slice(matches, season, cutoff_week)
    return forecasts.class_weights(forecasts.outcome_features(history, as_of=as_of))


def outcome_fit(model, rows: DataFrame) -> DataFrame:
    scored = models.predict_probability(model, rows, forecasts.OUTCOME_FEATURES, "p0", "p1", "p2")
    return metrics.multiclass_metrics(scored, "Label", ["p0", "p1", "p2"])


def fixture_outcome_probs(model, matches: DataFrame, remaining: DataFrame, season: SeasonLike) -> DataFrame:
    fixtures = cleaning.season_slice(remaining, season)
    form = teams.recent_form(teams.team_sides(cleaning.season_slice(matches, season), teams.POINTS))
    rows = forecasts.fixture_outcome_features(fixtures, form)
    scored = models.predict_probability(model, rows, forecasts.OUTCOME_FEATURES, "h", "d", "a")
    return scored.select(
        "Date", "HomeTeam", "AwayTeam",
        F.round(F.col("h") * 100, 1).alias("HomeWinProb"),
        F.round(F.col("d") * 100, 1).alias("DrawProb"),
        F.round(F.col("a") * 100, 1).alias("AwayWinProb"),
    ).orderBy(F.desc("HomeWinProb"), "Date", "HomeTeam", "AwayTeam")


def fit_goals(matches: DataFrame, season: SeasonLike, cutoff_week: int = 34, size: models.Size = models.GOALS):
    rows = forecasts.xg_training(cleaning.training_slice(matches, season, cutoff_week))
    return models.fit_regressor(rows, forecasts.GOAL_FEATURES, "xG", size)


def fixture_goals(model, fixtures: DataFrame, goal_stats: DataFrame) -> DataFrame:
    """Expected goals of both sides. Both scorings are narrow: no shuffle besides the lookups."""
    rows = forecasts.fixture_goal_features(fixtures, goal_stats)
    for side in ("Home", "Away"):
        rows = rows.withColumns({"xG": F.col(f"{side}XG"), "Form": F.col(f"{side}Form")})
        rows = models.predict(model, rows, forecasts.GOAL_FEATURES, f"_{side}")
        rows = rows.withColumn(f"Expected{side}Goals", F.round(f"_{side}", 2)).drop("xG", "Form", f"_{side}")
    return rows.drop("HomeXG", "HomeForm", "AwayXG", "AwayForm")


def fit_over(
    matches: DataFrame, season: SeasonLike, cutoff_week: int = 34, threshold: float = 2.5,
    size: models.Size = models.OVER, odds: tuple[str, str] = forecasts.ODDS,
):
    """Model trained on 80% of the past matches and its accuracy and log loss on the rest."""
    history = cleaning.training_slice(matches, season, cutoff_week)
    rows = metrics.random_split(forecasts.over_training(history, threshold, odds), ["MatchId"])
    features = forecasts.over_features(odds)
    model = models.fit_binary(rows.filter("is_test = 0"), features, "Over", size)
    held_out = models.predict_probability(model, rows.filter("is_test = 1"), features, "p")
    return model, metrics.classification_metrics(held_out, "Over", "p")


def fixture_over_probs(model, fixtures: DataFrame, goal_stats: DataFrame, odds: tuple[str, str] = forecasts.ODDS) -> DataFrame:
    rows = forecasts.fixture_over_features(fixtures, goal_stats, odds)
    features = forecasts.over_features(odds)
    scored = models.predict_probability(model, rows, features, "p")
    return scored.withColumns(
        {"Over2_5_Prob": F.round(F.col("p") * 100, 1), "Over2_5_Prediction": F.when(F.col("p") > 0.5, 1).otherwise(0)}
    ).drop("p", "xG_Home", "xG_Away", *features)


def fit_corners(matches: DataFrame, season: SeasonLike, cutoff_week: int = 34, size: models.Size = models.CORNERS):
    rows = forecasts.corner_training(cleaning.training_slice(matches, season, cutoff_week))
    return models.fit_regressor(rows, forecasts.CORNER_FEATURES, "Corners", size)


def fixture_corners(model, fixtures: DataFrame, corner_stats: DataFrame) -> DataFrame:
    rows = forecasts.fixture_corner_features(fixtures, corner_stats)
    for side in ("Home", "Away"):
        rows = rows.withColumns({"Corners": F.col(f"{side}Corners"), "RecentFormPPG": F.col(f"{side}CornerForm")})
        rows = models.predict(model, rows, forecasts.CORNER_FEATURES, f"_{side}")
        rows = rows.withColumn(f"Expected{side}Corners", F.round(f"_{side}", 1)).drop("Corners", "RecentFormPPG", f"_{side}")
    total = F.col("ExpectedHomeCorners") + F.col("ExpectedAwayCorners")
    return rows.withColumn("TotalExpectedCorners", total).drop(
        "HomeCorners", "HomeCornerForm", "AwayCorners", "AwayCornerForm"
    )


def match_forecast(goal_model, over_model, corner_model, matches: DataFrame, remaining: DataFrame, season: SeasonLike) -> DataFrame:
    """Goals, over/under and corners of every fixture of the season."""
    fixtures = cleaning.season_slice(remaining, season)
    stats = teams.goal_stats(matches, season)
    rows = fixture_goals(goal_model, fixtures, stats)
    rows = fixture_over_probs(over_model, rows, stats)
    rows = fixture_corners(corner_model, rows, forecasts.corner_stats(matches, season))
    return rows.select(
        "Date", "HomeTeam", "AwayTeam", "ExpectedHomeGoals", "ExpectedAwayGoals", "Over2_5_Prob",
        "Over2_5_Prediction", "ExpectedHomeCorners", "ExpectedAwayCorners", "TotalExpectedCorners",
    ).orderBy(F.desc("ExpectedHomeGoals"), "Date", "HomeTeam", "AwayTeam")
