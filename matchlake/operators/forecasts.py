"""Features for the match models: training rows from history, the same rows for fixtures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from matchlake.functions import columns as c
from matchlake.operators import cleaning
from matchlake.operators.teams import POINTS, TEAM, recent_form, recent_goals_and_form, rolling_form, team_sides

# Fixed values used where a team or a match statistic is unknown.
DEFAULT_FORM = 1.3
DEFAULT_HOME_GOALS = 1.3
DEFAULT_AWAY_GOALS = 1.1
DEFAULT_CORNERS = 5.0
DEFAULT_SHOTS = 10.0
DEFAULT_ODDS_OVER = 2.5
DEFAULT_ODDS_UNDER = 1.6
FIXTURE_STATS = {
    "HomeFouls": 10.0,
    "AwayFouls": 10.0,
    "HomeYellows": 1.5,
    "AwayYellows": 1.5,
    "HomeGoals": 1.6,
    "AwayGoals": 1.1,
    "HomeHTGoals": 0.8,
    "AwayHTGoals": 0.6,
    "HomeCorners": 5.5,
    "AwayCorners": 4.2,
}

OUTCOME_FEATURES = [
    "HomeForm", "AwayForm", "HomeFouls", "AwayFouls", "HomeYellows", "AwayYellows",
    "HomePressure", "AwayPressure", "FormDiff", "FoulsDiff", "YellowsDiff", "PressureDiff",
    "HomeGoals", "AwayGoals", "GoalDiff", "HTGoalDiff", "CornerDiff",
]
GOAL_FEATURES = ["xG", "Form"]
CORNER_FEATURES = ["Corners", "RecentFormPPG"]
ODDS = ("OddsOver", "OddsUnder")


def over_features(odds: tuple[str, str] = ODDS) -> list[str]:
    return [
        "AvgShotsPerGame", "AvgShotsOnTargetPerGame", "AvgCornersPerGame", *odds, "RecentFormGap", "xG_Gap",
    ]


def _look_up(df: DataFrame, table: DataFrame, keys: list[str], sides: tuple[str, ...] = ("Home", "Away"), how: str = "left") -> DataFrame:
    """Join ``table`` (one row per key) once per side; its columns get the side as prefix.

    The table has one row per (season, team), so adaptive execution broadcasts it when it
    is small and otherwise joins by key with skew splitting.
    """
    values = [n for n in table.columns if n not in keys]
    for side in sides:
        renamed = table.select(
            *[F.col(k).alias(f"{side}Team" if k == "Team" else k) for k in keys],
            *[F.col(v).alias(f"{side}_{v}") for v in values],
        )
        df = df.join(renamed, [f"{side}Team" if k == "Team" else k for k in keys], how)
    return df


# -- outcome ----------------------------------------------------------------


def pressure_start(sides: DataFrame, threshold: int = 60) -> DataFrame:
    """First match after which a team's season points exceed ``threshold``.

    Only matches with points count and each brings at least one, so the first
    threshold + 1 of them are enough: a bounded number of rows per team.
    """
    scoring = sides.na.drop(subset=TEAM).filter(F.col("Points") > 0)
    by_time = W.partitionBy(*TEAM).orderBy("Date", "MatchId")
    first = (
        scoring.select(*TEAM, "Date", "MatchId", "Points")
        .withColumn("_rn", F.row_number().over(by_time))
        .filter(F.col("_rn") <= threshold + 1)
    )
    reached = first.withColumn("_sum", F.sum("Points").over(by_time)).filter(F.col("_sum") > threshold)
    return reached.groupBy(*TEAM).agg(F.min(F.struct("Date", "MatchId")).alias("Start"))


def outcome_features(
    matches: DataFrame, form: DataFrame | None = None, as_of: bool = False, threshold: int = 60
) -> DataFrame:
    """17 features per match. Pressure: season points before the match above ``threshold``.

    By default a team's form is its last value in the given matches; ``as_of=True`` uses
    the form before each match instead.
    """
    matches = cleaning.ensure_columns(
        matches,
        ["HomeTeamFouls", "AwayTeamFouls", "HomeTeamYellowCards", "AwayTeamYellowCards", "FTHG", "FTAG",
         "HalfTimeHomeTeamGoals", "HalfTimeAwayTeamGoals", "HC", "AC"],
    )
    sides = team_sides(matches, POINTS)
    starts = pressure_start(sides, threshold)
    if as_of:
        # The rolling series is brought back to one row per match before the join.
        at = lambda side, flag: F.max(F.when(F.col("IsHome") == flag, F.col("RecentFormPPG"))).alias(f"{side}_RecentFormPPG")
        before = rolling_form(sides, lag=1).groupBy("MatchId").agg(at("Home", 1), at("Away", 0))
        rows = _look_up(matches.join(before, "MatchId", "left"), starts, TEAM)
    else:
        form = recent_form(sides) if form is None else form
        rows = _look_up(matches, form.join(starts, TEAM, "left"), TEAM)
    here = F.struct("Date", "MatchId")
    pressure = lambda side: F.when(here > F.col(f"{side}_Start"), 1).otherwise(0)
    rows = rows.select(
        "MatchId", "Season", "Date", "HomeTeam", "AwayTeam", "FTR",
        F.coalesce("Home_RecentFormPPG", F.lit(DEFAULT_FORM)).alias("HomeForm"),
        F.coalesce("Away_RecentFormPPG", F.lit(DEFAULT_FORM)).alias("AwayForm"),
        F.col("HomeTeamFouls").alias("HomeFouls"),
        F.col("AwayTeamFouls").alias("AwayFouls"),
        F.col("HomeTeamYellowCards").alias("HomeYellows"),
        F.col("AwayTeamYellowCards").alias("AwayYellows"),
        pressure("Home").alias("HomePressure"),
        pressure("Away").alias("AwayPressure"),
        F.col("FTHG").alias("HomeGoals"),
        F.col("FTAG").alias("AwayGoals"),
        (F.col("HalfTimeHomeTeamGoals") - F.col("HalfTimeAwayTeamGoals")).alias("HTGoalDiff"),
        (F.col("HC") - F.col("AC")).alias("CornerDiff"),
    )
    return _differences(rows).select("MatchId", "Season", "FTR", *OUTCOME_FEATURES)


def _differences(rows: DataFrame) -> DataFrame:
    pairs = {"FormDiff": "Form", "FoulsDiff": "Fouls", "YellowsDiff": "Yellows", "PressureDiff": "Pressure", "GoalDiff": "Goals"}
    return rows.withColumns({out: F.col(f"Home{m}") - F.col(f"Away{m}") for out, m in pairs.items()})


def outcome_label(result: Column | str = "FTR") -> Column:
    result = F.col(result) if isinstance(result, str) else result
    return F.when(result == "H", 0).when(result == "D", 1).when(result == "A", 2)


def class_weights(rows: DataFrame, result: str = "FTR") -> DataFrame:
    """Add Label and Weight = 1 / share of the class; rows without a label weigh 1."""
    labelled = rows.withColumn("Label", outcome_label(result))
    counts = labelled.agg(
        F.struct(
            F.count("Label").alias("n"),
            *[F.count(F.when(F.col("Label") == k, 1)).alias(f"n{k}") for k in range(3)],
        ).alias("s")
    ).scalar()
    weight = F.lit(1.0)
    for k in range(3):
        weight = F.when(F.col("Label") == k, c.ratio("_s.n", f"_s.n{k}")).otherwise(weight)
    return labelled.withColumn("_s", counts).withColumn("Weight", weight).drop("_s")


def fixture_outcome_features(remaining: DataFrame, form: DataFrame) -> DataFrame:
    """The 17 features for fixtures: known form, fixed values for match statistics."""
    rows = _look_up(remaining, form, TEAM).withColumns(
        {
            "HomeForm": F.coalesce("Home_RecentFormPPG", F.lit(DEFAULT_FORM)),
            "AwayForm": F.coalesce("Away_RecentFormPPG", F.lit(DEFAULT_FORM)),
            **{name: F.lit(value) for name, value in FIXTURE_STATS.items()},
        }
    )
    rows = rows.withColumns(
        {
            "HomePressure": F.when(F.col("HomeForm") > 1.6, 1).otherwise(0),
            "AwayPressure": F.when(F.col("AwayForm") > 1.6, 1).otherwise(0),
            "HTGoalDiff": F.col("HomeHTGoals") - F.col("AwayHTGoals"),
            "CornerDiff": F.col("HomeCorners") - F.col("AwayCorners"),
        }
    )
    return _differences(rows).select("MatchId", "Date", "HomeTeam", "AwayTeam", *OUTCOME_FEATURES)


# -- goals ------------------------------------------------------------------


def xg_training(matches: DataFrame, n: int = 5) -> DataFrame:
    """Rows for the goals model, from a training slice. The target equals the feature xG."""
    rows = recent_goals_and_form(team_sides(matches), n).na.drop()
    return rows.withColumnsRenamed({"AvgGoalsScored": "xG", "RecentFormPPG": "Form"})


def fixture_goal_features(remaining: DataFrame, goal_stats: DataFrame) -> DataFrame:
    stats = goal_stats.select("Team", "AvgGoalsScored", "RecentFormPPG")
    return _look_up(remaining, stats, ["Team"]).withColumns(
        {
            "HomeXG": F.coalesce("Home_AvgGoalsScored", F.lit(DEFAULT_HOME_GOALS)),
            "HomeForm": F.coalesce("Home_RecentFormPPG", F.lit(DEFAULT_FORM)),
            "AwayXG": F.coalesce("Away_AvgGoalsScored", F.lit(DEFAULT_AWAY_GOALS)),
            "AwayForm": F.coalesce("Away_RecentFormPPG", F.lit(DEFAULT_FORM)),
        }
    ).drop("Home_AvgGoalsScored", "Home_RecentFormPPG", "Away_AvgGoalsScored", "Away_RecentFormPPG")


# -- over / under -----------------------------------------------------------


def over_training(matches: DataFrame, threshold: float = 2.5, odds: tuple[str, str] = ODDS) -> DataFrame:
    """Features and label of the over/under model from a training slice.

    ``xG_Gap`` is the match's own goal difference and ``RecentFormGap`` is 0 here, while
    fixtures carry rolling gaps; the difference is part of the model's definition.
    """
    stats = ["FTHG", "FTAG", "HS", "AS", "HST", "AST", "HC", "AC", *odds]
    rows = cleaning.ensure_columns(matches, stats)
    half = lambda a, b: (F.col(a) + F.col(b)) / 2
    rows = rows.withColumns(
        {
            "TotalGoals": F.col("FTHG") + F.col("FTAG"),
            "AvgShotsPerGame": half("HS", "AS"),
            "AvgShotsOnTargetPerGame": half("HST", "AST"),
            "AvgCornersPerGame": half("HC", "AC"),
            "RecentFormGap": F.lit(0.0),
            "xG_Gap": (F.col("FTHG") - F.col("FTAG")).cast("double"),
        }
    )
    over = F.when(F.col("TotalGoals") > threshold, 1).otherwise(0)
    features = over_features(odds)
    return rows.select("MatchId", *features, over.alias("Over")).na.fill(0, subset=features)


def fixture_over_features(fixtures: DataFrame, goal_stats: DataFrame, odds: tuple[str, str] = ODDS) -> DataFrame:
    """Fixtures with both teams known; away expectation is what the away team concedes."""
    stats = goal_stats.select("Team", "AvgGoalsScored", "AvgGoalsConceded", "RecentFormPPG")
    rows = _look_up(fixtures, stats, ["Team"], how="inner")
    for name, default in zip(odds, (DEFAULT_ODDS_OVER, DEFAULT_ODDS_UNDER)):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(default))
    expected = {
        f"Expected{m}_{side}": DEFAULT_SHOTS if "Shots" in m else DEFAULT_CORNERS
        for m in ("Shots", "ShotsOnTarget", "Corners")
        for side in ("Home", "Away")
    }
    rows = rows.withColumns({n: F.lit(v) for n, v in expected.items() if n not in rows.columns})
    half = lambda m: (F.col(f"Expected{m}_Home") + F.col(f"Expected{m}_Away")) / 2
    rows = rows.withColumns(
        {
            "xG_Home": F.col("Home_AvgGoalsScored"),
            "xG_Away": F.col("Away_AvgGoalsConceded"),
            "AvgShotsPerGame": half("Shots"),
            "AvgShotsOnTargetPerGame": half("ShotsOnTarget"),
            "AvgCornersPerGame": half("Corners"),
            "RecentFormGap": F.col("Home_RecentFormPPG") - F.col("Away_RecentFormPPG"),
        }
    ).withColumn("xG_Gap", F.col("xG_Home") - F.col("xG_Away"))
    features = over_features(odds)
    kept = [n for n in fixtures.columns if n not in features]
    return rows.select(*kept, "xG_Home", "xG_Away", *features).na.fill(0, subset=features)


# -- corners ----------------------------------------------------------------


def _corner_means(matches: DataFrame) -> DataFrame:
    rows = cleaning.ensure_columns(matches, ["HC", "AC"])
    sides = team_sides(rows, {"Own": ("HC", "AC")}).na.drop(subset=["Team"])
    home = F.col("IsHome") == 1
    return sides.groupBy("Team").agg(
        F.avg(F.when(home, F.col("Own"))).alias("HomeCorners"), F.avg(F.when(~home, F.col("Own"))).alias("AwayCorners")
    )


def corner_training(matches: DataFrame) -> DataFrame:
    """Mean of home and away corner rates per team, one row per team and season form."""
    rates = _corner_means(matches).select("Team", c.mean_of_present("HomeCorners", "AwayCorners").alias("Corners"))
    form = recent_form(team_sides(matches, POINTS))
    return rates.join(form, "Team", "left").na.drop().select("Season", "Team", "Corners", "RecentFormPPG")


def corner_stats(matches: DataFrame, season: Column | str) -> DataFrame:
    """Corner rates over all seasons (a missing venue counts 0) with the form of one season."""
    rates = _corner_means(matches).na.fill(0)
    form = recent_form(team_sides(cleaning.season_slice(matches, season), POINTS)).drop("Season")
    corners = (F.col("HomeCorners") + F.col("AwayCorners")) / 2
    return (
        rates.withColumn("Corners", corners)
        .join(form, "Team", "left")
        .na.fill(0, subset=["RecentFormPPG"])
        .select("Team", "HomeCorners", "AwayCorners", "Corners", "RecentFormPPG")
    )


def fixture_corner_features(fixtures: DataFrame, stats: DataFrame) -> DataFrame:
    stats = stats.select("Team", "Corners", "RecentFormPPG")
    return _look_up(fixtures, stats, ["Team"]).withColumns(
        {
            "HomeCorners": F.coalesce("Home_Corners", F.lit(DEFAULT_CORNERS)),
            "HomeCornerForm": F.coalesce("Home_RecentFormPPG", F.lit(DEFAULT_FORM)),
            "AwayCorners": F.coalesce("Away_Corners", F.lit(DEFAULT_CORNERS)),
            "AwayCornerForm": F.coalesce("Away_RecentFormPPG", F.lit(DEFAULT_FORM)),
        }
    ).drop("Home_Corners", "Home_RecentFormPPG", "Away_Corners", "Away_RecentFormPPG")
