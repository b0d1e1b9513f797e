"""Team features: form, season aggregates, standings, discipline, pressure, referees."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from matchlake.functions import columns as c
from matchlake.functions import ordered
from matchlake.operators import cleaning

TEAM = ["Season", "Team"]
STAT_COLUMNS = ["FTHG", "FTAG", "HS", "HST", "HC", "AS", "AST", "AC"]
CARD_COLUMNS = [
    "HomeTeamFouls",
    "AwayTeamFouls",
    "HomeTeamYellowCards",
    "AwayTeamYellowCards",
    "HomeTeamRedCards",
    "AwayTeamRedCards",
]
FINAL_POINTS_FEATURES = [
    "PartialPoints", "FTHG", "FTAG", "GD", "HS", "HST", "HC", "MatchesLeft", "RecentFormPPG",
]
CARD_FEATURES = ["Fouls", "YellowCards", "RedCards", "RecentFormPPG", "HighPressureFlag", "RefereeStrictness"]

# Measures of a side: name -> (column when at home, column when away).
POINTS = {"Points": ("HomeTeamPoints", "AwayTeamPoints")}
GOALS = {"GoalsFor": ("FTHG", "FTAG"), "GoalsAgainst": ("FTAG", "FTHG")}
CARDS = {
    "Fouls": ("HomeTeamFouls", "AwayTeamFouls"),
    "YellowCards": ("HomeTeamYellowCards", "AwayTeamYellowCards"),
    "RedCards": ("HomeTeamRedCards", "AwayTeamRedCards"),
}
RESULT = {**POINTS, **GOALS}
_ROW_KEYS = ["Season", "Date", "MatchWeek", "MatchId"]


def team_sides(matches: DataFrame, measures: Mapping[str, tuple[str, str]] = RESULT) -> DataFrame:
    """Two rows per match, one for each side, from a single scan."""
    kept = [k for k in _ROW_KEYS if k in matches.columns]

    def side(at_home: bool) -> Column:
        team, opponent = ("HomeTeam", "AwayTeam") if at_home else ("AwayTeam", "HomeTeam")
        values = [F.col(pair[0 if at_home else 1]).alias(name) for name, pair in measures.items()]
        return F.struct(
            F.col(team).alias("Team"), F.col(opponent).alias("Opponent"),
            F.lit(int(at_home)).alias("IsHome"), *values,
        )

    return matches.select(*kept, F.inline(F.array(side(True), side(False))))


def _keyed(sides: DataFrame, keys: Sequence[str] = TEAM) -> DataFrame:
    """Rows without a key belong to no group."""
    return sides.na.drop(subset=list(keys))


# -- form -------------------------------------------------------------------


def rolling_form(sides: DataFrame, n: int = 5, lag: int = 0, chunk_rows: int = ordered.CHUNK_ROWS) -> DataFrame:
    """Every side row with the mean points of the team's last ``n`` matches."""
    return ordered.rolling_mean(
        _keyed(sides), TEAM, "Date", "MatchId", {"RecentFormPPG": "Points"}, n, lag, chunk_rows
    )


def recent_form(sides: DataFrame, n: int = 5) -> DataFrame:
    newest = ordered.newest_rows(_keyed(sides.select(*TEAM, "Date", "MatchId", "Points")), TEAM, "Date", "MatchId", n)
    return newest.groupBy(*TEAM).agg(F.avg("Points").alias("RecentFormPPG"))


def recent_goals_and_form(sides: DataFrame, n: int = 5) -> DataFrame:
    """Goals scored, goals conceded and form over the same last ``n`` matches, in one pass."""
    needed = sides.select(*TEAM, "Date", "MatchId", "Points", "GoalsFor", "GoalsAgainst")
    newest = ordered.newest_rows(_keyed(needed), TEAM, "Date", "MatchId", n)
    return newest.groupBy(*TEAM).agg(
        F.avg("GoalsFor").alias("AvgGoalsScored"),
        F.avg("GoalsAgainst").alias("AvgGoalsConceded"),
        F.avg("Points").alias("RecentFormPPG"),
    )


def rolling_goals(sides: DataFrame, n: int = 5) -> DataFrame:
    return recent_goals_and_form(sides, n).drop("RecentFormPPG")


def rolling_goal_history(sides: DataFrame, n: int = 5, chunk_rows: int = ordered.CHUNK_ROWS) -> DataFrame:
    """The rolling series behind :func:`rolling_goals`, for every match."""
    measures = {"AvgGoalsScored": "GoalsFor", "AvgGoalsConceded": "GoalsAgainst"}
    return ordered.rolling_mean(_keyed(sides), TEAM, "Date", "MatchId", measures, n, 0, chunk_rows)


def goal_stats(matches: DataFrame, season: Column | str, n: int = 5) -> DataFrame:
    return recent_goals_and_form(team_sides(cleaning.season_slice(matches, season)), n)


# -- season aggregates and standings ----------------------------------------


def _season_sides(matches: DataFrame) -> DataFrame:
    """Sides with the goals and shots needed by the season aggregates."""
    matches = cleaning.ensure_columns(matches, STAT_COLUMNS)
    both = {name: (name, name) for name in STAT_COLUMNS}
    return _keyed(team_sides(matches, {**POINTS, **GOALS, **both}))


def _season_sums() -> dict[str, Column]:
    """Summed expressions by output name. FTHG and FTAG add up both roles."""
    home = F.col("IsHome") == 1
    return {
        "HomeTeamPoints": F.when(home, F.col("Points")),
        "AwayTeamPoints": F.when(~home, F.col("Points")),
        "FTHG": F.col("FTHG"),
        "FTAG": F.col("FTAG"),
        "HS": F.when(home, F.col("HS")),
        "HST": F.when(home, F.col("HST")),
        "HC": F.when(home, F.col("HC")),
        "AS": F.when(~home, F.col("AS")),
        "AST": F.when(~home, F.col("AST")),
        "AC": F.when(~home, F.col("AC")),
        "GoalsFor": F.col("GoalsFor"),
        "GoalsAgainst": F.col("GoalsAgainst"),
        "GamesPlayed": F.lit(1),
    }


def _derived(agg: DataFrame) -> DataFrame:
    return agg.withColumns(
        {
            "GD": F.col("FTHG") - F.col("FTAG"),
            "GoalDiff": F.col("GoalsFor") - F.col("GoalsAgainst"),
            "PartialPoints": F.col("HomeTeamPoints") + F.col("AwayTeamPoints"),
        }
    )


def season_aggregate(matches: DataFrame, cutoff_week: int | None = None) -> DataFrame:
    """Per (season, team) sums; ``GD`` is home-role minus away-role goals, ``GoalDiff`` the real one."""
    if cutoff_week is not None:
        matches = matches.filter(F.col("MatchWeek") <= cutoff_week)
    sums = [c.sum_or_zero(x).alias(name) for name, x in _season_sums().items()]
    return _derived(_season_sides(matches).groupBy(*TEAM).agg(*sums))


def cutoff_sweep(matches: DataFrame, last_cutoff: int | None = None) -> DataFrame:
    """:func:`season_aggregate` for every cutoff 1..last_cutoff in one job; the last week of each season by default.

    Weeks are summed first, so the running window sees one row per team and week.
    """
    picks = _season_sums()
    sides = _season_sides(matches)
    if last_cutoff is None:
        last = season_weeks(matches).withColumnRenamed("Weeks", "_last")
    else:
        sides = sides.filter(F.col("MatchWeek") <= last_cutoff)
        last = sides.select("Season").distinct().withColumn("_last", F.lit(last_cutoff))
    weekly = (
        sides
        .groupBy(*TEAM, "MatchWeek")
        .agg(*[c.sum_or_zero(x).alias(name) for name, x in picks.items()])
    )
    by_week = W.partitionBy(*TEAM).orderBy("MatchWeek")
    running = weekly.select(
        *TEAM,
        F.col("MatchWeek").alias("_from"),
        (F.lead("MatchWeek").over(by_week) - 1).alias("_to"),
        *[F.sum(name).over(by_week).alias(name) for name in picks],
    )
    running = running.join(last, "Season").withColumn("_to", F.coalesce("_to", "_last"))
    swept = running.withColumn("Cutoff", F.explode(F.sequence("_from", "_to"))).drop("_from", "_to", "_last")
    return _derived(swept)


def season_weeks(matches: DataFrame) -> DataFrame:
    """Last match week of each season: at most one row per season."""
    return matches.groupBy("Season").agg(F.max("MatchWeek").alias("Weeks"))


def season_games(matches: DataFrame) -> DataFrame:
    """Games of each team in each season."""
    return _keyed(team_sides(matches, {})).groupBy(*TEAM).agg(F.count(F.lit(1)).alias("Games"))


def final_points_training(
    matches: DataFrame, past: DataFrame, season: Column | str, cutoff_week: int = 34, season_length: int | None = None
) -> DataFrame:
    """Rows of past seasons at the cutoff. A team's games left are counted in ``matches``, unless a length is given."""
    history = cleaning.training_slice(matches, season, cutoff_week)
    final = past.select(
        c.normalize_season("Season").alias("Season"),
        F.col("SquadName").alias("Team"),
        F.col("Pts").alias("FinalPoints"),
    )
    games = season_games(matches)
    if season_length is not None:
        games = games.withColumn("Games", F.lit(season_length))
    left = F.greatest(F.col("Games") - F.col("GamesPlayed"), F.lit(0))
    joined = (
        season_aggregate(history)
        .join(final, TEAM)
        .join(games, TEAM)
        .withColumn("MatchesLeft", left)
        .drop("Games")
        .withColumn("RemainingPoints", F.col("FinalPoints") - F.col("PartialPoints"))
        .withColumn("RemainingPPG", c.ratio("RemainingPoints", "MatchesLeft"))
        .join(recent_form(team_sides(history, POINTS)), TEAM, "left")
        .na.fill(0, subset=["RecentFormPPG"])
    )
    return joined.filter(F.col("RemainingPPG").isNotNull())


def fixtures_left(remaining: DataFrame, season: Column | str) -> DataFrame:
    sides = team_sides(cleaning.season_slice(remaining, season), {})
    return sides.na.drop(subset=["Team"]).groupBy("Team").agg(F.count(F.lit(1)).alias("MatchesLeft"))


def partial_features(
    matches: DataFrame, remaining: DataFrame, season: Column | str, cutoff_week: int | None = None
) -> DataFrame:
    """Current-season features. The whole season so far is used unless a cutoff is given."""
    current = cleaning.season_slice(matches, season)
    if cutoff_week is not None:
        current = current.filter(F.col("MatchWeek") <= cutoff_week)
    return (
        season_aggregate(current)
        .join(fixtures_left(remaining, season), "Team", "left")
        .join(recent_form(team_sides(current, POINTS)).drop("Season"), "Team", "left")
        .na.fill(0, subset=["MatchesLeft", "RecentFormPPG"])
    )


def final_table(pred: DataFrame, points_per_game: str = "RemainingPPG") -> DataFrame:
    """Standings from predicted points per remaining game; equal points rank by team name.

    One row per team reaches the ranking window (the team list, not the match history).
    """
    most = F.col("MatchesLeft") * 3
    raw = F.round(F.col(points_per_game) * F.col("MatchesLeft"), 6)
    remaining = F.ceil(F.least(F.greatest(raw, F.lit(0.0)), most.cast("double"))).cast("long")
    table = pred.withColumn("PredictedRemaining", remaining).withColumns(
        {
            "PredictedFinalPoints": F.col("PartialPoints") + F.col("PredictedRemaining"),
            "MaxFinalPoints": F.col("PartialPoints") + most,
        }
    )
    order = W.partitionBy("Season").orderBy(F.desc("PredictedFinalPoints"), "Team")
    return (
        table.withColumn("Rank", F.row_number().over(order))
        .select(
            "Rank", "Team", "PartialPoints", "MatchesLeft", "RecentFormPPG",
            "PredictedRemaining", "PredictedFinalPoints", "MaxFinalPoints",
        )
        .orderBy("Rank")
    )


def champion(table: DataFrame) -> DataFrame:
    return table.orderBy("Rank").limit(1).select("Team", "PredictedFinalPoints")


# -- discipline, pressure, referees -----------------------------------------


def discipline_per_game(matches: DataFrame, season: Column | str) -> DataFrame:
    """Mean fouls and cards at home and away, added and halved."""
    current = cleaning.ensure_columns(cleaning.season_slice(matches, season), CARD_COLUMNS)
    home = F.col("IsHome") == 1
    means = []
    for name in CARDS:
        means += [F.avg(F.when(home, F.col(name))).alias(f"h{name}"), F.avg(F.when(~home, F.col(name))).alias(f"a{name}")]
    per_team = team_sides(current, CARDS).na.drop(subset=["Team"]).groupBy("Team").agg(*means)
    return per_team.select("Team", *[c.half_sum(f"h{n}", f"a{n}").alias(f"{n}PerGame") for n in CARDS])


def with_discipline_index(team_stats: DataFrame) -> DataFrame:
    index = c.discipline_index("FoulsPerGame", "YellowCardsPerGame", "RedCardsPerGame")
    return team_stats.withColumn("DisciplineIndex", index)


def pressure_flag(sides: DataFrame, k: int = 5) -> DataFrame:
    """1 for teams whose points place them in the first or last ``k``.

    A team is in the first k if its points reach the k-th largest total, in the last k
    if they stay below the (k+1)-th smallest; both bounds are top-k limits, not a
    ranking of all teams in one task.
    """
    totals = sides.na.drop(subset=["Team"]).groupBy("Team").agg(c.sum_or_zero("Points").alias("Points"))
    top = totals.orderBy(F.desc("Points")).limit(k)
    low = totals.orderBy("Points").limit(k + 1)
    top_bound = top.agg(F.min("Points")).scalar()
    low_bound = low.agg(F.when(F.count(F.lit(1)) > k, F.max("Points"))).scalar()
    # No (k+1)-th team means every team is within k of both ends.
    flag = (F.col("Points") >= top_bound) | low_bound.isNull() | (F.col("Points") < low_bound)
    return totals.select("Team", "Points", F.when(flag, 1).otherwise(0).alias("HighPressureFlag"))


_REFEREE_CARDS = ["HomeTeamYellowCards", "AwayTeamYellowCards", "HomeTeamRedCards", "AwayTeamRedCards"]


def referee_strictness(matches: DataFrame) -> DataFrame:
    per_referee = (
        matches.filter(F.col("Referee").isNotNull())
        .groupBy("Referee")
        .agg(*[F.avg(name).alias(name) for name in _REFEREE_CARDS])
    )
    return per_referee.select("Referee", c.mean_of_present(*_REFEREE_CARDS).alias("RefereeStrictness"))


def team_strictness(matches: DataFrame) -> DataFrame:
    """Mean referee strictness over a team's matches.

    Matches are counted per (team, referee) first: what is joined has one row per pair.
    """
    known = matches.na.drop(subset=["Referee", "HomeTeam", "AwayTeam"])
    pairs = (
        team_sides(known, {"Referee": ("Referee", "Referee")})
        .groupBy("Team", "Referee")
        .agg(F.count(F.lit(1)).alias("_games"))
    )
    weighted = pairs.join(referee_strictness(matches), "Referee", "left").filter(F.col("RefereeStrictness").isNotNull())
    total = F.sum(F.col("RefereeStrictness") * F.col("_games"))
    return weighted.groupBy("Team").agg((total / F.sum("_games")).alias("RefereeStrictness"))


OPPONENT_COLUMNS = ["Opponent1", "Opponent2", "Opponent3", "Opponent4"]


def next_opponents(fixtures_wide: DataFrame, season: Column | str) -> DataFrame:
    """One row per (team, slot); Opponent is null for an empty slot."""
    return cleaning.season_slice(fixtures_wide, season).unpivot("Team", OPPONENT_COLUMNS, "Slot", "Opponent")


def opponent_profile(fixtures_wide: DataFrame, team_stats: DataFrame, season: Column | str) -> DataFrame:
    """Mean fouls and cards per game of up to four next opponents; 0 when there is none."""
    stats = team_stats.select(
        F.col("Team").alias("Opponent"), "FoulsPerGame", "YellowCardsPerGame", "RedCardsPerGame"
    )
    mean = lambda name: F.coalesce(F.avg(name), F.lit(0.0))
    return (
        next_opponents(fixtures_wide, season)
        .join(stats, "Opponent", "left")
        .groupBy("Team")
        .agg(
            mean("FoulsPerGame").alias("OpponentFoulsPG"),
            mean("YellowCardsPerGame").alias("OpponentYellowsPG"),
            mean("RedCardsPerGame").alias("OpponentRedsPG"),
        )
    )


def opponent_pressure(fixtures_wide: DataFrame, flags: DataFrame, season: Column | str) -> DataFrame:
    rated = flags.select(F.col("Team").alias("Opponent"), "HighPressureFlag")
    known = F.when(F.col("Opponent").isNotNull(), F.coalesce(F.col("HighPressureFlag"), F.lit(0)))
    return (
        next_opponents(fixtures_wide, season)
        .join(rated, "Opponent", "left")
        .groupBy("Team")
        .agg(F.coalesce(F.avg(known), F.lit(0.0)).alias("OpponentPressure"))
    )


def tension_index(fixtures_wide: DataFrame, flags: DataFrame, season: Column | str) -> DataFrame:
    """Own flag plus the mean flag of the next opponents."""
    if not set(OPPONENT_COLUMNS) <= set(fixtures_wide.columns):
        none = flags.withColumn("OpponentPressure", F.lit(0.0))
    else:
        none = flags.join(opponent_pressure(fixtures_wide, flags, season), "Team", "left")
    total = F.col("HighPressureFlag") + F.col("OpponentPressure")
    return none.select("Team", "HighPressureFlag", "OpponentPressure", total.alias("TensionIndex"))


def psych_table(matches: DataFrame, season: Column | str, fixtures_wide: DataFrame) -> DataFrame:
    """Discipline, form, pressure, opponents and referees of each team of a season."""
    current = cleaning.ensure_columns(cleaning.season_slice(matches, season), CARD_COLUMNS)
    points = team_sides(current, POINTS)
    discipline = with_discipline_index(discipline_per_game(matches, season)).na.fill(0)
    base = discipline.join(recent_form(points).drop("Season"), "Team", "left").na.fill(0)
    flags = pressure_flag(points).drop("Points")
    tension = tension_index(fixtures_wide, flags, season)
    if set(OPPONENT_COLUMNS) <= set(fixtures_wide.columns):
        base = base.join(opponent_profile(fixtures_wide, discipline, season), "Team", "left")
    else:
        base = base.withColumns({n: F.lit(0.0) for n in ("OpponentFoulsPG", "OpponentYellowsPG", "OpponentRedsPG")})
    return (
        base.join(tension, "Team", "left")
        .join(team_strictness(current), "Team", "left")
        .select(
            "Team", "FoulsPerGame", "YellowCardsPerGame", "RedCardsPerGame", "DisciplineIndex", "RecentFormPPG",
            "HighPressureFlag", "OpponentFoulsPG", "OpponentYellowsPG", "OpponentRedsPG", "OpponentPressure",
            "TensionIndex", "RefereeStrictness",
        )
        .orderBy(F.desc("TensionIndex"), "Team")
    )


def team_stats_lookup(psych: DataFrame) -> DataFrame:
    """:func:`psych_table` under the names the card models use."""
    return psych.withColumnsRenamed(
        {
            "FoulsPerGame": "Fouls",
            "YellowCardsPerGame": "YellowCards",
            "RedCardsPerGame": "RedCards",
            "HighPressureFlag": "Pressure",
        }
    )


def discipline_training(
    matches: DataFrame, season: Column | str, cutoff_week: int = 34, season_length: int | None = None
) -> DataFrame:
    """Card rates per team over all past seasons, one row per team and past-season form.

    The weeks left after the cutoff are those of the season in ``matches``, unless a length is given.
    """
    history = cleaning.ensure_columns(cleaning.training_slice(matches, season, cutoff_week), CARD_COLUMNS)
    sides = team_sides(history, {**POINTS, **CARDS})
    home = F.col("IsHome") == 1
    means = []
    for name in CARDS:
        means += [F.avg(F.when(home, F.col(name))).alias(f"h{name}"), F.avg(F.when(~home, F.col(name))).alias(f"a{name}")]
    rates = (
        sides.na.drop(subset=["Team"])
        .groupBy("Team")
        .agg(*means)
        .select("Team", *[c.mean_of_present(f"h{n}", f"a{n}").alias(n) for n in CARDS])
    )
    last = season_weeks(matches)
    if season_length is not None:
        last = last.withColumn("Weeks", F.lit(season_length))
    weeks = F.greatest(F.col("Weeks") - cutoff_week, F.lit(0))
    return (
        rates.join(recent_form(sides), "Team", "left")
        .join(last, "Season", "left")
        .join(pressure_flag(sides).drop("Points"), "Team", "left")
        .join(team_strictness(history), "Team", "left")
        .withColumns(
            {
                "RemainingYellowCards": F.col("YellowCards") * weeks,
                "RemainingRedCards": F.col("RedCards") * weeks,
            }
        )
        .na.drop(subset=["Fouls", "YellowCards", "RedCards", "RecentFormPPG", "RemainingYellowCards", "RemainingRedCards"])
        .select("Season", "Team", *CARD_FEATURES, "RemainingYellowCards", "RemainingRedCards")
    )


def predicted_cards(team_pred: DataFrame) -> DataFrame:
    """Whole cards from the two regressors' output (columns ``yellow`` and ``red``)."""
    return team_pred.select(
        "Team",
        F.ceil("yellow").alias("PredictedYellowCards"),
        F.ceil("red").alias("PredictedRedCards"),
    ).orderBy(F.desc("PredictedYellowCards"), "Team")
