"""Named queries over a folder of base tables: one per operator.

Each takes (spark, folder) and returns a DataFrame. Floating point columns are
rounded to six places so that results compare across engines.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from matchlake import fixtures
from matchlake.functions import columns as c
from matchlake.operators import cleaning, forecasts, forest, metrics, models, players, teams
from matchlake.plans import league, matchday, player_boards
from matchlake.session import shared_dir
from matchlake.sources import pages, snapshots

# Rows per piece of a cut history, small enough that the registered queries do cut.
PIECE_ROWS = 40
# Small models for the registered queries; the plans default to the full sizes.
SMALL = models.Size(5, 0.1, 3)
SMALL_GRID = {"trees": [3], "step": [0.05, 0.1], "depth": [3]}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
# Output names for columns whose source names need quoting.
PLAIN = {
    "PSxG/SoT": "PSxG_per_SoT",
    "Stp%": "Stp_pct",
    "#OPA/90": "OPA_per90",
    "Launch%": "Launch_pct",
    "Cmp%": "Cmp_pct",
    "90s": "Nineties",
}


class Inputs:
    """The derived tables of one folder.

    Source files and cleaned matches are stored as tables first, as nearly every query
    reads them: matches by season, so that a season filter prunes folders.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    @cached_property
    def tables(self) -> dict[str, DataFrame]:
        return fixtures.load(self.spark, self.sf_dir, self.folder("sources"))

    def raw(self, name: str) -> DataFrame:
        return self.tables[name]

    @cached_property
    def pages(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/pages.parquet")

    @cached_property
    def both(self) -> DataFrame:
        return cleaning.union_matches(self.raw("fx_league"), self.raw("fx_results"))

    def folder(self, name: str) -> str:
        """Place of a stored table, apart for every application and input folder."""
        app = self.spark.sparkContext.applicationId
        return f"{shared_dir(self.spark)}/matchlake/{app}/{self.sf_dir.strip('/').replace('/', '_')}/{name}"

    def stored(self, name: str, df: DataFrame) -> DataFrame:
        """Write a feature table once and go on from its files, without its lineage."""
        df.write.mode("overwrite").parquet(self.folder(name))
        return self.spark.read.parquet(self.folder(name))

    @cached_property
    def matches(self) -> DataFrame:
        path = self.folder("matches")
        snapshots.write_matches(cleaning.clean_matches(self.raw("fx_league"), self.raw("fx_results")), path)
        return self.spark.read.parquet(path)

    @cached_property
    def season(self) -> str:
        """The one value is read once, so that season filters prune folders at planning time."""
        return cleaning.latest_season(self.matches).first()["Season"]

    @cached_property
    def cutoff(self) -> int:
        """34 of 38 parts of the shortest past season: a week is a match date here, so seasons have many more weeks."""
        past = teams.season_weeks(self.matches).filter(F.col("Season") != self.season)
        return (past.agg(F.min("Weeks")).first()[0] or 0) * 34 // 38

    @cached_property
    def train(self) -> DataFrame:
        return cleaning.training_slice(self.matches, self.season, self.cutoff)

    @cached_property
    def current(self) -> DataFrame:
        return cleaning.season_slice(self.matches, self.season)

    @cached_property
    def remaining(self) -> DataFrame:
        return cleaning.clean_fixtures(self.raw("fx_remaining"))

    @cached_property
    def fixtures(self) -> DataFrame:
        return cleaning.season_slice(self.remaining, self.season)

    @cached_property
    def wide(self) -> DataFrame:
        return cleaning.with_season(self.raw("fx_remaining_wide"))

    @cached_property
    def past(self) -> DataFrame:
        return self.raw("fx_past")

    @cached_property
    def players(self) -> dict[str, DataFrame]:
        return fixtures.player_tables(self.stored("players", self.raw("fx_players")))

    @cached_property
    def merged(self) -> DataFrame:
        t = self.players
        others = [t["shooting"], t["passing"], t["possession"], t["gca"], t["misc"]]
        return players.merge_player_tables(t["standard"], others, t["gk"])

    @cached_property
    def star(self) -> DataFrame:
        return self.stored("star", players.star_features(self.merged))

    @cached_property
    def goals(self) -> DataFrame:
        return players.goal_features(self.players["standard"], self.players["shooting"], self.players["passing"])

    @cached_property
    def goalkeepers(self) -> DataFrame:
        return self.stored("goalkeepers", players.gk_features(self.players["gk"]))

    @cached_property
    def psych(self) -> DataFrame:
        # A table read from files has no order of its own.
        table = self.stored("psych", teams.psych_table(self.matches, self.season, self.wide))
        return table.orderBy(F.desc("TensionIndex"), "Team")

    @cached_property
    def clutch(self) -> DataFrame:
        return self.stored("clutch", players.clutch_features(self.players["standard"], self.players["misc"], self.psych))

    @cached_property
    def html(self) -> DataFrame:
        return pages.page_tables(self.raw("fx_html"))

    @cached_property
    def goal_stats(self) -> DataFrame:
        return teams.goal_stats(self.matches, self.season)

    @cached_property
    def current_form(self) -> DataFrame:
        return teams.recent_form(teams.team_sides(self.current, teams.POINTS))

    @cached_property
    def index(self) -> DataFrame:
        return self.stored("index", players.star_index(self.star)).orderBy(F.desc("StarScore"), "Player", "Squad")

    @cached_property
    def cards(self):
        return league.fit_cards(self.matches, self.season, self.cutoff, grid=SMALL_GRID)

    @cached_property
    def scored_stars(self) -> DataFrame:
        """Star labels with a fixed score in [0, 1) that has ties."""
        x = F.col("xGPer90") + F.col("xAPer90")
        return players.star_label(self.star).withColumn("score", F.floor(x / (1 + x) * 100) / 100)


_inputs: dict[tuple[str, str], Inputs] = {}


def inputs(spark: SparkSession, sf_dir: str) -> Inputs:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _inputs:
        _inputs[key] = Inputs(spark, sf_dir)
    return _inputs[key]


def _plain(df: DataFrame, places: int = 6) -> DataFrame:
    picked = []
    for field in df.schema.fields:
        col = F.col(f"`{field.name}`")
        if isinstance(field.dataType, DoubleType):
            col = F.round(col, places)
        picked.append(col.alias(PLAIN.get(field.name, field.name)))
    return df.select(*picked)


def query(name: str):
    def register(fn: Callable[[Inputs], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: _plain(fn(inputs(spark, sf_dir)))
        return fn

    return register


# -- sources ----------------------------------------------------------------

_STANDARD = "Player string, Squad string, Nation string, Age int, Born int, Pos string, `90s` double, Min string, Gls int, Ast int, Matches int"


@query("S01_read_table")
def _(x: Inputs):
    path = x.folder("standard_csv")
    x.players["standard"].write.mode("overwrite").option("header", True).option("encoding", "ISO-8859-1").csv(path)
    return snapshots.read_table(x.spark, path, _STANDARD)


@query("S02_latest_snapshot")
def _(x: Inputs):
    return snapshots.latest_snapshot(x.raw("fx_files"), ["stat"], "file_name").select("row_id", "stat", "snapshot_date")


@query("S03_write_dated")
def _(x: Inputs):
    path = x.folder("dated")
    snapshots.write_dated(x.players["passing"].filter("PrgP > 20"), path, "Passing", "Player", "2025-01-31")
    snapshots.write_dated(x.players["passing"], path, "Passing", "Player", "2025-02-01")
    return snapshots.read_dated(x.spark, path, "Passing")


@query("S04_extract_comments")
def _(x: Inputs):
    return pages.extract_comments(x.pages)


@query("S05_extract_table_cells")
def _(x: Inputs):
    return pages.extract_table_cells(x.html)


@query("S06_align_player_rows")
def _(x: Inputs):
    return pages.align_player_rows(x.html)


@query("S06_align_team_rows")
def _(x: Inputs):
    return pages.align_team_rows(x.html)


@query("S07_classify_tables")
def _(x: Inputs):
    return pages.classify_tables(x.html)


@query("S08_table_slug")
def _(x: Inputs):
    return pages.with_slug(x.html).select("page_id", "table_no", "slug")


# -- cleaning ---------------------------------------------------------------


@query("C01_standardize_columns")
def _(x: Inputs):
    renamed = cleaning.standardize_columns(x.raw("fx_league"))
    return renamed.select("MatchId", "FTHG", "FTAG", "FTR", "HS", F.col("AS").alias("AwayShots"), "HST", "AST", "HC", "AC")


@query("C02_normalize_season")
def _(x: Inputs):
    return x.raw("fx_matches").select("MatchId", c.normalize_season("Season").alias("Season"))


@query("C03_union_matches")
def _(x: Inputs):
    return x.both.select("MatchId", "Season", "Date", "HomeTeam", "AwayTeam", "FTHG", "FTAG", "FTR", "HC", "AC")


@query("C04_parse_dates")
def _(x: Inputs):
    return cleaning.parse_dates(x.both).select("MatchId", "Date")


@query("C05_latest_season")
def _(x: Inputs):
    return cleaning.latest_season(x.matches)


@query("C06_match_week")
def _(x: Inputs):
    return cleaning.match_week(cleaning.parse_dates(x.both)).select("MatchId", "Season", "MatchWeek")


@query("C07_add_match_points")
def _(x: Inputs):
    return cleaning.add_match_points(x.both).select("MatchId", "HomeTeamPoints", "AwayTeamPoints")


@query("C08_ensure_columns")
def _(x: Inputs):
    return cleaning.ensure_columns(x.raw("fx_remaining"), ["OddsOver", "HomeTeamFouls"]).select(
        "MatchId", "OddsOver", "HomeTeamFouls"
    )


@query("C09_coerce_numeric")
def _(x: Inputs):
    return cleaning.coerce_numeric(x.players["standard"], ["Min"]).select("Player", "Min")


@query("C10_first_present")
def _(x: Inputs):
    table = x.players["standard"]
    return table.select(
        "Player",
        cleaning.first_present(table, ["Minutes", "Min"]).alias("Minutes"),
        cleaning.first_present(table, ["xG", "xG_shoot"]).alias("xG"),
    )


@query("C11_complete_rows")
def _(x: Inputs):
    t = x.players
    rows = t["standard"].join(t["shooting"].select("Player", "Squad", "Sh", "xG"), ["Player", "Squad"], "left")
    rows = rows.join(t["gk"].select("Player", "Squad", "PSxG"), ["Player", "Squad"], "left")
    rates = cleaning.per90(rows, {"ShotsPer90": "Sh"})
    return cleaning.complete_rows(rates, ["ShotsPer90"], ["PSxG"]).select("Player", "ShotsPer90", "PSxG")


@query("C12_training_slice")
def _(x: Inputs):
    return x.train.select("MatchId", "Season", "MatchWeek")


@query("C13_per90")
def _(x: Inputs):
    rates = cleaning.per90(x.players["standard"], {"GoalsPer90": "Gls", "AssistsPer90": "Ast"})
    return rates.select("Player", "GoalsPer90", "AssistsPer90")


@query("C14_season_slice")
def _(x: Inputs):
    return x.current.select("MatchId", "Season", "HomeTeam", "AwayTeam")


# -- teams ------------------------------------------------------------------


@query("T01_team_sides")
def _(x: Inputs):
    return teams.team_sides(x.matches)


@query("T02_rolling_form")
def _(x: Inputs):
    return teams.rolling_form(teams.team_sides(x.matches, teams.POINTS), chunk_rows=PIECE_ROWS).select(
        "MatchId", "Season", "Team", "RecentFormPPG"
    )


@query("T03_recent_form")
def _(x: Inputs):
    return teams.recent_form(teams.team_sides(x.matches, teams.POINTS))


@query("T04_rolling_goals")
def _(x: Inputs):
    return teams.rolling_goals(teams.team_sides(x.matches))


@query("T04_rolling_goal_history")
def _(x: Inputs):
    return teams.rolling_goal_history(teams.team_sides(x.matches, teams.GOALS), chunk_rows=PIECE_ROWS).select(
        "MatchId", "Season", "Team", "AvgGoalsScored", "AvgGoalsConceded"
    )


@query("T05_goal_stats")
def _(x: Inputs):
    return x.goal_stats


def _aggregate_names(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed("AS", "AwayShots")


@query("T06_season_aggregate")
def _(x: Inputs):
    return _aggregate_names(teams.season_aggregate(x.matches))


@query("T07_final_points_training")
def _(x: Inputs):
    rows = teams.final_points_training(x.matches, x.past, x.season, x.cutoff)
    return rows.select("Season", "Team", *teams.FINAL_POINTS_FEATURES, "RemainingPoints", "RemainingPPG")


@query("T08_fixtures_left")
def _(x: Inputs):
    return teams.fixtures_left(x.remaining, x.season)


@query("T09_partial_features")
def _(x: Inputs):
    return _aggregate_names(teams.partial_features(x.matches, x.remaining, x.season))


@query("T10_final_table")
def _(x: Inputs):
    return league.form_standings(x.matches, x.remaining, x.season)


@query("T11_champion")
def _(x: Inputs):
    return teams.champion(league.form_standings(x.matches, x.remaining, x.season))


@query("T12_cutoff_sweep")
def _(x: Inputs):
    return _aggregate_names(teams.cutoff_sweep(x.matches))


@query("T13_discipline_per_game")
def _(x: Inputs):
    return teams.discipline_per_game(x.matches, x.season)


@query("T14_discipline_index")
def _(x: Inputs):
    return teams.with_discipline_index(teams.discipline_per_game(x.matches, x.season)).select("Team", "DisciplineIndex")


@query("T15_pressure_flag")
def _(x: Inputs):
    return teams.pressure_flag(teams.team_sides(x.current, teams.POINTS))


@query("T16_referee_strictness")
def _(x: Inputs):
    return teams.referee_strictness(x.matches)


@query("T17_team_strictness")
def _(x: Inputs):
    return teams.team_strictness(x.matches)


@query("T18_opponent_profile")
def _(x: Inputs):
    return teams.opponent_profile(x.wide, teams.discipline_per_game(x.matches, x.season), x.season)


@query("T19_tension_index")
def _(x: Inputs):
    flags = teams.pressure_flag(teams.team_sides(x.current, teams.POINTS)).drop("Points")
    return teams.tension_index(x.wide, flags, x.season)


@query("T20_psych_table")
def _(x: Inputs):
    return x.psych


@query("T20_team_stats_lookup")
def _(x: Inputs):
    return teams.team_stats_lookup(x.psych).select("Team", "Fouls", "YellowCards", "RedCards", "Pressure", "RecentFormPPG")


@query("T21_discipline_training")
def _(x: Inputs):
    return teams.discipline_training(x.matches, x.season, x.cutoff)


@query("T22_predicted_cards")
def _(x: Inputs):
    (yellow, _), (red, _) = x.cards
    return league.card_forecast(yellow, red, x.psych)


@query("T23_outcome_features")
def _(x: Inputs):
    return forecasts.outcome_features(x.train)


@query("T23_outcome_features_as_of")
def _(x: Inputs):
    return forecasts.outcome_features(x.train, as_of=True)


@query("T24_class_weights")
def _(x: Inputs):
    return forecasts.class_weights(x.train.select("MatchId", "FTR"))


@query("T25_fixture_outcome_features")
def _(x: Inputs):
    return forecasts.fixture_outcome_features(x.fixtures, x.current_form)


@query("T26_fixture_outcome_probs")
def _(x: Inputs):
    model = matchday.fit_outcome(x.matches, x.season, x.cutoff, size=SMALL)
    return matchday.fixture_outcome_probs(model, x.matches, x.remaining, x.season)


@query("T27_xg_training")
def _(x: Inputs):
    return forecasts.xg_training(x.train)


@query("T28_fixture_goal_features")
def _(x: Inputs):
    rows = forecasts.fixture_goal_features(x.fixtures, x.goal_stats)
    return rows.select("MatchId", "HomeXG", "HomeForm", "AwayXG", "AwayForm")


@query("T28_fixture_goals")
def _(x: Inputs):
    model = matchday.fit_goals(x.matches, x.season, x.cutoff, size=SMALL)
    return matchday.fixture_goals(model, x.fixtures, x.goal_stats)


@query("T29_over_training")
def _(x: Inputs):
    return forecasts.over_training(x.train)


@query("T30_fixture_over_features")
def _(x: Inputs):
    rows = forecasts.fixture_over_features(x.fixtures, x.goal_stats)
    return rows.select("MatchId", "xG_Home", "xG_Away", *forecasts.over_features())


@query("T31_fixture_over_probs")
def _(x: Inputs):
    model, _ = matchday.fit_over(x.matches, x.season, x.cutoff, size=SMALL)
    return matchday.fixture_over_probs(model, x.fixtures, x.goal_stats)


@query("T32_corner_training")
def _(x: Inputs):
    return forecasts.corner_training(x.train)


@query("T33_corner_stats")
def _(x: Inputs):
    return forecasts.corner_stats(x.matches, x.season)


@query("T34_fixture_corner_features")
def _(x: Inputs):
    rows = forecasts.fixture_corner_features(x.fixtures, forecasts.corner_stats(x.matches, x.season))
    return rows.select("MatchId", "HomeCorners", "HomeCornerForm", "AwayCorners", "AwayCornerForm")


@query("T34_fixture_corners")
def _(x: Inputs):
    model = matchday.fit_corners(x.matches, x.season, x.cutoff, size=SMALL)
    return matchday.fixture_corners(model, x.fixtures, forecasts.corner_stats(x.matches, x.season))


@query("T35_match_forecast")
def _(x: Inputs):
    goal = matchday.fit_goals(x.matches, x.season, x.cutoff, size=SMALL)
    over, _ = matchday.fit_over(x.matches, x.season, x.cutoff, size=SMALL)
    corner = matchday.fit_corners(x.matches, x.season, x.cutoff, size=SMALL)
    return matchday.match_forecast(goal, over, corner, x.matches, x.remaining, x.season)


# -- the same forecasts on a given forest (fx_forest), so that values compare ----


def _given(x: Inputs, parts: int, features: list[str], kind: str) -> forest.Given:
    nodes = x.raw("fx_forest").where(F.col("part") < parts).select(
        "part", "tree", "weight", "node", F.when(F.col("slot") >= 0, F.col("slot") % len(features)).otherwise(-1).alias("feature"),
        "split", F.col("left_node").alias("left"), F.col("right_node").alias("right"), "leaf", "gain", F.col("cnt").alias("count"),
    )
    return forest.Given(nodes, kind)


@query("T26_fixture_outcome_probs_given")
def _(x: Inputs):
    return matchday.fixture_outcome_probs(_given(x, 3, forecasts.OUTCOME_FEATURES, "classes"), x.matches, x.remaining, x.season)


@query("T28_fixture_goals_given")
def _(x: Inputs):
    goals = matchday.fixture_goals(_given(x, 1, forecasts.GOAL_FEATURES, "regression"), x.fixtures, x.goal_stats)
    return goals.select("MatchId", "ExpectedHomeGoals", "ExpectedAwayGoals")


@query("T31_fixture_over_probs_given")
def _(x: Inputs):
    over = matchday.fixture_over_probs(_given(x, 1, forecasts.over_features(), "binary"), x.fixtures, x.goal_stats)
    return over.select("MatchId", "Over2_5_Prob", "Over2_5_Prediction")


@query("T34_fixture_corners_given")
def _(x: Inputs):
    stats = forecasts.corner_stats(x.matches, x.season)
    corners = matchday.fixture_corners(_given(x, 1, forecasts.CORNER_FEATURES, "regression"), x.fixtures, stats)
    return corners.select("MatchId", "ExpectedHomeCorners", "ExpectedAwayCorners", "TotalExpectedCorners")


@query("M11_feature_importances_given")
def _(x: Inputs):
    board = forest.importances(_given(x, 3, forecasts.OUTCOME_FEATURES, "classes").table, forecasts.OUTCOME_FEATURES)
    return board.select("Feature", F.round("Importance", 6).alias("Importance"))


# -- players ----------------------------------------------------------------


@query("P01_merge_player_tables")
def _(x: Inputs):
    return x.merged.select(
        "Player", "Squad", "90s", "Min", "Gls", "Ast", "Sh", "xG", "xA", "KP", "Touches", "GCA", "SCA", "CrdY", "CrdR",
        "Fls", "PSxG", "`PSxG/SoT`", "`Stp%`", "AvgDist",
    )


@query("P02_goal_features")
def _(x: Inputs):
    return x.goals


@query("P03_star_features")
def _(x: Inputs):
    return x.star


@query("P04_min_max_scale")
def _(x: Inputs):
    return metrics.min_max_scale(x.star, ["GoalsPer90", "KP", "Touches"]).select("Player", "GoalsPer90", "KP", "Touches")


@query("P05_star_index")
def _(x: Inputs):
    return x.index.select(
        "Player", "Squad", "StarScore", "GoalsPer90", "AssistsPer90", "xGPer90", "xAPer90", "KP", "GCA90", "Touches",
        "CrdYPer90", "CrdRPer90",
    )


@query("P06_star_summary")
def _(x: Inputs):
    return players.star_summary(x.index)


@query("P07_star_index_fit")
def _(x: Inputs):
    return players.star_index_fit(x.index)


@query("P08_star_label")
def _(x: Inputs):
    return players.star_label(x.star).select("Player", "Squad", "GA_per90", "is_star")


@query("P09_gk_features")
def _(x: Inputs):
    return x.goalkeepers


@query("P10_gk_label")
def _(x: Inputs):
    return players.gk_label(x.goalkeepers).select("Player", "Squad", "GoalsPrevented", "is_top_gk")


@query("P11_clutch_features")
def _(x: Inputs):
    return x.clutch


@query("P12_clutch_label")
def _(x: Inputs):
    return players.clutch_label(x.clutch).select("Player", "Squad", "GA_Per90_HP", "is_clutch")


@query("P13_top_k")
def _(x: Inputs):
    return players.top_k(x.index, "StarScore").select("Player", "Squad", "StarScore")


# -- metrics and models -----------------------------------------------------


@query("M01_standard_scale")
def _(x: Inputs):
    return metrics.standard_scale(x.star, ["GoalsPer90", "KP", "Touches"]).select("Player", "GoalsPer90", "KP", "Touches")


@query("M02_final_points_standings")
def _(x: Inputs):
    model = league.fit_final_points(x.matches, x.past, x.season, x.cutoff, size=SMALL)
    return league.standings(model, x.matches, x.remaining, x.season)


@query("M02_final_points_fit")
def _(x: Inputs):
    model = league.fit_final_points(x.matches, x.past, x.season, x.cutoff, size=SMALL)
    return league.final_points_fit(model, x.matches, x.past, x.season, x.cutoff)


@query("M02_player_goals")
def _(x: Inputs):
    return player_boards.predicted_goals(player_boards.fit_player_goals(x.goals, SMALL), x.goals)


@query("M03_over_holdout")
def _(x: Inputs):
    return matchday.fit_over(x.matches, x.season, x.cutoff, size=SMALL)[1]


@query("M04_outcome_fit")
def _(x: Inputs):
    rows = matchday.outcome_rows(x.matches, x.season, x.cutoff)
    model = models.fit_outcome(rows, forecasts.OUTCOME_FEATURES, "Label", "Weight", SMALL)
    return matchday.outcome_fit(model, rows)


@query("M05_tune_regressor")
def _(x: Inputs):
    (_, yellow), (_, red) = x.cards
    return x.spark.createDataFrame([("yellow", yellow), ("red", red)], "Target string, BestMAE double")


@query("M06_regression_metrics")
def _(x: Inputs):
    return metrics.regression_metrics(x.goals, "GoalsPer90", "xGPer90")


@query("M07_classification_metrics")
def _(x: Inputs):
    return metrics.classification_metrics(x.scored_stars, "is_star", "score")


@query("M08_binary_report")
def _(x: Inputs):
    return metrics.binary_report(x.scored_stars, "is_star", "score")


@query("M09_random_split")
def _(x: Inputs):
    return metrics.random_split(x.matches, ["MatchId"]).select("MatchId", "is_test")


@query("M10_stratified_split")
def _(x: Inputs):
    # The split reads its rows more than once.
    labelled = x.stored("star_labels", players.star_label(x.star).select("Player", "Squad", "is_star"))
    return metrics.stratified_split(labelled, "is_star", ["Player", "Squad"]).select("Player", "Squad", "is_star", "is_test")


@query("M11_feature_importances")
def _(x: Inputs):
    model = matchday.fit_outcome(x.matches, x.season, x.cutoff, size=SMALL)
    return models.feature_importances(model, forecasts.OUTCOME_FEATURES, x.matches)


@query("M12_star_board")
def _(x: Inputs):
    board = player_boards.star_board(x.star, SMALL)[1]
    return board.select("Player", "Squad", "StarProb", "StarPrediction", *players.STAR_FEATURES[:5])


@query("M12_gk_board")
def _(x: Inputs):
    board = player_boards.gk_board(x.goalkeepers, SMALL)[1]
    return board.select(
        "Player", "Squad", "GA", "PSxG", "GoalsPrevented", "TopGK_Prob", "TopGK_Pred", *[f"`{n}`" for n in players.GK_FEATURES]
    )


@query("M12_clutch_board")
def _(x: Inputs):
    board = player_boards.clutch_board(x.clutch, SMALL)[1]
    return board.select("Player", "Squad", "ClutchScore", "ClutchPrediction", *players.CLUTCH_FEATURES[:6])


@query("M12_board_report")
def _(x: Inputs):
    return player_boards.star_board(x.star, SMALL)[2]


# -- fits, checked ----------------------------------------------------------
# What must hold for any fitted model, as rows that the tables alone determine.


def _within(*names: str, low: float = 0, high: float = 1):
    valid = F.lit(True)
    for name in names:
        valid = valid & F.col(name).between(low, high)
    return valid


def _checked(df: DataFrame, valid) -> DataFrame:
    """One row: how many rows there are, and for how many ``valid`` holds."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count(F.when(valid, 1)).alias("n_valid"))


@query("T22_predicted_cards_given")
def _(x: Inputs):
    """The cards of given predictions: a share of the rates instead of a model's output."""
    given = x.psych.select("Team", (F.col("FoulsPerGame") / 4).alias("yellow"), (F.col("RedCardsPerGame") * 7).alias("red"))
    return teams.predicted_cards(given)


@query("M02_final_points_checks")
def _(x: Inputs):
    rows = teams.final_points_training(x.matches, x.past, x.season, x.cutoff)
    model = league.fit_final_points(x.matches, x.past, x.season, x.cutoff, size=SMALL)
    scored = models.predict(model, rows, teams.FINAL_POINTS_FEATURES, "ppg").withColumn("mean", rows.agg(F.avg("RemainingPPG")).scalar())
    off = lambda name: F.avg(F.abs(F.col(name) - F.col("RemainingPPG")))
    return scored.agg(F.count("ppg").alias("n_rows"), (off("ppg") <= off("mean")).alias("no_worse_than_mean"))


@query("M04_outcome_checks")
def _(x: Inputs):
    rows = matchday.outcome_rows(x.matches, x.season, x.cutoff)
    model = models.fit_outcome(rows, forecasts.OUTCOME_FEATURES, "Label", "Weight", SMALL)
    scored = models.predict_probability(model, rows, forecasts.OUTCOME_FEATURES, "h", "d", "a")
    return _checked(scored, _within("h", "d", "a") & (F.abs(F.col("h") + F.col("d") + F.col("a") - 1) < 1e-9))


@query("T26_fixture_outcome_checks")
def _(x: Inputs):
    model = matchday.fit_outcome(x.matches, x.season, x.cutoff, size=SMALL)
    probs = matchday.fixture_outcome_probs(model, x.matches, x.remaining, x.season)
    names = ["HomeWinProb", "DrawProb", "AwayWinProb"]
    whole = F.abs(sum((F.col(n) for n in names[1:]), F.col(names[0])) - 100) < 0.2
    return _checked(probs, _within(*names, high=100) & whole)


@query("T31_fixture_over_checks")
def _(x: Inputs):
    model, _ = matchday.fit_over(x.matches, x.season, x.cutoff, size=SMALL)
    probs = matchday.fixture_over_probs(model, x.fixtures, x.goal_stats)
    said = (F.col("Over2_5_Prob") > 50.05) == (F.col("Over2_5_Prediction") == 1)
    return _checked(probs, _within("Over2_5_Prob", high=100) & (said | F.col("Over2_5_Prob").between(49.95, 50.05)))


@query("T35_match_forecast_checks")
def _(x: Inputs):
    forecast = QUERIES["T35_match_forecast"](x.spark, x.sf_dir)
    total = F.abs(F.col("ExpectedHomeCorners") + F.col("ExpectedAwayCorners") - F.col("TotalExpectedCorners")) < 0.051
    goals = F.col("ExpectedHomeGoals").isNotNull() & F.col("ExpectedAwayGoals").isNotNull()
    return _checked(forecast, goals & total & _within("Over2_5_Prob", high=100))


@query("M12_board_checks")
def _(x: Inputs):
    boards = [
        ("star", player_boards.star_board(x.star, SMALL)[1], "StarProb", "StarPrediction"),
        ("goalkeeper", player_boards.gk_board(x.goalkeepers, SMALL)[1], "TopGK_Prob", "TopGK_Pred"),
        ("clutch", player_boards.clutch_board(x.clutch, SMALL)[1], "ClutchScore", "ClutchPrediction"),
    ]
    rows = [
        _checked(board, _within(prob) & ((F.col(prob) > 0.5) == (F.col(said) == 1))).withColumn("board", F.lit(name))
        for name, board, prob, said in boards
    ]
    return rows[0].union(rows[1]).union(rows[2])


@query("M12_goalkeeper_report")
def _(x: Inputs):
    return player_boards.gk_board(x.goalkeepers, SMALL)[2]


@query("M12_clutch_report")
def _(x: Inputs):
    return player_boards.clutch_board(x.clutch, SMALL)[2]


@query("M02_player_goals_fit")
def _(x: Inputs):
    scored = player_boards.predicted_goals(player_boards.fit_player_goals(x.goals, SMALL), x.goals)
    return metrics.regression_metrics(scored, "GoalsPer90", "PredictedGoalsPer90")


@query("M02_player_goals_full")
def _(x: Inputs):
    return player_boards.predicted_goals(player_boards.fit_player_goals(x.goals), x.goals)


@query("M12_star_board_full")
def _(x: Inputs):
    return player_boards.star_board(x.star)[1].select("Player", "Squad", "StarProb", "StarPrediction")
