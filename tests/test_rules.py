"""Hand-made cases for the rules that differ from a naive reading."""

import datetime
import math

import pytest
from pyspark.sql import functions as F

from matchlake.functions import columns as c
from matchlake.operators import cleaning, forecasts, metrics, players, teams
from matchlake.sources import snapshots

MATCH = (
    "MatchId long, Season string, Date date, MatchWeek int, HomeTeam string, AwayTeam string, FTR string, FTHG int, FTAG int,"
    "HomeTeamPoints int, AwayTeamPoints int, HomeTeamFouls int, AwayTeamFouls int, HomeTeamYellowCards int,"
    "AwayTeamYellowCards int, HomeTeamRedCards int, AwayTeamRedCards int, Referee string"
)


def match(i, home, away, result="H", season="2000-2001", day=None, cards=(10, 12, 1, 2, 0, 0), referee="R1", goals=(2, 1)):
    points = {"H": (3, 0), "D": (1, 1), "A": (0, 3)}.get(result, (0, 0))
    date = datetime.date(2000, 8, 1) + datetime.timedelta(days=i if day is None else day)
    return (i, season, date, i, home, away, result, *goals, *points, *cards, referee)


def column(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(fn(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    "raw,want",
    [("1999-00", "1999-2000"), (" 2024-25 ", "2024-2025"), ("2024-2025", "2024-2025"), ("2024", "2024"), ("a-b-c", "a-b-c"), (None, None)],
)
def test_season(spark, raw, want):
    assert column(spark, raw, c.normalize_season) == want


@pytest.mark.parametrize(
    "raw,want",
    [("2001-02-03", datetime.date(2001, 2, 3)), ("03/02/2001", datetime.date(2001, 2, 3)), ("03/02/01", datetime.date(2001, 2, 3)),
     ("TBC", None), ("31/31/2001", None), (None, None), ("15/08/93", datetime.date(1993, 8, 15)), ("01/01/68", datetime.date(2068, 1, 1)),
     ("2020-08-01T15:00:00", datetime.date(2020, 8, 1)), ("2020-08-01 15:00", datetime.date(2020, 8, 1)), ("15 Aug 2020", datetime.date(2020, 8, 15)),
     ("15/08/2020 19:45", datetime.date(2020, 8, 15))],
)
def test_mixed_dates(spark, raw, want):
    assert column(spark, raw, c.parse_date) == want


@pytest.mark.parametrize("raw,want", [("2,345", 2345.0), ("12", 12.0), (" 1.5 ", 1.5), ("1e3", 1000.0), ("1.0d", None), ("x", None), ("", None), ("NaN", None)])
def test_numbers(spark, raw, want):
    assert column(spark, raw, c.to_number) == want


def test_null_season_is_never_latest(spark):
    df = spark.createDataFrame([("2000-2001",), (None,)], "Season string")
    assert cleaning.latest_season(df).first()["Season"] == "2000-2001"


def test_points_fall_back_to_long_name_and_other_results_score_nothing(spark):
    df = cleaning.add_match_points(spark.createDataFrame([("H",), ("D",), (None,), ("X",)], "FullTimeResult string"))
    assert [(r.HomeTeamPoints, r.AwayTeamPoints) for r in df.collect()] == [(3, 0), (1, 1), (0, 0), (0, 0)]


def test_complete_rows(spark):
    df = spark.createDataFrame([(1.0, None), (float("inf"), 1.0), (None, 1.0), (2.0, float("nan"))], "a double, b double")
    assert [tuple(r) for r in cleaning.complete_rows(df, ["a"], ["b"]).collect()] == [(1.0, 0.0), (2.0, 0.0)]


def test_single_venue_team_has_half_its_rate_in_the_table_but_not_in_training(spark):
    rows = [match(1, "A", "B"), match(2, "A", "C", season="1999-2000")]
    df = spark.createDataFrame(rows, MATCH)
    table = {r.Team: r.FoulsPerGame for r in teams.discipline_per_game(df, "2000-2001").collect()}
    assert table == {"A": 5.0, "B": 6.0}
    trained = {r.Team: r.Fouls for r in teams.discipline_training(df, "2000-2001", 34).collect()}
    assert trained == {"A": 10.0, "C": 12.0}


def test_pressure_ties_and_few_teams(spark):
    def flags(points):
        sides = spark.createDataFrame([(f"t{i:02}", p) for i, p in enumerate(points)], "Team string, Points int")
        return [r.HighPressureFlag for r in teams.pressure_flag(sides).orderBy("Team").collect()]

    def plain(points):
        ranks = [1 + sum(q > p for q in points) for p in points]
        return [int(r <= 5 or r > len(points) - 5) for r in ranks]

    for points in ([9, 8, 7, 6, 5, 5, 5, 4, 3, 2, 1, 1, 0], [1] * 12, [3, 2, 1], list(range(20)), [5] * 6 + [0] * 7):
        assert flags(points) == plain(points), points


def test_referees(spark):
    rows = [
        match(1, "A", "B", cards=(1, 1, 2, 4, 0, 2), referee="R1"),
        match(2, "B", "A", cards=(1, 1, None, None, 1, 3), referee="R2"),
        match(3, "A", "B", cards=(1, 1, 9, 9, 9, 9), referee=None),
    ]
    df = spark.createDataFrame(rows, MATCH)
    assert {r.Referee: r.RefereeStrictness for r in teams.referee_strictness(df).collect()} == {"R1": 2.0, "R2": 2.0}
    assert {r.Team: r.RefereeStrictness for r in teams.team_strictness(df).collect()} == {"A": 2.0, "B": 2.0}


def test_opponents(spark):
    wide = spark.createDataFrame(
        [("2000-2001", "A", "B", "C", None, None), ("2000-2001", "B", None, None, None, None), ("2000-2001", "C", "Z", None, None, None)],
        "Season string, Team string, Opponent1 string, Opponent2 string, Opponent3 string, Opponent4 string",
    )
    flags = spark.createDataFrame([("A", 1), ("B", 1), ("C", 0), ("D", 1)], "Team string, HighPressureFlag int")
    tension = {r.Team: (r.OpponentPressure, r.TensionIndex) for r in teams.tension_index(wide, flags, "2000-2001").collect()}
    assert tension == {"A": (0.5, 1.5), "B": (0.0, 1.0), "C": (0.0, 0.0), "D": (None, None)}
    bare = teams.tension_index(wide.select("Season", "Team"), flags, "2000-2001").collect()
    assert {r.Team: r.TensionIndex for r in bare} == {"A": 1.0, "B": 1.0, "C": 0.0, "D": 1.0}


def test_final_table_orders_ties_by_name_and_clips(spark):
    pred = spark.createDataFrame(
        [("s", "B", 10, 2, 1.0, 9.0), ("s", "A", 10, 2, 1.0, 9.0), ("s", "C", 12, 2, 1.0, -1.0), ("s", "D", 1, 0, 0.0, 2.0)],
        "Season string, Team string, PartialPoints long, MatchesLeft long, RecentFormPPG double, RemainingPPG double",
    )
    got = [(r.Rank, r.Team, r.PredictedRemaining, r.MaxFinalPoints) for r in teams.final_table(pred).collect()]
    assert got == [(1, "A", 6, 16), (2, "B", 6, 16), (3, "C", 0, 18), (4, "D", 0, 1)]


def test_season_pressure_counts_points_before_the_match(spark):
    rows = [match(i, "A", f"x{i}") for i in range(1, 24)]
    df = cleaning.ensure_columns(spark.createDataFrame(rows, MATCH), ["HalfTimeHomeTeamGoals", "HalfTimeAwayTeamGoals", "HC", "AC"])
    got = {r.MatchId: r.HomePressure for r in forecasts.outcome_features(df).collect()}
    assert [i for i, flag in sorted(got.items()) if flag] == [22, 23]  # 63 points after match 21


def test_unknown_teams_get_defaults(spark):
    fixtures = spark.createDataFrame([(1, "2000-2001", None, "A", "B")], "MatchId long, Season string, Date date, HomeTeam string, AwayTeam string")
    stats = spark.createDataFrame([], "Season string, Team string, AvgGoalsScored double, AvgGoalsConceded double, RecentFormPPG double")
    row = forecasts.fixture_goal_features(fixtures, stats).first()
    assert (row.HomeXG, row.AwayXG, row.HomeForm, row.AwayForm) == (1.3, 1.1, 1.3, 1.3)
    assert forecasts.fixture_over_features(fixtures, stats).count() == 0
    corner = forecasts.fixture_corner_features(fixtures, spark.createDataFrame([], "Team string, Corners double, RecentFormPPG double")).first()
    assert (corner.HomeCorners, corner.AwayCornerForm) == (5.0, 1.3)


def test_odds_stay_with_their_fixture_or_default(spark):
    stats = spark.createDataFrame([("A", 1.0, 2.0, 1.5), ("B", 3.0, 0.5, 1.0)], "Team string, AvgGoalsScored double, AvgGoalsConceded double, RecentFormPPG double")
    fixtures = spark.createDataFrame([(1, "Q", "B", 9.0, 9.5), (2, "A", "B", 2.1, 1.7)], "MatchId long, HomeTeam string, AwayTeam string, OddsOver double, OddsUnder double")
    row = forecasts.fixture_over_features(fixtures, stats).collect()
    assert [(r.MatchId, r.OddsOver, r.xG_Gap, r.RecentFormGap) for r in row] == [(2, 2.1, 0.5, 0.5)]
    bare = forecasts.fixture_over_features(fixtures.drop("OddsOver", "OddsUnder"), stats).first()
    assert (bare.OddsOver, bare.OddsUnder) == (2.5, 1.6)


def test_constant_columns_scale_to_zero(spark):
    df = spark.createDataFrame([(1.0, 4.0), (3.0, 4.0)], "a double, b double")
    assert [tuple(r) for r in metrics.min_max_scale(df, ["a", "b"]).collect()] == [(0.0, 0.0), (1.0, 0.0)]
    assert [tuple(r) for r in metrics.standard_scale(df, ["a", "b"]).collect()] == [(-1.0, 0.0), (1.0, 0.0)]


def test_clutch_drops_teams_without_pressure(spark):
    std = spark.createDataFrame([("p", "A", "2", "1", "10", "11"), ("q", "B", "2", "1", "10", "11"), ("r", "C", "2", "1", "10", "11")],
                                "Player string, Squad string, Gls string, Ast string, `90s` string, Matches string")
    misc = spark.createDataFrame([(x, s, "4", "1", "0", "10", "11") for x, s in (("p", "A"), ("q", "B"), ("r", "C"))],
                                 "Player string, Squad string, Fls string, CrdY string, CrdR string, `90s` string, Matches string")
    psych = spark.createDataFrame([("A", 1), ("B", 0)], "Team string, HighPressureFlag int")
    got = {r.Player: (round(r.GoalsPer90_HP, 6), round(r.PressureFlagCount, 6)) for r in players.clutch_features(std, misc, psych).collect()}
    assert got == {"p": (0.2, 1.0), "r": (0.2, 3.8)}


def test_missing_keys_match_in_player_merge(spark):
    keys = "Player string, Squad string, Nation string, Age int, Born int, Pos string, `90s` double"
    std = spark.createDataFrame([("p", "A", None, 20, 2000, "FW", 10.0, 3)], keys + ", Gls int")
    shoot = spark.createDataFrame([("p", "A", None, 20, 2000, "FW", 10.0, 7, 99)], keys + ", Sh int, Gls int")
    row = players.merge_player_tables(std, [shoot, None]).first()
    assert (row.Sh, row.Gls) == (7.0, 3.0)


def test_snapshots(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "x int, y string")
    path = str(tmp_path / "runs")
    snapshots.write_dated(df, path, "Passing", "Player", "2025-01-01")
    snapshots.write_dated(df.filter("x = 2"), path, "Passing", "Player", "2025-02-01")
    snapshots.write_dated(df, path, "Passing", "Squad", "2025-03-01")
    assert [tuple(r) for r in snapshots.read_dated(spark, path, "Passing").collect()] == [(2, "b")]
    snapshots.write_dated(df.filter("x = 1"), path, "Passing", "Player", "2025-02-01")
    assert [tuple(r) for r in snapshots.read_dated(spark, path, "Passing").collect()] == [(1, "a")]


def test_latest_csv_by_listing(spark, tmp_path):
    folder = tmp_path / "Passing"
    folder.mkdir()
    for name, text in {
        "Player_Passing_2025-01-01.csv": "old", "Player_Passing_2025-02-01.csv": "M\xfcller", "Squad_Passing_2025-03-01.csv": "squad",
        "Player_Passing_undated.csv": "none",
    }.items():
        (folder / name).write_bytes(f" Player \n{text}\n".encode("latin-1"))
    got = snapshots.read_latest(spark, str(folder), "` Player ` string")
    assert got.columns == ["Player"] and [r.Player for r in got.collect()] == ["M\xfcller"]
    assert snapshots.read_latest(spark, str(folder), "Player string", "Other") is None


def test_season_may_be_a_lazy_scalar(spark):
    df = spark.createDataFrame([match(1, "A", "B"), match(2, "A", "C", season="1999-2000"), match(3, "B", "A", "D")], MATCH)
    lazy = cleaning.latest_season(df).scalar()
    assert sorted(teams.goal_stats(df, lazy).collect()) == sorted(teams.goal_stats(df, "2000-2001").collect())
    assert [r.MatchId for r in cleaning.training_slice(df, lazy).collect()] == [2]


def test_cutoff_sweep_agrees_with_each_cutoff(spark):
    df = spark.createDataFrame([match(1, "A", "B"), match(3, "B", "A", "D"), match(4, "A", "C", "A")], MATCH)
    swept = teams.cutoff_sweep(df, 6)
    for cutoff in range(1, 7):
        want = teams.season_aggregate(df, cutoff).select("Team", "PartialPoints", "GD", "GamesPlayed")
        got = swept.filter(F.col("Cutoff") == cutoff).select("Team", "PartialPoints", "GD", "GamesPlayed")
        assert sorted(got.collect()) == sorted(want.collect())


def test_training_metrics(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 3.0), (5.0, 4.0)], "y double, p double")
    assert tuple(metrics.regression_metrics(df, "y", "p").first()) == pytest.approx((2 / 3, 1 - 2 / 8))
    probs = spark.createDataFrame([(0, 0.7, 0.2, 0.1), (2, 0.5, 0.3, 0.2)], "k int, a double, b double, c double")
    row = metrics.multiclass_metrics(probs, "k", ["a", "b", "c"]).first()
    assert tuple(row) == pytest.approx((0.5, -(math.log(0.7) + math.log(0.2)) / 2))
