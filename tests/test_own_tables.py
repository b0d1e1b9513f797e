"""Files as they are published: no match ids, dotted odds names, columns in any order."""

import pytest

from matchlake.operators import cleaning, forecasts, metrics, teams
from matchlake.sources import snapshots

HISTORY = """Season,Date,HomeTeam,AwayTeam,FullTimeHomeTeamGoals,FullTimeAwayTeamGoals,FullTimeResult,B365Over2.5Goals,B365Under2.5Goals
1999-00,15/08/99,A,B,2,0,H,1.5,2.5
1999-00,22/08/99,B,A,1,1,D,1.6,2.4
1999-00,29/08/99,A,C,0,3,A,1.7,2.3
2000-01,2000-08-20,C,A,2,2,D,1.8,2.2
"""
RESULTS = """AwayTeam, Season,HomeTeam,FTAG,FTHG,FTR,Date,Note
B,2000-01,C,0,1,H,2000-08-27T15:00:00,x
"""
GOALS = "FullTimeHomeTeamGoals int, FullTimeAwayTeamGoals int, FullTimeResult string, `B365Over2.5Goals` double, `B365Under2.5Goals` double"


@pytest.fixture
def matches(spark, tmp_path):
    (tmp_path / "history.csv").write_text(HISTORY)
    (tmp_path / "results.csv").write_text(RESULTS)
    keys = "Season string, Date string, HomeTeam string, AwayTeam string"
    history = snapshots.read_table(spark, str(tmp_path / "history.csv"), f"{keys}, {GOALS}")
    results = snapshots.read_table(spark, str(tmp_path / "results.csv"), f"{keys}, FTHG int, FTAG int, FTR string, Missing int")
    assert results.first().asDict() == {
        "Season": "2000-01", "Date": "2000-08-27T15:00:00", "HomeTeam": "C", "AwayTeam": "B", "FTHG": 1, "FTAG": 0, "FTR": "H", "Missing": None,
    }
    return cleaning.clean_matches(history, results.drop("Missing"))


def test_matches_get_an_id_and_plain_odds(matches):
    assert sorted(r.MatchId for r in matches.select("MatchId").collect())[0] == "1999-2000|1999-08-15|A|B"
    odds = matches.filter("HomeTeam = 'A' and AwayTeam = 'C'").first()
    assert (odds.OddsOver, odds.OddsUnder) == (1.7, 2.3)


def test_operators_over_such_tables(matches):
    sides = teams.team_sides(matches)
    form = {(r.Season, r.Team): r.RecentFormPPG for r in teams.recent_form(sides).collect()}
    assert form["1999-2000", "A"] == pytest.approx(4 / 3)
    assert teams.rolling_form(sides).count() == 10
    assert forecasts.outcome_features(matches).count() == 5
    assert forecasts.outcome_features(matches, as_of=True).count() == 5
    over = {r.MatchId: r for r in forecasts.over_training(matches).collect()}
    assert over["1999-2000|1999-08-29|A|C"].Over == 1 and over["1999-2000|1999-08-29|A|C"].OddsOver == 1.7
    assert metrics.random_split(matches, ["MatchId"], 1.0).filter("is_test = 1").count() == 5


def test_games_and_weeks_come_from_the_matches(matches):
    assert {(r.Season, r.Team): r.Games for r in teams.season_games(matches).collect()}["1999-2000", "A"] == 3
    assert {r.Season: r.Weeks for r in teams.season_weeks(matches).collect()} == {"1999-2000": 3, "2000-2001": 2}
    swept = teams.cutoff_sweep(matches).collect()
    assert max(r.Cutoff for r in swept if r.Season == "1999-2000") == 3
    assert {r.GamesPlayed for r in swept if r.Team == "A" and r.Cutoff == 3} == {3}


def test_small_share_of_rows(spark):
    rows = spark.range(20000)
    picked = metrics.random_split(rows, ["id"], 0.004).filter("is_test = 1").count()
    assert 40 < picked < 130
