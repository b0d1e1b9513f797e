"""Model outputs: shapes, ranges, repeatability."""

import pytest

from matchlake.catalog import QUERIES, SMALL, inputs
from matchlake.plans import matchday

SF = "/root/testdata/sf0.001"


def rows(spark, name):
    return QUERIES[name](spark, SF).collect()


def test_standings(spark):
    table = rows(spark, "M02_final_points_standings")
    assert [r.Rank for r in table] == list(range(1, len(table) + 1))
    assert all(r.PartialPoints <= r.PredictedFinalPoints <= r.MaxFinalPoints for r in table)


def test_outcome_probabilities_add_up(spark):
    got = rows(spark, "T26_fixture_outcome_probs")
    assert len(got) == inputs(spark, SF).fixtures.count()
    assert all(abs(r.HomeWinProb + r.DrawProb + r.AwayWinProb - 100) < 0.21 for r in got)


def test_forecast_has_one_row_per_known_fixture(spark):
    got = rows(spark, "T35_match_forecast")
    assert len(got) == len(rows(spark, "T30_fixture_over_features"))
    assert all(0 <= r.Over2_5_Prob <= 100 and r.Over2_5_Prediction in (0, 1) for r in got)
    assert all(abs(r.TotalExpectedCorners - r.ExpectedHomeCorners - r.ExpectedAwayCorners) < 1e-6 for r in got)


def test_boards(spark):
    board = rows(spark, "M12_star_board")
    assert len(board) == len(rows(spark, "P03_star_features"))
    assert all(0 <= r.StarProb <= 1 and r.StarPrediction == int(r.StarProb > 0.5) for r in board)


def test_same_seed_same_scores(spark):
    x = inputs(spark, SF)
    first, second = (matchday.fit_goals(x.matches, x.season, 200, SMALL) for _ in range(2))
    scored = [sorted(map(str, matchday.fixture_goals(m, x.fixtures, x.goal_stats).collect())) for m in (first, second)]
    assert scored[0] == scored[1]


@pytest.mark.parametrize("name", ["T22_predicted_cards", "M05_tune_regressor", "M11_feature_importances"])
def test_others_give_rows(spark, name):
    assert rows(spark, name)
