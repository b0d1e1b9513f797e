"""What must hold for every plan, whatever the size of the data."""

import re

import pytest

from matchlake.catalog import QUERIES, inputs
from matchlake.comparison import COMPARISON_SQL
from matchlake.operators import teams

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(COMPARISON_SQL))
def test_no_python_no_all_pairs(spark, name):
    text = plan(QUERIES[name](spark, SF))
    for node in ("Python", "ArrowEval", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert node not in text, node


def test_season_filter_prunes_folders(spark):
    x = inputs(spark, SF)
    text = plan(teams.discipline_per_game(x.matches, "1999-2000"))
    assert re.search(r"PartitionFilters: \[[^\]]*Season#\d+ = 1999-2000", text)
    schema = re.search(r"ReadSchema: (\S+)", text).group(1)
    assert "HomeTeamFouls" in schema and "FTHG" not in schema and "Referee" not in schema


def test_recent_form_limits_groups_before_the_shuffle(spark):
    x = inputs(spark, SF)
    text = plan(teams.recent_form(teams.team_sides(x.matches, teams.POINTS)))
    assert "WindowGroupLimit" in text and "Partial" in text and text.count("Exchange hashpartitioning") == 1
