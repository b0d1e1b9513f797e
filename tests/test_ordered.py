"""Split windows, quantiles, ranks and splits against plain single-machine answers."""

import datetime
import random

import numpy as np
import pandas as pd
import pytest

from matchlake.functions import ordered
from matchlake.operators import metrics


@pytest.fixture(scope="module")
def history(spark):
    """A third of all rows belongs to one team, and half of these to one day."""
    rng = random.Random(7)
    rows, day0 = [], datetime.date(2001, 1, 1)
    for i in range(300):
        team = "hot" if i % 3 == 0 else f"t{i % 7}"
        day = day0 if team == "hot" and i % 2 == 0 else day0 + datetime.timedelta(days=rng.randrange(-20, 40))
        rows.append(("s1", team, day, i * 17 % 1009, rng.choice([0, 1, 3])))
    return spark.createDataFrame(rows, "Season string, Team string, Date date, MatchId long, Points int")


def plain(history, n, lag):
    pdf = history.toPandas().sort_values(["Season", "Team", "Date", "MatchId"])
    shifted = pdf.groupby(["Season", "Team"])["Points"].shift(lag) if lag else pdf["Points"]
    pdf["want"] = shifted.groupby([pdf["Season"], pdf["Team"]]).transform(lambda x: x.rolling(n, min_periods=1).mean())
    return {(r.Team, r.MatchId): None if pd.isna(r.want) else round(r.want, 9) for r in pdf.itertuples()}


@pytest.mark.parametrize("chunk_rows", [1, 3, 10, 1_000_000])
@pytest.mark.parametrize("n,lag", [(5, 0), (3, 1), (1, 0)])
def test_rolling_mean_in_chunks(history, chunk_rows, n, lag):
    got = ordered.rolling_mean(
        history, ["Season", "Team"], "Date", "MatchId", {"form": "Points"}, n, lag, chunk_rows
    ).collect()
    assert {(r.Team, r.MatchId): None if r.form is None else round(r.form, 9) for r in got} == plain(history, n, lag)


@pytest.mark.parametrize("chunk_rows", [2, 1_000_000])
def test_rolling_mean_with_missing_days_text_ids_and_outliers(history, chunk_rows):
    from pyspark.sql import functions as F

    odd = history.withColumn("Date", F.when(F.col("MatchId") % 5 > 0, F.col("Date")))
    as_text = odd.withColumn("MatchId", F.format_string("m%04d|é", "MatchId"))
    outlier = odd.withColumn("MatchId", F.when(F.col("MatchId") == 17, 10**12).otherwise(F.col("MatchId")))
    for df in (odd, as_text, outlier):
        keys = ["Season", "Team"]
        got = ordered.rolling_mean(df, keys, "Date", "MatchId", {"form": "Points"}, 5, 1, chunk_rows).collect()
        pdf = df.toPandas()
        pdf["Date"] = pdf["Date"].map(lambda d: d or datetime.date.min)
        pdf = pdf.sort_values([*keys, "Date", "MatchId"])
        shifted = pdf.groupby(keys)["Points"].shift(1)
        pdf["want"] = shifted.groupby([pdf["Season"], pdf["Team"]]).transform(lambda x: x.rolling(5, min_periods=1).mean())
        want = {(r.Team, r.MatchId): None if pd.isna(r.want) else round(r.want, 9) for r in pdf.itertuples()}
        assert {(r.Team, r.MatchId): None if r.form is None else round(r.form, 9) for r in got} == want


def test_hot_day_is_cut(history):
    cut = ordered.cut_history(history, ["Season", "Team"], "Date", "MatchId", 10)
    largest = cut.groupBy("Team", "_chunk", "_piece").count().agg({"count": "max"}).first()[0]
    assert cut.count() == 300 and largest < 25


@pytest.mark.parametrize("q", [0.0, 0.25, 0.5, 0.9, 1.0])
def test_exact_quantile(spark, q):
    rng = np.random.default_rng(3)
    data = np.concatenate([rng.normal(0, 1, 500), rng.normal(1e6, 1, 20), np.zeros(100), -rng.random(50) * 1e-9])
    df = spark.createDataFrame(pd.DataFrame({"x": data}))
    got = ordered.exact_quantile(df, "x", q).first()["q"]
    assert got == pytest.approx(np.quantile(data, q), rel=1e-12, abs=1e-12)


def test_quantile_of_nothing(spark):
    assert ordered.exact_quantile(spark.createDataFrame([], "x double"), "x", 0.5).first()["q"] is None


def test_value_bin_keeps_order(spark):
    rng = np.random.default_rng(5)
    edges = [2.0**k for k in range(-60, 60)]
    data = [*edges, *np.nextafter(edges, 0), *(-np.array(edges)), *rng.normal(0, 100, 500), 0.0, 5e-324, 1.7e308]
    df = spark.createDataFrame(pd.DataFrame({"x": np.array(data, dtype=float)}))
    rows = sorted((r.x, r.b) for r in df.select("x", ordered.value_bin(df["x"]).alias("b")).collect())
    bins = [b for _, b in rows]
    assert bins == sorted(bins)


def test_auc_with_ties(spark):
    rng = np.random.default_rng(11)
    y = rng.integers(0, 2, 400)
    s = np.round(rng.random(400) * 0.6 + y * 0.2, 2)
    df = spark.createDataFrame(pd.DataFrame({"y": y, "s": s}))
    pos, neg = s[y == 1], s[y == 0]
    want = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    assert metrics.auc(df, "y", "s").first()["AUC"] == pytest.approx(want)


def test_auc_of_one_class_is_null(spark):
    df = spark.createDataFrame([(1, 0.2), (1, 0.3)], "y int, s double")
    assert metrics.auc(df, "y", "s").first()["AUC"] is None


def test_stratified_split_is_exact_and_stable(spark):
    df = spark.createDataFrame([(f"p{i}", "a", int(i % 3 == 0)) for i in range(200)], "Player string, Squad string, y int")
    first = metrics.stratified_split(df, "y", ["Player", "Squad"], 0.2)
    counts = {(r.y, r.is_test): r["count"] for r in first.groupBy("y", "is_test").count().collect()}
    assert counts == {(0, 0): 106, (0, 1): 27, (1, 0): 54, (1, 1): 13}
    again = metrics.stratified_split(df.repartition(5), "y", ["Player", "Squad"], 0.2)
    assert sorted(first.collect()) == sorted(again.collect())


def test_split_orders_only_the_parts_it_ends_in(spark):
    """No join or window shuffles the rows; groups of one row, empty shares and rows with equal keys keep exact counts."""
    rows = [("a", i % 700) for i in range(1000)] + [("b", 1)] + [("c", 7)] * 9 + [(None, 1)]
    df = spark.createDataFrame(rows, "label string, id int")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        got = metrics.stratified_split(df, "label", ["id"])
        plan = got._jdf.queryExecution().executedPlan().toString()
        counts = {(r["label"], r["is_test"]): r["count"] for r in got.groupBy("label", "is_test").count().collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
    assert counts == {("a", 0): 800, ("a", 1): 200, ("b", 0): 1, ("c", 0): 7, ("c", 1): 2}
    assert {r["id"] for r in got.filter("label = 'a' AND is_test = 1").collect()} == {
        r["id"] for r in df.filter("label = 'a'").orderBy(metrics.c.stable_hash(42, "id"), "id").limit(200).collect()
    }
