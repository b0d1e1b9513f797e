"""Player features, indices and labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchlake.functions import columns as c
from matchlake.functions import ordered
from matchlake.operators import cleaning, metrics

KEYS = ["Player", "Squad", "Nation", "Age", "Born", "Pos", "90s"]
GK_MERGED = ["PSxG", "PSxG/SoT", "Stp%", "AvgDist"]
GK_COLUMNS = ["GA", "PSxG", "PSxG/SoT", "Stp%", "#OPA", "#OPA/90", "AvgDist", "Launch%", "Cmp%"]
GK_FEATURES = ["PSxG/SoT", "Stp%", "#OPA/90", "AvgDist", "Launch%", "Cmp%"]
GOAL_FEATURES = ["ShotsPer90", "xGPer90", "xAPer90"]
STAR_FEATURES = [
    "GoalsPer90", "AssistsPer90", "xGPer90", "xAPer90", "KP", "GCA90", "SCA90", "Touches",
    "PrgC", "PrgP", "PrgR", "CrdYPer90", "CrdRPer90", "FoulsPer90",
]
CLUTCH_FEATURES = [
    "GoalsPer90_HP", "AssistsPer90_HP", "FoulsPer90_HP", "CrdYPer90_HP", "CrdRPer90_HP",
    "FormInPressure", "PressureFlagCount",
]
# Weights of the star index (fixed values).
STAR_WEIGHTS = {
    "GoalsPer90": 3.0,
    "AssistsPer90": 2.0,
    "xGPer90": 2.0,
    "xAPer90": 2.0,
    "KP": 1.5,
    "GCA90": 1.5,
    "SCA90": 1.2,
    "Touches": 1.0,
    "PrgC": 1.0,
    "PrgP": 1.0,
    "PrgR": 1.0,
    "CrdYPer90": -2.0,
    "CrdRPer90": -4.0,
    "FoulsPer90": -1.0,
}


def _q(name: str):
    return F.col(f"`{name}`")


def _add_columns(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join that takes only the columns ``left`` does not have yet.

    Keys compare null-safe: a missing nation matches a missing nation. Successive joins use
    the same keys, so the left side is shuffled once.
    """
    new = [n for n in right.columns if n not in left.columns]
    other = right.select(*[_q(k).alias(f"_r_{i}") for i, k in enumerate(keys)], *[_q(n) for n in new])
    same = None
    for i, k in enumerate(keys):
        test = left[f"`{k}`"].eqNullSafe(other[f"_r_{i}"])
        same = test if same is None else same & test
    return left.join(other, same, "left").drop(*[f"_r_{i}" for i in range(len(keys))])


def merge_player_tables(standard: DataFrame, others: Sequence[DataFrame | None], gk: DataFrame | None = None) -> DataFrame:
    """All stat tables on the seven keys; players above 3 nineties, missing numbers 0."""
    df = standard
    for table in others:
        if table is not None:
            df = _add_columns(df, table, KEYS)
    if gk is not None:
        df = _add_columns(df, gk.select(*[_q(n) for n in [*KEYS, *GK_MERGED]]), KEYS)
    text = {"Player", "Squad", "Nation", "Pos", "Age", "Born"}
    numbers = [n for n in df.columns if n not in text]
    df = cleaning.coerce_numeric(df, numbers).filter(_q("90s") > 3)
    return df.withColumns({n: F.coalesce(_q(n), F.lit(0.0)) for n in numbers})


def goal_features(standard: DataFrame, shooting: DataFrame, passing: DataFrame) -> DataFrame:
    """Regular attackers and midfielders with their goal, shot, xG and xA rates."""
    df = _add_columns(_add_columns(standard, shooting, ["Player", "Squad"]), passing, ["Player", "Squad"])
    nineties = cleaning.number(df, "90s")
    minutes = cleaning.first_present(df, ["Min"])
    df = df.withColumns(
        {
            "Minutes": minutes,
            "Goals": cleaning.first_present(df, ["Gls"]),
            "ShotsPer90": c.ratio(cleaning.first_present(df, ["Sh"]), nineties),
            "xGPer90": c.ratio(cleaning.first_present(df, ["xG"]), nineties),
            "xAPer90": c.ratio(cleaning.first_present(df, ["xA"]), nineties),
        }
    ).withColumn("GoalsPer90", c.ratio("Goals", nineties))
    return (
        df.filter((F.col("Minutes") >= 900) & (F.col("Goals") >= 1))
        .filter((F.col("xGPer90") >= 0.2) & (F.col("ShotsPer90") >= 1.0))
        .filter(F.col("Pos").rlike("(?i)(FW|MF)"))
        .select("Player", "Squad", "GoalsPer90", "ShotsPer90", "xGPer90", "xAPer90")
        .na.drop()
    )


def star_features(merged: DataFrame) -> DataFrame:
    nineties = cleaning.number(merged, "90s")
    stat = lambda name: cleaning.first_present(merged, [name])
    rates = {
        "GoalsPer90": "Gls", "AssistsPer90": "Ast", "xGPer90": "xG", "xAPer90": "xA", "CrdYPer90": "CrdY",
        "CrdRPer90": "CrdR", "FoulsPer90": "Fls", "GCA90": "GCA", "SCA90": "SCA",
    }
    volumes = ["KP", "Touches", "PrgC", "PrgP", "PrgR"]
    values = {out: c.ratio(stat(src), nineties) for out, src in rates.items()}
    values |= {name: stat(name) for name in volumes}
    return (
        merged.filter(nineties >= 5)
        .select("Player", "Squad", *[values[name].alias(name) for name in STAR_FEATURES])
        .na.drop()
    )


def star_index(features: DataFrame) -> DataFrame:
    """Scaled features and their weighted sum, best first."""
    scaled = metrics.min_max_scale(features, STAR_FEATURES)
    score = sum((F.col(name) * weight for name, weight in STAR_WEIGHTS.items()), F.lit(0.0))
    return scaled.withColumn("StarScore", score).orderBy(F.desc("StarScore"), "Player", "Squad")


def star_summary(index: DataFrame) -> DataFrame:
    median = ordered.exact_quantile(index, "StarScore", 0.5).scalar()
    return index.agg(
        F.count(F.lit(1)).alias("Players"),
        F.max("StarScore").alias("MaxScore"),
        F.avg("StarScore").alias("MeanScore"),
    ).withColumn("MedianScore", median)


def star_index_fit(index: DataFrame) -> DataFrame:
    """MAE and R2 of the score against scaled goals + assists."""
    pairs = index.select((F.col("GoalsPer90") + F.col("AssistsPer90")).alias("y"), F.col("StarScore").alias("yhat"))
    return metrics.regression_metrics(pairs, "y", "yhat")


def _above(df: DataFrame, value: str, q: float, out: str, strict: bool = False) -> DataFrame:
    # Compared at nine places, so that equal rates are not told apart by their last bits.
    bound = F.round(ordered.exact_quantile(df, value, q).scalar(), 9)
    rate = F.round(value, 9)
    hit = rate > bound if strict else rate >= bound
    return df.withColumn(out, F.when(hit, 1).otherwise(0))


def star_label(features: DataFrame, q: float = 0.90) -> DataFrame:
    total = features.withColumn("GA_per90", F.col("GoalsPer90") + F.col("AssistsPer90"))
    return _above(total, "GA_per90", q, "is_star")


def gk_features(gk: DataFrame) -> DataFrame:
    df = cleaning.ensure_columns(cleaning.coerce_numeric(gk, [*GK_COLUMNS, "90s"]), GK_COLUMNS)
    return (
        df.filter(_q("90s") >= 5)
        .withColumn("GoalsPrevented", F.col("PSxG") - F.col("GA"))
        .select("Player", "Squad", "GA", "PSxG", "GoalsPrevented", *[_q(n) for n in GK_FEATURES])
        .na.drop()
    )


def gk_label(features: DataFrame) -> DataFrame:
    return _above(features, "GoalsPrevented", 0.5, "is_top_gk", strict=True)


def clutch_features(standard: DataFrame, misc: DataFrame, psych: DataFrame) -> DataFrame:
    """Rates scaled by the pressure on a player's team; 0 / 0 for teams without pressure drops the row."""
    of = lambda df, name, out: cleaning.number(df, name).alias(out)
    std = standard.select(
        "Player", "Squad", of(standard, "Gls", "Gls"), of(standard, "Ast", "Ast"),
        of(standard, "90s", "Std90s"), of(standard, "Matches", "StdMatches"),
    )
    oth = misc.select(
        "Player", "Squad", of(misc, "Fls", "Fls"), of(misc, "CrdY", "CrdY"), of(misc, "CrdR", "CrdR"),
        of(misc, "90s", "Misc90s"), of(misc, "Matches", "MiscMatches"),
    )
    # 38 is the fixed season length of the pressure share; 0.1 stands for unknown teams.
    flags = psych.select(F.col("Team").alias("Squad"), (F.col("HighPressureFlag") / 38).alias("PressureRatio"))
    df = (
        std.join(oth, ["Player", "Squad"])
        .join(flags, "Squad", "left")
        .na.fill(0.1, subset=["PressureRatio"])
        .withColumns(
            {
                "90s": c.mean_of_present("Std90s", "Misc90s"),
                "Matches": c.mean_of_present("StdMatches", "MiscMatches"),
            }
        )
        .withColumn("90s_HP", _q("90s") * F.col("PressureRatio"))
    )
    rates = {"GoalsPer90_HP": "Gls", "AssistsPer90_HP": "Ast", "FoulsPer90_HP": "Fls", "CrdYPer90_HP": "CrdY", "CrdRPer90_HP": "CrdR"}
    df = df.withColumns({out: c.ratio(F.col(src) * F.col("PressureRatio"), _q("90s_HP")) for out, src in rates.items()})
    return (
        df.na.drop(subset=list(rates))
        .filter(_q("90s_HP") > 0)
        .withColumns(
            {
                "FormInPressure": 1.3 + 0.4 * F.col("PressureRatio"),
                "PressureFlagCount": 38 * F.col("PressureRatio"),
            }
        )
        .select("Player", "Squad", *CLUTCH_FEATURES)
    )


def clutch_label(features: DataFrame, q: float = 0.75) -> DataFrame:
    total = features.withColumn("GA_Per90_HP", F.col("GoalsPer90_HP") + F.col("AssistsPer90_HP"))
    return _above(total, "GA_Per90_HP", q, "is_clutch")


def top_k(df: DataFrame, score: str, k: int = 15, ties: Sequence[str] = ("Player", "Squad")) -> DataFrame:
    return df.orderBy(F.desc(score), *ties).limit(k)
