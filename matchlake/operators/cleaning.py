"""Cleaning and typing of match and player tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import NumericType

from matchlake.functions import columns as c

# Long header -> short header (fixed values).
SHORT_NAMES = {
    "FullTimeHomeTeamGoals": "FTHG",
    "FullTimeAwayTeamGoals": "FTAG",
    "FullTimeResult": "FTR",
    "HomeTeamShots": "HS",
    "AwayTeamShots": "AS",
    "HomeTeamShotsOnTarget": "HST",
    "AwayTeamShotsOnTarget": "AST",
    "HomeTeamCorners": "HC",
    "AwayTeamCorners": "AC",
    # Names with a dot need quoting everywhere, so they go at the source.
    "B365Over2.5Goals": "OddsOver",
    "B365Under2.5Goals": "OddsUnder",
}


def standardize_columns(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed(SHORT_NAMES)


def with_season(df: DataFrame) -> DataFrame:
    return df.withColumn("Season", c.normalize_season("Season"))


def union_matches(*tables: DataFrame) -> DataFrame:
    """Stack match tables by name after renaming headers and seasons."""
    first, *rest = [with_season(standardize_columns(t)) for t in tables]
    for table in rest:
        first = first.unionByName(table, allowMissingColumns=True)
    return first


def with_match_id(df: DataFrame) -> DataFrame:
    """Tables without a match id get one of season, date and the two teams."""
    if "MatchId" in df.columns:
        return df
    return df.withColumn("MatchId", F.concat_ws("|", "Season", F.col("Date").cast("string"), "HomeTeam", "AwayTeam"))


def parse_dates(df: DataFrame, formats: tuple[str, ...] = c.DATE_FORMATS) -> DataFrame:
    return df.withColumn("Date", c.parse_date("Date", formats)).filter(F.col("Date").isNotNull())


def latest_season(df: DataFrame) -> DataFrame:
    """One row, column Season; null seasons are ignored."""
    return df.agg(F.max("Season").alias("Season"))


def match_week(df: DataFrame) -> DataFrame:
    """Number the distinct match dates of each season 1, 2, ...

    Only the (season, date) pairs are ranked, at most one row per calendar day.
    """
    days = df.select("Season", "Date").filter(F.col("Season").isNotNull()).distinct()
    days = days.withColumn("MatchWeek", F.row_number().over(W.partitionBy("Season").orderBy("Date")))
    return df.join(days, ["Season", "Date"], "left")


def add_match_points(df: DataFrame) -> DataFrame:
    if "FTR" not in df.columns and "FullTimeResult" in df.columns:
        df = df.withColumn("FTR", F.col("FullTimeResult"))
    if "FTR" not in df.columns:
        return df
    return df.withColumns({"HomeTeamPoints": c.home_points("FTR"), "AwayTeamPoints": c.away_points("FTR")})


def ensure_columns(df: DataFrame, names: Sequence[str], default: float | int = 0) -> DataFrame:
    missing = {name: F.lit(default) for name in names if name not in df.columns}
    return df.withColumns(missing) if missing else df


def number(df: DataFrame, name: str) -> Column:
    """A column as double; only text is parsed."""
    col = F.col(f"`{name}`")
    return col.cast("double") if isinstance(df.schema[name].dataType, NumericType) else c.to_number(col)


def coerce_numeric(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.withColumns({n: number(df, n) for n in names if n in df.columns})


def first_present(df: DataFrame, candidates: Sequence[str]) -> Column:
    for name in candidates:
        if name in df.columns:
            return number(df, name)
    return F.lit(0.0)


def complete_rows(
    df: DataFrame, required: Sequence[str], fill: Sequence[str] = (), finite: Sequence[str] | None = None
) -> DataFrame:
    """Infinite or NaN -> null, rows missing a required value dropped, ``fill`` columns 0."""
    checked = [*required, *fill] if finite is None else finite
    df = df.withColumns({n: c.finite_or_null(n) for n in checked})
    df = df.na.drop(subset=list(required)) if required else df
    return df.na.fill(0, subset=list(fill)) if fill else df


def season_slice(df: DataFrame, season: Column | str) -> DataFrame:
    return df.filter(F.col("Season") == F.lit(season))


def training_slice(df: DataFrame, season: Column | str, cutoff_week: int = 34) -> DataFrame:
    return df.filter((F.col("Season") != F.lit(season)) & (F.col("MatchWeek") <= cutoff_week))


def per90(df: DataFrame, rates: dict[str, str], nineties: str = "90s") -> DataFrame:
    """Add ``rates`` = {new name: stat column} divided by the 90-minute count."""
    return df.withColumns({out: c.ratio(F.col(f"`{src}`"), F.col(f"`{nineties}`")) for out, src in rates.items()})


def clean_matches(history: DataFrame, results: DataFrame) -> DataFrame:
    """The whole cleaning chain for the two match sources."""
    return add_match_points(match_week(with_match_id(parse_dates(union_matches(history, results)))))


def clean_fixtures(remaining: DataFrame) -> DataFrame:
    return with_match_id(with_season(standardize_columns(remaining)).withColumn("Date", c.parse_date("Date")))
