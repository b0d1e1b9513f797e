"""Column expressions shared by the operators. Nothing here touches a DataFrame."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted date layouts, tried in this order (fixed values).
DATE_FORMATS = (
    "yyyy-MM-dd", "dd/MM/yyyy", "dd/MM/yy", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm", "dd/MM/yyyy HH:mm", "d MMM yyyy", "d MMMM yyyy",
)
# Two-digit years above this one belong to the last century.
LAST_TWO_DIGIT_YEAR = 68

_NUMBER = r"^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?$"


def _as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_season(season: Column | str) -> Column:
    """``1999-00`` -> ``1999-2000``; any other text is only trimmed."""
    text = F.trim(_as_col(season))
    start = F.substring(text, 1, 4).try_cast("int")
    end = F.substring(text, 6, 2).try_cast("int")
    rollover = F.when(end <= start % 100, 1).otherwise(0)
    full_end = (F.floor(start / 100) + rollover) * 100 + end
    short = text.rlike(r"^[0-9]{4}-[0-9]{2}$")
    return F.when(short, F.concat_ws("-", start.cast("string"), full_end.cast("string"))).otherwise(text)


def parse_date(text: Column | str, formats: tuple[str, ...] = DATE_FORMATS) -> Column:
    """First layout that fits, else null. Years of two digits are 1969 to 2068."""
    text = F.trim(_as_col(text).cast("string"))

    def by(layout: str) -> Column:
        day = F.try_to_date(text, layout)
        if "yyyy" in layout:
            return day
        return F.when(F.year(day) % 100 > LAST_TWO_DIGIT_YEAR, F.add_months(day, -1200)).otherwise(day)

    return F.coalesce(*[by(layout) for layout in formats])


def home_points(result: Column | str) -> Column:
    result = _as_col(result)
    return F.when(result == "H", 3).when(result == "D", 1).otherwise(0)


def away_points(result: Column | str) -> Column:
    result = _as_col(result)
    return F.when(result == "A", 3).when(result == "D", 1).otherwise(0)


def finite_or_null(x: Column | str) -> Column:
    x = _as_col(x).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def to_number(x: Column | str) -> Column:
    """Text to double: thousands separators removed, anything unreadable null."""
    text = F.regexp_replace(F.trim(_as_col(x).cast("string")), ",", "")
    return F.when(text.rlike(_NUMBER), text.try_cast("double"))


def ratio(top: Column | str, bottom: Column | str) -> Column:
    """Quotient as double; null where the divisor is zero or missing."""
    return F.try_divide(_as_col(top).cast("double"), _as_col(bottom).cast("double"))


def mean_of_present(*cols: Column | str) -> Column:
    """Mean across columns, ignoring nulls; null when all are null."""
    cols = tuple(_as_col(c).cast("double") for c in cols)
    total = reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) for c in cols])
    present = reduce(lambda a, b: a + b, [c.isNotNull().cast("int") for c in cols])
    return ratio(total, present)


def half_sum(home: Column | str, away: Column | str) -> Column:
    """(home + away) / 2 with one missing side as 0; null when both are missing."""
    home, away = _as_col(home), _as_col(away)
    value = (F.coalesce(home, F.lit(0.0)) + F.coalesce(away, F.lit(0.0))) / 2
    return F.when(home.isNotNull() | away.isNotNull(), value)


def sum_or_zero(x: Column | str) -> Column:
    return F.coalesce(F.sum(_as_col(x)), F.lit(0))


def stable_hash(seed: int, *keys: Column | str) -> Column:
    """24-bit number from md5(keys, seed); reproducible in any SQL engine."""
    text = F.concat_ws("|", *[_as_col(k).cast("string") for k in keys], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 6), 16, 10).cast("long")


def discipline_index(fouls: Column | str, yellows: Column | str, reds: Column | str) -> Column:
    # Weights are fixed values: 1 a foul, 2 a yellow, 3 a red.
    return 1.0 * _as_col(fouls) + 2.0 * _as_col(yellows) + 3.0 * _as_col(reds)
