"""Order statistics and ordered windows that never put a whole key in one task.

A plain ``Window.partitionBy(team)`` sends all rows of a team to one task, and
``percentile`` keeps every distinct value of a column in one buffer. The helpers
here give the same, exact answers with bounded work per task:

* histories are cut into chunks of a given size and each chunk gets the few
  rows it needs from its predecessors;
* quantiles and ranks come from a histogram over value bins, and values are put in
  order inside one bin at a time.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import StringType

from matchlake.functions import columns as c

# Rows of a key that one task orders.
CHUNK_ROWS = 2_000_000
# A large day is cut into so many pieces at most.
CUTS = 256


# -- ordered histories ------------------------------------------------------


def _place(df: DataFrame, name: str) -> Column:
    """A number that never falls where the column rises: numbers as they are, text by its first six bytes."""
    if isinstance(df.schema[name].dataType, StringType):
        head = F.rpad(F.substring(F.hex(F.encode(name, "UTF-8")), 1, 12), 12, "0")
        return F.conv(head, 16, 10).cast("double")
    return F.col(name).cast("double")


def cut_history(
    df: DataFrame, keys: Sequence[str], day: str, tie: str, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """Add ``_chunk`` and ``_piece``; their order agrees with (day, tie) inside each key.

    Whole days are packed into chunks of about ``chunk_rows`` rows. A day that is
    larger by itself is cut at quantiles of ``tie``. Rows without a day come first,
    as in a sort. The day histogram is one row per key and day, so its window is
    bounded by the calendar, not by the data.
    """
    marked = df.withColumn("_place", _place(df, tie))
    grid = [k / CUTS for k in range(1, CUTS)]
    per_day = marked.groupBy(*keys, day).agg(
        F.count(F.lit(1)).alias("_rows"), F.percentile_approx("_place", grid, 1000).alias("_cuts")
    )
    earlier = W.partitionBy(*keys).orderBy(day).rowsBetween(W.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_rows").over(earlier), F.lit(0))
    pieces = F.ceil(F.col("_rows") / F.lit(chunk_rows))
    per_day = per_day.select(
        *[F.col(k).alias(f"_of_{k}") for k in keys],
        F.col(day).alias("_of_day"),
        F.floor(before / F.lit(chunk_rows)).alias("_chunk"),
        pieces.alias("_pieces"),
        F.when(pieces > 1, F.col("_cuts")).alias("_cuts"),
    )
    same = [marked[k] == per_day[f"_of_{k}"] for k in keys]
    joined = marked.join(per_day, [*same, marked[day].eqNullSafe(per_day["_of_day"])])
    passed = F.size(F.filter("_cuts", lambda cut: cut < F.col("_place")))
    piece = F.when(F.col("_pieces") > 1, F.floor(passed * F.col("_pieces") / CUTS)).otherwise(F.lit(0))
    return joined.withColumn("_piece", F.coalesce(piece.cast("long"), F.lit(0))).drop(
        "_pieces", "_cuts", "_place", "_of_day", *[f"_of_{k}" for k in keys]
    )


def rolling_mean(
    df: DataFrame,
    keys: Sequence[str],
    day: str,
    tie: str,
    measures: Mapping[str, str],
    n: int,
    lag: int = 0,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Mean of the last ``n`` rows per key, one output row per input row.

    ``lag=1`` leaves the row itself out. Histories are always cut: each chunk borrows
    the last ``n - 1 + lag`` rows of the chunks before it, so a key is worked on by as
    many tasks as it has chunks. ``tie`` may be a number or text; rows without a day
    come first.
    """
    reach = n - 1 + lag
    part = [*keys, "_chunk", "_piece"]
    sources = list(dict.fromkeys(measures.values()))
    rows = cut_history(df, keys, day, tie, chunk_rows)

    # At most ``reach`` rows per chunk survive the map-side group limit.
    newest = W.partitionBy(*part).orderBy(F.desc(day), F.desc(tie))
    tails = (
        rows.select(*part, day, tie, *sources)
        .withColumn("_rn", F.row_number().over(newest))
        .filter(F.col("_rn") <= reach)
        .groupBy(*part)
        .agg(F.sort_array(F.collect_list(F.struct(day, tie, *sources))).alias("_tail"))
    )
    preceding = W.partitionBy(*keys).orderBy("_chunk", "_piece").rowsBetween(-max(reach, 1), -1)
    carried = F.flatten(F.collect_list("_tail").over(preceding))
    halo = (
        tails.withColumn("_carried", carried)
        .withColumn("_from", F.greatest(F.size("_carried") - reach + 1, F.lit(1)))
        .select(*part, F.inline(F.slice("_carried", F.col("_from"), reach)))
        .withColumn("_halo", F.lit(True))
    )
    frame = W.partitionBy(*part).orderBy(day, tie).rowsBetween(-reach, -lag)
    return (
        rows.withColumn("_halo", F.lit(False))
        .unionByName(halo, allowMissingColumns=True)
        .withColumns({out: F.avg(src).over(frame) for out, src in measures.items()})
        .filter(~F.col("_halo"))
        .drop("_halo", "_chunk", "_piece")
    )


def newest_rows(
    df: DataFrame, keys: Sequence[str], day: str, tie: str, n: int
) -> DataFrame:
    """Last ``n`` rows per key. Every map task forwards at most ``n`` rows of a key."""
    newest = W.partitionBy(*keys).orderBy(F.desc(day), F.desc(tie))
    return df.withColumn("_rn", F.row_number().over(newest)).filter(F.col("_rn") <= n).drop("_rn")


# -- quantiles, ranks, splits -----------------------------------------------

STEPS = 1024


def value_bin(value: Column) -> Column:
    """Whole number that grows with ``value``: sign, power of two and 1,024 steps in between.

    It depends on nothing but the value, so no first pass over the data is needed. A
    rounding slip of the logarithm is harmless: one power too high gives step -1, one too
    low gives step 1,024, which is the same bin. Numbers from 0.001 to 1,000 fall into
    about 20,000 bins; all doubles together into about 4 million.
    """
    size = F.abs(value)
    power = F.floor(F.log2(size))
    step = F.floor((size / F.pow(F.lit(2.0), power) - 1) * STEPS)
    above_zero = power * STEPS + step + F.lit(2**21)
    return F.when(value > 0, above_zero).when(value < 0, -above_zero).otherwise(F.lit(0)).cast("long")


def exact_quantile(df: DataFrame, value: str, q: float, out: str = "q") -> DataFrame:
    """One row: the q-quantile with linear interpolation, exact and distributed.

    Equal values are merged first. A histogram over value bins then finds the bins with the
    two neighbouring positions, and only these bins are ordered value by value.
    """
    counted = (
        df.select(c.finite_or_null(value).alias("v"))
        .filter(F.col("v").isNotNull())
        .groupBy("v")
        .agg(F.count(F.lit(1)).alias("c"))
        .withColumn("_bin", value_bin(F.col("v")))
    )
    # One row per bin reaches this window, see value_bin for the bound.
    everything = W.partitionBy(F.lit(0))
    upto = everything.orderBy("_bin").rowsBetween(W.unboundedPreceding, 0)
    h = F.lit(q) * (F.sum("c").over(everything) - 1)
    totals = counted.groupBy("_bin").agg(F.sum("c").alias("c"))
    totals = totals.select("_bin", "c", (F.sum("c").over(upto) - F.col("c")).alias("_before"), h.alias("h"))
    has = lambda k: (F.col("_before") <= k) & (k < F.col("_before") + F.col("c"))
    low, high = F.floor("h"), F.ceil("h")
    wanted = totals.filter(has(low) | has(high)).select("_bin", "_before", "h")
    # ``wanted`` has one or two rows.
    inner = W.partitionBy("_bin").orderBy("v")
    placed = counted.join(F.broadcast(wanted), "_bin").withColumn(
        "_before", F.col("_before") + F.sum("c").over(inner) - F.col("c")
    )
    return placed.agg(
        F.max(F.when(has(low), F.col("v"))).alias("lo"),
        F.max(F.when(has(high), F.col("v"))).alias("hi"),
        F.max(F.col("h") - low).alias("part"),
    ).select((F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("part")).alias(out))


def weight_below(df: DataFrame, value: str, weight: str, out: str) -> DataFrame:
    """For one row per distinct ``value``: total ``weight`` of all smaller values."""
    binned = df.withColumn("_bin", value_bin(F.col(value)))
    # One row per bin reaches this window, see value_bin for the bound.
    upto = W.partitionBy(F.lit(0)).orderBy("_bin").rowsBetween(W.unboundedPreceding, 0)
    totals = (
        binned.groupBy("_bin")
        .agg(F.sum(weight).alias("_w"))
        .select("_bin", (F.sum("_w").over(upto) - F.col("_w")).alias("_base"))
    )
    inner = W.partitionBy("_bin").orderBy(value)
    return (
        binned.join(totals, "_bin")
        .withColumn(out, F.col("_base") + F.sum(weight).over(inner) - F.col(weight))
        .drop("_bin", "_base")
    )


def smallest_share(
    df: DataFrame, group: str, hashed: str, tie: Sequence[str], share: float, out: str, hash_bits: int = 24
) -> DataFrame:
    """Flag exactly round-half-up(share x size) rows of each group: those with the smallest hash.

    Groups are cut by the leading 16 bits of the hash. A count per part tells the one part of each
    group that the share ends in; only its rows are shuffled and ordered, all others are flagged
    by their part alone.
    """
    cut = df.withColumn("_part", F.shiftright(F.col(hashed), hash_bits - 16))
    sizes = cut.groupBy(group, "_part").agg(F.count(F.lit(1)).alias("_n"))
    # Bounded: at most 65,536 rows per group reach these windows.
    upto = W.partitionBy(group).orderBy("_part")
    sizes = sizes.select(
        group,
        "_part",
        (F.sum("_n").over(upto) - F.col("_n")).alias("_before"),
        F.floor(F.lit(share) * F.sum("_n").over(W.partitionBy(group)) + F.lit(0.5)).alias("_want"),
    )
    reached = F.when(F.col("_before") < F.col("_want"), F.struct("_part", (F.col("_want") - F.col("_before")).alias("left")))
    ends = sizes.groupBy(group).agg(F.max(reached).alias("_end"))
    # One row per group; a share of no rows ends before the first part.
    rows = cut.join(F.broadcast(ends), group).withColumn("_at", F.coalesce(F.col("_end._part"), F.lit(-1)))
    place = F.row_number().over(W.partitionBy(group, "_part").orderBy(hashed, *tie))
    whole = rows.filter(F.col("_part") != F.col("_at")).withColumn(out, (F.col("_part") < F.col("_at")).cast("int"))
    edge = rows.filter(F.col("_part") == F.col("_at")).withColumn(out, (place <= F.col("_end.left")).cast("int"))
    return whole.unionByName(edge).drop("_part", "_end", "_at")
