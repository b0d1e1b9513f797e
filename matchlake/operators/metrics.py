"""Scaling, splits and model metrics as aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchlake.functions import columns as c
from matchlake.functions import ordered


def min_max_scale(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(x - min) / (max - min); a constant column becomes 0."""
    bounds = df.agg(
        F.struct(*[F.min(n).alias(f"lo_{n}") for n in cols], *[F.max(n).alias(f"hi_{n}") for n in cols]).alias("b")
    ).scalar()

    def scaled(name):
        low, high = F.col(f"_b.lo_{name}"), F.col(f"_b.hi_{name}")
        value = c.ratio(F.col(name) - low, high - low)
        return F.when(F.col(name).isNotNull(), F.coalesce(value, F.lit(0.0)))

    return df.withColumn("_b", bounds).withColumns({n: scaled(n) for n in cols}).drop("_b")


def standard_scale(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(x - mean) / population standard deviation; a constant column becomes 0."""
    facts = df.agg(
        F.struct(*[F.avg(n).alias(f"m_{n}") for n in cols], *[F.stddev_pop(n).alias(f"s_{n}") for n in cols]).alias("b")
    ).scalar()

    def scaled(name):
        value = c.ratio(F.col(name) - F.col(f"_b.m_{name}"), F.col(f"_b.s_{name}"))
        return F.when(F.col(name).isNotNull(), F.coalesce(value, F.lit(0.0)))

    return df.withColumn("_b", facts).withColumns({n: scaled(n) for n in cols}).drop("_b")


def regression_metrics(df: DataFrame, y: str, yhat: str) -> DataFrame:
    """One row: MAE and R2."""
    mean = df.agg(F.avg(y)).scalar()
    error = F.col(y) - F.col(yhat)
    return (
        df.withColumn("_mean", mean)
        .agg(
            F.avg(F.abs(error)).alias("MAE"),
            F.sum(error * error).alias("_sse"),
            F.sum((F.col(y) - F.col("_mean")) * (F.col(y) - F.col("_mean"))).alias("_sst"),
        )
        .select("MAE", (1 - c.ratio("_sse", "_sst")).alias("R2"))
    )


def classification_metrics(df: DataFrame, label: str, prob: str, threshold: float = 0.5, eps: float = 1e-15) -> DataFrame:
    """One row: accuracy and log loss of a binary model; rows without a label or score are left out."""
    df = df.filter(F.col(label).isNotNull() & F.col(prob).isNotNull())
    p = F.least(F.greatest(F.col(prob), F.lit(eps)), F.lit(1 - eps))
    loss = F.when(F.col(label) == 1, -F.ln(p)).otherwise(-F.ln(1 - p))
    hit = F.when((F.col(prob) > threshold) == (F.col(label) == 1), 1.0).otherwise(0.0)
    return df.agg(F.avg(hit).alias("Accuracy"), F.avg(loss).alias("LogLoss"))


def multiclass_metrics(df: DataFrame, label: str, probs: Sequence[str], eps: float = 1e-15) -> DataFrame:
    """One row: accuracy and log loss from one probability column per class."""
    of_label = F.lit(None).cast("double")
    for k, name in enumerate(probs):
        of_label = F.when(F.col(label) == k, F.col(name)).otherwise(of_label)
    best = F.greatest(*probs)
    hit = F.when(of_label == best, 1.0).otherwise(0.0)
    p = F.least(F.greatest(of_label, F.lit(eps)), F.lit(1 - eps))
    return df.agg(F.avg(hit).alias("Accuracy"), F.avg(-F.ln(p)).alias("LogLoss"))


def auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """One row: area under the ROC curve, ties counted half.

    Rows are reduced to one per distinct score before anything is ordered.
    """
    by_score = (
        df.filter(F.col(score).isNotNull())
        .groupBy(F.col(score).cast("double").alias("s"))
        .agg(
            F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("pos"),
            F.sum(F.when(F.col(label) == 1, 0).otherwise(1)).alias("neg"),
        )
    )
    placed = ordered.weight_below(by_score, "s", "neg", "neg_below")
    wins = F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2))
    pairs = F.sum("pos").cast("double") * F.sum("neg")
    return placed.agg(wins.alias("w"), pairs.alias("n")).select(c.ratio("w", "n").alias("AUC"))


def binary_report(df: DataFrame, label: str, score: str, threshold: float = 0.5) -> DataFrame:
    """One row: AUC and precision, recall, F1 of class 1."""
    said, true = F.col(score) > threshold, F.col(label) == 1
    count = lambda test: F.sum(F.when(test, 1).otherwise(0))
    counts = df.agg(count(said & true).alias("tp"), count(said & ~true).alias("fp"), count(~said & true).alias("fn"))
    or_zero = lambda top, bottom: F.coalesce(c.ratio(top, bottom), F.lit(0.0))
    return counts.select(
        auc(df, label, score).scalar().alias("AUC"),
        or_zero("tp", F.col("tp") + F.col("fp")).alias("Precision"),
        or_zero("tp", F.col("tp") + F.col("fn")).alias("Recall"),
        or_zero(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("F1"),
    )


def random_split(df: DataFrame, keys: Sequence[str], frac: float = 0.2, seed: int = 42, out: str = "is_test") -> DataFrame:
    """Flag about ``frac`` of the rows by a 24-bit hash of their keys; the same rows every time."""
    picked = c.stable_hash(seed, *keys) < round(frac * 2**24)
    return df.withColumn(out, F.when(picked, 1).otherwise(0))


def stratified_split(
    df: DataFrame, label: str, keys: Sequence[str], frac: float = 0.2, seed: int = 42, out: str = "is_test"
) -> DataFrame:
    """Flag ``frac`` of each class (exact count), chosen by hash of the keys."""
    hashed = df.withColumn("_hash", c.stable_hash(seed, *keys))
    return ordered.smallest_share(hashed, label, "_hash", keys, frac, out).drop("_hash")
