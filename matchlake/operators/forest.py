"""Boosted tree ensembles as relational node tables.

A forest is a table of nodes: (part, tree, weight, node, feature, split, left,
right, leaf, gain, count). ``part`` numbers the models of a one-against-rest
family (0 for a single model); a node with ``left < 0`` is a leaf; a row goes
left when its feature value is at most ``split``. Missing and non-finite
values take the place ``models.MISSING``, as in fitting.

* :func:`from_model` reads a fitted Spark model through its own saved form
  (``write().save``), which already is such a table; no tree is walked in Python.
* :func:`score` compiles every tree into one nested ``CASE`` expression and
  sums them: a narrow projection in generated code, without a join or a
  shuffle, however many rows are scored. The node table is bounded by the
  model (trees times 2^depth), not by the data, so it is read to the driver.
* :func:`importances` is an aggregate over the node table: ``gain * count`` of
  the splits on each feature, summed over trees and scaled to sum 1 (each tree
  scaled first for random forests), averaged over parts -- Spark's own definition.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matchlake.functions import columns as c
from matchlake.operators.models import MISSING, OneAgainstRest
from matchlake.session import shared_dir

NODES = "part int, tree int, weight double, node int, feature int, split double, left int, right int, leaf double, gain double, count double"


def _one(model, part: int) -> DataFrame:
    spark = SparkSession.getActiveSession()
    folder = f"{shared_dir(spark)}/forest-{uuid.uuid4().hex}"
    model.write().overwrite().save(folder)
    data = spark.read.parquet(f"{folder}/data")
    weights = spark.read.parquet(f"{folder}/treesMetadata").select(F.col("_1").alias("treeID"), F.col("_3").alias("weight"))
    n = F.col("nodeData")
    stats = n["impurityStats"]
    # the trees of boosting are regression trees: their nodes hold (count, sum, sum of squares)
    count = stats[0]
    return data.join(weights, "treeID").select(
        F.lit(part).alias("part"),
        F.col("treeID").alias("tree"),
        "weight",
        n["id"].alias("node"),
        n["split"]["featureIndex"].alias("feature"),
        F.coalesce(F.get(n["split"]["leftCategoriesOrThreshold"], 0), F.lit(0.0)).alias("split"),
        n["leftChild"].alias("left"),
        n["rightChild"].alias("right"),
        n["prediction"].alias("leaf"),
        n["gain"].alias("gain"),
        count.cast("double").alias("count"),
    )


def from_model(model) -> DataFrame:
    """Node table of a fitted boosted model, or of each model of a one-against-rest family."""
    several = model.models if isinstance(model, OneAgainstRest) else (model,)
    tables = [_one(m, k) for k, m in enumerate(several)]
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def _values(features: Sequence[str]) -> list[Column]:
    return [F.coalesce(c.finite_or_null(F.col(f"`{name}`")), F.lit(MISSING)) for name in features]


def _tree(nodes: dict[int, tuple], at: int, x: list[Column]) -> Column:
    feature, split, left, right, leaf = nodes[at]
    if left < 0:
        return F.lit(float(leaf))
    return F.when(x[feature] <= F.lit(float(split)), _tree(nodes, left, x)).otherwise(_tree(nodes, right, x))


def margins(forest: DataFrame, features: Sequence[str]) -> list[Column]:
    """One column per part: the weighted sum of its trees' leaves, as one expression."""
    rows = forest.select("part", "tree", "weight", "node", "feature", "split", "left", "right", "leaf").collect()
    trees: dict[tuple[int, int], dict[int, tuple]] = {}
    weights: dict[tuple[int, int], float] = {}
    for r in rows:
        trees.setdefault((r["part"], r["tree"]), {})[r["node"]] = (r["feature"], r["split"], r["left"], r["right"], r["leaf"])
        weights[(r["part"], r["tree"])] = r["weight"]
    x = _values(features)
    parts = sorted({p for p, _ in trees})
    out = []
    for p in parts:
        terms = [F.lit(float(weights[key])) * _tree(trees[key], 0, x) for key in sorted(trees) if key[0] == p]
        out.append(sum(terms[1:], terms[0]) if terms else F.lit(0.0))
    return out


def score(forest: DataFrame, df: DataFrame, features: Sequence[str], kind: str, *out: str) -> DataFrame:
    """Add predictions from a node table.

    ``kind``: 'regression' (one column, the margin), 'binary' (one column, the
    probability 1 / (1 + exp(-2 margin)) of a log-loss boosted model), or
    'classes' (one column per part: each part's probability, brought to a sum of 1).
    """
    m = margins(forest, features)
    if kind == "regression":
        return df.withColumn(out[0], m[0])
    prob = [F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-2.0) * x)) for x in m]
    if kind == "binary":
        return df.withColumn(out[0], prob[0])
    total = sum(prob[1:], prob[0])
    return df.withColumns({name: p / total for name, p in zip(out, prob)})


class Given:
    """A node table standing where a fitted model is expected (``models.predict``, ``models.predict_probability``)."""

    def __init__(self, table: DataFrame, kind: str):
        self.table, self.kind = table, kind

    def score_into(self, df: DataFrame, features: Sequence[str], *out: str) -> DataFrame:
        return score(self.table, df, features, self.kind, *out)


def importances(forest: DataFrame, features: Sequence[str], per_tree: bool = False) -> DataFrame:
    """(Feature, Importance) from the node table, largest first.

    Boosted trees fit what the earlier ones left, so their gains are summed as
    they are (``per_tree=False``, as Spark does for boosting); ``per_tree=True``
    first scales each tree to sum 1, as for random forests.
    """
    g = (F.col("gain") * F.col("count")).alias("g")
    splits = forest.where(F.col("left") >= 0).select("part", "tree", F.col("feature").alias("slot"), g)
    trees = splits.groupBy("part", "tree", "slot").agg(F.sum("g").alias("g"))
    tree_total = F.sum("g").over(Window.partitionBy("part", "tree"))
    if per_tree:
        trees = trees.withColumn("g", F.when(tree_total > 0, F.col("g") / tree_total).otherwise(F.lit(0.0)))
    per_part = trees.groupBy("part", "slot").agg(F.sum("g").alias("g"))
    part_total = F.sum("g").over(Window.partitionBy("part"))
    per_part = per_part.withColumn("g", F.when(part_total > 0, F.col("g") / part_total).otherwise(F.lit(0.0)))
    parts = forest.select("part").distinct().count()
    names = forest.sparkSession.createDataFrame(list(enumerate(features)), "slot int, Feature string")
    means = per_part.groupBy("slot").agg((F.sum("g") / F.lit(max(parts, 1))).alias("Importance"))
    board = names.join(means, "slot", "left").select("Feature", F.coalesce("Importance", F.lit(0.0)).alias("Importance"))
    return board.orderBy(F.desc("Importance"), "Feature")
