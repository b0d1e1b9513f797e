"""Node tables of fitted models score and rank features as the models themselves do."""

import math
import random

import pytest
from pyspark.sql import functions as F

from matchlake.operators import forest, models

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(1)
    data = []
    for i in range(300):
        a, b, c = rnd.uniform(0, 5), rnd.uniform(-2, 2), rnd.choice([None, float("nan"), rnd.uniform(0, 1)])
        y = a + (b > 0) * 2 + (0 if c is None or c != c else c)
        data.append((i, a, b, c, y, int(y > 3), i % 3, 1.0 + (i % 2)))
    return spark.createDataFrame(data, "id int, a double, b double, c double, y double, over int, label int, w double")


def test_regressor_node_table_scores_as_the_model(rows):
    model = models.fit_regressor(rows, FEATURES, "y", models.Size(7, 0.3, 3))
    table = forest.from_model(model)
    want = {r["id"]: r["p"] for r in models.predict(model, rows, FEATURES, "p").collect()}
    got = {r["id"]: r["p"] for r in forest.score(table, rows, FEATURES, "regression", "p").collect()}
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)
    board = {r["Feature"]: r["Importance"] for r in forest.importances(table, FEATURES).collect()}
    spark_board = dict(zip(FEATURES, model.featureImportances.toArray()))
    assert all(abs(board[f] - spark_board[f]) < 1e-9 for f in FEATURES)


def test_binary_and_classes_score_as_the_models(rows):
    binary = models.fit_binary(rows, FEATURES, "over", models.Size(5, 0.2, 2))
    want = {r["id"]: r["p"] for r in models.predict_probability(binary, rows, FEATURES, "p").collect()}
    got = {r["id"]: r["p"] for r in forest.score(forest.from_model(binary), rows, FEATURES, "binary", "p").collect()}
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)
    three = models.fit_outcome(rows, FEATURES, "label", "w", models.Size(4, 0.2, 2))
    names = ("p0", "p1", "p2")
    want = {r["id"]: [r[n] for n in names] for r in models.predict_probability(three, rows, FEATURES, *names).collect()}
    table = forest.from_model(three)
    got = {r["id"]: [r[n] for n in names] for r in forest.score(table, rows, FEATURES, "classes", *names).collect()}
    assert all(abs(x - y) < 1e-9 for k in want for x, y in zip(got[k], want[k]))
    board = {r["Feature"]: r["Importance"] for r in forest.importances(table, FEATURES).collect()}
    spark_board = {r["Feature"]: r["Importance"] for r in models.feature_importances(three, FEATURES, rows).collect()}
    assert all(abs(board[f] - spark_board[f]) < 1e-9 for f in FEATURES)
    assert math.isclose(sum(board.values()), 1.0)


def test_empty_rows_and_single_leaf(spark):
    nodes = spark.createDataFrame([(0, 0, 1.0, 0, -1, 0.0, -1, -1, 2.5, -1.0, 3.0)], forest.NODES)
    empty = spark.createDataFrame([], "a double, b double, c double")
    assert forest.score(nodes, empty, FEATURES, "regression", "p").count() == 0
    one = spark.createDataFrame([(None, None, None)], "a double, b double, c double")
    assert forest.score(nodes, one, FEATURES, "regression", "p").first()["p"] == 2.5
    assert [r["Importance"] for r in forest.importances(nodes, FEATURES).collect()] == [0.0, 0.0, 0.0]
