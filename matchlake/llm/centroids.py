"""Centroid clustering of integer vectors with JVM-native expressions.

Every round puts the current centroids into the plan as literal arrays. For
each vector, ``zip_with`` and ``aggregate`` give its exact integer squared
distance to every centroid, and ``array_min`` over (distance, number) structs
picks the nearest one, ties to the smaller number. New centroids come from one
``groupBy`` with a ``sum`` column per component: the partial aggregate runs
map-side in generated code, so each task sends at most ``k`` rows whatever the
share of its largest cluster. Only ``k`` centroids of ``dim`` integers travel
through the driver between rounds; the vectors are never collected.

Defined results:

* a row takes part if its id is not null and its vector has exactly ``dim``
  components, none null, NaN or infinite, each with ``|floor(64 x)| < 2**27``
  (so that every squared distance fits exactly in a long); other rows are
  left out of the result;
* fewer kept vectors than ``k``: as many centroids as kept vectors; none: an
  empty result with the same columns;
* repeated rows and equal vectors are clustered each on their own; ties of
  the start hash (repeated ids) are broken by the vector;
* extra input columns are dropped, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the contract.
K, DIM, ROUNDS, SCALE, SEED_PREFIX = 16, 64, 3, 64, "1:"
# Largest magnitude of an integer component: squared distances stay below 2**63.
LIMIT = 2**27


def integer_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """(vec_id, v) for the rows that take part: v holds floor(scale * x) of every component, as longs."""
    x = F.col(vec_col)
    fine = F.forall(
        x,
        lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")) & (F.abs(F.floor(c.cast("double") * scale)) < LIMIT),
    )
    kept = vectors.where(F.col(id_col).isNotNull() & x.isNotNull() & (F.size(x) == dim) & fine)
    ints = F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long"))
    return kept.select(F.col(id_col).cast("long").alias("vec_id"), ints.alias("v"))


def start_centroids(points: DataFrame, k: int = K, prefix: str = SEED_PREFIX) -> list[list[int]]:
    """The ``k`` vectors with the smallest sha256 of ``prefix || vec_id``, in ascending hash order (a top-k, at most k rows to the driver)."""
    ranked = points.select(F.sha2(F.concat(F.lit(prefix), F.col("vec_id").cast("string")), 256).alias("h"), "v")
    return [list(r["v"]) for r in ranked.orderBy("h", "v").limit(k).collect()]


def _distance(v: Column, centroid: list[int]) -> Column:
    """Exact squared Euclidean distance of integer arrays, one literal centroid."""
    diffs = F.zip_with(v, F.array(*[F.lit(int(c)).cast("long") for c in centroid]), lambda a, b: (a - b) * (a - b))
    return F.aggregate(diffs, F.lit(0).cast("long"), lambda acc, d: acc + d)


def assign(points: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """Add ``cluster`` (int) and ``distance`` (long): the nearest centroid, ties to the smaller number."""
    options = F.array(*[F.struct(_distance(F.col("v"), c).alias("d"), F.lit(i).alias("k")) for i, c in enumerate(centroids)])
    best = F.array_min(options)
    return points.withColumn("_best", best).select(
        *[c for c in points.columns], F.col("_best.k").cast("int").alias("cluster"), F.col("_best.d").alias("distance")
    )


def update(assigned: DataFrame, centroids: list[list[int]], dim: int = DIM) -> list[list[int]]:
    """Componentwise floor(sum / count) of each non-empty cluster; empty ones stay as they were."""
    sums = [F.sum(F.col("v")[i]).alias(f"s{i}") for i in range(dim)]
    rows = assigned.groupBy("cluster").agg(F.count("*").alias("n"), *sums)
    # exact floor division of longs: (s - pmod(s, n)) div n
    floors = [F.expr(f"(s{i} - pmod(s{i}, n)) div n").alias(f"c{i}") for i in range(dim)]
    new = {r["cluster"]: [r[f"c{i}"] for i in range(dim)] for r in rows.select("cluster", *floors).collect()}
    return [new.get(i, c) for i, c in enumerate(centroids)]


def cluster(
    vectors: DataFrame,
    k: int = K,
    rounds: int = ROUNDS,
    dim: int = DIM,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
) -> tuple[DataFrame, list[list[int]]]:
    """Lloyd's rounds from hash-chosen starts; returns the final assignment and the final centroids.

    The assignment has vec_id, v, cluster and distance; cluster numbers are the
    places of the start vectors in ascending hash order.
    """
    points = integer_vectors(vectors, id_col, vec_col, dim)
    centroids = start_centroids(points, k)
    for _ in range(rounds if centroids else 0):
        centroids = update(assign(points, centroids), centroids, dim)
    if not centroids:
        empty = points.select("vec_id", "v", F.lit(0).cast("int").alias("cluster"), F.lit(0).cast("long").alias("distance"))
        return empty.where(F.lit(False)), centroids
    return assign(points, centroids), centroids


def report(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dim: int = DIM, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Per kept vector: vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256.

    Cluster sums come from one partial aggregate of at most ``k`` rows a task;
    the ``k``-row table of sums and centroid hashes is joined back by broadcast
    (its size is bounded by ``k``), so no shuffle is keyed by cluster.
    """
    assigned, centroids = cluster(vectors, k, rounds, dim, id_col, vec_col)
    spark = vectors.sparkSession
    digest = spark.createDataFrame(
        [(i, ",".join(str(int(x)) for x in c)) for i, c in enumerate(centroids)], "cluster int, centroid string"
    )
    sums = assigned.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    table = digest.join(sums, "cluster", "left").select(
        "cluster",
        F.coalesce("cluster_inertia", F.lit(0)).cast("long").alias("cluster_inertia"),
        F.sum(F.coalesce("cluster_inertia", F.lit(0))).over(_everything()).cast("long").alias("inertia"),
        F.sha2("centroid", 256).alias("centroid_sha256"),
    )
    return assigned.join(F.broadcast(table), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


def _everything() -> Window:
    """One window over the ``k`` rows of the cluster table (bounded by ``k``)."""
    return Window.partitionBy(F.lit(0))
