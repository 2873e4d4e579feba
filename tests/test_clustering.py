"""Batched k-means against plain NumPy and MLlib."""

import numpy as np
import pandas as pd
import pytest

from revlens.operators import clustering as CL


def _blobs(seed=0, n=900):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 2)) * 0.6 + np.array([[0, 0], [6, 0], [0, 6], [6, 6]])[rng.integers(0, 4, n)]
    return pd.DataFrame(np.concatenate([x, x[:100]]), columns=["x", "y"])  # a hundred points twice


def _cost(x, centers):
    return ((x[:, None] - centers[None]) ** 2).sum(-1).min(1).sum()


def test_one_step_serves_all_restarts(spark):
    pdf = _blobs()
    centers = np.array([[[0, 0], [5, 5], [9, 9]], [[1, 0], [0, 1], [3, 3]]], dtype=float)
    points = CL.distinct_points(spark.createDataFrame(pdf).repartition(6), ["x", "y"])
    rows = CL.lloyd_step(points, ["x", "y"], centers).collect()
    x = pdf.to_numpy()
    for r in range(2):
        near = ((x[:, None] - centers[r][None]) ** 2).sum(-1).argmin(1)
        got = {row["cluster"]: row for row in rows if row["restart"] == r}
        assert set(got) == set(near.tolist())
        for c, row in got.items():
            assert row["n"] == (near == c).sum()
            assert np.allclose([row["sum_x"], row["sum_y"]], x[near == c].sum(axis=0))
            assert np.isclose(row["cost"], ((x[near == c] - centers[r][c]) ** 2).sum())


def test_fit_is_settled_and_costs_no_more_than_separate_fits(spark):
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler
    pdf = _blobs(1)
    df = spark.createDataFrame(pdf)
    got = CL.fit(df, ["x", "y"], 4, restarts=5)
    x = pdf.to_numpy()
    assert np.isclose(got.cost, _cost(x, got.values))
    near = ((x[:, None] - got.values[None]) ** 2).sum(-1).argmin(1)
    assert np.allclose(got.values, [x[near == c].mean(axis=0) for c in range(4)], atol=0.01)
    vec = VectorAssembler(inputCols=["x", "y"], outputCol="features").transform(df)
    separate = min(KMeans(k=4, seed=s).fit(vec).summary.trainingCost for s in range(3))
    assert got.cost <= separate * 1.001
    again = CL.fit(df.repartition(7), ["x", "y"], 4, restarts=5)
    assert np.allclose(again.values, got.values, atol=1e-9)
    assigned = df.withColumn("c", got.nearest()).toPandas()
    assert (assigned["c"].to_numpy() == ((assigned[["x", "y"]].to_numpy()[:, None] - got.values[None]) ** 2).sum(-1).argmin(1)).all()


def test_seeds_follow_the_squared_distance(spark):
    # one far point holds nearly all of the squared distance
    df = spark.createDataFrame([(float(i % 10) / 100, 0.0) for i in range(200)] + [(1000.0, 0.0)], "x double, y double")
    points = CL.distinct_points(df, ["x", "y"]).persist()
    chosen = np.zeros((20, 1, 2))
    seeds = CL._next_seeds(points, ["x", "y"], chosen, 20, 7)
    assert (seeds[:, 0] == 1000.0).all()
    first = CL._next_seeds(points, ["x", "y"], np.empty((40, 0, 2)), 40, 7)
    assert len(set(first[:, 0])) > 5  # restarts start from points of their own
    points.unpersist()


def test_missing_features_fewer_points_than_clusters_and_tables(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 1.0), (3.0, 3.0), (None, 1.0), (float("nan"), 1.0), (float("inf"), 2.0)], "x double, y double")
    got = CL.fit(df, ["x", "y"], 3, restarts=2)
    assert got.cost == 0.0 and {tuple(c) for c in got.values} == {(1.0, 1.0), (3.0, 3.0)}
    clusters = [r["c"] for r in df.withColumn("c", got.nearest()).collect()]
    assert clusters[0] == clusters[1] != clusters[2] and clusters[3:] == [None] * 3
    same = CL.Centers.from_table(got.to_table(spark))
    assert same.features == got.features and (same.values == got.values).all() and same.cost == got.cost
    with pytest.raises(ValueError):
        CL.fit(df.limit(0), ["x", "y"], 2)
