"""K-means with batched restarts.

Equal points become one row with their number. A pass over these rows serves
all restarts at once: each task finds the nearest centre of every restart and
adds up counts, sums and costs, and Spark adds up the tasks' rows, so an
iteration is one job whatever the number of restarts, and the driver gets
restarts x k rows of it. A restart that has settled leaves the next passes.

Seeds are chosen as k-means++ does: the next centre is drawn in proportion to
the squared distance from those chosen so far. The draw is a race, in which
every point has an exponential time of its own (from a hash of its values, the
seed, the restart and the step) and the first one wins; this takes one pass a
centre for all restarts and doesn't depend on the partitioning.

Defined cases: points with a NULL, NaN or infinite feature take no part in the
fit and get no cluster; a cluster that loses all points keeps its centre; of
equally near centres the first counts; no usable points at all is an error.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.plans.materialize import materialize

#: Rows whose distances are held at once.
ROWS = 4_096


@dataclass(frozen=True)
class Centers:
    """Fitted centres: one row of ``values`` a cluster, in the order of ``features``."""

    features: tuple[str, ...]
    values: np.ndarray
    cost: float = 0.0

    def clusterCenters(self) -> list[np.ndarray]:
        return list(self.values)

    def nearest(self) -> Column:
        """The number of the nearest centre, as an expression on the features."""
        far = [sum(((F.col(f).cast("double") - float(v)) * (F.col(f).cast("double") - float(v)) for f, v in zip(self.features, c, strict=True)), F.lit(0.0))
               for c in self.values]
        least = F.array_min(F.array(*far))
        return F.when(usable(self.features), (F.array_position(F.array(*far), least) - 1).cast("int"))

    def to_table(self, spark: SparkSession) -> DataFrame:
        """A row per centre and feature."""
        k, d = self.values.shape
        pdf = pd.DataFrame({"cluster": np.repeat(np.arange(k), d), "place": np.tile(np.arange(d), k), "feature": list(self.features) * k,
                            "value": self.values.ravel(), "cost": self.cost})
        return spark.createDataFrame(pdf, "cluster int, place int, feature string, value double, cost double")

    @staticmethod
    def from_table(table: DataFrame) -> Centers:
        pdf = table.toPandas().sort_values(["cluster", "place"])  # clusters x features rows
        features = tuple(pdf.loc[pdf["cluster"] == 0, "feature"])
        return Centers(features, pdf["value"].to_numpy().reshape(-1, len(features)), float(pdf["cost"].iloc[0]))


def usable(features: Sequence[str]) -> Column:
    """All features are finite numbers."""
    x = F.array(*[F.col(f).cast("double") for f in features])
    return F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))


def distinct_points(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """(features, n, h): usable points, their number and a hash of their values."""
    cols = [F.col(f).cast("double").alias(f) for f in features]
    return (rows.where(usable(features)).select(*cols).groupBy(*features).agg(F.count(F.lit(1)).alias("n"))
                .withColumn("h", F.xxhash64(*features)))


def _blocks(batch: pa.RecordBatch, features: Sequence[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    x = np.stack([batch.column(f).to_numpy(zero_copy_only=False) for f in features], axis=1)
    n, h = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("n", "h"))
    for at in range(0, len(x), ROWS):
        yield x[at : at + ROWS], n[at : at + ROWS].astype(np.float64), h[at : at + ROWS].view(np.uint64)


def _far(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """(rows, restarts, centres): squared distances."""
    out = np.zeros((len(x), *centers.shape[:2]))
    for f in range(x.shape[1]):
        out += (x[:, f, None, None] - centers[None, :, :, f]) ** 2
    return out


def lloyd_step(points: DataFrame, features: Sequence[str], centers: np.ndarray) -> DataFrame:
    """(restart, cluster, n, cost, sum of each feature) after every point of
    ``distinct_points`` went to the nearest of ``centers`` (restarts, k,
    features). Clusters without points have no row."""
    features, (r, k, d) = list(features), centers.shape
    names = ["restart", "cluster", "n", "cost", *(f"sum_{f}" for f in features)]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((r * k, d + 2))
        for batch in it:
            for x, n, _ in _blocks(batch, features):
                far = _far(x, centers)
                cell = (far.argmin(axis=2) + np.arange(r)[None, :] * k).ravel()
                for at, w in enumerate([np.ones_like(n), *x.T]):
                    total[:, at if at == 0 else at + 1] += np.bincount(cell, np.repeat(w * n, r), r * k)
                total[:, 1] += np.bincount(cell, (far.min(axis=2) * n[:, None]).ravel(), r * k)
        seen = np.flatnonzero(total[:, 0])
        columns = [pa.array((seen // k).astype(np.int32)), pa.array((seen % k).astype(np.int32)), *(pa.array(c) for c in total[seen].T)]
        yield pa.RecordBatch.from_arrays(columns, names=names)

    parts = points.mapInArrow(run, "restart int, cluster int, " + ", ".join(f"`{c}` double" for c in names[2:]))
    sums = [F.sum(f"`{c}`").alias(c) for c in names[3:]]
    return parts.groupBy("restart", "cluster").agg(F.sum("n").cast("long").alias("n"), *sums)


def _uniform(h: np.ndarray, *salt: int) -> np.ndarray:
    """Numbers in (0, 1) from hashes and a salt."""
    with np.errstate(over="ignore"):
        z = h.copy()
        for s in salt:
            z = (z ^ np.uint64(s + 1)) * np.uint64(0x9E3779B97F4A7C15)
            z ^= z >> np.uint64(29)
            z *= np.uint64(0xBF58476D1CE4E5B9)
            z ^= z >> np.uint64(32)
    return ((z >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)


def _next_seeds(points: DataFrame, features: Sequence[str], chosen: np.ndarray, restarts: int, seed: int) -> np.ndarray:
    """(restarts, features): the next centre of each restart, given ``chosen``
    (restarts, centres so far, features)."""
    features, step = list(features), chosen.shape[1]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, where = np.full(restarts, np.inf), np.full((restarts, len(features)), np.nan)
        for batch in it:
            for x, n, h in _blocks(batch, features):
                weight = n[:, None] * (_far(x, chosen).min(axis=2) if step else np.ones((1, restarts)))
                for r in range(restarts):
                    with np.errstate(divide="ignore"):
                        time = np.where(weight[:, r] > 0, -np.log(_uniform(h, seed, r, step)) / weight[:, r], np.finfo(float).max)
                    i = int(time.argmin())
                    if time[i] < best[r]:
                        best[r], where[r] = time[i], x[i]
        got = np.flatnonzero(best < np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(got.astype(np.int32)), pa.array(best[got]), *(pa.array(c) for c in where[got].T)],
                                         names=["restart", "time", *features])

    schema = "restart int, time double, " + ", ".join(f"`{f}` double" for f in features)
    first = points.mapInArrow(run, schema).groupBy("restart").agg(F.min(F.struct("time", *features)).alias("first"))
    rows = sorted((r["restart"], tuple(r["first"])[1:]) for r in first.collect())  # one a restart
    if not rows:
        raise ValueError("k-means needs at least one point without a missing feature")
    return np.array([v for _, v in rows])


def fit(rows: DataFrame, features: Sequence[str], k: int, restarts: int = 10, seed: int = 42, max_iter: int = 300, tol: float = 1e-4) -> Centers:
    """The centres of least cost among the restarts. Costs within 1e-9 of the
    least are equal, as the order of sums changes their last digits, and the
    first of equal restarts counts. A restart has settled when its centres' squared moves add up to at most
    ``tol``."""
    features = tuple(features)
    points = materialize(distinct_points(rows, features), "points").persist()
    try:
        centers = np.empty((restarts, 0, len(features)))
        for _ in range(k):
            centers = np.concatenate([centers, _next_seeds(points, features, centers, restarts, seed)[:, None, :]], axis=1)
        live = np.arange(restarts)
        for _ in range(max_iter):
            old = centers[live]
            new = old.copy()
            for row in lloyd_step(points, features, old).collect():  # at most restarts x k rows
                new[row["restart"], row["cluster"]] = np.array([row[f"sum_{f}"] for f in features]) / row["n"]
            centers[live] = new
            live = live[((new - old) ** 2).sum(axis=(1, 2)) > tol]
            if not len(live):
                break
        cost = np.zeros(restarts)
        for row in lloyd_step(points, features, centers).collect():
            cost[row["restart"]] += row["cost"]
    finally:
        points.unpersist()
    best = int(np.flatnonzero(cost <= cost.min() * (1 + 1e-9))[0])
    return Centers(features, centers[best], float(cost[best]))
