"""Customer personas: clustering, naming, traits, recovery (M13-M16,
A9-A11, J1, X5-X7).

Customer profiles are one aggregation of the transaction table; scaling
uses population statistics from one global aggregate; ``clustering`` fits the centres, all
``n_init`` restarts in the same passes. Cluster statistics and the persona
mapping are tiny (k rows).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revlens.functions import expressions as X
from revlens.operators import clustering
from revlens.operators.rollups import customer_profiles
from revlens.plans.joins import attach_one_row, small_table
from revlens.plans.materialize import materialize

PROFILE_FEATURES = ("sales", "margin_rate", "discount")


class SegmentationError(ValueError):
    pass


@dataclass(frozen=True)
class PersonaParams:
    k: int = 4
    n_init: int = 10
    seed: int = 42
    min_customers: int = 20
    max_iter: int = 300
    tol: float = 1e-4


def standardize(profiles: DataFrame, features=PROFILE_FEATURES) -> DataFrame:
    """(x - mean) / population std per feature (std 0 -> 1), from one global
    aggregate attached to every row."""
    return scale(profiles, scaling_of(profiles, features), features)


def scaling_of(profiles: DataFrame, features=PROFILE_FEATURES) -> DataFrame:
    """One row: mean and population std of each feature."""
    return profiles.agg(*[F.avg(f).alias(f"_m_{f}") for f in features],
                        *[F.stddev_pop(f).alias(f"_s_{f}") for f in features])


def scale(profiles: DataFrame, scaling: DataFrame, features=PROFILE_FEATURES) -> DataFrame:
    """Apply a scaling row to profiles."""
    out = attach_one_row(profiles, scaling)
    for f in features:
        s = F.when(F.col(f"_s_{f}") > 0, F.col(f"_s_{f}")).otherwise(F.lit(1.0))
        out = out.withColumn(f"z_{f}", (F.col(f).cast("double") - F.col(f"_m_{f}")) / s)
    return out.drop(*[f"_m_{f}" for f in features], *[f"_s_{f}" for f in features])


def cluster_customers(tx: DataFrame, params: PersonaParams = PersonaParams()):
    """Returns (clustered profiles with ``cluster``, silhouette,
    (centres, scaling row)). Profiles are written once, as every pass reads
    them; one with a missing feature gets no cluster.
    Silhouette is MLlib's ClusteringEvaluator (squared Euclidean, linear in
    the number of customers; NULL for a single cluster); ``exact_silhouette`` is the Euclidean form."""
    prof = materialize(customer_profiles(tx).withColumn("sales", F.col("sales").cast("double")), "profiles")
    n = prof.count()
    if n < params.min_customers:
        raise SegmentationError(f"need >= {params.min_customers} customers, got {n}")
    scaling = materialize(scaling_of(prof), "scaling")
    z = [f"z_{f}" for f in PROFILE_FEATURES]
    scaled = scale(prof, scaling)
    model = clustering.fit(scaled, z, params.k, params.n_init, params.seed, params.max_iter, params.tol)
    out = scaled.withColumn("cluster", model.nearest())
    known = VectorAssembler(inputCols=z, outputCol="features").transform(out.where(F.col("cluster").isNotNull()))
    several = known.agg(F.min("cluster") < F.max("cluster")).first()[0]
    sil = round(ClusteringEvaluator(featuresCol="features", predictionCol="cluster").evaluate(known), 3) if several else None
    return out, sil, (model, scaling)


def assign_clusters(profiles: DataFrame, model: clustering.Centers, scaling: DataFrame) -> DataFrame:
    """``profiles`` with the cluster of each, also of customers that weren't in
    the fit: scaled as the fitted ones were, then the nearest centre."""
    return scale(profiles, scaling).withColumn("cluster", model.nearest())


#: Rows whose distances to as many others are one piece of work, the least that are worth one, and the sums of a piece at most.
SILHOUETTE_BLOCK, SILHOUETTE_LEAST, SILHOUETTE_SUMS = 65_536, 512, 1 << 22
#: Rows and columns of distances at once (they stay in the cache), and blocks' sums that are added up at once.
DISTANCE_TILE, MERGED_SUMS = (64, 512), 64


def exact_silhouette(clustered: DataFrame, features, cluster: str = "cluster", most: int | None = None, seed: int = 42) -> DataFrame:
    """M14, the exact Euclidean form: one row (silhouette, n_rows, n_clusters).

    Every row's mean distance to its own cluster's other rows (a) and to the
    nearest other cluster (b) give (b - a) / max(a, b); a cluster's only row
    gives 0, and fewer than two clusters give NULL. All rows take part, so
    distances grow with the square of the rows: rows are dealt into blocks, and
    each pair of blocks is a piece of work of its own, which gives both blocks
    their sums of distances to the other's clusters. A task holds two blocks.

    ``most``: only if given, and only beyond so many rows, each cluster's share
    of about ``most`` rows (one at least) takes part, by a hash of the row.
    """
    features = list(features)
    rows = clustered.select(*[F.col(f).cast("double").alias(f) for f in features], F.col(cluster).cast("long").alias("cluster"))
    rows = rows.where(F.col("cluster").isNotNull() & F.forall(F.array(*features), lambda x: x.isNotNull() & ~F.isnan(x)))
    if most is not None and (n := rows.count()) > most:
        first = Window.partitionBy("cluster").orderBy(F.xxhash64(F.lit(seed), *features), *features)
        sizes = small_table(rows.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) * F.lit(most / n)).alias("_take")), "sizes")
        share = F.pmod(F.xxhash64(F.lit(seed), *features), F.lit(1 << 20)) < F.lit(int(min(1.0, 4 * most / n) * (1 << 20)))
        # the hash thins large clusters before their rows are ranked
        thin = rows.join(sizes, "cluster").where(share | (F.col("_take") <= 64))
        rows = thin.withColumn("_nth", F.row_number().over(first)).where(F.col("_nth") <= F.col("_take")).drop("_nth", "_take")
    rows = materialize(rows, "silhouette")
    counts = sorted(rows.groupBy("cluster").count().collect())  # a row per cluster
    names, size = np.array([c[0] for c in counts], np.int64), np.array([c[1] for c in counts], np.float64)
    if len(names) < 2:
        return rows.agg(F.lit(None).cast("double").alias("silhouette"), F.count(F.lit(1)).alias("n_rows"), F.lit(len(names)).cast("long").alias("n_clusters"))
    n, tasks = int(size.sum()), clustered.sparkSession.sparkContext.defaultParallelism
    most_rows = max(SILHOUETTE_LEAST, min(SILHOUETTE_BLOCK, SILHOUETTE_SUMS // len(names)))
    parts = max(-(-n // most_rows), min(int(np.ceil(np.sqrt(8 * tasks))), -(-n // SILHOUETTE_LEAST)))
    scores = silhouette_scores(distance_sums(point_blocks(rows, features, names, parts), len(features), len(names), parts), size, parts)
    return scores.agg((F.sum("s") / F.sum("n")).alias("silhouette"), F.sum("n").alias("n_rows")).withColumn("n_clusters", F.lit(len(names)).cast("long"))


def point_blocks(rows: DataFrame, features: list[str], names: np.ndarray, parts: int) -> DataFrame:
    """The rows in ``parts`` blocks of about as many: (block, points, own), the
    points as an array (features x rows) and their clusters' places among
    ``names`` in ascending order. Written once, as each block goes to many tasks."""
    def run(it):
        held = pa.Table.from_batches([b for b in it if b.num_rows] or [pa.RecordBatch.from_pylist([], schema)])
        own = np.searchsorted(names, held.column("cluster").to_numpy())
        order = np.argsort(own, kind="stable")
        points = np.stack([held.column(f).to_numpy()[order] for f in features])
        if len(order):
            packed = [pa.array([v.tobytes()], pa.binary()) for v in (points, own[order].astype(np.int64))]
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), *packed], names=["block", "points", "own"])

    schema = pa.schema([*[(f, pa.float64()) for f in features], ("cluster", pa.int64())])
    return materialize(rows.repartition(parts).mapInArrow(run, "block int, points binary, own binary"), "blocks")


def distance_sums(blocks: DataFrame, features: int, clusters: int, parts: int) -> DataFrame:
    """(block, other, own, sums): the sums of distances from each point of
    ``block`` to each cluster's points in ``other`` (points x clusters). ``own``
    is only given where both are the same."""
    def run(table: pa.Table) -> pa.Table:
        block, points, own = (table.column(c) for c in ("block", "points", "own"))
        x, y = (np.frombuffer(points[i].as_buffer()).reshape(features, -1) for i in (0, table.num_rows - 1))
        kx, ky = (np.frombuffer(own[i].as_buffer(), np.int64) for i in (0, table.num_rows - 1))
        to_y, to_x = cluster_distances(x, y, kx, ky, clusters, both=table.num_rows > 1)
        if table.num_rows == 1:
            return pa.table({"block": block, "other": block, "own": own, "sums": pa.array([to_y.tobytes()], pa.binary())})
        return pa.table({"block": block, "other": pa.array([block[1].as_py(), block[0].as_py()], pa.int32()), "own": pa.nulls(2, pa.binary()),
                         "sums": pa.array([to_y.tobytes(), to_x.tobytes()], pa.binary())})

    other = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    met = blocks.withColumn("_other", other).select(F.least("block", "_other").alias("_low"), F.greatest("block", "_other").alias("_high"), *blocks.columns)
    # a number of partitions that isn't cut down, as the blocks are few bytes and much work
    pairs = parts * (parts + 1) // 2
    return met.repartition(min(pairs, 4_096), "_low", "_high").groupBy("_low", "_high").applyInArrow(run, "block int, other int, own binary, sums binary")


def cluster_distances(x: np.ndarray, y: np.ndarray, own_x: np.ndarray, own_y: np.ndarray, clusters: int, both: bool) -> tuple:
    """Sums of distances from each point of ``x`` (features x points) to each
    cluster's points of ``y``, and (``both``) from those of ``y`` to ``x``'s."""
    high, wide = DISTANCE_TILE
    to_y, to_x = np.zeros((x.shape[1], clusters)), np.zeros((y.shape[1], clusters))
    spare = np.empty((2, high, wide))
    kinds = np.arange(clusters)
    for at in range(0, x.shape[1], high):
        left = x[:, at : at + high]
        in_x = (own_x[at : at + high] == kinds[:, None]).astype(np.float64)
        for to in range(0, y.shape[1], wide):
            right = y[:, to : to + wide]
            far, step = spare[:, : left.shape[1], : right.shape[1]]
            far[:] = 0.0
            for a, b in zip(left, right):
                np.subtract(a[:, None], b, out=step)
                np.multiply(step, step, out=step)
                np.add(far, step, out=far)
            np.sqrt(far, out=far)
            to_y[at : at + high] += far @ (own_y[to : to + wide, None] == kinds).astype(np.float64)
            if both:
                to_x[to : to + wide] += (in_x @ far).T
    return to_y, to_x


def silhouette_scores(sums: DataFrame, size: np.ndarray, parts: int) -> DataFrame:
    """(s, n): each block's sum of the rows' scores, and its rows."""
    shape = "block int, other int, own binary, sums binary"

    def added(table: pa.Table) -> tuple:
        order = np.argsort(table.column("other").to_numpy())
        total = sum(np.frombuffer(table.column("sums")[int(i)].as_buffer()) for i in order)
        return table.column("own").drop_null(), total, table.column("other")[int(order[0])].as_py()

    def add(table: pa.Table) -> pa.Table:
        own, total, other = added(table)
        return pa.table({"block": table.column("block")[:1], "other": pa.array([other], pa.int32()), "own": pa.array([own[0].as_py() if len(own) else None], pa.binary()),
                         "sums": pa.array([total.tobytes()], pa.binary())})

    def score(table: pa.Table) -> pa.Table:
        own, total, _ = added(table)
        k = np.frombuffer(own[0].as_buffer(), np.int64)
        far, each = total.reshape(len(k), -1).copy(), np.arange(len(k))
        a = far[each, k] / np.maximum(size[k] - 1, 1)
        far /= size
        far[each, k] = np.inf
        b = far.min(axis=1)
        s = np.where((size[k] > 1) & (np.maximum(a, b) > 0), (b - a) / np.maximum(np.maximum(a, b), 1e-300), 0.0)
        return pa.table({"s": [float(s.sum())], "n": [len(k)]})

    some = parts
    while some > MERGED_SUMS:
        some = -(-some // MERGED_SUMS)
        sums = sums.groupBy("block", F.pmod(F.xxhash64("other"), F.lit(some))).applyInArrow(add, shape)
    return sums.groupBy("block").applyInArrow(score, "s double, n long")


def cluster_stats(clustered: DataFrame) -> DataFrame:
    """Per cluster the mean of each profile feature and the size."""
    return clustered.groupBy("cluster").agg(
        X.exact_avg("sales", 6).alias("avg_sales"), X.exact_avg("margin_rate").alias("avg_margin"),
        X.exact_avg("discount").alias("avg_discount"), F.count(F.lit(1)).alias("n_customers"))


def name_personas(stats: DataFrame) -> DataFrame:
    """Champions = highest mean margin, Discount Seekers = highest
    mean discount, Volume Accounts = highest mean sales (ties -> lowest
    cluster id), the rest At-Risk; when one cluster wins several, Volume
    overrides Seekers overrides Champions. ``stats`` has k rows."""
    def arg_max(c):
        return F.max_by(F.col("cluster"), F.struct(F.col(c), -F.col("cluster")))
    winners = stats.agg(arg_max("avg_margin").alias("_champ"), arg_max("avg_discount").alias("_seek"),
                        arg_max("avg_sales").alias("_vol"))
    j = attach_one_row(stats, winners)
    c = F.col("cluster")
    name = (F.when(c == F.col("_vol"), X.PERSONA_VOLUME).when(c == F.col("_seek"), X.PERSONA_SEEKERS)
             .when(c == F.col("_champ"), X.PERSONA_CHAMPIONS).otherwise(X.PERSONA_AT_RISK))
    return (j.withColumn("persona", name).withColumn("action_signal", X.action_signal(F.col("persona")))
             .drop("_champ", "_seek", "_vol"))


def assign_personas(clustered: DataFrame, naming: DataFrame) -> DataFrame:
    """Cluster -> persona (k-row table, broadcast: bounded by k)."""
    return clustered.join(F.broadcast(naming.select("cluster", "persona")), "cluster", "left")


def roi_recovery(assigned: DataFrame) -> DataFrame:
    """max(0, (mean margin of Champions - mean margin of Seekers) x
    total sales of Seekers); 0 when either persona is empty. One pass."""
    p = F.col("persona")
    agg = assigned.agg(
        X.exact_avg(F.when(p == X.PERSONA_CHAMPIONS, F.col("margin_rate"))).alias("champions_margin"),
        X.exact_avg(F.when(p == X.PERSONA_SEEKERS, F.col("margin_rate"))).alias("seekers_margin"),
        F.sum(F.when(p == X.PERSONA_SEEKERS, F.col("sales").cast("double"))).alias("seekers_sales"))
    gap = F.col("champions_margin") - F.col("seekers_margin")
    val = F.when(F.col("champions_margin").isNull() | F.col("seekers_margin").isNull(), F.lit(0.0)) \
        .otherwise(F.greatest(F.lit(0.0), gap * F.col("seekers_sales")))
    return agg.withColumn("recovery_usd", F.round(val, 2))


def persona_traits(assigned: DataFrame, tx: DataFrame, naming: DataFrame) -> DataFrame:
    """One row per persona: label, churn risk, mean customer total sales
    (``avg_customer_sales``), mean discount, mean margin, size, and the most
    frequent region of its customers' transactions (ties -> smallest)."""
    stats = naming.select("cluster", "persona", "avg_sales", "avg_discount", "avg_margin", "n_customers")
    cust = assigned.select("customer", "cluster")
    # pre-aggregate transactions to (customer, region) counts before joining
    per_cust = tx.groupBy("customer", "region").agg(F.count(F.lit(1)).alias("_c"))
    regions = (per_cust.join(cust, "customer")
                       .groupBy("cluster", "region").agg(F.sum("_c").alias("_n")))
    mx = regions.groupBy("cluster").agg(F.max("_n").alias("_max_n"))
    # most frequent region; ties -> smallest region name
    top_region = (regions.join(mx, "cluster").where(F.col("_n") == F.col("_max_n"))
                         .groupBy("cluster").agg(F.min("region").alias("top_region")))
    j = stats.join(top_region, "cluster", "left")
    return j.select(
        "persona", "cluster",
        X.persona_label(F.col("avg_sales"), F.col("avg_discount"), F.col("avg_margin")).alias("persona_label"),
        X.churn_risk(F.col("avg_discount"), F.col("avg_margin")).alias("churn_risk"),
        F.round("avg_sales", 2).alias("avg_customer_sales"), F.round("avg_discount", 4).alias("avg_discount"),
        F.round("avg_margin", 4).alias("avg_margin"), F.col("n_customers").alias("cluster_size"),
        F.coalesce("top_region", F.lit("Global")).alias("top_region"))
