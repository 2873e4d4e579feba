"""Train-once model cache (per session, keyed by input path and params), and
saving and loading of the fitted models (S7).

All pillars read one written clean table (``clean_table``): the star join and
the margin features run once for a composite query, not once per pillar.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

from revlens.operators import forecast as FC
from revlens.operators import margin as MG
from revlens.operators import personas as PS
from revlens.operators import rollups as R
from revlens.operators.boosting import Trees
from revlens.operators.clustering import Centers
from revlens.plans.joins import small_table
from revlens.plans.materialize import materialize, release
from revlens.sources import tables as S

_CACHE: dict = {}


def _key(spark: SparkSession, *parts):
    return (id(spark._jsparkSession), *parts)


def _cached(spark: SparkSession, name: str, *parts, make):
    k = _key(spark, name, *parts)
    if k not in _CACHE:
        _CACHE[k] = make()
    return _CACHE[k]


def clear(spark: SparkSession | None = None) -> None:
    """Forget all models and remove the tables written for them."""
    _CACHE.clear()
    release(spark)


def clean_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clean transactions with margin features, written once."""
    return _cached(spark, "clean", sf_dir, make=lambda: materialize(
        R.margin_features(S.transactions(spark, sf_dir)), "clean"))


def monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cached(spark, "monthly", sf_dir, make=lambda: materialize(
        R.monthly_rollup(clean_table(spark, sf_dir)), "monthly"))


def margin_model(spark: SparkSession, sf_dir: str, params: MG.MarginParams = MG.MarginParams(),
                 metrics_now: bool = False) -> MG.MarginModel:
    return _cached(spark, "margin", sf_dir, params,
                   make=lambda: MG.train_margin_model(clean_table(spark, sf_dir), params, metrics_now))


def ceilings(spark: SparkSession, sf_dir: str, params: MG.MarginParams = MG.MarginParams()) -> DataFrame:
    return _cached(spark, "ceilings", sf_dir, params, make=lambda: small_table(
        MG.discount_ceilings(margin_model(spark, sf_dir, params), clean_table(spark, sf_dir), params), "ceilings"))


def clusters(spark: SparkSession, sf_dir: str, params: PS.PersonaParams = PS.PersonaParams()):
    """(clustered profiles, silhouette)."""
    def make():
        clustered, sil, _ = PS.cluster_customers(clean_table(spark, sf_dir), params)
        return materialize(clustered, "clusters"), sil
    return _cached(spark, "clusters", sf_dir, params, make=make)


def forecast_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cached(spark, "forecast", sf_dir, make=lambda: materialize(
        FC.segment_models(monthly(spark, sf_dir)), "forecast"))


def train_all(spark: SparkSession, sf_dir: str) -> None:
    """Train the three pillars (margin model + ceilings, customer clusters,
    forecast models) at once: they are independent, and their many small jobs
    leave executors idle when run one after another."""
    clean_table(spark, sf_dir)

    def margin():
        margin_model(spark, sf_dir, metrics_now=True)
        ceilings(spark, sf_dir)

    with ThreadPoolExecutor(max_workers=3) as pool:
        for f in [pool.submit(margin), pool.submit(clusters, spark, sf_dir), pool.submit(forecast_models, spark, sf_dir)]:
            f.result()


def save_margin_model(model: MG.MarginModel, path: str) -> None:
    """The trees' nodes, encoders, medians, metrics and importances as Parquet."""
    spark = model.encoders.sparkSession
    model.model.to_table(spark).write.mode("overwrite").parquet(f"{path}/trees")
    model.encoders.write.mode("overwrite").parquet(f"{path}/encoders")
    model.medians.write.mode("overwrite").parquet(f"{path}/medians")
    if model.representatives is not None:
        model.representatives.write.mode("overwrite").parquet(f"{path}/representatives")
    spark.createDataFrame([(model.r2, model.mae)], "r2 double, mae double").write.mode("overwrite").parquet(
        f"{path}/metrics")
    spark.createDataFrame(model.importances, "feature string, importance double").write.mode(
        "overwrite").parquet(f"{path}/importances")


def load_margin_model(spark: SparkSession, path: str) -> MG.MarginModel:
    m = spark.read.parquet(f"{path}/metrics").first()
    imp = [(r.feature, r.importance) for r in spark.read.parquet(f"{path}/importances").collect()]
    imp.sort(key=lambda t: (-t[1], t[0]))
    return MG.MarginModel(model=Trees.from_table(spark.read.parquet(f"{path}/trees"), MG.FEATURES),
                          encoders=spark.read.parquet(f"{path}/encoders"),
                          medians=spark.read.parquet(f"{path}/medians"),
                          importances=imp, metrics={"r2": m.r2, "mae": m.mae})


def save_clusters(model: Centers, scaling: DataFrame, path: str) -> None:
    """The centres and the means and deviations they were fitted with."""
    model.to_table(scaling.sparkSession).write.mode("overwrite").parquet(f"{path}/centers")
    scaling.write.mode("overwrite").parquet(f"{path}/scaling")


def load_clusters(spark: SparkSession, path: str) -> tuple[Centers, DataFrame]:
    """What ``personas.assign_clusters`` needs."""
    return Centers.from_table(spark.read.parquet(f"{path}/centers")), spark.read.parquet(f"{path}/scaling")


def save_forecast(models: DataFrame, path: str) -> None:
    """Coefficients, scaling and back-test figures per segment."""
    models.write.mode("overwrite").parquet(path)


def load_forecast(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
