"""Per-segment revenue forecast: trend + Fourier ridge regression (M1-M7,
A12, A14, W1-W3, W6, J7, U1).

The input is the monthly rollup (segments x months rows), so after A1's
shuffle everything here works on a table whose size is set by the calendar,
not by the data volume. The ridge fit is expressed as aggregations: per
(segment, split) the centred Gram matrix and cross-products are summed in
Spark; the 8x8 solve per row is a vectorised pandas UDF (NumPy), after which
predictions are dot products computed with higher-order array functions.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revlens.functions import expressions as X
from revlens.plans.materialize import materialize

# Model constants.
N_FOURIER = 3
SEASON = 12
MIN_MONTHS = 12
HOLDOUT = 6
RIDGE_ALPHA = 1.0
Z_95 = 1.96

FEATURES = ("t", "t2") + tuple(f"{f}{k}" for k in range(1, N_FOURIER + 1) for f in ("sin", "cos"))
N_FEAT = len(FEATURES)


class ForecastError(ValueError):
    pass


@dataclass(frozen=True)
class ForecastParams:
    holdout: int = HOLDOUT
    alpha: float = RIDGE_ALPHA
    min_months: int = MIN_MONTHS
    z: float = Z_95
    periods: int = 3
    calendar: bool = False   # time index by calendar month, so gaps count


def feature_columns(t: Column) -> list[Column]:
    """M1: [t, t^2, sin(2 pi k t / 12), cos(2 pi k t / 12) for k = 1..3]."""
    cols = [t.alias("t"), (t * t).alias("t2")]
    for k in range(1, N_FOURIER + 1):
        ang = F.lit(2 * math.pi * k / SEASON) * t
        cols += [F.sin(ang).alias(f"sin{k}"), F.cos(ang).alias(f"cos{k}")]
    return cols


def forecast_design(monthly: DataFrame, params: ForecastParams = ForecastParams(),
                    key: str = "segment", value: str = "sales") -> DataFrame:
    """Positional time index per segment (month gaps collapse;
    with ``params.calendar`` the months since the segment's first one), series
    length T, features, target standardised by the full-series mean
    and population std (std < 1e-6 -> 1), and the hold-out flag for the last
    min(holdout, T div 3) positions."""
    w = Window.partitionBy(key).orderBy("month")
    wall = Window.partitionBy(key)
    d = (monthly.select(key, "month", F.col(value).cast("double").alias("y"))
                .withColumn("t_idx", (F.row_number().over(w) - 1).cast("int"))
                .withColumn("n_months", F.count(F.lit(1)).over(wall).cast("int"))
                .withColumn("y_mean", F.avg("y").over(wall))
                .withColumn("y_std_raw", F.stddev_pop("y").over(wall)))
    d = d.withColumn("y_std", F.when(F.col("y_std_raw") < 1e-6, F.lit(1.0)).otherwise(F.col("y_std_raw")))
    d = d.withColumn("y_s", (F.col("y") - F.col("y_mean")) / F.col("y_std"))
    hold = F.least(F.lit(params.holdout), F.floor(F.col("n_months") / 3).cast("int"))
    d = d.withColumn("is_train", F.col("t_idx") < F.col("n_months") - hold)
    if params.calendar:
        since = F.round(F.months_between("month", F.min("month").over(wall))).cast("int")
        d = d.withColumn("t_idx", since).withColumn("n_months", F.max("t_idx").over(wall) + 1)
    t = F.col("t_idx").cast("double")
    return d.select(key, "month", "t_idx", "n_months", "y", "y_mean", "y_std", "y_s", "is_train",
                    *feature_columns(t))


def _gram(design: DataFrame, key: str) -> DataFrame:
    """Per (key, split): n, feature means, target mean, centred X'X (upper
    triangle, row-major) and X'y, all as sums over the split's rows."""
    split = F.explode(F.array(F.lit("full"), F.when(F.col("is_train"), F.lit("train"))))
    rows = design.withColumn("split", split).where(F.col("split").isNotNull())
    w = Window.partitionBy(key, "split")
    for f in FEATURES:
        rows = rows.withColumn(f"m_{f}", F.avg(f).over(w))
    rows = rows.withColumn("m_y", F.avg("y_s").over(w))
    cen = {f: F.col(f) - F.col(f"m_{f}") for f in FEATURES}
    yc = F.col("y_s") - F.col("m_y")
    gram = [F.sum(cen[a] * cen[b]) for i, a in enumerate(FEATURES) for b in FEATURES[i:]]
    xty = [F.sum(cen[a] * yc) for a in FEATURES]
    return rows.groupBy(key, "split").agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*[F.first(f"m_{f}") for f in FEATURES]).alias("x_mean"),
        F.first("m_y").alias("y_mean_s"),
        F.array(*gram).alias("gram"),
        F.array(*xty).alias("xty"))


def _solver(alpha: float):
    iu = np.triu_indices(N_FEAT)

    @F.pandas_udf("array<double>")
    def solve(gram: pd.Series, xty: pd.Series) -> pd.Series:
        out = []
        for g, b in zip(gram, xty):
            m = np.zeros((N_FEAT, N_FEAT))
            m[iu] = np.asarray(g, dtype=float)
            m = m + np.triu(m, 1).T + alpha * np.eye(N_FEAT)
            out.append(np.linalg.solve(m, np.asarray(b, dtype=float)).tolist())
        return pd.Series(out)
    return solve


def dot(coef: Column, feats: list[Column]) -> Column:
    """sum_i coef[i] * feats[i] with array higher-order functions."""
    return F.aggregate(F.zip_with(coef, F.array(*feats), lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x)


def fit(design: DataFrame, params: ForecastParams = ForecastParams(), key: str = "segment",
        check: bool = True) -> DataFrame:
    """M2/M3: ridge with an unpenalised intercept per (segment, split).
    Segments with T < min_months are skipped; raise when none is left."""
    eligible = design.where(F.col("n_months") >= params.min_months)
    if check and eligible.limit(1).count() == 0:
        raise ForecastError(f"no segment has >= {params.min_months} months of history")
    g = _gram(eligible, key)
    coef = _solver(params.alpha)(F.col("gram"), F.col("xty"))
    g = g.withColumn("coef", coef)
    icpt = F.col("y_mean_s") - dot(F.col("coef"), [F.col("x_mean")[i] for i in range(N_FEAT)])
    return g.select(key, "split", "n", "coef", icpt.alias("intercept"))


def coefficients(monthly: DataFrame, params: ForecastParams = ForecastParams(), key: str = "segment") -> DataFrame:
    return fit(forecast_design(monthly, params, key), params, key)


def _predict_s(coef_df: DataFrame, design: DataFrame, key: str) -> DataFrame:
    feats = [F.col(f) for f in FEATURES]
    j = design.join(coef_df, key)
    return j.withColumn("yhat_s", F.col("intercept") + dot(F.col("coef"), feats))


def segment_models(monthly: DataFrame, params: ForecastParams = ForecastParams(), key: str = "segment") -> DataFrame:
    """One row per segment: full-fit coefficients, hold-out R2 (3 dp),
    residual population std (scaled units), mean/std, T and last month."""
    design = materialize(forecast_design(monthly, params, key), "design")
    co = materialize(fit(design, params, key), "coefficients")
    train = co.where(F.col("split") == "train").select(key, "coef", "intercept")
    full = co.where(F.col("split") == "full").select(key, "coef", "intercept")
    hold = _predict_s(train, design.where(~F.col("is_train")), key)
    w = Window.partitionBy(key)
    hold = hold.withColumn("_ym", F.avg("y_s").over(w))
    sse, sst = F.sum(F.pow(F.col("y_s") - F.col("yhat_s"), 2)), F.sum(F.pow(F.col("y_s") - F.col("_ym"), 2))
    # constant hold-out target: 1 for a perfect fit, else 0 (finite R2)
    r2v = F.when(sst == 0, F.when(sse == 0, F.lit(1.0)).otherwise(F.lit(0.0))).otherwise(1 - F.try_divide(sse, sst))
    r2 = hold.groupBy(key).agg(F.round(r2v, 3).alias("r2_validation"))
    ins = _predict_s(full, design, key)
    stats = ins.groupBy(key).agg(
        F.stddev_pop(F.col("y_s") - F.col("yhat_s")).alias("resid_std_s"),
        F.first("y_mean").alias("y_mean"), F.first("y_std").alias("y_std"),
        F.first("n_months").alias("n_months"), F.max("month").alias("last_month"))
    return full.join(r2, key, "left").join(stats, key)


def segment_forecast(models: DataFrame, params: ForecastParams = ForecastParams(),
                     key: str = "segment") -> DataFrame:
    """M4: h = 1..periods: yhat = (b0 + x.w) * std + mean at t = T + h - 1,
    interval yhat +- z * resid_std * std, label = last month + h, 2 dp."""
    if params.periods < 1:
        raise ValueError(f"periods must be >= 1, got {params.periods}")
    h = models.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(params.periods))))
    t = (F.col("n_months") + F.col("step") - 1).cast("double")
    feats = [c for c in feature_columns(t)]
    yhat = (F.col("intercept") + dot(F.col("coef"), feats)) * F.col("y_std") + F.col("y_mean")
    band = F.lit(params.z) * F.col("resid_std_s") * F.col("y_std")
    return h.select(key, "step", F.add_months("last_month", F.col("step")).alias("month"),
                    F.round(yhat, 2).alias("yhat"), F.round(yhat - band, 2).alias("yhat_lower"),
                    F.round(yhat + band, 2).alias("yhat_upper"), "r2_validation")


def forecast_global(fc: DataFrame, segment: str | None = None, key: str = "segment") -> DataFrame:
    """Sum over segments by horizon step (not by date), mean R2;
    month labels are reported as the min/max over segments."""
    if segment is not None:
        if fc.where(F.col(key) == segment).limit(1).count() == 0:
            raise ForecastError(f"segment {segment!r} has no trained model")
        fc = fc.where(F.col(key) == segment)
    return fc.groupBy("step").agg(
        F.round(F.sum("yhat"), 2).alias("yhat"), F.round(F.sum("yhat_lower"), 2).alias("yhat_lower"),
        F.round(F.sum("yhat_upper"), 2).alias("yhat_upper"),
        F.round(F.avg("r2_validation"), 3).alias("r2"),
        F.min("month").alias("first_label"), F.max("month").alias("last_label"),
        F.count(F.lit(1)).alias("n_segments"))


def forecast_vs_current(fc: DataFrame, monthly: DataFrame, key: str = "segment") -> DataFrame:
    """Next-period forecast next to the last actual per segment,
    pct change (0 when current <= 0), trend label."""
    cur = monthly.groupBy(key).agg(F.max_by(F.col("sales").cast("double"), F.col("month")).alias("current_revenue"))
    nxt = fc.where(F.col("step") == 1)
    j = nxt.join(cur, key, "left").withColumn("current_revenue", F.coalesce("current_revenue", F.lit(0.0)))
    pct = X.pct_change(F.col("yhat"), F.col("current_revenue"))
    return j.select(key, F.col("yhat").alias("next_period_revenue"),
                    F.col("yhat_lower").alias("confidence_lower"), F.col("yhat_upper").alias("confidence_upper"),
                    "current_revenue", pct.alias("pct_change_vs_current"),
                    X.trend(pct).alias("trend_direction"), "r2_validation")


def aggregate_outlook(fvc: DataFrame) -> DataFrame:
    """Aggregate % change of next vs current totals and a +-5 % trend."""
    agg = fvc.agg(F.sum("next_period_revenue").alias("total_next_period_revenue"),
                  F.sum("current_revenue").alias("total_current_revenue"))
    pct = X.pct_change(F.col("total_next_period_revenue"), F.col("total_current_revenue"))
    return agg.withColumn("aggregate_pct_change", pct).withColumn("aggregate_trend", X.trend(pct))


# Display-mode growth per forecast step (reference chart).
DISPLAY_GROWTH = {"Enterprise": 0.02, "SMB": 0.01, "Strategic": 0.03}


def forecast_chart(monthly: DataFrame, fc: DataFrame, last: int = 12, key: str = "segment",
                   display: bool = False, growth: dict[str, float] | None = None) -> DataFrame:
    """Last n history months plus the forecast steps, flagged.
    ``display=True`` reproduces the reference chart: the first-step forecast
    grown by a per-segment factor (1 + g * i), of the table ``growth``, instead
    of the real steps."""
    from revlens.operators.rollups import last_months
    hist = last_months(monthly, last).select(key, "month", F.col("sales").cast("double").alias("sales"),
                                             F.lit(False).alias("is_forecast"), F.lit(0).alias("step"))
    if display:
        first = fc.where(F.col("step") == 1).select(key, "month", "yhat")
        g = _growth(F.col(key), DISPLAY_GROWTH if growth is None else growth)
        fut = (first.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(3))))
                    .select(key, F.add_months("month", F.col("step") - 1).alias("month"),
                            (F.col("yhat") * (1 + g * (F.col("step") - 1))).alias("sales"),
                            F.lit(True).alias("is_forecast"), "step"))
    else:
        fut = fc.select(key, "month", F.col("yhat").alias("sales"), F.lit(True).alias("is_forecast"), "step")
    return hist.unionByName(fut)


def _growth(c: Column, table: dict[str, float]) -> Column:
    expr = F.lit(0.0)
    for k, v in table.items():
        expr = F.when(c == k, F.lit(v)).otherwise(expr)
    return expr
