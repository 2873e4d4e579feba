import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from revlens.operators import forecast as FC


def _monthly(spark, series: dict):
    rows = []
    for seg, ys in series.items():
        for i, y in enumerate(ys):
            m = dt.date(2018 + i // 12, i % 12 + 1, 1)
            rows.append((m, seg, float(y)))
    return spark.createDataFrame(rows, "month date, segment string, sales double")


def _numpy_ridge(y, alpha=1.0, holdout=6):
    T = len(y)
    t = np.arange(T, dtype=float)
    X = np.column_stack([t, t ** 2] + [f(2 * np.pi * k * t / 12) for k in (1, 2, 3) for f in (np.sin, np.cos)])
    mu, sd = y.mean(), y.std()
    sd = 1.0 if sd < 1e-6 else sd
    ys = (y - mu) / sd

    def fit(X, y):
        xm, ym = X.mean(0), y.mean()
        Xc, yc = X - xm, y - ym
        w = np.linalg.solve(Xc.T @ Xc + alpha * np.eye(X.shape[1]), Xc.T @ yc)
        return w, ym - xm @ w
    h = min(holdout, T // 3)
    w_tr, b_tr = fit(X[:-h], ys[:-h])
    pred = X[-h:] @ w_tr + b_tr
    r2 = 1 - ((ys[-h:] - pred) ** 2).sum() / ((ys[-h:] - ys[-h:].mean()) ** 2).sum()
    w, b = fit(X, ys)
    resid = (ys - (X @ w + b)).std()
    tf = np.arange(T, T + 3, dtype=float)
    Xf = np.column_stack([tf, tf ** 2] + [f(2 * np.pi * k * tf / 12) for k in (1, 2, 3) for f in (np.sin, np.cos)])
    yhat = (Xf @ w + b) * sd + mu
    return w, b, round(r2, 3), yhat, 1.96 * resid * sd


def test_ridge_matches_numpy_closed_form(spark):
    rng = np.random.default_rng(3)
    a = 1000 + 10 * np.arange(40) + 50 * np.sin(np.arange(40)) + rng.normal(0, 20, 40)
    b = 500 + rng.normal(0, 5, 30)
    monthly = _monthly(spark, {"A": a, "B": b})
    models = FC.segment_models(monthly)
    fc = FC.segment_forecast(models).collect()
    for seg, y in (("A", a), ("B", b)):
        w, b0, r2, yhat, band = _numpy_ridge(np.asarray(y))
        row = models.where(F.col("segment") == seg).first()
        assert np.allclose(row.coef, w, atol=1e-8) and abs(row.intercept - b0) < 1e-8
        assert row.r2_validation == r2
        got = sorted([r for r in fc if r.segment == seg], key=lambda r: r.step)
        assert np.allclose([r.yhat for r in got], np.round(yhat, 2), atol=0.011)
        for r in got:
            assert r.yhat_lower <= r.yhat <= r.yhat_upper
            assert abs((r.yhat_upper - r.yhat_lower) / 2 - band) < 0.02


def test_matches_mllib_ridge(spark):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression
    rng = np.random.default_rng(5)
    y = 100 + np.arange(36) * 3 + rng.normal(0, 4, 36)
    design = FC.forecast_design(_monthly(spark, {"S": y}))
    full = FC.fit(design).where("split = 'full'").first()
    n = 36
    label_std = float(np.asarray(((y - y.mean()) / y.std())).std())
    va = VectorAssembler(inputCols=list(FC.FEATURES), outputCol="f")
    lr = LinearRegression(featuresCol="f", labelCol="y_s", solver="normal", standardization=False,
                          elasticNetParam=0.0, regParam=1.0 / n * label_std)
    m = lr.fit(va.transform(design))
    assert np.allclose(m.coefficients.toArray(), full.coef, atol=1e-6)


def test_short_series_and_bad_periods(spark):
    monthly = _monthly(spark, {"S": np.arange(11, dtype=float)})
    with pytest.raises(FC.ForecastError):
        FC.segment_models(monthly).collect()
    ok = _monthly(spark, {"S": np.full(14, 7.0)})          # constant series: std -> 1
    models = FC.segment_models(ok)
    fc = FC.segment_forecast(models).collect()
    assert all(math.isclose(r.yhat, 7.0, abs_tol=1e-6) for r in fc)
    with pytest.raises(ValueError):
        FC.segment_forecast(models, FC.ForecastParams(periods=0))


def test_global_and_alerting_inputs(spark):
    monthly = _monthly(spark, {"A": np.linspace(100, 200, 24), "B": np.linspace(300, 100, 24)})
    fc = FC.segment_forecast(FC.segment_models(monthly))
    g = FC.forecast_global(fc).orderBy("step").collect()
    per = fc.groupBy("step").agg(F.sum("yhat").alias("s")).orderBy("step").collect()
    assert [round(r.yhat, 2) for r in g] == [round(r.s, 2) for r in per]
    fvc = {r.segment: r for r in FC.forecast_vs_current(fc, monthly).collect()}
    assert fvc["B"].trend_direction == "down" and fvc["A"].current_revenue == 200.0
    with pytest.raises(FC.ForecastError):
        FC.forecast_global(fc, segment="nope")


def test_chart_time_ranges_keep_forecasts(spark):
    from revlens.operators.explore import time_range
    from revlens.plans.materialize import materialize
    monthly = _monthly(spark, {"A": np.linspace(100, 200, 24)})
    fc = FC.segment_forecast(FC.segment_models(monthly))
    chart = materialize(FC.forecast_chart(monthly, fc, last=12), "chart")
    assert chart.where("is_forecast").count() == 3 and chart.where("not is_forecast").count() == 12
    r3 = time_range(chart, "3m")
    assert r3.where("not is_forecast").count() == 3 and r3.where("is_forecast").count() == 3
    ytd = time_range(chart, "ytd", year=2019)
    assert ytd.where("not is_forecast").count() == 12
    disp = FC.forecast_chart(monthly, fc, display=True).where("is_forecast").orderBy("step").collect()
    assert [r.step for r in disp] == [1, 2, 3] and disp[0].sales == disp[1].sales   # 'A' has no growth factor
