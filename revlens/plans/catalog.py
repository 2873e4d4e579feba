"""The query catalog: every operator as a (spark, sf_dir) -> DataFrame callable.

Each entry reads the fixture tables (whole tables, no sampling) and applies
one library operator; outputs are projected with stable, aliased column
names and DOUBLE-rounded numerics so they can be compared with the DuckDB
oracle in ``revlens.plans.oracle``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.functions import expressions as X
from revlens.operators import explore as EX
from revlens.operators import ingest as IN
from revlens.operators import margin as MG
from revlens.operators import alerts as AL
from revlens.operators import boosting as BO
from revlens.operators import clustering as CL
from revlens.operators import context as CX
from revlens.operators import forecast as FC
from revlens.operators import personas as PS
from revlens.operators import rollups as R
from revlens.plans import models as MD
from revlens.session import checkpoint_dir
from revlens.plans.materialize import materialize
from revlens.plans import overview as OV
from revlens.sources import files as FL
from revlens.sources import tables as S

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def register(name: str):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn
    return deco


def _tx(spark, sf_dir):
    return R.margin_features(S.transactions(spark, sf_dir))


def _clean(spark, sf_dir):
    """The clean table written once: for queries that read it several times."""
    return MD.clean_table(spark, sf_dir)


def _d(c):
    return F.col(c).cast("double")


@register("transactions")
def q_transactions(spark, sf_dir):
    tx = S.transactions(spark, sf_dir)
    return tx.select("order_id", "line_number", F.col("order_date").cast("date").alias("order_date"),
                     "customer", "segment", "region", "product", "industry", "license", "quantity",
                     F.round("discount", 6).alias("discount"), _d("sales").alias("sales"),
                     _d("profit").alias("profit"))


@register("margin_features")
def q_margin_features(spark, sf_dir):
    return _tx(spark, sf_dir).select(
        "order_id", "line_number", F.col("order_date").cast("date").alias("order_date"), "customer",
        _d("sales").alias("sales"), F.round("margin_rate", 6).alias("margin_rate"), "high_discount_flag")


@register("monthly_rollup")
def q_monthly_rollup(spark, sf_dir):
    m = R.monthly_rollup(_tx(spark, sf_dir))
    return m.select("month", "segment", _d("sales").alias("sales"), _d("profit").alias("profit"),
                    F.round("margin_rate", 6).alias("margin_rate"))


def _r(c, n=6):
    return F.round(F.col(c).cast("double"), n)


def _date(c="order_date"):
    return F.col(c).cast("date").alias(c)


# Query parameters.
SEARCH_TERM, SEARCH_SEGMENT = "99", "BUILDING"
PIVOT_SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
YTD_YEAR = 2000
PAGE_SIZE = 12


@register("customer_profiles")
def q_customer_profiles(spark, sf_dir):
    c = R.customer_profiles(_tx(spark, sf_dir))
    return c.select("customer", _d("sales").alias("sales"), _r("margin_rate").alias("margin_rate"),
                    _r("discount").alias("discount"))


@register("avg_margin_by_segment")
def q_avg_margin(spark, sf_dir):
    return R.avg_margin_by(_tx(spark, sf_dir), "segment", 4)


@register("median_rev_per_unit")
def q_median_rpu(spark, sf_dir):
    m = MG.median_rev_per_unit(_tx(spark, sf_dir))
    return m.select("segment", _r("median_revenue_per_unit").alias("median_revenue_per_unit"))


@register("kpi_overview")
def q_kpi(spark, sf_dir):
    k = R.kpi_overview(_tx(spark, sf_dir))
    return k.select("portfolio_margin_health", "risk_alerts", _r("at_risk_sales", 4).alias("at_risk_sales"),
                    _r("recovery_opportunity", 6).alias("recovery_opportunity"), "margin_target",
                    _r("target_progress", 6).alias("target_progress"), "n_rows")


def _monthly(spark, sf_dir):
    return R.monthly_rollup(_tx(spark, sf_dir))


@register("revenue_pivot")
def q_pivot(spark, sf_dir):
    p = R.revenue_pivot(_monthly(spark, sf_dir), PIVOT_SEGMENTS, 12)
    return p.select("month", *[_d(s).alias(s) for s in PIVOT_SEGMENTS])


@register("revenue_sparkline")
def q_sparkline(spark, sf_dir):
    return R.revenue_sparkline(_monthly(spark, sf_dir), 6).select("month", _d("sales").alias("sales"))


_RISK_COLS = ["order_id", "line_number", "customer", "segment", "region"]


@register("at_risk_deals")
def q_at_risk(spark, sf_dir):
    a = R.at_risk(_tx(spark, sf_dir), 0.05)
    return a.select(*_RISK_COLS, _date(), _d("sales").alias("sales"), _r("discount").alias("discount"),
                    _r("margin_rate").alias("margin_rate"))


@register("top_at_risk")
def q_top_at_risk(spark, sf_dir):
    a = R.top_at_risk(_tx(spark, sf_dir), 50, 0.05)
    return a.select(*_RISK_COLS, _date(), _d("sales").alias("sales"), _r("discount").alias("discount"),
                    _r("margin_rate").alias("margin_rate"))


@register("search_transactions")
def q_search(spark, sf_dir):
    s_ = EX.search(_tx(spark, sf_dir), SEARCH_TERM, SEARCH_SEGMENT)
    return s_.select("order_id", "line_number", "customer", "segment", _d("sales").alias("sales"))


def _history_chart(spark, sf_dir):
    m = MD.monthly(spark, sf_dir)
    hist = m.select("month", "segment", _d("sales").alias("sales"), F.lit(False).alias("is_forecast"))
    fut = _fixed_forecast(spark, sf_dir).select("month", "segment", F.col("yhat").alias("sales"),
                                                F.lit(True).alias("is_forecast"))
    return hist.unionByName(fut)


def _time_range_query(rng):
    def q(spark, sf_dir):
        return EX.time_range(_history_chart(spark, sf_dir), rng, year=YTD_YEAR)
    return q


for _rng in ("3m", "6m", "12m", "ytd"):
    register(f"time_range_{_rng}")(_time_range_query(_rng))


@register("transactions_view")
def q_transactions_view(spark, sf_dir):
    return EX.listing(_tx(spark, sf_dir))


@register("preview")
def q_preview(spark, sf_dir):
    return EX.preview(_clean(spark, sf_dir), 100)


@register("paged_transactions")
def q_paged(spark, sf_dir):
    lst = EX.listing(_tx(spark, sf_dir))
    return EX.page(lst, [*EX.LISTING_ORDER, "margin_pct"], None, PAGE_SIZE)


@register("transactions_page")
def q_page(spark, sf_dir):
    # second explorer variant: 8 rows per page, requested page clamped
    lst = EX.listing(_clean(spark, sf_dir))
    return EX.page(lst, [*EX.LISTING_ORDER, "margin_pct"], number=100_000, size=8)


@register("transactions_middle_page")
def q_middle_page(spark, sf_dir):
    # a page far from both ends
    lst = EX.listing(_clean(spark, sf_dir))
    return EX.page(lst, [*EX.LISTING_ORDER, "margin_pct"], number=lst.count() // 24, size=12)


@register("trend_label")
def q_trend(spark, sf_dir):
    return _mom(spark, sf_dir).select("segment", "month", "trend")


@register("mom_change")
def q_mom(spark, sf_dir):
    return _mom(spark, sf_dir).select("segment", "month", "sales", "prev_sales", "pct_change")


def _mom(spark, sf_dir):
    from pyspark.sql import Window
    m = MD.monthly(spark, sf_dir).select("segment", "month", _d("sales").alias("sales"))
    # monthly is (segments x months) rows: a per-segment window is small.
    w = Window.partitionBy("segment").orderBy("month")
    m = m.withColumn("prev_sales", F.lag("sales").over(w))
    pct = X.pct_change(F.col("sales"), F.col("prev_sales"))
    return m.withColumn("pct_change", F.round(pct, 6)).withColumn("trend", X.trend(pct))


def _tx_rules(spark, sf_dir):
    return _tx(spark, sf_dir).select("order_id", "line_number", "margin_rate", "discount", "segment", "region")


@register("margin_flag")
def q_margin_flag(spark, sf_dir):
    t = _tx_rules(spark, sf_dir)
    return t.select("order_id", "line_number", _r("margin_rate").alias("margin_rate"),
                    X.margin_flag(F.col("margin_rate")).alias("margin_flag"))


@register("margin_rating")
def q_margin_rating(spark, sf_dir):
    t = _tx_rules(spark, sf_dir)
    return t.select("order_id", "line_number", X.margin_rating(F.col("margin_rate")).alias("margin_rating"),
                    X.is_profitable(F.col("margin_rate")).alias("is_profitable"))


@register("margin_band")
def q_margin_band(spark, sf_dir):
    t = EX.listing(_tx(spark, sf_dir))
    return t.select("order_id", "customer", "margin_pct", X.margin_band(F.col("margin_pct")).alias("margin_band"))


def _personas_input(spark, sf_dir):
    c = R.customer_profiles(_tx(spark, sf_dir))
    # Averages are rounded to 9 dp before the rules: cut points such as 0.25
    # must not depend on the order in which a distributed sum was added up.
    return c.select("customer", F.col("sales").cast("double").alias("avg_value"),
                    F.round("discount", 9).alias("avg_discount"), F.round("margin_rate", 9).alias("avg_margin"))


@register("persona_label")
def q_persona_label(spark, sf_dir):
    c = _personas_input(spark, sf_dir)
    return c.select("customer", X.persona_label("avg_value", "avg_discount", "avg_margin").alias("persona_label"))


@register("churn_risk")
def q_churn(spark, sf_dir):
    c = _personas_input(spark, sf_dir)
    return c.select("customer", X.churn_risk("avg_discount", "avg_margin").alias("churn_risk"))


@register("token_estimate")
def q_tokens(spark, sf_dir):
    d = S.read_table(spark, sf_dir, "documents")
    t = X.token_estimate(F.col("text"))
    return d.select("doc_id", F.length("text").alias("n_chars"), t.alias("token_estimate"),
                    X.budget_used_pct(t).alias("budget_used_pct"))


@register("content_fingerprint")
def q_fingerprint(spark, sf_dir):
    d = S.read_table(spark, sf_dir, "documents")
    return d.select("doc_id", F.concat(F.lit("sha256:"), F.sha2(F.col("text"), 256)).alias("content_hash"))


@register("rule_recovery")
def q_rule_recovery(spark, sf_dir):
    r = MG.rule_recovery(S.deals(spark, sf_dir))
    return r.select("deal_id", "industry", "product", "safe_ceiling_pct", "cliff_pct",
                    _r("recovery", 6).alias("recovery"))


@register("discount_sweep")
def q_sweep(spark, sf_dir):
    # The curve depends only on (segment, region, product, quantity): sweep
    # each distinct configuration once instead of every deal.
    cfg = S.deals(spark, sf_dir).select("segment", "region", "product", "quantity").distinct()
    sw = MG.discount_sweep(cfg)
    return sw.select("segment", "region", "product", "quantity", "discount_pct", "margin_pct", "zone")


@register("whatif_discount")
def q_whatif(spark, sf_dir):
    w = MG.whatif_discount(_tx(spark, sf_dir))
    return w.select("month", "segment", "scenario_discount", _r("actual_revenue", 4).alias("actual_revenue"),
                    _r("scenario_revenue", 4).alias("scenario_revenue"), _r("revenue_delta", 4).alias("revenue_delta"))


@register("encode_categories")
def q_encoders(spark, sf_dir):
    return MG.fit_encoders(_tx(spark, sf_dir))


def _typed_dirty(spark, sf_dir):
    raw = S.raw_orders(spark, sf_dir)
    norm, _ = IN.normalize_headers(raw)
    return IN.with_rule(IN.enforce_schema(norm))


@register("encode_oov")
def q_encode_oov(spark, sf_dir):
    enc = MG.fit_encoders(_tx(spark, sf_dir))
    e = MG.encode(_typed_dirty(spark, sf_dir), enc)
    return e.select("segment", "region", "industry", "product", "segment_enc", "region_enc", "industry_enc",
                    "product_enc", F.size("warnings").alias("n_warnings"))


@register("impute_rev_per_unit")
def q_impute(spark, sf_dir):
    med = MG.median_rev_per_unit(_tx(spark, sf_dir))
    d = MG.impute_rev_per_unit(_typed_dirty(spark, sf_dir), med)
    return d.select("segment", _r("sales").alias("sales"), _r("quantity").alias("quantity"),
                    _r("revenue_per_unit").alias("revenue_per_unit"), "rpu_imputed")


def _reps(spark, sf_dir):
    feats = IN.deal_features(_clean(spark, sf_dir))
    enc = MG.fit_encoders(feats)
    return MG.representative_deals(MG.encode(feats, enc, warn=False), enc)


@register("representative_deals")
def q_reps(spark, sf_dir):
    r = _reps(spark, sf_dir)
    return r.select("segment", "region", "segment_enc", "region_enc", _r("quantity").alias("quantity"),
                    _r("revenue_per_unit").alias("revenue_per_unit"), "industry_enc", "product_enc")


@register("ceiling_grid")
def q_grid(spark, sf_dir):
    g = MG.ceiling_grid(_reps(spark, sf_dir))
    return g.select("segment", "region", _r("discount", 2).alias("discount"), _r("quantity").alias("quantity"),
                    _r("discount_x_quantity").alias("discount_x_quantity"), "high_discount_flag_int")


@register("deal_features")
def q_deal_features(spark, sf_dir):
    f = IN.deal_features(_tx(spark, sf_dir))
    return f.select("order_id", "line_number", _r("discount_x_quantity").alias("discount_x_quantity"),
                    _r("revenue_per_unit").alias("revenue_per_unit"), "high_discount_flag_int")


@register("validate_deals")
def q_validate(spark, sf_dir):
    t = _typed_dirty(spark, sf_dir).select("segment", "region", "industry", "product", "quantity", "sales",
                                           "discount")
    v = IN.validate_deals(t)
    return v.select("segment", "region", _r("quantity").alias("quantity"), _r("sales").alias("sales"),
                    _r("discount").alias("discount"), F.concat_ws(",", "errors").alias("errors"), "is_valid")


@register("normalized_headers")
def q_headers(spark, sf_dir):
    norm, _ = IN.normalize_headers(S.raw_orders(spark, sf_dir))
    return norm


@register("synth_order_id")
def q_synth(spark, sf_dir):
    raw = S.raw_orders(spark, sf_dir).drop(" order_id ")
    norm, _ = IN.normalize_headers(raw)
    t = IN.enforce_schema(norm)
    return t.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("order_id").alias("n_distinct"),
                 F.min_by("order_id", _id_number()).alias("min_id"), F.max_by("order_id", _id_number()).alias("max_id"))


def _id_number():
    # 'AUTO-%06d' grows wider than six digits: compare its number
    return F.regexp_extract("order_id", r"(\d+)$", 1).cast("bigint")


@register("coerce_numeric")
def q_coerce(spark, sf_dir):
    raw = S.raw_orders(spark, sf_dir)
    p = IN.CleanParams()
    return raw.select(
        F.col("Amount").alias("amount_raw"), F.col("Qty").alias("qty_raw"),
        F.col("`Discount Rate`").alias("discount_raw"),
        F.round(IN.coerce_number(F.col("Amount"), 0.0, p), 6).alias("sales"),
        F.round(IN.coerce_number(F.col("Qty"), 1.0, p), 6).alias("quantity"),
        F.round(IN.coerce_number(F.col("`Discount Rate`"), 0.0, p), 6).alias("discount"),
        F.round(IN.coerce_number(F.col("net_profit"), 0.0, p), 6).alias("profit"))


@register("fill_categorical")
def q_fill(spark, sf_dir):
    norm, _ = IN.normalize_headers(S.raw_orders(spark, sf_dir))
    p = IN.CleanParams()
    present = [f.name for f in IN.S.CATEGORICAL if f.name in norm.columns]
    nulls = norm.select(*[IN.null_tokens(F.col(c), p.null_tokens).alias(c) for c in present])
    counts = IN.fill_counts(nulls)
    stack = ", ".join(f"'{c}', `{c}`" for c in present)
    return counts.selectExpr(f"stack({len(present)}, {stack}) as (column_name, null_count)")


@register("parse_dates")
def q_parse_dates(spark, sf_dir):
    raw = S.raw_orders(spark, sf_dir)
    return raw.select(F.col("Date").alias("date_raw"), IN.parse_date(F.col("Date")).alias("order_date"))


@register("clean_transactions")
def q_clean(spark, sf_dir):
    c = IN.clean(S.raw_orders(spark, sf_dir))
    return c.select("order_id", _date(), "customer", "segment", "region", "product", "industry", "license",
                    _r("sales").alias("sales"), _r("quantity").alias("quantity"), _r("discount").alias("discount"),
                    _r("profit").alias("profit"), _r("margin_rate").alias("margin_rate"), "high_discount_flag")


@register("dq_report")
def q_dq(spark, sf_dir):
    return IN.dq_report(S.raw_orders(spark, sf_dir))


@register("dq_examples")
def q_dq_examples(spark, sf_dir):
    e = IN.dq_examples(S.raw_orders(spark, sf_dir))
    return e.select("failed_rule", "example_rank", "order_id", "customer", _r("sales").alias("sales"),
                    _r("quantity").alias("quantity"), _r("discount").alias("discount"), "violations", "and_more")


@register("ingest_summary")
def q_ingest_summary(spark, sf_dir):
    s_ = IN.ingest_summary(S.raw_orders(spark, sf_dir))
    return s_.select("rows_raw", "rows_loaded", "rows_dropped", "rows_monthly",
                     F.concat_ws("|", "segments").alias("segments"), "profit_all_zero",
                     F.size("warnings").alias("n_warnings"), F.size("validation_errors").alias("n_errors"))




# ------------------------------------------------------------------ forecast
@register("forecast_design")
def q_forecast_design(spark, sf_dir):
    d = FC.forecast_design(_monthly(spark, sf_dir))
    return d.select("segment", "month", "t_idx", "n_months", _r("y_s").alias("y_s"), "is_train",
                    *[_r(f).alias(f) for f in FC.FEATURES])


def _fc_models(spark, sf_dir):
    return MD.forecast_models(spark, sf_dir)


@register("forecast_coefficients")
def q_forecast_coefficients(spark, sf_dir):
    co = FC.coefficients(_monthly(spark, sf_dir))
    return co.select("segment", "split", "n", F.round("intercept", 6).alias("intercept"),
                     *[F.round(F.col("coef")[i], 6).alias(f"coef_{f}") for i, f in enumerate(FC.FEATURES)])


@register("forecast_backtest")
def q_forecast_backtest(spark, sf_dir):
    return _fc_models(spark, sf_dir).select("segment", "n_months", "r2_validation",
                                            F.round("resid_std_s", 6).alias("resid_std_s"))


def _segment_forecast(spark, sf_dir, periods=3):
    return FC.segment_forecast(MD.forecast_models(spark, sf_dir), FC.ForecastParams(periods=periods))


@register("segment_forecast")
def q_segment_forecast(spark, sf_dir):
    return _segment_forecast(spark, sf_dir)


@register("forecast_global")
def q_forecast_global(spark, sf_dir):
    return FC.forecast_global(_segment_forecast(spark, sf_dir))


def _fvc(spark, sf_dir):
    return FC.forecast_vs_current(_segment_forecast(spark, sf_dir), MD.monthly(spark, sf_dir))


@register("forecast_single_segment")
def q_forecast_single(spark, sf_dir):
    return FC.forecast_global(_segment_forecast(spark, sf_dir), segment=PIVOT_SEGMENTS[0])


@register("forecast_vs_current")
def q_fvc(spark, sf_dir):
    return _fvc(spark, sf_dir)


@register("forecast_chart")
def q_forecast_chart(spark, sf_dir):
    return FC.forecast_chart(MD.monthly(spark, sf_dir), _segment_forecast(spark, sf_dir))


@register("aggregate_outlook")
def q_outlook(spark, sf_dir):
    return FC.aggregate_outlook(_fvc(spark, sf_dir))


# ------------------------------------------------------------------ margin model
@register("margin_model_metrics")
def q_margin_metrics(spark, sf_dir):
    m = MD.margin_model(spark, sf_dir)
    top = m.importances[0][0]
    return spark.createDataFrame([(m.r2, m.mae, top)], "r2 double, mae double, top_feature string")


@register("feature_importances")
def q_importances(spark, sf_dir):
    return MG.feature_importances(MD.margin_model(spark, sf_dir), spark, 3)


@register("discount_ceilings")
def q_ceilings(spark, sf_dir):
    return MD.ceilings(spark, sf_dir)


@register("deal_scores")
def q_deal_scores(spark, sf_dir):
    m = MD.margin_model(spark, sf_dir)
    # the clean table has been written for the model: its rows needn't be joined once more
    return MG.score_deals(m, S.deals_of(_clean(spark, sf_dir)), MD.ceilings(spark, sf_dir))


def _as_deals(tx):
    return tx.select(F.col("order_id").alias("deal_id"), "segment", "region", "industry", "product",
                     F.col("quantity").cast("int").alias("quantity"), _d("sales").alias("sales"),
                     _d("discount").alias("discount"))


@register("discount_sweep_model")
def q_sweep_model(spark, sf_dir):
    # The prediction depends on the model's inputs only: sweep each distinct
    # configuration of all deals once.
    m = MD.margin_model(spark, sf_dir)
    # the clean table has been written for the model: its rows needn't be joined once more
    cfg = S.deals_of(_clean(spark, sf_dir)).select("segment", "region", "industry", "product", "quantity", "sales").distinct()
    cfg = cfg.withColumn("discount", F.lit(0.0))  # the sweep's, not the deal's
    sw = MG.discount_sweep_model(m, cfg)
    return sw.select("segment", "region", "industry", "product", "quantity", "sales", "discount", "predicted_margin_rate")


@register("at_risk_scored")
def q_at_risk_scored(spark, sf_dir):
    top = R.top_at_risk(_clean(spark, sf_dir), 50, 0.05)
    return MG.score_deals(MD.margin_model(spark, sf_dir), _as_deals(top), MD.ceilings(spark, sf_dir))


# ------------------------------------------------------------------ personas
@register("customer_clusters")
def q_clusters(spark, sf_dir):
    c, _ = MD.clusters(spark, sf_dir)
    return c.select("customer", "cluster", _d("sales").alias("sales"), _r("margin_rate").alias("margin_rate"),
                    _r("discount").alias("discount"))


@register("silhouette")
def q_silhouette(spark, sf_dir):
    c, sil = MD.clusters(spark, sf_dir)
    return c.groupBy().agg(F.count(F.lit(1)).alias("n_customers"),
                           F.count_distinct("cluster").alias("n_clusters")).withColumn("silhouette", F.lit(sil))


@register("silhouette_exact")
def q_silhouette_exact(spark, sf_dir):
    c, _ = MD.clusters(spark, sf_dir)
    return PS.exact_silhouette(c, [f"z_{f}" for f in PS.PROFILE_FEATURES])


@register("silhouette_exact_fixed")
def q_silhouette_exact_fixed(spark, sf_dir):
    z = PS.standardize(materialize(_fixed_profiles(spark, sf_dir), "profiles"))
    return PS.exact_silhouette(z, [f"z_{f}" for f in PS.PROFILE_FEATURES]).withColumn("silhouette", F.round("silhouette", 6))


#: Centres of two restarts, in deviations from the mean.
FIXED_CENTERS = [[(1.0, 0.5, -0.5), (-1.0, 0.25, 0.75), (0.125, -1.0, 0.0), (-0.25, 0.0, -1.25)],
                 [(0.0, 0.0, 0.0), (2.0, -0.5, 0.5), (-0.5, 1.5, 0.25), (0.75, 0.75, 1.0)]]


def _profiles(spark, sf_dir):
    return R.customer_profiles(_clean(spark, sf_dir)).withColumn("sales", F.col("sales").cast("double"))


@register("lloyd_step_fixed")
def q_lloyd_step(spark, sf_dir):
    # one pass that serves two restarts
    z = [f"z_{f}" for f in PS.PROFILE_FEATURES]
    points = CL.distinct_points(PS.standardize(materialize(_profiles(spark, sf_dir), "profiles")), z)
    step = CL.lloyd_step(points, z, np.array(FIXED_CENTERS))
    return step.select("restart", "cluster", "n", _r("cost", 5).alias("cost"), *[F.round(F.col(f"sum_{f}") / F.col("n"), 6).alias(f) for f in z])


@register("saved_cluster_scores")
def q_saved_clusters(spark, sf_dir):
    # Customers are assigned by the centres and the scaling as they were saved and read again
    path = f"{checkpoint_dir(spark).rstrip('/')}/models/clusters-{uuid.uuid4().hex}"
    prof = materialize(_profiles(spark, sf_dir), "profiles")
    MD.save_clusters(CL.Centers(tuple(f"z_{f}" for f in PS.PROFILE_FEATURES), np.array(FIXED_CENTERS[0])), PS.scaling_of(prof), path)
    return PS.assign_clusters(prof, *MD.load_clusters(spark, path)).select("customer", "cluster")


@register("cluster_stats")
def q_cluster_stats(spark, sf_dir):
    c, _ = MD.clusters(spark, sf_dir)
    return PS.cluster_stats(c)


def _naming(spark, sf_dir):
    c, _ = MD.clusters(spark, sf_dir)
    return PS.name_personas(PS.cluster_stats(c))


@register("persona_assignments")
def q_assign(spark, sf_dir):
    c, _ = MD.clusters(spark, sf_dir)
    return PS.assign_personas(c, _naming(spark, sf_dir)).select("customer", "cluster", "persona")


def _traits(spark, sf_dir):
    c, _ = MD.clusters(spark, sf_dir)
    naming = _naming(spark, sf_dir)
    return PS.persona_traits(PS.assign_personas(c, naming), _clean(spark, sf_dir), naming)


@register("persona_traits")
def q_traits(spark, sf_dir):
    return _traits(spark, sf_dir)


def _fixed_profiles(spark, sf_dir):
    prof = R.customer_profiles(_clean(spark, sf_dir)).withColumn("sales", F.col("sales").cast("double"))
    return prof.join(S.fixed_clusters(spark, sf_dir), "customer")


@register("persona_naming")
def q_persona_naming(spark, sf_dir):
    n = PS.name_personas(PS.cluster_stats(_fixed_profiles(spark, sf_dir)))
    return n.select("cluster", "persona", "action_signal", _r("avg_sales", 4).alias("avg_sales"),
                    _r("avg_margin").alias("avg_margin"), _r("avg_discount").alias("avg_discount"), "n_customers")


@register("roi_recovery")
def q_roi(spark, sf_dir):
    prof = materialize(_fixed_profiles(spark, sf_dir), "profiles")
    naming = PS.name_personas(PS.cluster_stats(prof))
    r = PS.roi_recovery(PS.assign_personas(prof, naming))
    return r.select(_r("champions_margin").alias("champions_margin"), _r("seekers_margin").alias("seekers_margin"),
                    _r("seekers_sales", 4).alias("seekers_sales"), "recovery_usd")


# ------------------------------------------------------------------ composites
def _fixed_fvc(spark, sf_dir):
    """Deterministic stand-in for forecast output: each segment's last month
    against the month before (the same columns forecast_vs_current emits)."""
    m = _mom(spark, sf_dir)
    from pyspark.sql import Window
    w = Window.partitionBy("segment").orderBy(F.col("month").desc())
    last = m.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1)
    return last.select("segment", F.col("pct_change").alias("pct_change_vs_current"),
                       F.col("trend").alias("trend_direction"))


def _fixed_personas(spark, sf_dir):
    prof = _fixed_profiles(spark, sf_dir)
    st = PS.cluster_stats(prof)
    return st.select("cluster", X.churn_risk(F.round("avg_discount", 9), F.round("avg_margin", 9)).alias("churn_risk"))


@register("alerts")
def q_alerts(spark, sf_dir):
    return AL.alerts(_fixed_fvc(spark, sf_dir), _fixed_personas(spark, sf_dir))


@register("alert_count")
def q_alert_count(spark, sf_dir):
    return AL.count_alerts(AL.alerts(_fixed_fvc(spark, sf_dir), _fixed_personas(spark, sf_dir)))


@register("context_packet")
def q_context(spark, sf_dir):
    MD.train_all(spark, sf_dir)
    tx, model = _clean(spark, sf_dir), MD.margin_model(spark, sf_dir)
    # every region's own largest at-risk deals are scored
    deals = _as_deals(R.top_at_risk_by(tx, "region", 50, 0.05))
    scored = materialize(MG.score_deals(model, deals, MD.ceilings(spark, sf_dir)), "scored")
    fvc, traits = materialize(_fvc(spark, sf_dir), "fvc"), materialize(_traits(spark, sf_dir), "traits")
    CX.check_packets(fvc, scored, traits)
    facts = CX.ModelFacts(model.r2, PS.PersonaParams().k, MD.clusters(spark, sf_dir)[1])
    return CX.context_packets(fvc, scored, traits, tx.select("region").distinct(), MD.ceilings(spark, sf_dir),
                              R.avg_margin_by(tx, "segment", 4), facts, key="region")


@register("executive_overview")
def q_overview(spark, sf_dir):
    o = OV.overview_by(_clean(spark, sf_dir), "segment")
    return o.select("segment", "portfolio_margin_health", "risk_alerts", _r("at_risk_sales", 4).alias("at_risk_sales"),
                    _r("recovery_opportunity", 6).alias("recovery_opportunity"), "n_rows",
                    _r("recent_revenue", 4).alias("recent_revenue"), "recent_months")


@register("executive_overview_full")
def q_overview_full(spark, sf_dir):
    MD.train_all(spark, sf_dir)
    monthly = MD.monthly(spark, sf_dir)
    fc = _segment_forecast(spark, sf_dir)
    fvc = FC.forecast_vs_current(fc, monthly)
    chart = FC.forecast_chart(monthly, fc)
    spark_line = R.revenue_sparkline(monthly, 6)
    kpi = R.kpi_overview(_clean(spark, sf_dir))
    m = MD.margin_model(spark, sf_dir)
    return OV.executive_overview(kpi, fvc, chart, spark_line, MD.ceilings(spark, sf_dir), m.r2)


# ------------------------------------------------------------------ fixed models
# The operators downstream of a fitted model, on models of fixed coefficients:
# the same code paths, with results that SQL can state.
FIXED_COEF = (0.01, 0.0005, 0.1, -0.2, 0.05, 0.02, -0.03, 0.04)
FIXED_INTERCEPT, FIXED_STD, FIXED_MEAN, FIXED_RESIDUAL, FIXED_R2 = 0.25, 25_000.0, 100_000.0, 0.5, 0.4
FIXED_GROWTH = {"AUTOMOBILE": 0.02, "BUILDING": 0.01, "MACHINERY": 0.03}
FIXED_MARGIN = {"discount": -0.9, "quantity": 0.0005, "revenue_per_unit": 0.00001, "segment_enc": -0.01,
                "region_enc": 0.002, "industry_enc": 0.001, "product_enc": -0.0003}
FIXED_MARGIN_BASE = 0.45
# the rule tables' entries under names that the tables have
FIXED_RULES = MG.RuleTables(
    industry_ceiling={"Brand#11": 22.0, "Brand#22": 12.0, "Brand#3": 18.0},
    product_adjust={"ECONOMY": 5.0, "STANDARD": -3.0},
    segment_offset={"AUTOMOBILE": -2.5, "BUILDING": 1.0}, region_offset={"EUROPE": 1.5, "ASIA": -1.0},
    product_offset={"ECONOMY": 4.0, "STANDARD": -2.0})


def _fixed_models(spark, sf_dir):
    per = MD.monthly(spark, sf_dir).groupBy("segment").agg(
        F.count(F.lit(1)).cast("int").alias("n_months"), F.max("month").alias("last_month"))
    return per.withColumns({
        "coef": F.array(*[F.lit(c) for c in FIXED_COEF]), "intercept": F.lit(FIXED_INTERCEPT),
        "r2_validation": F.lit(FIXED_R2), "resid_std_s": F.lit(FIXED_RESIDUAL), "y_mean": F.lit(FIXED_MEAN),
        "y_std": F.lit(FIXED_STD)})


def _fixed_forecast(spark, sf_dir):
    return FC.segment_forecast(_fixed_models(spark, sf_dir), FC.ForecastParams(periods=3))


def _fixed_vs_current(spark, sf_dir):
    return FC.forecast_vs_current(_fixed_forecast(spark, sf_dir), MD.monthly(spark, sf_dir))


@register("segment_forecast_fixed")
def q_segment_forecast_fixed(spark, sf_dir):
    return _fixed_forecast(spark, sf_dir)


@register("forecast_global_fixed")
def q_forecast_global_fixed(spark, sf_dir):
    return FC.forecast_global(_fixed_forecast(spark, sf_dir))


@register("forecast_single_segment_fixed")
def q_forecast_single_fixed(spark, sf_dir):
    return FC.forecast_global(_fixed_forecast(spark, sf_dir), segment=PIVOT_SEGMENTS[0])


@register("forecast_vs_current_fixed")
def q_fvc_fixed(spark, sf_dir):
    return _fixed_vs_current(spark, sf_dir).withColumn("pct_change_vs_current", _r("pct_change_vs_current"))


@register("aggregate_outlook_fixed")
def q_outlook_fixed(spark, sf_dir):
    o = FC.aggregate_outlook(_fixed_vs_current(spark, sf_dir))
    return o.select(_r("total_next_period_revenue", 2).alias("total_next_period_revenue"),
                    _r("total_current_revenue", 2).alias("total_current_revenue"),
                    _r("aggregate_pct_change").alias("aggregate_pct_change"), "aggregate_trend")


@register("forecast_chart_fixed")
def q_chart_fixed(spark, sf_dir):
    return FC.forecast_chart(MD.monthly(spark, sf_dir), _fixed_forecast(spark, sf_dir))


@register("forecast_chart_display_fixed")
def q_chart_display_fixed(spark, sf_dir):
    c = FC.forecast_chart(MD.monthly(spark, sf_dir), _fixed_forecast(spark, sf_dir), display=True, growth=FIXED_GROWTH)
    return c.withColumn("sales", _r("sales", 4))


@register("cluster_stats_fixed")
def q_cluster_stats_fixed(spark, sf_dir):
    st = PS.cluster_stats(_fixed_profiles(spark, sf_dir))
    return st.select("cluster", _r("avg_sales", 4).alias("avg_sales"), _r("avg_margin").alias("avg_margin"),
                     _r("avg_discount").alias("avg_discount"), "n_customers")


@register("persona_assignments_fixed")
def q_assign_fixed(spark, sf_dir):
    prof = _fixed_profiles(spark, sf_dir)
    return PS.assign_personas(prof, PS.name_personas(PS.cluster_stats(prof))).select("customer", "cluster", "persona")


@register("persona_traits_fixed")
def q_traits_fixed(spark, sf_dir):
    prof = _fixed_profiles(spark, sf_dir)
    naming = PS.name_personas(PS.cluster_stats(prof))
    return PS.persona_traits(PS.assign_personas(prof, naming), _clean(spark, sf_dir), naming)


class LinearStandIn:
    """A predictor of fixed weights in place of the fitted trees."""

    def transform(self, df: DataFrame) -> DataFrame:
        out = F.lit(FIXED_MARGIN_BASE)
        for name, w in FIXED_MARGIN.items():
            out = out + F.col(name) * F.lit(w)
        return df.withColumn("prediction", out).withColumn("features", F.lit(None).cast("string"))


def _fixed_margin_model(spark, sf_dir) -> MG.MarginModel:
    tx = _clean(spark, sf_dir)
    return MG.MarginModel(model=LinearStandIn(), encoders=MG.fit_encoders(IN.deal_features(tx)),
                          medians=MG.median_rev_per_unit(tx), importances=[], metrics={"r2": 0.9, "mae": 0.05})


def _fixed_ceilings(spark, sf_dir, model):
    return MG.discount_ceilings(model, _clean(spark, sf_dir))


@register("discount_ceilings_fixed")
def q_ceilings_fixed(spark, sf_dir):
    return _fixed_ceilings(spark, sf_dir, _fixed_margin_model(spark, sf_dir))


def _score_columns(scored):
    return scored.withColumn("discount_use", _r("discount_use")).withColumn("warnings", F.concat_ws("|", "warnings"))


@register("deal_scores_fixed")
def q_deal_scores_fixed(spark, sf_dir):
    m = _fixed_margin_model(spark, sf_dir)
    return _score_columns(MG.score_deals(m, S.deals_of(_clean(spark, sf_dir)), _fixed_ceilings(spark, sf_dir, m)))


@register("at_risk_scored_fixed")
def q_at_risk_fixed(spark, sf_dir):
    m = _fixed_margin_model(spark, sf_dir)
    top = R.top_at_risk(_clean(spark, sf_dir), 50, 0.05)
    return _score_columns(MG.score_deals(m, _as_deals(top), _fixed_ceilings(spark, sf_dir, m)))


# three trees that cut on all kinds of features, those along the discount too
FIXED_TREES = BO.Trees.of(MG.FEATURES, 0.30, [
    ("high_discount_flag_int", 0.5, ("discount", 0.045, 0.05, ("discount_x_quantity", 1.255, -0.02, -0.08)), -0.30),
    ("quantity", 24.5, ("region_enc", 1.5, 0.03, ("discount", 0.255, 0.01, -0.04)),
     ("revenue_per_unit", 1500.0, -0.03, ("discount_x_quantity", 8.003, 0.02, -0.09))),
    ("segment_enc", 2.5, ("industry_enc", 9.5, 0.012, -0.006), ("discount", 0.125, 0.004, ("product_enc", 2.5, -0.05, -0.11))),
])


def _fixed_tree_model(spark, sf_dir) -> MG.MarginModel:
    m = _fixed_margin_model(spark, sf_dir)
    return MG.MarginModel(model=FIXED_TREES, encoders=m.encoders, medians=m.medians, importances=FIXED_TREES.importances(), metrics=m.metrics)


@register("discount_ceilings_trees_fixed")
def q_ceilings_trees(spark, sf_dir):
    return _fixed_ceilings(spark, sf_dir, _fixed_tree_model(spark, sf_dir))


@register("discount_sweep_model_fixed")
def q_sweep_trees(spark, sf_dir):
    cfg = S.deals(spark, sf_dir).select("segment", "region", "industry", "product", "quantity", "sales", F.lit(0.0).alias("discount")).distinct()
    sw = MG.discount_sweep_model(_fixed_tree_model(spark, sf_dir), cfg)
    # a row per configuration would be 81 times the deals: the curve's summary by
    # segment, region and discount; rates of 4 places are summed as whole numbers
    return sw.groupBy("segment", "region", "discount").agg(
        F.count(F.lit(1)).alias("n"), (F.sum(F.rint(F.col("predicted_margin_rate") * 10_000).cast("long")) / 10_000).alias("total_margin"),
        F.min("predicted_margin_rate").alias("least_margin"), F.max("predicted_margin_rate").alias("most_margin"))


@register("saved_model_scores")
def q_saved_model(spark, sf_dir):
    # What is scored is the model as it was saved and read again
    path = f"{checkpoint_dir(spark).rstrip('/')}/models/margin-{uuid.uuid4().hex}"
    MD.save_margin_model(_fixed_tree_model(spark, sf_dir), path)
    m = MD.load_margin_model(spark, path)
    scored = MG.score_deals(m, S.deals(spark, sf_dir), _fixed_ceilings(spark, sf_dir, m))
    return scored.select("deal_id", "predicted_margin_rate", "margin_flag", "max_safe_discount", "within_ceiling")


FIXED_CUTS = {"quantity": [5.5, 12.5, 24.5, 40.5], "discount": [0.005, 0.025, 0.045, 0.075], "revenue_per_unit": [1000.0, 1250.0, 1500.0, 1750.0],
              "discount_x_quantity": [0.255, 0.755, 1.255, 2.505], "segment_enc": [0.5, 1.5, 2.5, 3.5]}


@register("split_gains_fixed")
def q_split_gains(spark, sf_dir):
    feats = IN.deal_features(_clean(spark, sf_dir))
    data = MG.encode(feats, MG.fit_encoders(feats), warn=False).select(*FIXED_CUTS, "margin_rate")
    gains = BO.split_gains(data, list(FIXED_CUTS), "margin_rate", list(FIXED_CUTS.values()))
    return gains.withColumn("gain", F.round("gain", 3))


@register("top_at_risk_by_region")
def q_top_by_region(spark, sf_dir):
    a = R.top_at_risk_by(_tx(spark, sf_dir), "region", 50, 0.05)
    return a.select(*_RISK_COLS, _date(), _d("sales").alias("sales"), _r("discount").alias("discount"),
                    _r("margin_rate").alias("margin_rate"))


@register("rule_recovery_mapped")
def q_rule_recovery_mapped(spark, sf_dir):
    r = MG.rule_recovery(S.deals(spark, sf_dir), FIXED_RULES)
    return r.select("deal_id", "industry", "product", "safe_ceiling_pct", "cliff_pct", _r("recovery", 6).alias("recovery"))


@register("discount_sweep_mapped")
def q_sweep_mapped(spark, sf_dir):
    cfg = S.deals(spark, sf_dir).select("segment", "region", "product", "quantity").distinct()
    sw = MG.discount_sweep(cfg, rules=FIXED_RULES)
    return sw.select("segment", "region", "product", "quantity", "discount_pct", "margin_pct", "zone")


# ------------------------------------------------------------------ ingestion pieces
# One text form for each remainder of the row's number; Java date patterns, and
# what they are written with (%: as is).
DATE_FORMS = ("yyyy-M-d", "yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd HH:mm:ss.SSS", "yyyy-MM-dd HH:mm", "MMM d, yyyy",
              "dd-MMM-yyyy", "yyyyMMdd", "M/d/yy", "M/d/yyyy HH:mm", "MM-dd-yyyy", "M.d.yyyy", "MMMM d yyyy",
              "d MMM yyyy", "yyyy/MM/dd hh:mm a", "yyyy-MM-dd'T'HH:mm:ss'+00:00'", "yyyy.MM.dd")


@register("parse_date_forms")
def q_parse_date_forms(spark, sf_dir):
    tx = _tx(spark, sf_dir)
    k = F.col("order_id").cast("bigint") * 10 + F.col("line_number")
    form = F.pmod(k, F.lit(len(DATE_FORMS)))
    text = F.lit("not a date")
    for i, pattern in enumerate(DATE_FORMS):
        text = F.when(form == i, F.date_format("order_date", pattern)).otherwise(text)
    return tx.select("order_id", "line_number", form.cast("int").alias("form"), IN.parse_date(text).alias("order_date"))


@register("date_key")
def q_date_key(spark, sf_dir):
    """C11: a date key column is kept as a whole number, unparsable as NULL."""
    raw = S.raw_orders(spark, sf_dir).withColumn("Date Key", F.regexp_replace("Date", "[-/]", ""))
    norm, _ = IN.normalize_headers(raw)
    typed = IN.enforce_schema(norm)
    return typed.groupBy("date_key").agg(F.count(F.lit(1)).alias("rows"))


@register("missing_critical")
def q_missing_critical(spark, sf_dir):
    """Which critical columns a file without each header would miss."""
    raw = S.raw_orders(spark, sf_dir)
    rows = []
    for c in raw.columns:
        norm, _ = IN.normalize_headers(raw.drop(c))
        try:
            IN.check_critical(norm)
            rows.append((c.strip(), False))
        except IN.SchemaError:
            rows.append((c.strip(), True))
    n = raw.agg(F.count(F.lit(1)).alias("rows"))
    return spark.createDataFrame(rows, "dropped string, rejected boolean").withColumn("rows", n.scalar())


@register("fill_model_columns")
def q_fill_model(spark, sf_dir):
    """Missing model categoricals are 'Unknown'."""
    t = _typed_dirty(spark, sf_dir).drop("industry").withColumn(
        "product", F.when(F.col("quantity") > 1, F.col("product")))
    return IN.deal_features(t).groupBy("industry", "product").agg(F.count(F.lit(1)).alias("rows"))


@register("quoted_orders")
def q_quoted_orders(spark, sf_dir):
    # an export separated by ';' whose quoted header and fields hold commas
    path = f"{checkpoint_dir(spark).rstrip('/')}/fixtures/quoted-{uuid.uuid4().hex}"
    tx = S.transactions(spark, sf_dir).select(
        F.col("order_id").alias("order, id"), F.col("line_number").cast("string").alias("line, number"),
        F.concat_ws(", ", "customer", "segment", "region").alias("who, what, where"), F.col("sales").cast("string").alias("sales"))
    tx.write.option("header", True).option("sep", ";").option("quoteAll", True).option("escape", '"').csv(path)
    raw = FL.read_csv(spark, path)
    return raw.select(F.col("`order, id`").alias("order_id"), F.col("`line, number`").cast("int").alias("line_number"),
                      F.col("`who, what, where`").alias("who"), F.col("sales").cast("double").alias("sales"))


@register("sniffed_orders")
def q_sniffed(spark, sf_dir):
    """The raw export read with detected delimiter and encodings."""
    raw = FL.read_csv(spark, S.raw_orders_path(spark, sf_dir))
    norm, _ = IN.normalize_headers(raw)
    return norm


@register("file_fingerprints")
def q_file_fingerprints(spark, sf_dir):
    """S3: one row per file of the raw export."""
    f = FL.content_fingerprint(spark, S.raw_orders_path(spark, sf_dir))
    return f.select(F.element_at(F.split("path", "/"), -1).alias("file"), "length", "file_hash")


@register("csv_export")
def q_csv_export(spark, sf_dir):
    """The listing's rows as the export writes them."""
    return FL.csv_lines(EX.listing(_tx(spark, sf_dir)).select("order_id", "order_date", "customer", "segment", "region", "product", "margin"))


FLAGSHIP = "executive_overview"
