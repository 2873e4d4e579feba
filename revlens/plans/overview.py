"""Executive overview (M20): KPI, chart, sparkline, ceilings and model
health composed from the other operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.operators import rollups as R
from revlens.plans.joins import attach_one_row


def overview_by(tx: DataFrame, key: str = "segment", floor: float = 0.05, recovery_share: float = 0.15,
                spark_months: int = 6) -> DataFrame:
    """The rule-based part of the overview per group (no model training):
    margin health, at-risk count and sales, recovery estimate, and revenue
    of the group's last ``spark_months`` months. One aggregation per group
    plus the (group x month) rollup for the recent revenue."""
    tx = R.margin_features(tx) if "margin_rate" not in tx.columns else tx
    risky = F.col("margin_rate") < floor
    kpi = tx.groupBy(key).agg(
        F.round(F.avg("margin_rate") * 100, 1).alias("portfolio_margin_health"),
        F.count_if(risky).alias("risk_alerts"),
        F.coalesce(F.sum(F.when(risky, F.col("sales"))), F.lit(0)).cast("double").alias("at_risk_sales"),
        F.count(F.lit(1)).alias("n_rows"))
    kpi = kpi.withColumn("recovery_opportunity", F.col("at_risk_sales") * recovery_share)
    monthly = tx.groupBy(key, R.month_col().alias("month")).agg(F.sum("sales").alias("sales"))
    recent = R.last_months(monthly, spark_months).groupBy(key).agg(
        F.sum("sales").cast("double").alias("recent_revenue"), F.count(F.lit(1)).alias("recent_months"))
    return kpi.join(recent, key, "left")


def executive_overview(kpi: DataFrame, fvc: DataFrame, chart: DataFrame, sparkline: DataFrame,
                       ceilings: DataFrame, margin_r2: float) -> DataFrame:
    """One row: KPIs, next-month and next-quarter revenue, growth (mean of
    segment % changes), forecast chart, sparkline, ceiling matrix rows and
    model health. Arrays are bounded by months/segments/regions."""
    fc = fvc.agg(F.round(F.sum("next_period_revenue"), 2).alias("next_month_revenue"),
                 F.round(F.avg(F.col("pct_change_vs_current") * 100), 1).alias("revenue_growth_pct"),
                 F.round(F.avg("r2_validation"), 3).alias("forecast_r2"))
    quarter = chart.where(F.col("is_forecast")).agg(F.round(F.sum("sales"), 2).alias("next_quarter_revenue"))
    ch = chart.agg(F.array_sort(F.collect_list(F.struct("month", "segment", "sales", "is_forecast")))
                   .alias("forecast_data"))
    sp = sparkline.agg(F.array_sort(F.collect_list(F.struct("month", F.col("sales").cast("double").alias("value"))))
                       .alias("sparkline_revenue"))
    cm = ceilings.agg(F.array_sort(F.collect_list(F.struct("segment", "region", "ceiling"))).alias("discount_matrix"))
    out = kpi
    for one in (fc, quarter, ch, sp, cm):
        out = attach_one_row(out, one)
    return out.withColumn("margin_r2", F.lit(float(margin_r2)))
