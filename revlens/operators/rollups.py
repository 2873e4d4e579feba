"""Aggregations over the clean transaction table.

All of them are hash aggregations with a map-side partial step, so a hot key
(one segment holding a third of the rows) is combined inside each task before
the shuffle: the shuffle volume is (#tasks x #groups), not #rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revlens.functions import expressions as X


def margin_features(tx: DataFrame, high_discount: float = 0.3) -> DataFrame:
    """Add ``margin_rate`` (clipped ratio) and ``high_discount_flag``."""
    return (tx.withColumn("margin_rate", X.margin_rate("profit", "sales"))
              .withColumn("high_discount_flag", X.high_discount_flag("discount", high_discount)))


def _with_margin(tx: DataFrame) -> DataFrame:
    return tx if "margin_rate" in tx.columns else margin_features(tx)


def month_col(date_col: str = "order_date"):
    return F.trunc(F.col(date_col), "month")


def monthly_rollup(tx: DataFrame) -> DataFrame:
    """A1: month x segment -> sum sales, sum profit, unweighted mean margin."""
    tx = _with_margin(tx)
    return (tx.groupBy(month_col().alias("month"), F.col("segment"))
              .agg(F.sum("sales").alias("sales"),
                   F.sum("profit").alias("profit"),
                   F.avg("margin_rate").alias("margin_rate")))


def customer_profiles(tx: DataFrame) -> DataFrame:
    """A2: per customer total sales, mean margin rate and mean discount."""
    tx = _with_margin(tx)
    return (tx.groupBy("customer")
              .agg(F.sum("sales").alias("sales"),
                   X.exact_avg("margin_rate").alias("margin_rate"),
                   X.exact_avg("discount").alias("discount")))


def avg_margin_by(tx: DataFrame, key: str = "segment", digits: int = 4) -> DataFrame:
    """A3: mean margin rate per key, rounded."""
    tx = _with_margin(tx)
    return tx.groupBy(key).agg(F.round(X.exact_avg("margin_rate"), digits).alias("avg_margin"))


def at_risk(tx: DataFrame, threshold: float = 0.05) -> DataFrame:
    """rows whose margin rate is strictly below the floor."""
    return _with_margin(tx).where(F.col("margin_rate") < threshold)


def top_at_risk(tx: DataFrame, n: int = 50, threshold: float = 0.05,
                tie_break: tuple[str, ...] = ("order_id", "line_number", "order_date", "customer",
                                              "product", "industry", "quantity", "discount",
                                              "profit")) -> DataFrame:
    """K1: the n at-risk rows with the largest sales (full tie-break order).
    ``orderBy(...).limit(n)`` plans as TakeOrderedAndProject: each task keeps
    its own top n, only n rows per task reach the final merge."""
    cols = [c for c in tie_break if c in tx.columns]
    return (at_risk(tx, threshold)
            .orderBy(F.col("sales").desc(), *[F.col(c).asc_nulls_first() for c in cols])
            .limit(n))


def top_at_risk_by(tx: DataFrame, key: str, n: int = 50, threshold: float = 0.05,
                   tie_break: tuple[str, ...] = ("order_id", "line_number", "order_date", "customer",
                                                 "product", "industry", "quantity", "discount",
                                                 "profit")) -> DataFrame:
    """K1 per group: each group's n at-risk rows with the largest sales. Spark
    limits each task to n rows a group before the shuffle."""
    cols = [c for c in tie_break if c in tx.columns]
    w = Window.partitionBy(key).orderBy(F.col("sales").desc(), *[F.col(c).asc_nulls_first() for c in cols])
    return at_risk(tx, threshold).withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_rank")


def kpi_overview(tx: DataFrame, floor: float = 0.05, recovery_share: float = 0.15,
                 target: float = 25.0) -> DataFrame:
    """A6 + X11: portfolio margin health (mean margin x 100, 1 dp), count and
    sales of at-risk rows, recovery estimate, progress to the margin target.
    One global aggregation: each task emits one partial row."""
    tx = _with_margin(tx)
    risky = F.col("margin_rate") < floor
    agg = tx.agg(
        X.exact_avg("margin_rate").alias("mean_margin"),
        F.count_if(risky).alias("risk_alerts"),
        F.sum(F.when(risky, F.col("sales"))).alias("at_risk_sales"),
        F.count(F.lit(1)).alias("n_rows"),
    )
    health = F.round(F.col("mean_margin") * 100, 1)
    return agg.select(
        health.alias("portfolio_margin_health"),
        F.col("risk_alerts"),
        F.coalesce(F.col("at_risk_sales"), F.lit(0)).alias("at_risk_sales"),
        (F.coalesce(F.col("at_risk_sales"), F.lit(0)).cast("double") * recovery_share).alias("recovery_opportunity"),
        F.lit(target).alias("margin_target"),
        X.target_progress(health, target).alias("target_progress"),
        F.col("n_rows"),
    )


def last_months(monthly: DataFrame, n: int, month: str = "month") -> DataFrame:
    """Keep rows of the n most recent distinct months. ``monthly`` is a
    rollup, bounded by months x segments: it is ranked in one task, and read
    once (a semi-join with its own months would compute it twice)."""
    rank = F.dense_rank().over(Window.orderBy(F.col(month).desc()))
    return monthly.withColumn("_r", rank).where(F.col("_r") <= n).drop("_r")


def revenue_pivot(monthly: DataFrame, segments: tuple[str, ...], last: int = 12) -> DataFrame:
    """Month x named segments, sales summed, missing -> 0, last n months."""
    recent = last_months(monthly, last)
    piv = recent.groupBy("month").pivot("segment", list(segments)).agg(F.sum("sales"))
    for s in segments:
        piv = piv.withColumn(s, F.coalesce(F.col(s), F.lit(0)))
    return piv


def revenue_sparkline(monthly: DataFrame, last: int = 6) -> DataFrame:
    """Total sales per month for the last n months."""
    totals = monthly.groupBy("month").agg(F.sum("sales").alias("sales"))
    return last_months(totals, last)
