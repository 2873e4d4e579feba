"""Alert table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


# Alert texts.
DOWN_TITLE = "%s Revenue Drop"
DOWN_TEXT = "Forecast predicts a %s change next period. Immediate sales intervention recommended."
CHURN_TITLE = "High Churn Risk Detected"
CHURN_TEXT = "%d customer segments show behavior patterns consistent with imminent churn."
STABLE_TITLE = "System Optimal"
STABLE_TEXT = ("All business segments are performing within predicted variance. "
               "No critical anomalies detected.")


def alerts(fvc: DataFrame, personas: DataFrame, strict_trend: bool = False,
           key: str = "segment") -> DataFrame:
    """Segment-down alerts (trend down, or - unless strict - any negative
    change, as the reference fires on a '-' sign in the formatted text),
    one churn alert when any persona has high churn risk, else one
    'stable' row. Columns: alert_id, type, title, description, action."""
    pct = F.col("pct_change_vs_current")
    down = F.col("trend_direction") == "down"
    if not strict_trend:
        down = down | (pct < 0)
    pct_text = F.concat(F.format_string("%+.1f", F.round(pct * 100, 1)), F.lit("%"))
    seg = fvc.where(down).select(
        F.concat(F.lit("fc-"), F.col(key)).alias("alert_id"), F.lit("critical").alias("type"),
        F.format_string(DOWN_TITLE, F.col(key)).alias("title"),
        F.format_string(DOWN_TEXT, pct_text).alias("description"), F.lit("View Forecast").alias("action"))
    n_high = personas.agg(F.count_if(F.col("churn_risk") == "high").alias("_n"))
    churn = n_high.where(F.col("_n") > 0).select(
        F.lit("persona-churn").alias("alert_id"), F.lit("warning").alias("type"),
        F.lit(CHURN_TITLE).alias("title"), F.format_string(CHURN_TEXT, F.col("_n")).alias("description"),
        F.lit("Audit Personas").alias("action"))
    found = seg.unionByName(churn)
    n = found.agg(F.count(F.lit(1)).alias("_found"))
    stable = n.where(F.col("_found") == 0).select(
        F.lit("stable").alias("alert_id"), F.lit("info").alias("type"), F.lit(STABLE_TITLE).alias("title"),
        F.lit(STABLE_TEXT).alias("description"), F.lit("View Report").alias("action"))
    return found.unionByName(stable)


def count_alerts(alert_table: DataFrame) -> DataFrame:
    """Number of priority (non-info) alerts."""
    return alert_table.agg(F.count_if(F.col("type") != "info").alias("priority_alerts"))
