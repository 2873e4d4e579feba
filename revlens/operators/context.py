"""Size-budgeted JSON context packets.

Re-aimed from one packet per process to one packet per group key (for
example per region). A packet has fixed facts - the forecast's summary, mean
margins, the group's discount ceilings, cluster figures - and three lists:
forecast segments, personas, and the group's worst at-risk deals. The lists'
items are ranked by keep-priority, a running sum of their JSON lengths decides
which fit the character budget, and the kept ones are assembled as JSON that
is always whole. If the fixed facts alone are over the budget, the ceilings
go, last of all. Items per group are few (deals are capped per group with a
top-k window that Spark limits before the shuffle), so every window and
``collect_list`` here is bounded by segments, personas and that cap.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revlens.functions import expressions as X
from revlens.plans.joins import attach_one_row

# Budget, characters per token, deals per packet.
TOKEN_BUDGET = 600
CHARS_PER_TOKEN = 4
MAX_DEALS = 5
# Lists in the order in which they are kept; trimming goes the other way round.
LISTS = ("forecast", "persona", "deal")


class EmptyPacketError(ValueError):
    """No pillar has anything to report."""


@dataclass(frozen=True)
class ModelFacts:
    """Scalars of the fitted models."""
    model_r2: float | None = None
    n_clusters: int | None = None
    silhouette: float | None = None


def _pct(c: Column) -> Column:
    return F.concat(F.format_string("%.1f", F.round(c * 100, 1)), F.lit("%"))


def forecast_items(fvc: DataFrame) -> DataFrame:
    return fvc.select(
        F.lit("forecast").alias("list"), F.col("segment").alias("_order"),
        F.to_json(F.struct(
            F.col("segment"), F.round("next_period_revenue", 2).alias("next_period_revenue"),
            F.array(F.round("confidence_lower", 2), F.round("confidence_upper", 2)).alias("confidence_interval"),
            _pct(F.col("pct_change_vs_current")).alias("pct_change_vs_current"),
            X.trend_arrow(F.col("trend_direction")).alias("trend"), F.round("r2_validation", 2).alias("r2"))).alias("item"))


def persona_items(personas: DataFrame) -> DataFrame:
    return personas.select(
        F.lit("persona").alias("list"), F.col("persona").alias("_order"),
        F.to_json(F.struct(
            F.col("persona").alias("segment"), F.col("persona_label").alias("persona"),
            F.round("avg_customer_sales", 2).alias("avg_deal_value"), _pct(F.col("avg_discount")).alias("avg_discount"),
            _pct(F.col("avg_margin")).alias("avg_margin"), "churn_risk", "top_region",
            F.col("cluster_size").alias("n_customers"))).alias("item"))


def deal_items(deals: DataFrame, key: str) -> DataFrame:
    """K2: per group the deals of the worst predicted margin."""
    worst = Window.partitionBy(key).orderBy(F.col("predicted_margin_rate").asc(), F.col("deal_id").asc())
    top = deals.withColumn("_rank", F.row_number().over(worst)).where(F.col("_rank") <= MAX_DEALS)
    return top.select(
        key, F.lit("deal").alias("list"), F.format_string("%05d", F.col("_rank")).alias("_order"),
        F.to_json(F.struct(
            F.col("deal_id").alias("id"), "segment", "region",
            _pct(F.col("predicted_margin_rate")).alias("predicted_margin"),
            _pct(F.col("discount")).alias("discount"), F.col("recommendation").alias("action"))).alias("item"))


def _object(name: Column, value: Column) -> Column:
    """A JSON object from one row per member (few: segments, regions)."""
    pairs = F.array_sort(F.collect_list(F.struct(name.alias("k"), value.alias("v"))))
    return F.coalesce(F.to_json(F.map_from_entries(pairs)), F.lit("{}"))


def _fixed_facts(fvc: DataFrame, avg_margin: DataFrame, facts: ModelFacts) -> DataFrame:
    """One row: the JSON of the summary and of the margins per segment."""
    from revlens.operators.forecast import aggregate_outlook
    out = aggregate_outlook(fvc).select(F.to_json(F.struct(
        F.round("total_next_period_revenue", 2).alias("global_yhat"),
        F.round("total_next_period_revenue", 2).alias("total_next_period_revenue"),
        _pct(F.col("aggregate_pct_change")).alias("aggregate_pct_change"),
        X.trend_arrow(F.col("aggregate_trend")).alias("aggregate_trend"))).alias("_summary"))
    margins = avg_margin.agg(_object(F.col("segment"), _pct(F.col("avg_margin"))).alias("_margins"))
    return attach_one_row(out, margins).withColumn("_r2", _number(facts.model_r2)).withColumn(
        "_clusters", _number(facts.n_clusters)).withColumn("_silhouette", _number(facts.silhouette))


def _number(x: float | None) -> Column:
    return F.lit("null" if x is None else f"{round(x, 2):g}")


def context_packets(fvc: DataFrame, deals: DataFrame, personas: DataFrame, groups: DataFrame, ceilings: DataFrame,
                    avg_margin: DataFrame, facts: ModelFacts = ModelFacts(), key: str = "region",
                    budget_tokens: int = TOKEN_BUDGET) -> DataFrame:
    """One row per group: json, token_estimate, budget_used_pct,
    pruning_log, n_items_kept, n_items_dropped.

    ``fvc``: forecast_vs_current rows, ``personas``: persona traits,
    ``avg_margin``: (segment, avg_margin) - shared by all groups; ``deals``:
    scored at-risk deals and ``ceilings``: (segment, region, ceiling), each
    with the group column; ``groups``: the distinct group keys.
    """
    shared = forecast_items(fvc).unionByName(persona_items(personas))
    gathered = shared.agg(F.collect_list(F.struct("list", "_order", "item")).alias("_shared"))
    head = groups.select(key).distinct()
    own = ceilings.groupBy(key).agg(
        _object(F.concat_ws("/", "segment", "region"), _pct(F.col("ceiling"))).alias("_ceilings"))
    head = head.join(own, key, "left").withColumn("_ceilings", F.coalesce("_ceilings", F.lit("{}")))
    head = attach_one_row(attach_one_row(head, _fixed_facts(fvc, avg_margin, facts)), gathered)

    empty = head.withColumn("_f", F.lit("")).withColumn("_p", F.lit("")).withColumn("_d", F.lit(""))
    full, budget = F.length(_packet()), F.lit(budget_tokens * CHARS_PER_TOKEN)
    empty = empty.withColumn("_cut", full > budget)
    empty = empty.withColumn("_ceilings", F.when(F.col("_cut"), F.lit("{}")).otherwise(F.col("_ceilings")))
    empty = empty.withColumn("_base", F.length(_packet())).drop("_f", "_p", "_d")

    items = empty.select(key, "_base", F.explode("_shared").alias("_s")).select(key, "_base", "_s.list", "_s._order", "_s.item")
    items = items.unionByName(deal_items(deals, key).join(empty.select(key, "_base"), key))
    prio = F.array_position(F.array(*[F.lit(x) for x in LISTS]), F.col("list"))
    comma = F.when(F.row_number().over(Window.partitionBy(key, "list").orderBy("_order")) > 1, 1).otherwise(0)
    running = Window.partitionBy(key).orderBy("_prio", "_order").rowsBetween(Window.unboundedPreceding, 0)
    items = items.withColumn("_prio", prio).withColumn("_size", F.length("item") + comma)
    items = items.withColumn("_keep", F.sum("_size").over(running) + F.col("_base") <= budget)

    def kept(name: str) -> Column:
        mine = F.when(F.col("_keep") & (F.col("list") == name), F.struct("_order", "item"))
        return F.array_join(F.transform(F.array_sort(F.collect_list(mine)), lambda s: s["item"]), ",")

    lost = [F.count_if(~F.col("_keep") & (F.col("list") == name)).alias(f"_lost_{name}") for name in LISTS]
    lists = items.groupBy(key).agg(kept("forecast").alias("_f"), kept("persona").alias("_p"), kept("deal").alias("_d"),
                                   F.count_if("_keep").alias("n_items_kept"),
                                   F.count_if(~F.col("_keep")).alias("n_items_dropped"), *lost)
    out = empty.join(lists, key, "left").fillna("", ["_f", "_p", "_d"]).fillna(0)
    names = {"deal": "at-risk deal(s)", "persona": "persona(s)", "forecast": "forecast segment(s)"}
    log = [F.when(F.col(f"_lost_{k}") > 0, F.format_string(f"dropped %d {v}", F.col(f"_lost_{k}"))) for k, v in names.items()]
    log.append(F.when(F.col("_cut"), F.lit("dropped the discount ceilings")))
    tokens = X.token_estimate(F.col("json"))
    return (out.select(key, _packet().alias("json"), F.array_compact(F.array(*log)).alias("pruning_log"),
                       "n_items_kept", "n_items_dropped")
               .withColumn("token_estimate", tokens)
               .withColumn("budget_used_pct", X.budget_used_pct(tokens, budget_tokens)))


def _packet() -> Column:
    """The packet's JSON from its parts."""
    parts = ['{"forecast":{"global_summary":', "_summary", ',"segments":[', "_f", ']},"margin":{"model_r2":', "_r2",
             ',"avg_margin_by_segment":', "_margins", ',"discount_ceiling":', "_ceilings", ',"at_risk_deals":[', "_d",
             ']},"segmentation":{"n_clusters":', "_clusters", ',"silhouette":', "_silhouette", ',"personas":[', "_p", "]}}"]
    return F.concat(*[F.coalesce(F.col(p), F.lit("null")) if p.startswith("_") else F.lit(p) for p in parts])


def check_packets(fvc: DataFrame, deals: DataFrame, personas: DataFrame) -> None:
    """Raise when no pillar has a row (three ``limit(1)`` jobs)."""
    if not any(df.limit(1).count() for df in (fvc, deals, personas)):
        raise EmptyPacketError("forecast, margin and segmentation are all empty")
