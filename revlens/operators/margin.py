"""Deal-margin modelling.

The margin model is boosted trees (``operators.boosting``) over nine plain
DOUBLE features (categorical columns enter as ordinal codes, like the
reference's label-encoded trees). Everything around it - encoders, medians,
modes, scoring, ceilings - is DataFrame code: joins against small
per-category tables and grouped aggregations. Along the discount a row's
prediction is a step function, which is built once per row and read at all
grid points, instead of a prediction per row and point.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revlens.functions import expressions as X
from revlens.operators import boosting
from revlens.operators.ingest import MODEL_CATEGORICALS, deal_features
from revlens.operators.quantiles import group_quantiles
from revlens.plans.joins import attach_one_row, small_table
from revlens.plans.materialize import materialize

# Model feature order.
FEATURES = ("quantity", "discount", "discount_x_quantity", "revenue_per_unit",
            "high_discount_flag_int", "segment_enc", "industry_enc", "region_enc", "product_enc")
OOV_CODE = -1


class MarginModelError(ValueError):
    pass


@dataclass(frozen=True)
class MarginParams:
    max_iter: int = 300
    step_size: float = 0.05
    max_depth: int = 5
    subsampling_rate: float = 0.8
    column_rate: float = 0.8         # of the features, drawn per tree
    min_instances: int = 10
    leaf_penalty: float = 1.0
    max_bins: int = 64
    batch_trees: int = 15            # trees that fit the same gradient (1: one after another)
    seed: int = 42
    test_fraction: float = 0.2
    min_rows: int = 100
    high_discount: float = 0.3
    margin_floor: float = 0.05       # ceiling: prediction must exceed this
    discount_step: float = 0.01
    discount_max: float = 0.80


# ---------------------------------------------------------------- M8 / J4
def fit_encoders(tx: DataFrame, columns=MODEL_CATEGORICALS) -> DataFrame:
    """M8: (column, value, code) with codes 0..n-1 in alphabetical order per
    column; NULL is no class (``deal_features`` fills it first). The table
    holds the classes only, so one sort per column is enough; it is written
    once, as every encoding joins it."""
    # one scan: every row contributes one (column, value) pair per column
    pairs = tx.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])).alias("_p"))
    distinct = pairs.select("_p.column", "_p.value").where(F.col("value").isNotNull()).distinct()
    code = F.row_number().over(Window.partitionBy("column").orderBy("value")) - 1
    return small_table(distinct.select("column", "value", code.cast("int").alias("code")), "encoders")


def encode(df: DataFrame, encoders: DataFrame, columns=MODEL_CATEGORICALS,
           warn: bool = True) -> DataFrame:
    """Add ``<col>_enc`` per column (unknown / NULL -> -1) and a
    ``warnings`` array naming each unknown value. One left join per column
    against that column's slice of the written encoder table, which carries a
    broadcast hint if its bytes are few (``fit_encoders``)."""
    out = df
    msgs, all_known = [], F.lit(True)
    for c in columns:
        enc = encoders.where(F.col("column") == c).select(F.col("value").alias(f"_{c}_v"),
                                                          F.col("code").alias(f"_{c}_code"))
        out = out.join(enc, out[c].cast("string") == enc[f"_{c}_v"], "left").drop(f"_{c}_v")
        known = F.col(f"_{c}_code").isNotNull()
        all_known = all_known & known
        msgs.append(F.when(~known, F.format_string(f"Unknown {c} '%s' encoded as -1.",
                                                   F.coalesce(F.col(c).cast("string"), F.lit("")))))
        out = out.withColumn(f"{c}_enc", F.coalesce(F.col(f"_{c}_code"), F.lit(OOV_CODE)))
    if warn:
        prev = F.col("warnings") if "warnings" in df.columns else F.array().cast("array<string>")
        # most rows have nothing to add
        out = out.withColumn("warnings", F.when(all_known, prev).otherwise(F.concat(prev, F.array_compact(F.array(*msgs)))))
    return out.drop(*[f"_{c}_code" for c in columns])


# ---------------------------------------------------------------- A4 / J3
def median_rev_per_unit(tx: DataFrame) -> DataFrame:
    """A4: exact median revenue per unit per segment, plus the global median
    as a row with segment NULL. Only the two columns needed are written, and
    read by the quantiles' passes."""
    f = materialize(tx.select("segment", X.revenue_per_unit("sales", "quantity").alias("rpu")), "rpu")
    out = "median_revenue_per_unit"
    by_segment, every = group_quantiles(f, [(["segment"], "rpu", out), ([], "rpu", out)])
    known = by_segment.where(F.col("segment").isNotNull())
    return small_table(known.unionByName(every.select(F.lit(None).cast("string").alias("segment"), out)), "medians")


def impute_rev_per_unit(deals: DataFrame, medians: DataFrame) -> DataFrame:
    """Revenue per unit = sales/quantity when positive, else the segment
    median, else (unknown segment) the mean of the segment medians."""
    seg = medians.where(F.col("segment").isNotNull())
    mean_med = seg.agg(F.avg("median_revenue_per_unit").alias("_mean_median"))
    own = F.when(F.col("quantity") > 0, F.try_divide(F.col("sales").cast("double"), F.col("quantity").cast("double")))
    out = attach_one_row(deals.join(seg.select("segment", F.col("median_revenue_per_unit").alias("_seg_median")),
                                    "segment", "left"), mean_med)
    imputed = ~(F.coalesce(own, F.lit(0.0)) > 0)
    return (out.withColumn("rpu_imputed", imputed)
               .withColumn("revenue_per_unit",
                           F.when(imputed, F.coalesce(F.col("_seg_median"), F.col("_mean_median"))).otherwise(own))
               .drop("_seg_median", "_mean_median"))


# ---------------------------------------------------------------- A5 / J5
def _mode_code(df: DataFrame, keys: list[str], code: str, out: str) -> DataFrame:
    """Most frequent code per group, ties -> smallest code. Two aggregations
    (group x code counts, then max_by), both with map-side combine."""
    counts = df.groupBy(*keys, code).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(*keys).agg(
        F.max_by(F.col(code), F.struct(F.col("_n"), -F.col(code))).alias(out))


def representative_deals(encoded: DataFrame, encoders: DataFrame) -> DataFrame:
    """A5: per (segment, region) of the encoder classes: median quantity,
    median revenue per unit, modal industry and product codes; combinations
    without rows fall back to the segment median quantity, the segment
    median revenue per unit and code 0."""
    # The narrow projection is read by the medians' passes and by the modes:
    # write it once instead of re-running joins and encoders.
    return representatives_of(materialize(encoded.select("segment", "region", F.col("quantity").cast("double").alias("quantity"),
                                                         "revenue_per_unit", "industry_enc", "product_enc"), "representatives"), encoders)


def representatives_of(base: DataFrame, encoders: DataFrame) -> DataFrame:
    """``representative_deals`` of a written table of the columns they need."""
    keys = ["segment", "region"]
    rep = combo_grid(encoders)
    # all four medians share their passes
    wanted = [(level, col, f"{pre}_{short}") for level, pre in ((keys, "med"), (["segment"], "seg"))
              for col, short in (("quantity", "quantity"), ("revenue_per_unit", "rpu"))]
    for (level, _, _), medians in zip(wanted, group_quantiles(base, wanted)):
        rep = rep.join(medians, level, "left")
    for code in ("industry_enc", "product_enc"):
        rep = rep.join(_mode_code(base, keys, code, code), keys, "left")
    return rep.select(
        "segment", "region", "segment_enc", "region_enc",
        F.coalesce("med_quantity", "seg_quantity").alias("quantity"),
        F.coalesce("med_rpu", "seg_rpu").alias("revenue_per_unit"),
        F.coalesce("industry_enc", F.lit(0)).alias("industry_enc"),
        F.coalesce("product_enc", F.lit(0)).alias("product_enc"),
    )


def combo_grid(encoders: DataFrame) -> DataFrame:
    """Every segment class x every region class. The region classes are
    gathered into one sorted array (one row, bounded by the number of
    regions) and exploded onto each segment row."""
    seg = encoders.where(F.col("column") == "segment").select(
        F.col("value").alias("segment"), F.col("code").alias("segment_enc"))
    regs = encoders.where(F.col("column") == "region").agg(
        F.array_sort(F.collect_list(F.struct(F.col("value").alias("region"),
                                             F.col("code").alias("region_enc")))).alias("_regions"))
    return (attach_one_row(seg, regs)
               .select("segment", "segment_enc", F.explode("_regions").alias("_r"))
               .select("segment", "segment_enc", "_r.region", "_r.region_enc"))


def discount_steps(step: float = 0.01, max_discount: float = 0.80):
    n = int(round(max_discount / step))
    return F.explode(F.sequence(F.lit(0), F.lit(n))), n


def ceiling_grid(reps: DataFrame, params: MarginParams = MarginParams()) -> DataFrame:
    """Every representative row x discounts 0, step, .., max (81 rows
    for 0.01 / 0.80), with the model features filled in."""
    n = int(round(params.discount_max / params.discount_step))
    g = reps.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(n))))
    d = F.round(F.col("_i") * F.lit(params.discount_step), 2)
    return (g.withColumn("discount", d).drop("_i")
             .withColumn("discount_x_quantity", F.col("discount") * F.col("quantity"))
             .withColumn("high_discount_flag_int", (F.col("discount") > params.high_discount).cast("int")))


# ---------------------------------------------------------------- M9
@dataclass
class MarginModel:
    """A predictor (anything with ``transform``) and its small tables. The
    hold-out metrics need a fit of their own and are made when first asked."""
    model: boosting.Trees
    encoders: DataFrame
    medians: DataFrame
    importances: list[tuple[str, float]]
    metrics: dict = field(default_factory=dict)
    measure: object = None
    representatives: DataFrame | None = None

    def _metric(self, name: str) -> float:
        if name not in self.metrics and self.measure is not None:
            self.metrics.update(self.measure())
        return self.metrics[name]

    @property
    def r2(self) -> float:
        return self._metric("r2")

    @property
    def mae(self) -> float:
        return self._metric("mae")


def _prepared(tx: DataFrame, params: MarginParams):
    """Encoders and the written training frame, with the hold-out flag. The
    split follows a hash of the row, so results don't depend on the cluster's
    size. Rows without a label are kept, as the representative deals count them."""
    feats = deal_features(tx, params.high_discount)
    encoders = fit_encoders(feats)
    enc = encode(feats, encoders, warn=False)
    cols = [F.col(c).cast("double").alias(c) for c in FEATURES]
    data = enc.select("segment", "region", *cols, F.col("margin_rate").cast("double").alias("label"))
    data = data.withColumn("_h", F.xxhash64(F.lit(params.seed), *FEATURES, "label"))
    data = data.withColumn("_test", F.pmod("_h", F.lit(1000)) < F.lit(int(1000 * params.test_fraction)))
    return encoders, materialize(data.drop("_h"), "training")


def boost_params(params: MarginParams) -> boosting.BoostParams:
    return boosting.BoostParams(trees=params.max_iter, step=params.step_size, depth=params.max_depth, row_rate=params.subsampling_rate,
                                column_rate=params.column_rate, min_rows=params.min_instances, leaf_penalty=params.leaf_penalty,
                                max_bins=params.max_bins, batch=params.batch_trees, seed=params.seed)


def regression_metrics(scored: DataFrame, label: str = "label", prediction: str = "prediction") -> dict:
    """R2 and mean absolute error (4 dp) in one aggregation."""
    y, error = F.col(label), F.col(label) - F.col(prediction)
    m = scored.agg(F.avg(error * error).alias("mse"), F.avg(F.abs(error)).alias("mae"), F.var_pop(y).alias("var")).first()
    return {"r2": round(1 - m["mse"] / m["var"], 4) if m["var"] else None, "mae": None if m["mae"] is None else round(m["mae"], 4)}


def train_margin_model(tx: DataFrame, params: MarginParams = MarginParams(), metrics_now: bool = False) -> MarginModel:
    """M9: the model is fitted on all rows; hold-out R2/MAE come from a second
    fit on 80 % of them, made when they are asked for - or, if they are wanted
    anyway (``metrics_now``), at the same time as the first. The medians and
    the representative deals are made meanwhile, as a fit's passes are short."""
    encoders, every = _prepared(tx, params)
    data = every.where(F.col("label").isNotNull())
    n = data.count()
    if n < params.min_rows:
        raise MarginModelError(f"need >= {params.min_rows} rows to train, got {n}")

    def fit(rows: DataFrame) -> boosting.Trees:
        return boosting.fit(rows, FEATURES, "label", boost_params(params))

    def measure() -> dict:
        return regression_metrics(fit(data.where(~F.col("_test"))).transform(data.where(F.col("_test"))))

    def represent() -> DataFrame:
        codes = [F.col(c).cast("int").alias(c) for c in ("industry_enc", "product_enc")]
        base = every.select("segment", "region", "quantity", "revenue_per_unit", *codes)
        return small_table(representatives_of(base, encoders), "representatives")

    with ThreadPoolExecutor(max_workers=4) as pool:
        fitted, medians, reps = pool.submit(fit, data), pool.submit(median_rev_per_unit, tx), pool.submit(represent)
        measured = pool.submit(measure) if metrics_now else None
        model = fitted.result()
        return MarginModel(model=model, encoders=encoders, medians=medians.result(), importances=model.importances(),
                           metrics=measured.result() if measured else {}, measure=measure, representatives=reps.result())


def predict(model: MarginModel, feats: DataFrame, **how) -> DataFrame:
    """Run the predictor on rows that carry the nine feature columns."""
    casted = feats
    for c in FEATURES:
        casted = casted.withColumn(c, F.col(c).cast("double"))
    return model.model.transform(casted, **how).drop("features")


def predicted_rates(model: MarginModel, feats: DataFrame) -> DataFrame:
    """Predictions clipped to [-1, 1] and rounded to 4 places as
    ``predicted_margin_rate``. Trees round where they predict, as Spark's own
    rounding of a double by decimals costs about as much as all trees."""
    if isinstance(model.model, boosting.Trees):
        return predict(model, feats, then=rounded_rates).withColumnRenamed("prediction", "predicted_margin_rate")
    rate = F.round(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("prediction"))), 4)
    return predict(model, feats).withColumn("predicted_margin_rate", rate)


def rounded_rates(p: np.ndarray) -> np.ndarray:
    """Margins clipped to [-1, 1] and rounded to 4 places as Spark's ``round``
    does it (half up, by the shortest decimal of the double)."""
    clipped = np.clip(p, -1.0, 1.0)
    scaled = clipped * 1e4
    out = np.rint(scaled) / 1e4 + 0.0
    for at in map(tuple, np.argwhere(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-6)):
        out[at] = float(Decimal(repr(float(clipped[at]))).quantize(Decimal("0.0001"), ROUND_HALF_UP)) + 0.0
    return out


def discount_curve(model: MarginModel, params: MarginParams = MarginParams(), rounded: bool = False) -> Column:
    """The predicted margins at all grid discounts as an array column, for rows
    with the six features that don't depend on the discount: the trees' step
    function along the discount, built once per row. Rows with a negative or
    missing quantity are predicted point by point (their steps may run back).
    ``rounded``: structs of each prediction and its margin rate
    (``rounded_rates``), as Spark's own rounding of so many doubles by decimals
    costs more than the prediction."""
    trees: boosting.Trees = model.model
    n = int(round(params.discount_max / params.discount_step))
    grid = np.round(np.arange(n + 1) * params.discount_step, 2)
    high = (grid > params.high_discount).astype(float)
    still = [c for c in FEATURES if c not in ("discount", "discount_x_quantity", "high_discount_flag_int")]

    def curves(columns: tuple[pa.Array, ...]) -> np.ndarray:
        given = dict(zip(still, (c.to_numpy(zero_copy_only=False).astype(np.float64) for c in columns)))
        out = np.empty((len(columns[0]), len(grid)))
        for at in range(0, len(out), 16_384):
            part = {c: v[at : at + 16_384] for c, v in given.items()}
            along = grid[None, :] * part["quantity"][:, None]
            x = np.column_stack([part.get(c, np.zeros(len(along))) for c in FEATURES])
            plain = ~(part["quantity"] >= 0)
            rows = np.flatnonzero(~plain)
            out[at + rows] = trees.steps(x[rows], grid, {"discount": grid, "discount_x_quantity": along[rows], "high_discount_flag_int": high})
            for i in np.flatnonzero(plain):
                full = np.repeat(x[i : i + 1], len(grid), axis=0)
                for c, v in (("discount", grid), ("discount_x_quantity", along[i]), ("high_discount_flag_int", high)):
                    full[:, FEATURES.index(c)] = v
                out[at + i] = trees.predict(full)
        return out

    def listed(out: np.ndarray) -> pa.Array:
        ends = np.arange(0, out.size + 1, out.shape[1], dtype=np.int32)
        return pa.ListArray.from_arrays(ends, np.ascontiguousarray(out).reshape(-1))

    @F.arrow_udf("array<double>")
    def curve(*columns: pa.Array) -> pa.Array:
        return listed(curves(columns))

    @F.arrow_udf("prediction array<double>, rate array<double>")
    def both(*columns: pa.Array) -> pa.Array:
        out = curves(columns)
        return pa.StructArray.from_arrays([listed(out), listed(rounded_rates(out))], names=["prediction", "rate"])

    return (both if rounded else curve)(*[F.col(c).cast("double") for c in still])


# ---------------------------------------------------------------- M11
def discount_ceilings(model: MarginModel, tx: DataFrame, params: MarginParams = MarginParams()) -> DataFrame:
    """Per segment x region the LARGEST grid discount whose predicted
    margin exceeds the floor (0.0 when none does), rounded to 2 dp. Boosted
    trees give each representative deal's step function; any other predictor
    is run on the grid."""
    reps = model.representatives
    if reps is None:
        encoded = encode(deal_features(tx, params.high_discount), model.encoders, warn=False)
        reps = representative_deals(encoded, model.encoders)
    if isinstance(model.model, boosting.Trees):
        above = F.filter(F.transform("_curve", lambda p, i: F.when(p > params.margin_floor, i)), lambda i: i.isNotNull())
        last = F.coalesce(F.array_max(above), F.lit(0))
        return (reps.withColumn("_curve", discount_curve(model, params))
                    .select("segment", "region", F.round(last * F.lit(params.discount_step), 2).alias("ceiling")))
    grid = ceiling_grid(reps, params)
    scored = predict(model, grid)
    return (scored.groupBy("segment", "region")
                  .agg(F.round(F.coalesce(F.max(F.when(F.col("prediction") > params.margin_floor,
                                                       F.col("discount"))), F.lit(0.0)), 2)
                       .alias("ceiling")))


# ---------------------------------------------------------------- M10 / J2
def score_deals(model: MarginModel, deals: DataFrame, ceilings: DataFrame | None = None,
                params: MarginParams = MarginParams()) -> DataFrame:
    """Predict, clip to [-1, 1], round 4, flag, rating, recommendation,
    ceiling (NULL -> 0.0 as max_safe_discount) and per-row warnings. Bad rows
    never fail the batch: problems become entries of ``warnings``."""
    rp = impute_rev_per_unit(deals, model.medians)
    imputed_msg = F.format_string("No revenue per unit given; the segment's median of %.2f stands in.", F.col("revenue_per_unit"))
    nothing = F.array_compact(F.array(F.lit(None).cast("string")))
    rp = rp.withColumn("warnings", F.when(F.col("rpu_imputed"), F.array(imputed_msg)).otherwise(nothing))
    q, d = F.col("quantity").cast("double"), F.col("discount").cast("double")
    rp = (rp.withColumn("discount_x_quantity", d * q)
            .withColumn("high_discount_flag_int", (d > params.high_discount).cast("int")))
    out = predicted_rates(model, encode(rp, model.encoders))
    if ceilings is not None:
        note = X.ceiling_note("segment", "region", "ceiling")  # there are few
        out = out.join(ceilings.select("segment", "region", F.col("ceiling").alias("discount_ceiling"), note.alias("_note")),
                       ["segment", "region"], "left")
    else:
        out = out.withColumns({"discount_ceiling": F.lit(None).cast("double"), "_note": F.lit(None).cast("string")})
    p = F.col("predicted_margin_rate")
    return out.select(
        *[c for c in deals.columns],
        "predicted_margin_rate",
        X.margin_flag(p).alias("margin_flag"),
        X.margin_rating(p).alias("margin_rating"),
        X.is_profitable(p).alias("is_profitable"),
        F.coalesce(F.col("discount_ceiling"), F.lit(0.0)).alias("max_safe_discount"),
        X.recommendation(p, F.col("discount"), F.col("_note"), X.rate_text(p)).alias("recommendation"),
        X.discount_use(F.col("discount"), F.col("discount_ceiling")).alias("discount_use"),
        X.within_ceiling(F.col("discount"), F.coalesce(F.col("discount_ceiling"), F.lit(0.0))).alias("within_ceiling"),
        "warnings",
    )


def feature_importances(model: MarginModel, spark, top: int = 3) -> DataFrame:
    """K3: top-k feature importances (nine numbers from the fitted model)."""
    rows = [(name, float(v), i + 1) for i, (name, v) in enumerate(model.importances[:top])]
    return spark.createDataFrame(rows, "feature string, importance double, rank int")


# ---------------------------------------------------------------- M17 / M18 / M19
@dataclass(frozen=True)
class RuleTables:
    """The rule-based curves as data: what a value of a column adds. Pass
    other tables to use other names of industries, products, ...

    Fixed values: the defaults (percent; percentage points for offsets)."""
    base_ceiling: float = 15.0
    cliff_gap: float = 15.0
    industry_ceiling: dict = field(default_factory=lambda: {"Tech": 22.0, "Finance": 12.0, "Healthcare": 18.0})
    product_adjust: dict = field(default_factory=lambda: {"Enterprise API": 5.0, "Basic": -3.0})
    segment_offset: dict = field(default_factory=lambda: {"Enterprise": -2.5, "Small Business": 1.0})
    region_offset: dict = field(default_factory=lambda: {"Europe": 1.5, "APAC": -1.0})
    product_offset: dict = field(default_factory=lambda: {"Enterprise API": 4.0, "Basic": -2.0})
    volume_slope: float = -1.5  # per 1000 units
    cliff_pct: float = 35.0
    # pieces of the margin curve: up to this discount, margin at its start, loss per point
    pieces: tuple = ((10, 28.0, 1.2), (25, 16.0, 0.8), (40, 4.0, 0.4), (None, -2.0, 0.5))
    floor: float = -15.0


def _lookup(col, table: dict, default):
    expr = F.lit(default)
    for k, v in table.items():
        expr = F.when(col == k, F.lit(v)).otherwise(expr)
    return expr


def rule_recovery(deals: DataFrame, rules: RuleTables = RuleTables()) -> DataFrame:
    """Rule ceiling (percent) per deal, cliff = ceiling + gap, recovery
    = sales * max(0, discount% - ceiling) / 100."""
    ceiling = _lookup(F.col("industry"), rules.industry_ceiling, rules.base_ceiling) + \
        _lookup(F.col("product"), rules.product_adjust, 0.0)
    over = F.col("discount").cast("double") * 100 - F.col("safe_ceiling_pct")
    return (deals.withColumn("safe_ceiling_pct", ceiling)
                 .withColumn("cliff_pct", F.col("safe_ceiling_pct") + rules.cliff_gap)
                 .withColumn("recovery", F.col("sales").cast("double") * F.greatest(F.lit(0.0), over) / 100))


def discount_sweep(deals: DataFrame, max_pct: int = 80, rules: RuleTables = RuleTables()) -> DataFrame:
    """Per deal the rule-based margin (percent, 1 dp) at every discount
    0..max_pct and its zone (danger above the cliff)."""
    o = (_lookup(F.col("segment"), rules.segment_offset, 0.0)
         + _lookup(F.col("region"), rules.region_offset, 0.0)
         + _lookup(F.col("product"), rules.product_offset, 0.0)
         + F.col("quantity").cast("double") / 1000 * rules.volume_slope)
    d = F.col("discount_pct").cast("double")
    begins = [0, *[p[0] for p in rules.pieces[:-1]]]
    margin = F.greatest(F.lit(rules.floor), F.lit(rules.pieces[-1][1]) + o - (d - begins[-1]) * rules.pieces[-1][2])
    for start, (upto, at_start, slope) in reversed(list(zip(begins, rules.pieces))[:-1]):
        margin = F.when(d <= upto, F.lit(at_start) + o - (d - start) * slope).otherwise(margin)
    return (deals.withColumn("discount_pct", F.explode(F.sequence(F.lit(0), F.lit(max_pct))))
                 .withColumn("margin_pct", F.round(margin, 1))
                 .withColumn("zone", F.when(d > rules.cliff_pct, "danger").otherwise("healthy")))


def discount_sweep_model(model: "MarginModel", deals: DataFrame, params: MarginParams = MarginParams()) -> DataFrame:
    """M18, model mode: per deal the model's predicted margin at every grid
    discount (0..max step), revenue per unit from the deal (segment median
    when missing), categorical codes from the model's encoders. A deal's
    margins are read from its step function; only the results are exploded, with
    their rates already rounded."""
    rp = impute_rev_per_unit(deals, model.medians)
    enc = encode(rp, model.encoders, warn=False).withColumn("deal_discount", F.col("discount"))
    swept = enc.drop("discount").withColumn("_curve", discount_curve(model, params, rounded=True))
    n = int(round(params.discount_max / params.discount_step))
    grid = F.lit([float(d) for d in np.round(np.arange(n + 1) * params.discount_step, 2)])
    # the grid's discounts are rounded once, the rates with their curve; predictions are read by their
    # place, so that they needn't be exploded where only the rates are wanted; the outer form, as Spark would
    # make the curves once more to look for empty ones
    kept = [F.col(f"`{c}`") for c in swept.columns if c != "_curve"]
    points = swept.select(*kept, F.col("_curve.prediction").alias("_predictions"), F.posexplode_outer("_curve.rate").alias("_point", "predicted_margin_rate"))
    at = F.col("_point")
    return points.select(*kept, F.get("_predictions", at).alias("prediction"), F.get(grid, at).alias("discount"), "predicted_margin_rate")


# Default what-if discount scenarios.
WHATIF_SCENARIOS = (0.0, 0.05, 0.10, 0.20)


def whatif_discount(tx: DataFrame, scenarios=WHATIF_SCENARIOS) -> DataFrame:
    """List value = sales / (1 - discount) (rows with discount = 1 are
    excluded), scenario revenue = list * (1 - s); per month x segment x
    scenario: actual, scenario revenue and their difference. The scenario
    list is exploded after the per-row list value is computed; the
    aggregation is partial on the map side."""
    base = tx.where(F.col("discount") < 1).select(
        F.trunc("order_date", "month").alias("month"), "segment",
        F.col("sales").cast("double").alias("sales"),
        (F.col("sales").cast("double") / (1 - F.col("discount").cast("double"))).alias("list_value"))
    sc = F.array(*[F.lit(float(s)) for s in scenarios])
    g = base.withColumn("scenario_discount", F.explode(sc))
    agg = g.groupBy("month", "segment", "scenario_discount").agg(
        F.sum("sales").alias("actual_revenue"),
        F.sum(F.col("list_value") * (1 - F.col("scenario_discount"))).alias("scenario_revenue"))
    return agg.withColumn("revenue_delta", F.col("scenario_revenue") - F.col("actual_revenue"))
