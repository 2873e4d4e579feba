"""Column-valued business rules (pure expressions, no actions).

Every function takes and returns ``Column`` so it stays inside whole-stage
codegen and can be used in ``select``/``withColumn``/``agg`` on batch or
streaming DataFrames alike.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    if isinstance(x, Column):
        return x
    if isinstance(x, str):
        return F.col(x)
    return F.lit(x)


def as_double(x) -> Column:
    return _c(x).cast("double")


def exact_avg(x, scale: int = 12) -> Column:
    """Mean of values rounded to ``scale`` decimals: the sum is exact, so it
    doesn't depend on the order in which tasks add up, and is divided once."""
    v = F.round(as_double(x), scale).cast(f"decimal({scale + 16},{scale})")
    return F.sum(v).cast("double") / F.count(v)


# ---------------------------------------------------------------- features
def margin_rate(profit="profit", sales="sales") -> Column:
    """clip(profit / sales, -1, 1); NULL when sales is 0 or NULL."""
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(as_double(profit), as_double(sales))))


def high_discount_flag(discount="discount", threshold: float = 0.3) -> Column:
    """Strictly above the threshold."""
    return _c(discount) > F.lit(threshold)


def revenue_per_unit(sales="sales", quantity="quantity", floor: float = 1e-6) -> Column:
    return as_double(sales) / F.greatest(as_double(quantity), F.lit(floor))


# ---------------------------------------------------------------- X1 / X2
def trend(pct, band: float = 0.05) -> Column:
    """up when pct >= band, down when pct <= -band, else flat."""
    p = _c(pct)
    return F.when(p >= band, "up").when(p <= -band, "down").otherwise("flat")


# The mark of each trend in context packets.
TREND_ARROWS = {"up": "↑", "down": "↓", "flat": "→"}


def trend_arrow(direction: Column) -> Column:
    """The arrow of a trend's name (sideways for any other name)."""
    out = F.lit(TREND_ARROWS["flat"])
    for name, arrow in TREND_ARROWS.items():
        out = F.when(direction == name, F.lit(arrow)).otherwise(out)
    return out


def pct_change(nxt, current) -> Column:
    """(next - current) / current, 0 when current <= 0."""
    n, c = as_double(nxt), as_double(current)
    return F.when(c > 0, (n - c) / c).otherwise(F.lit(0.0))


# ---------------------------------------------------------------- X3 / X4
GREEN_FLOOR = 0.15
CAUTION_FLOOR = 0.05


def margin_flag(pred) -> Column:
    p = _c(pred)
    return F.when(p >= GREEN_FLOOR, "green").when(p >= CAUTION_FLOOR, "caution").otherwise("red")


def margin_rating(rate) -> Column:
    r = _c(rate)
    return F.when(r >= GREEN_FLOOR, "healthy").when(r >= CAUTION_FLOOR, "at_risk").otherwise("critical")


def is_profitable(rate) -> Column:
    return _c(rate) > 0


def pct_text(x, decimals: int = 1) -> Column:
    """A ratio as percent text, rounded half up in decimals (a binary product
    may miss a tie)."""
    pct = F.round(as_double(x).cast("decimal(18,6)") * 100, decimals).cast(f"decimal(18,{decimals})")
    return F.concat(pct.cast("string"), F.lit("%"))


def rate_text(rate) -> Column:
    """``pct_text`` of a rate of at most 4 decimals, by whole numbers, which
    cost a fraction of decimals."""
    n = F.rint(as_double(rate) * 10000).cast("long")
    tenths = F.floor((F.abs(n) + 5) / 10)
    sign = F.when((n < 0) & (tenths > 0), F.lit("-")).otherwise(F.lit(""))
    return F.concat(sign, F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit("%"))


def ceiling_note(segment, region, ceiling) -> Column:
    """The sentence on a known ceiling."""
    return F.concat(F.lit(" Safe ceiling for "), _c(segment), F.lit("/"), _c(region), F.lit(": "), pct_text(ceiling, 0), F.lit("."))


def recommendation(pred, discount, note, rate=None) -> Column:
    """Traffic-light recommendation text; the ceiling sentence (``note``) is
    added only when a ceiling is known. ``rate``: the prediction's text, if it
    is made in another way than by ``pct_text``."""
    # Recommendation sentences.
    suffix = F.coalesce(_c(note), F.lit(""))
    p = _c(pred)
    rate = pct_text(p, 1) if rate is None else rate
    green = F.concat(F.lit("Margin is healthy at "), rate,
                     F.lit(". Deal is within acceptable range."), suffix)
    caution = F.concat(F.lit("Margin is thin at "), rate, F.lit(". Current discount ("),
                       pct_text(discount, 0), F.lit(") is approaching the risk zone."), suffix)
    red = F.concat(F.lit("Predicted margin ("), rate,
                   F.lit(") is below the 5% threshold. Discount of "), pct_text(discount, 0),
                   F.lit(" is too aggressive for this deal."), suffix,
                   F.lit(" Revise terms or escalate for approval."))
    return F.when(p >= GREEN_FLOOR, green).when(p >= CAUTION_FLOOR, caution).otherwise(red)


# ---------------------------------------------------------------- X5 / X6 / X7
# Cut points, and the label of (value is high, what stands out).
LABEL_VALUE, LABEL_MARGIN, LABEL_DISCOUNT = 5000, 0.15, 0.20
LABELS = {
    True: {"margin": "Champion", "discount": "Value Seeker", "nothing": "High Value"},
    False: {"margin": "Steady SMB", "discount": "At Risk", "nothing": "Standard"},
}


def persona_label(avg_value, avg_discount, avg_margin) -> Column:
    """What stands out - a good margin before a deep discount - names the
    persona, in a list for high and one for low values."""
    standout = (F.when(_c(avg_margin) >= LABEL_MARGIN, "margin")
                .when(_c(avg_discount) >= LABEL_DISCOUNT, "discount").otherwise("nothing"))
    names = {high: F.create_map(*[F.lit(x) for kv in table.items() for x in kv]) for high, table in LABELS.items()}
    return F.when(_c(avg_value) >= LABEL_VALUE, names[True][standout]).otherwise(names[False][standout])


def churn_risk(avg_discount, avg_margin) -> Column:
    d, m = _c(avg_discount), _c(avg_margin)
    return (F.when((m < 0.10) | (d >= 0.25), "high")
            .when((m < 0.15) | (d >= 0.15), "medium").otherwise("low"))


# Persona names and their action signals.
PERSONA_CHAMPIONS = "Champions"
PERSONA_SEEKERS = "Discount Seekers"
PERSONA_VOLUME = "Volume Accounts"
PERSONA_AT_RISK = "At-Risk"
ACTION_SIGNALS = {
    "Champions": "Protect & Upsell",
    "Discount Seekers": "Reprice & Cap Discounts",
    "Volume Accounts": "Retention Strategy",
    "At-Risk": "Immediate Intervention",
}
DEFAULT_ACTION = "Analyze Behavior"


def action_signal(name) -> Column:
    n = _c(name)
    expr = None
    for persona, signal in ACTION_SIGNALS.items():
        expr = F.when(n == persona, signal) if expr is None else expr.when(n == persona, signal)
    return expr.otherwise(DEFAULT_ACTION)


# ---------------------------------------------------------------- X8 .. X11
CHARS_PER_TOKEN = 4
TOKEN_BUDGET = 600


def token_estimate(text) -> Column:
    """ceil(chars / 4) as BIGINT."""
    return F.ceil(F.length(_c(text)) / F.lit(CHARS_PER_TOKEN)).cast("bigint")


def budget_used_pct(tokens, budget: int = TOKEN_BUDGET) -> Column:
    return F.round(F.lit(100.0) * as_double(tokens) / F.lit(float(budget)), 1)


def margin_band(margin_pct) -> Column:
    """Explorer colour band of a margin given in percent."""
    m = _c(margin_pct)
    return F.when(m >= 15, "healthy").when(m >= 10, "thin").otherwise("low")


def discount_use(discount, ceiling) -> Column:
    """Share of the safe ceiling used, capped at 1 (0.01 floor for ceiling)."""
    c = F.coalesce(F.when(as_double(ceiling) != 0, as_double(ceiling)), F.lit(0.01))
    return F.least(as_double(discount) / c, F.lit(1.0))


def within_ceiling(discount, ceiling) -> Column:
    return _c(discount) <= _c(ceiling)


def target_progress(margin_pct, target: float = 25.0) -> Column:
    return F.least(F.lit(100.0), as_double(margin_pct) / F.lit(float(target)) * 100)
