"""Exploration operators: preview, listing, search, paging, time ranges
(S4, S5, F1, F3, W5, K4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revlens.functions import expressions as X
from revlens.operators.rollups import last_months
from revlens.operators.sequence import with_row_number
from revlens.plans.joins import attach_one_row, small_table

# Total order used wherever rows must be listed deterministically: the
# reference lists rows in file order, which a distributed table does not have.
LISTING_ORDER = ("order_date", "order_id", "customer", "segment", "region", "product", "sales")


def listing(tx: DataFrame) -> DataFrame:
    """The preview projection without a limit. Margin is shown as
    ``round(margin_rate * 100, 1)`` (percent) and as text with a % sign."""
    margin = X.margin_rate("profit", "sales") if "margin_rate" not in tx.columns else F.col("margin_rate")
    pct = F.round(F.coalesce(margin, F.lit(0.0)) * 100, 1)
    return tx.select(
        F.coalesce(F.col("order_id").cast("string"), F.lit("")).alias("order_id"),
        F.date_format("order_date", "yyyy-MM-dd").alias("order_date"),
        "customer", "segment",
        F.coalesce(F.col("region"), F.lit("Global")).alias("region"),
        "product",
        F.coalesce(F.col("sales").cast("double"), F.lit(0.0)).alias("sales"),
        pct.alias("margin_pct"),
        F.concat(F.format_string("%.1f", pct), F.lit("%")).alias("margin"),
    )


def preview(tx: DataFrame, n: int = 100) -> DataFrame:
    """Total row count plus the first n rows in LISTING_ORDER.
    ``orderBy.limit`` is a TakeOrderedAndProject (per-task top-n); the count
    is a global aggregate of its own scan, read as a scalar subquery."""
    rows = listing(tx)
    top = rows.orderBy(*[F.col(c).asc_nulls_first() for c in LISTING_ORDER], "margin_pct").limit(n)
    total = tx.agg(F.count(F.lit(1)).alias("total_count"))
    return attach_one_row(top, total)


def search(tx: DataFrame, term: str, segment: str | None = None) -> DataFrame:
    """case-insensitive substring match on order id OR customer, AND
    segment equality unless segment is None/'All'."""
    t = F.lit(term.lower())
    cond = (F.lower(F.coalesce(F.col("order_id").cast("string"), F.lit(""))).contains(t)
            | F.lower(F.coalesce(F.col("customer"), F.lit(""))).contains(t))
    if segment not in (None, "All"):
        cond = cond & (F.col("segment") == F.lit(segment))
    return tx.where(cond)


#: Rows of a sample of keys, standard deviations of a rank in it that fences keep off, rows between fences that are sorted.
SAMPLED, APART, FENCED = 16_384, 4, 20_000


def page(df: DataFrame, order_by: list[str], number: int | None = None, size: int = 12) -> DataFrame:
    """Page slicing in ascending order of the columns ``order_by`` (nulls
    first). With ``number`` the page is clamped to
    [1, total_pages] and only its rows are returned; without it every row
    gets its page number (total_pages = max(1, ceil(n / size))).

    One page is a rank selection (``rows_between_ranks``): only the few rows
    between two fences around it are sorted, wherever the page lies. All
    pages need row numbers, which come from ``with_row_number``
    (range-partitioned sort and partition offsets), never from a
    single-partition window."""
    if number is not None:
        n = df.count()
        pages = max(1, -(-n // size))
        wanted = min(max(number, 1), pages)
        skip = (wanted - 1) * size
        rows = rows_between_ranks(df, order_by, skip, min(size, n - skip), n)
        w = Window.orderBy(*[_asc(c) for c in order_by])  # one page
        return (rows.withColumn("row_number", (F.row_number().over(w) + F.lit(skip)).cast("long"))
                    .withColumn("page", F.lit(wanted).cast("long")).withColumn("total_pages", F.lit(pages).cast("long")))
    numbered = with_row_number(df, [_asc(c) for c in order_by], name="row_number")
    numbered = numbered.withColumn("page", F.ceil(F.col("row_number") / F.lit(size)).cast("long"))
    total = numbered.agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / F.lit(size))).cast("long")
                         .alias("total_pages"))
    return attach_one_row(numbered, total)


def rows_between_ranks(df: DataFrame, order_by: list[str], skip: int, rows: int, n: int | None = None) -> DataFrame:
    """The ``rows`` rows after the first ``skip`` ones, in ascending order of
    ``order_by`` (nulls first), without sorting the others.

    A sample of keys names two fences around the wanted ranks; one pass counts
    the rows below and between them exactly. Fences that miss the ranks are
    moved outwards; as long as many rows lie between them, a sample of those
    gives closer ones. Rows that share a fence's whole key are
    interchangeable: if fences meet, the rows of that key are counted off.
    Numbers of rows are never limits of Spark's (2^31), but for the rows
    between the last fences."""
    n = df.count() if n is None else n
    if rows <= 0:
        return df.limit(0)
    key = F.struct(*[F.col(c) for c in order_by])
    types = [df.schema[c].dataType for c in order_by]

    def fence(values) -> Column:
        return F.struct(*[F.lit(v).cast(t).alias(c) for c, v, t in zip(order_by, values, types)])

    inside, below, between = df, 0, n
    low = high = None
    while between > FENCED:
        share = min(1.0, SAMPLED / between)
        keys = [tuple(r) for r in inside.select(*order_by).sample(share, seed=7).orderBy(*[_asc(c) for c in order_by]).collect()]
        apart = APART * int(len(keys) ** 0.5) + 1
        first, last = (skip - below) / between * len(keys), (skip + rows - below) / between * len(keys)
        while True:
            a, b = int(first) - apart, int(last) + apart
            new_low, new_high = (keys[a] if 0 <= a < len(keys) else low), (keys[b] if 0 <= b < len(keys) else high)
            under = F.lit(False) if new_low is None else key < fence(new_low)
            over = F.lit(False) if new_high is None else key > fence(new_high)
            seen = inside.agg(F.count_if(under).alias("under"), F.count_if(~under & ~over).alias("within")).first()
            if below + seen["under"] <= skip and skip + rows <= below + seen["under"] + seen["within"]:
                break
            apart *= 4
        closer = seen["within"] < between
        low, high, below, between = new_low, new_high, below + seen["under"], seen["within"]
        inside = inside.where(~under & ~over)
        if low is not None and low == high:
            return inside.limit(rows)  # equal keys all of them
        if not closer:
            # few different keys: part the rows at the key that holds the rank
            return _at_keys(inside, order_by, skip - below, rows)
    return inside.orderBy(*[_asc(c) for c in order_by]).limit(skip - below + rows).offset(skip - below)


def _at_keys(df: DataFrame, order_by: list[str], skip: int, rows: int) -> DataFrame:
    """``rows_between_ranks`` for rows of few different keys, by counts of the keys."""
    counts = small_table(df.groupBy(*order_by).agg(F.count(F.lit(1)).alias("_n")), "keys")
    upto = F.sum("_n").over(Window.orderBy(*[_asc(c) for c in order_by]).rowsBetween(Window.unboundedPreceding, 0))
    wanted = counts.withColumn("_end", upto).withColumn("_begin", F.col("_end") - F.col("_n"))
    wanted = wanted.where((F.col("_end") > skip) & (F.col("_begin") < skip + rows))
    out = None
    for r in wanted.orderBy("_begin").limit(rows).collect():  # no more keys than rows of the page
        take = min(r["_end"], skip + rows) - max(r["_begin"], skip)
        same = F.lit(True)
        for c in order_by:
            same = same & F.col(c).eqNullSafe(F.lit(r[c]).cast(df.schema[c].dataType))
        part = df.where(same).limit(take)
        out = part if out is None else out.unionByName(part)
    return df.limit(0) if out is None else out


def _asc(c: str):
    return F.col(c).asc_nulls_first()


# Chart time ranges (number of history months; None = all).
TIME_RANGES = {"3m": 3, "6m": 6, "12m": 12}


def time_range(chart: DataFrame, rng: str, year: int | None = None,
               month: str = "month", forecast_flag: str = "is_forecast") -> DataFrame:
    """keep the last 3/6/12 history months, or the history months of
    ``year`` for 'ytd' (the year is a parameter, never the wall clock);
    forecast rows are always kept."""
    hist = chart.where(~F.col(forecast_flag))
    fut = chart.where(F.col(forecast_flag))
    if rng == "ytd":
        if year is None:
            raise ValueError("time_range('ytd') needs an explicit year")
        kept = hist.where(F.year(month) == year)
    elif rng in TIME_RANGES:
        kept = last_months(hist, TIME_RANGES[rng], month)
    else:
        raise ValueError(f"unknown time range {rng!r}")
    return kept.unionByName(fut)
