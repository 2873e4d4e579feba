"""Exact per-group quantiles (linear interpolation, the SQL ``median`` /
``percentile_cont`` definition) that stay distributed under skew.

Spark's exact ``percentile`` keeps a value -> count map per group in one
buffer, so a group holding a third of a 100 TB table would be merged in one
task. Here no row is shuffled by its group. A pass counts each group's rows in
cells that follow the order of the values (with the cells' least and greatest
value), which combines in the map tasks; prefix sums over a group's cells say
in which of them a wanted rank lies. The first pass takes steps of the
logarithm, later ones cut the found cell into equal stretches. A cell of one
value is the answer; when all cells left are small, their (group, value)
counts are ranked. Every pass parts a cell's least from its greatest value, so
the passes end.

Several quantiles (other columns, other keys) share all passes: a row is
exploded into one entry for each. The input is read once per pass: hand in a
written (or narrow) table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Cells of an octave in the first pass, cells of a cell in later ones, rows of a cell that are ranked by value.
OCTAVE, CELLS, FEW_ROWS = 256, 4_096, 100_000


def _steps(v: Column) -> Column:
    """A whole number that never falls as the value grows."""
    size = F.floor(F.log2(F.abs(v)) * OCTAVE).cast("long") + F.lit(1 << 20)
    far = F.abs(v) == float("inf")
    return (F.when(F.isnan(v), F.lit(1 << 40)).when(v == 0, F.lit(0))
             .when(v > 0, F.when(far, F.lit(1 << 39)).otherwise(size)).otherwise(F.when(far, F.lit(-(1 << 39))).otherwise(-size)))


def group_quantiles(df: DataFrame, wanted: Sequence[tuple[Sequence[str], str, str]], q: float = 0.5,
                    few_rows: int = FEW_ROWS) -> list[DataFrame]:
    """For each (keys, value column, name): one row per group with the keys and
    the quantile. NULL values are ignored; groups with only NULLs are absent."""
    from revlens.plans.joins import small_table
    every = list(dict.fromkeys(k for keys, _, _ in wanted for k in keys))
    named = {k: f"_k{i}" for i, k in enumerate(every)}
    entry = [F.struct(F.lit(n).alias("_w"), *[(F.col(k) if k in keys else F.lit(None)).cast(df.schema[k].dataType).alias(named[k]) for k in every],
                      F.col(value).cast("double").alias("_v")) for n, (keys, value, _) in enumerate(wanted)]
    base = df.select(F.explode(F.array(*entry)).alias("_e")).select("_e.*").where(F.col("_v").isNotNull())
    grp = ["_w", *named.values()]

    def picked(cells: DataFrame, ranks: DataFrame | None) -> DataFrame:
        """(group, rank, at, lo, hi, below, in): the cell of each wanted rank.
        ``cells`` may be parts of an older cell, which begins at ``_from``."""
        part = [*grp, "_from"]
        upto = F.sum("_in").over(Window.partitionBy(*part).orderBy("_digit").rowsBetween(Window.unboundedPreceding, 0))
        placed = cells.withColumn("_end", F.col("_base") + upto).withColumn("_below", F.col("_end") - F.col("_in"))
        if ranks is None:
            n = F.sum("_in").over(Window.partitionBy(*part))
            pos = (F.col("_n") - 1) * F.lit(q)
            placed = placed.withColumn("_n", n).withColumn("_at", F.explode(F.array(F.floor(pos), F.ceil(pos)))).withColumn("_share", pos - F.floor(pos))
            placed = placed.withColumn("_second", F.col("_at") > F.floor(pos))
        else:
            r = ranks.select(*[F.col(c).alias(f"_r{c}") for c in part], "_at", "_second", "_share")
            placed = placed.join(r, [placed[c].eqNullSafe(r[f"_r{c}"]) for c in part])
        here = placed.where((F.col("_at") >= F.col("_below")) & (F.col("_at") < F.col("_end")))
        # equal ranks (a whole position) come twice
        return here.select(*grp, "_at", "_second", "_share", "_lo", "_hi", "_below", "_in").distinct()

    def within(state: DataFrame) -> DataFrame:
        """The rows that lie in an open cell, with the cell."""
        s = state.where(F.col("_lo") < F.col("_hi")).select(*[F.col(c).alias(f"_s{c}") for c in grp], F.col("_lo").alias("_from"), F.col("_hi").alias("_to"),
                                                           F.col("_below").alias("_base")).distinct()
        return base.join(s, [base[c].eqNullSafe(s[f"_s{c}"]) for c in grp] + [F.col("_v").between(F.col("_from"), F.col("_to"))])

    counted = [F.count(F.lit(1)).alias("_in"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")]
    first = base.groupBy(*grp, _steps(F.col("_v")).alias("_digit")).agg(*counted)
    state = small_table(picked(first.withColumn("_from", F.lit(0.0)).withColumn("_base", F.lit(0).cast("long")), None), "quantile")
    while True:
        widest = state.where(F.col("_lo") < F.col("_hi")).agg(F.max("_in")).first()[0]
        if widest is None or widest <= few_rows:
            break
        share = (F.col("_v") - F.col("_from")) / (F.col("_to") - F.col("_from"))
        digit = F.least(F.floor(share * CELLS), F.lit(CELLS - 1)).alias("_digit")
        parts = within(state).groupBy(*grp, "_from", "_base", digit).agg(*counted)
        open_ = state.where(F.col("_lo") < F.col("_hi")).withColumn("_from", F.col("_lo"))
        state = small_table(state.where(~(F.col("_lo") < F.col("_hi"))).unionByName(picked(parts, open_)), "quantile")
    if widest is not None:
        values = within(state).groupBy(*grp, "_from", "_base", "_v").agg(F.count(F.lit(1)).alias("_in"))
        ranked = values.withColumn("_digit", F.col("_v")).withColumn("_lo", F.col("_v")).withColumn("_hi", F.col("_v"))
        open_ = state.where(F.col("_lo") < F.col("_hi")).withColumn("_from", F.col("_lo"))
        state = state.where(~(F.col("_lo") < F.col("_hi"))).unionByName(picked(ranked, open_))
    found = state.groupBy(*grp).agg(F.max(F.when(~F.col("_second"), F.col("_lo"))).alias("_a"), F.max(F.when(F.col("_second"), F.col("_lo"))).alias("_b"),
                                    F.max("_share").alias("_share"))
    value = F.when(F.col("_b").isNull(), F.col("_a")).otherwise(F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_share"))
    found = small_table(found.select(*grp, value.alias("_v")), "quantile")
    return [found.where(F.col("_w") == n).select(*[F.col(named[k]).alias(k) for k in keys], F.col("_v").alias(out))
            for n, (keys, _, out) in enumerate(wanted)]


def group_quantile(df: DataFrame, keys: list[str], value: str, q: float = 0.5,
                   out: str = "median", approx: bool = False, accuracy: int = 100_000,
                   few_rows: int = FEW_ROWS) -> DataFrame:
    """One quantile: ``keys + [out]``; ``approx`` takes one pass of a sketch."""
    if approx:
        known = df.where(F.col(value).isNotNull())
        return known.groupBy(*keys).agg(F.percentile_approx(F.col(value).cast("double"), q, accuracy).alias(out))
    return group_quantiles(df, [(keys, value, out)], q, few_rows)[0]
