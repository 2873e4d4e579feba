"""Join helpers.

Most joins are left to Spark, whose own size checks (the broadcast threshold
at planning time, AQE's statistics at run time) choose the strategy. Small
derived tables (medians, ceilings, encoder classes) have no usable estimate
before they run, so ``small_table`` writes them once and checks the bytes
written: up to ``BROADCAST_BYTES`` the table is hinted as a broadcast, beyond
that the plain join stays and both sides are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.plans.materialize import materialize, size_of

#: Bytes of Parquet up to which a written table may be broadcast.
BROADCAST_BYTES = 8 << 20


def small_table(df: DataFrame, name: str, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` written once and read back, with a broadcast hint if it is small."""
    written, path = materialize(df, name, with_path=True)
    return F.broadcast(written) if size_of(df.sparkSession, path) <= max_bytes else written


def attach_one_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Append the columns of a global aggregate (at most one row) to every
    row of ``df``. The row is packed into one struct and read through a
    scalar subquery: it is computed once and no join is planned. No rows
    yields NULLs (like a left join)."""
    cols = [c for c in one_row.columns if c not in df.columns]
    packed = one_row.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("_one_row")).scalar()
    return df.withColumn("_one_row", packed).select(
        *[F.col(f"`{c}`") for c in df.columns], *[F.col("_one_row").getField(c).alias(c) for c in cols])
