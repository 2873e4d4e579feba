"""Global row numbers without a single-partition window.

``row_number() over (order by ...)`` with no PARTITION BY moves every row
into one task.

Rows of a file scan are numbered in file order by scan split: a first pass
counts the rows of each split (file, block start, block length) and reads no
data column; prefix sums over those few rows give each split's first number,
and a row's number follows from its place in its split. Nothing is written
but the splits' counts. Both passes must cut the files alike, so the number
of partitions that Spark plans scans for is fixed in the session if it isn't
set (otherwise it follows the executors of the moment).

For any other input, and for a wanted order, we (1) sort globally - a range-partitioned shuffle
that spreads even a hot key over many tasks - or keep the input order,
(2) tag rows with ``spark_partition_id`` and ``monotonically_increasing_id``,
(3) cut the lineage with a reliable ``checkpoint`` so the tags are stable if
an executor is lost, (4) count rows per partition (one tiny row per
partition), turn the counts into offsets and (5) broadcast that table - its
size is the number of partitions, a configuration value - back onto the rows.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revlens.plans.joins import small_table
from revlens.session import checkpoint_dir

#: A partition's first ``monotonically_increasing_id`` has none of these bits.
PLACE_BITS = (1 << 33) - 1


def _tag_and_checkpoint(df: DataFrame) -> DataFrame:
    checkpoint_dir(df.sparkSession)
    tagged = (df.withColumn("_pid", F.spark_partition_id())
                .withColumn("_mid", F.monotonically_increasing_id()))
    return tagged.checkpoint(eager=True)


def with_row_number(df: DataFrame, order_by: list | tuple | None = None,
                    name: str = "row_number", start: int = 1) -> DataFrame:
    """Add a dense 1-based (or ``start``-based) sequence number.

    ``order_by=None`` numbers rows in input (file) order, like a CSV reader's
    row index; otherwise rows are numbered in the given total order.
    """
    if not order_by and is_file_scan(df):
        return _by_scan_split(df, name, start)
    src = df.orderBy(*order_by) if order_by else df
    tagged = _tag_and_checkpoint(src)
    blocks = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_c"), F.min("_mid").alias("_m0"))
    # One row per partition: a single-task window here is bounded by the
    # partition count, not by the data.
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = blocks.withColumn("_off", F.sum("_c").over(w) - F.col("_c")).select("_pid", "_off", "_m0")
    out = tagged.join(F.broadcast(offsets), "_pid")
    out = out.withColumn(name, F.col("_off") + (F.col("_mid") - F.col("_m0")) + F.lit(start))
    return out.drop("_pid", "_mid", "_off", "_m0")


def is_file_scan(df: DataFrame) -> bool:
    """Whether the rows come one by one from files (no join, union, ...)."""
    if df.isStreaming:
        return False
    try:
        df.select("_metadata.file_path", "_metadata.file_block_start")
    except AnalysisException:
        return False
    # a number of rows per split is only a row's place if no shuffle lies between
    plan = df._jdf.queryExecution().optimizedPlan()
    leaves = plan.collectLeaves().size()
    nodes = plan.toString()
    return leaves == 1 and not any(f"{n} " in nodes for n in ("Aggregate", "Join", "Sort", "RepartitionByExpression", "Repartition", "Window", "Generate", "GlobalLimit"))


def _by_scan_split(df: DataFrame, name: str, start: int) -> DataFrame:
    spark = df.sparkSession
    pinned = "spark.sql.files.minPartitionNum"
    if spark.conf.get(pinned, None) is None:
        spark.conf.set(pinned, str(max(1, spark.sparkContext.defaultParallelism)))
    meta = [F.col(f"_metadata.file_{c}").alias(f"_{c}") for c in ("path", "block_start", "block_length")]
    place = F.monotonically_increasing_id().bitwiseAND(F.lit(PLACE_BITS)).alias("_place")
    split = ["_path", "_block_start", "_block_length"]
    counts = df.select(*meta, place).groupBy(*split).agg(F.count(F.lit(1)).alias("_n"), F.min("_place").alias("_first"))
    # a row per split: a single-task window is bounded by the files' blocks
    before = Window.orderBy("_path", "_block_start").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = small_table(counts.withColumn("_off", F.sum("_n").over(before) - F.col("_n")).drop("_n"), "splits")
    placed = df.select("*", *meta, place).join(offsets, split)
    return placed.withColumn(name, F.col("_off") + F.col("_place") - F.col("_first") + F.lit(start)).drop(*split, "_place", "_first", "_off")
