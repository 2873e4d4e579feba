"""Write a derived table once to the shared checkpoint directory and read it
back: the Spark form of "the clean table in the cache". Many operators read
the clean transactions; re-running the star join and the cleaning for each of
them is the dominant cost at scale, so a composite query writes the narrow
clean table once and hands the re-read DataFrame to every operator. Written
tables are removed when the Python process ends (``release`` does it earlier).
"""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.session import checkpoint_dir

_WRITTEN: list[tuple[SparkSession, str]] = []


def _place(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def size_of(spark: SparkSession, path: str) -> int:
    """Bytes under a path of any Hadoop file system."""
    place, fs = _place(spark, path)
    return fs.getContentSummary(place).getLength()


def materialize(df: DataFrame, name: str, partition_by: tuple[str, ...] = (),
                path: str | None = None, with_path: bool = False):
    """Write ``df`` as Parquet under ``spark.checkpoint.dir`` (or ``path``)
    and return the re-read table (and its path); the lineage is cut, and a
    lost executor only re-reads files instead of recomputing joins."""
    spark = df.sparkSession
    target = path or f"{checkpoint_dir(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(target)
    if path is None:
        _WRITTEN.append((spark, target))
    # partition columns come last on disk
    schema = df.schema if not partition_by else None
    read = spark.read.schema(schema).parquet(target) if schema is not None else spark.read.parquet(target)
    return (read, target) if with_path else read


def release(spark: SparkSession | None = None) -> None:
    """Remove the tables that this process wrote (those of one session)."""
    for entry in list(_WRITTEN):
        if spark is None or entry[0] is spark:
            _WRITTEN.remove(entry)
            try:
                place, fs = _place(*entry)
                fs.delete(place, True)
            except Exception:  # noqa: BLE001 - the session may be gone; the folder then stays
                continue


atexit.register(release)


def materialize_transactions(tx: DataFrame, path: str | None = None) -> DataFrame:
    """Clean transactions with margin features, partitioned by month."""
    out = tx.withColumn("month", F.trunc("order_date", "month"))
    return materialize(out, "transactions", ("month",), path)
