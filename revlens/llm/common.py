"""Helpers shared by the operators of this package."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from revlens.session import checkpoint_dir

#: A staged table up to this many bytes of Parquet may be broadcast.
BROADCAST_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the one named by ``spark.checkpoint.dir``. Only a local master may
    leave that setting out (tests, a laptop), where a scratch folder is made.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return checkpoint_dir(spark).rstrip("/")


def _path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/llm/{name}-{uuid.uuid4().hex}"


#: Rows and bytes of an Arrow batch: texts are long, and a worker holds a batch whole.
BATCH_ROWS, BATCH_BYTES = 1_000, 16 << 20


def small_arrow_batches(spark: SparkSession) -> None:
    """Lower Spark's rows and bytes per Arrow batch for this session if they are more."""
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(f"spark.sql.execution.arrow.{key}").lower().removesuffix("b")
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(f"spark.sql.execution.arrow.{key}", str(most))


def stage(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a lineage cut that
    survives lost executors and fixes what a later reader sees."""
    return staged(df, name, codec)[0]


def staged(df: DataFrame, name: str, codec: str = "zstd") -> tuple[DataFrame, int]:
    """``stage`` and the bytes of the files written."""
    spark = df.sparkSession
    path = _path(spark, name)
    df.write.option("compression", codec).parquet(path)
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    size = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(place).getLength()
    return spark.read.schema(df.schema).parquet(path), size


def broadcast_if_small(df: DataFrame, size: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast for a staged table of known size; beyond ``limit`` the
    join is left to Spark, which then shuffles both sides."""
    return F.broadcast(df) if size <= limit else df


def same(a: Column, b: Column) -> Column:
    """Equality that holds between two nulls."""
    return a.eqNullSafe(b)


def batches(columns: dict[str, pa.DataType]):
    """Build record batches of the given columns from Python lists or arrays."""
    schema = pa.schema(list(columns.items()))

    def build(*values) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(v, type=t) for v, t in zip(values, columns.values(), strict=True)], schema=schema)

    return build


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch, null as the empty text."""
    return [x or "" for x in batch.column(column).to_pylist()]


def small_batches(it: Iterator[pa.RecordBatch], column: str = "text", most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that one holds about ``most_bytes`` of a text column (or one row)."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in it:
        n = batch.num_rows
        if not n:
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < n:
            base = size[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(size, base + most_bytes, side="right")))
            yield batch.slice(at, to - at)
            at = to
    # a worker is used again: it shouldn't hold what this task needed
    pa.default_memory_pool().release_unused()
