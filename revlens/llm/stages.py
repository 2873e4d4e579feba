"""The pipeline's stages: each applies one operator to the documents that the
stage before it kept. All but the last return the columns they got."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from revlens.llm import linedup, mixing, packing, quality, queries, simhash
from revlens.llm.common import broadcast_if_small, small_arrow_batches, stage, staged


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: documents that score below its threshold go."""
    small_arrow_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    scored = quality.score(docs, quality.train(docs, labels))
    return scored.where(F.col("__score") >= quality.THRESHOLD).select(*docs.columns)


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup: lines that an earlier document has go, and documents that
    lose all of their text. Lengths follow the texts."""
    small_arrow_batches(spark)
    out = linedup.dedup_lines(docs)
    emptied = (F.size("__deleted") > 0) & (F.length(F.trim("text")) == 0)
    out = out.where(~F.coalesce(emptied, F.lit(False)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size("__deleted") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup: one row of each group of linked fingerprints stays, of the smallest id."""
    small_arrow_batches(spark)
    return simhash.keep_one(docs, words=3, distance=3, seed=42)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing sources to target weights: each document comes as often as the
    mix takes words from it, in whole texts (a part that is taken counts as a
    whole); documents that the mix takes nothing of go."""
    small_arrow_batches(spark)
    # ids may be null or come again: rows are told apart by a written number
    base = stage(docs.withColumn("__row", F.monotonically_increasing_id()), "mix-rows")
    taken = mixing.mix(base, keep=("__row",)).documents.where("taken > 0")
    times, size = staged(taken.select("__row", F.ceil(F.col("taken") / F.col("size")).cast("int").alias("__times")), "mix-times")
    repeated = base.join(broadcast_if_small(times, size), "__row").withColumn("__time", F.explode(F.sequence(F.lit(1), F.col("__times"))))
    return repeated.select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing: a row per piece with its place in its sequence."""
    small_arrow_batches(spark)
    pieces = packing.pack(docs, queries.packing_tokenizer())
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
