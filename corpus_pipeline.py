"""A corpus pipeline: quality, lines, near-duplicates, mix, packing.

Each stage of ``STAGES`` takes (spark, docs, sf_dir), works on all documents
that the stage before it kept, and calls one operator of ``revlens.llm``. Its
result is written as Parquet to the folder that the cluster shares and read
again as the next one's documents.

SQL can express neither the classifier nor the tokenizer, so ``ORACLE_SQL`` is
None and the tests hold the pipeline against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from revlens.llm import stages
from revlens.llm.common import stage

STAGES = [
    ("quality classifier", stages.keep_good),
    ("line dedup", stages.remove_repeated_lines),
    ("simhash near-dedup", stages.keep_one_of_each_group),
    ("mixing sources to target weights", stages.mix_sources),
    ("best-fit packing", stages.pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; returns the last one's rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, apply in STAGES:
        docs = stage(apply(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
