"""The numbered queries: each applies its operator to a whole table.

Every query takes (spark, sf_dir) and returns its operator's rows with the
digests that its contract names. ``ORACLE`` has DuckDB SQL where SQL can
express a query over whole tables fast enough; the others are tested against
brute force in ``tests/llm``.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession, functions as F

from revlens.llm import fingerprints, infill, licenses, linedup, lm, mixing, negatives, packing, pivots, quality, sharding, simhash, suffixes
from revlens.llm.common import small_arrow_batches

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(fn):
    """Register a query, with Arrow batches that suit whole texts."""
    @functools.wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        small_arrow_batches(spark)
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = run
    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packing_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query
def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 4096 tokens: a row per piece."""
    pieces = packing.pack(table(spark, sf_dir, "documents"), packing_tokenizer())
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


@query
def op3_minimax_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of near equal bytes, equal texts together."""
    return sharding.shard(table(spark, sf_dir, "documents")).withColumn("law", F.lit("bytes")).withColumn("grown_shard", F.lit(None).cast("int"))


@query
def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that a mix of 150 % of all words takes from each document."""
    return mixing.mix(table(spark, sf_dir, "documents")).documents.select("doc_id", "size", "source_size", "target", "taken")


@query
def op7_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and its edited text, and their likeness."""
    rows = fingerprints.fingerprint_edits(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


@query
def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash of every text and the smallest id within linked fingerprints."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, distance=3, seed=42)


@query
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What remains of every text, without lines that an earlier one has."""
    rows = linedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", F.col("__n_lines").alias("n_lines"), F.size("__deleted").alias("n_removed"), F.col("__deleted").alias("deleted"), "text")


@query
def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every whole text, learned from rows not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    net = quality.train(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    rows = quality.score(docs, net)
    return rows.select("doc_id", (quality.held_out_remainder(F.col("doc_id"), 5) == 0).alias("held_out"), F.col("__score").alias("score"),
                       F.when(F.col("__score") >= quality.THRESHOLD, 1).otherwise(0).alias("predicted"))


@query
def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the bytes of 200-byte strings that come again."""
    rows = suffixes.remove_repeats(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("firsts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query
def op2_pivot_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of cosine 0.93 and more between vectors of equal label."""
    return pivots.near_duplicates(table(spark, sf_dir, "embeddings"), cosine=0.93)


@query
def op9_maxent_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model scores of every whole text."""
    return lm.score(table(spark, sf_dir, "documents"), parts=10)


@query
def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licences that every whole text names or grants."""
    return licenses.labels(licenses.scan(table(spark, sf_dir, "documents")))


@query
def op12_hilbert_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five hard negatives for each of the five positives of every hundredth vector."""
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0, scale=256, positives=5, negatives=5, least_pct=80)


ORACLE["op12_hilbert_negatives"] = """
WITH ready AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM ready a JOIN ready b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5),
found AS (
  SELECT p.anchor_id, p.positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id) AS rank,
         s.other_id AS negative_id, p.positive_score, s.score AS negative_score
  FROM positives p JOIN scores s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * p.positive_score <= 100 * s.score AND s.score <= p.positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM found WHERE rank <= 5
"""


@query
def op13_displacement_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text cut by lines into prefix, middle and suffix, and rebuilt from its output."""
    rows = infill.restore(infill.fill_in_middle(table(spark, sf_dir, "documents"), seed=7, rate_pct=100, spm_pct=50))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


# The text is rebuilt by cutting the output at its marks.
ORACLE["op13_displacement_infill"] = r"""
WITH lines AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS units, sha256('7:' || CAST(doc_id AS VARCHAR)) AS h
  FROM documents),
drawn AS (
  SELECT *, CAST(len(units) AS BIGINT) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4
  FROM lines),
cuts AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn),
parts AS (
  SELECT doc_id, n, form, text, array_to_string(units[1:a], '') AS pre, array_to_string(units[a + 1:b], '') AS mid, array_to_string(units[b + 1:n], '') AS suf
  FROM cuts),
outputs AS (
  SELECT *, CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END AS output
  FROM parts),
found AS (SELECT *, instr(output, '<P>') AS p, instr(output, '<S>') AS s, instr(output, '<M>') AS m FROM outputs)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
       sha256(output) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN output
              WHEN 'psm' THEN output[p + 3:s - 1] || output[m + 3:] || output[s + 3:m - 1]
              ELSE output[p + 3:m - 1] || output[m + 3:] || output[s + 3:p - 1] END) AS restored_sha256
FROM found
"""
