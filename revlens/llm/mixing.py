"""Mixing sources to target weights by a low-discrepancy schedule.

Each source has a target number of words: its weight's share of the mix, at
most ``repeats`` times its own size, the excess shared again by weight. Slot i
of the schedule maps the i-th golden-ratio point through the cumulative
targets, so every stretch of the mix has the sources in proportion. A source's
documents stand in shuffled order on a line of words that is cut into blocks
of equal length; the r-th slot of a source gets its r-th block, and a second
pass over the line follows the first where the target is above the size. What
the points leave a source short of its target (a few blocks at most) follows
at the end of the schedule, and slots past a target stay empty.

DataFrame operations only. Sources are few against documents (their table is
ordered in one task); everything else is dealt by source and hash bucket or
by source and block, so a source that holds a third of all rows is no hot key.

Defined cases: null text has no words; documents without words are never
taken; null source is a source of its own, last in order; repeated rows are
taken each on its own; an empty table gives no rows; a mix of no words takes
nothing. Results depend on the rows only, so reruns agree.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from revlens.llm.common import broadcast_if_small, same, stage, staged

WORD = "[^\\x20\\x09-\\x0D]+"
#: The golden ratio's fraction in 40 bits; odd, so that no point comes twice in 2^40.
POINT_BITS, GOLDEN = 40, 679_544_997_313
BLOCK_WORDS = 256
WEIGHTS = (3, 1, 2)
ROWS_PER_BUCKET = 16_384
SLOTS_PER_CHUNK = 4_096
CELLS = 1_024


@dataclass
class Mix:
    """``documents``: a row per input row with its words taken; ``schedule``:
    a row per stretch of a document in a slot; ``sources``: sizes and targets."""

    documents: DataFrame
    schedule: DataFrame
    sources: DataFrame


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def golden_point(i: Column) -> Column:
    """i times the golden ratio, its fraction, in [0, 1). Exact for i below 2^40."""
    half = POINT_BITS // 2
    low = F.expr(f"slot & {(1 << half) - 1}") * F.lit(GOLDEN)
    high = F.shiftleft(F.expr(f"((slot >> {half}) * {GOLDEN}) & {(1 << half) - 1}"), half)
    return F.pmod(low + high, F.lit(1 << POINT_BITS)) / F.lit(float(1 << POINT_BITS))


def source_targets(sized: DataFrame, weights: tuple[int, ...], share: float, repeats: int) -> DataFrame:
    """(source, k, source_size, rows, target, goal, lo, hi): targets by filling
    up to a common level of words per weight, each source stopping at its cap."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("k", (F.row_number().over(by_name) - 1).cast("long"))
    per = per.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("k") % len(weights) + 1).cast("int")))
    per = per.withColumn("cap", F.col("source_size") * F.lit(float(repeats))).withColumn("level", F.col("cap") / F.col("weight"))
    by_level = Window.orderBy("level", "k")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("total", F.sum("source_size").over(whole) * F.lit(share))
    per = per.withColumn("open_weight", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    per = per.withColumn("filled", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    per = per.withColumn("fill", (F.col("total") - F.col("filled")) / F.col("open_weight"))
    reached = F.min_by("fill", F.when(F.col("fill") <= F.col("level"), F.struct("level", "k"))).over(whole)
    per = per.withColumn("target", F.least(F.col("cap"), F.coalesce(reached, F.lit(float("inf"))) * F.col("weight")))
    per = per.withColumn("goal", F.least(F.round("target").cast("long"), F.col("source_size") * F.lit(repeats)))
    upto = F.sum("goal").over(Window.orderBy("k").rowsBetween(Window.unboundedPreceding, 0))
    all_ = F.sum("goal").over(whole)
    per = per.withColumn("hi", F.when(all_ > 0, upto / all_).otherwise(0.0)).withColumn("lo", F.when(all_ > 0, (upto - F.col("goal")) / all_).otherwise(0.0))
    return per.select("source", "k", "source_size", "rows", "target", "goal", "lo", "hi")


def source_line(sized: DataFrame, sources: DataFrame, rows: int) -> DataFrame:
    """Documents in shuffled order on their source's line: (k, bucket, nth)
    names a row, ``start`` is the words before it."""
    dealt = sized.join(sources, same(sized["source"], sources["source"])).drop(sources["source"])
    dealt = dealt.withColumn("bucket", F.pmod("h", F.lit(max(16, rows // ROWS_PER_BUCKET))))
    sums = dealt.groupBy("k", "bucket").agg(F.sum("size").alias("n"))
    before = Window.partitionBy("k").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("k", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    order = Window.partitionBy("k", "bucket").orderBy("h", "id", "size")
    inside = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    dealt = dealt.withColumn("nth", F.row_number().over(order)).withColumn("inside", inside)
    return dealt.join(base, ["k", "bucket"]).withColumn("start", F.col("base") + F.col("inside")).drop("base", "inside")


def schedule_slots(sources: DataFrame, slots: int, block: int) -> DataFrame:
    """(slot, k, rank): which block of which source stands in each slot."""
    spark = sources.sparkSession
    goals = sources.where("goal > 0")
    cells = goals.select("k", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") * CELLS), F.floor(F.col("hi") * CELLS))).alias("cell"))
    points = spark.range(slots).withColumnRenamed("id", "slot")
    points = points.withColumn("point", golden_point(F.col("slot"))).withColumn("cell", F.floor(F.col("point") * CELLS))
    hits = points.join(cells, (points["cell"] == cells["cell"]) & (F.col("point") >= F.col("lo")) & (F.col("point") < F.col("hi")))
    hits = hits.select("slot", "k", F.expr(f"slot div {SLOTS_PER_CHUNK}").alias("chunk"))
    counts = hits.groupBy("k", "chunk").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("k").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("k", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = F.row_number().over(Window.partitionBy("k", "chunk").orderBy("slot")) - 1
    ranked = hits.withColumn("inside", inside).join(base, ["k", "chunk"]).select("slot", "k", (F.col("base") + F.col("inside")).alias("rank"))
    need = goals.select("k", F.ceil(F.col("goal") / F.lit(block)).alias("need"))
    drawn = counts.groupBy("k").agg(F.sum("n").alias("drawn"))
    missing = need.join(drawn, "k", "left").select("k", "need", F.coalesce("drawn", F.lit(0)).alias("drawn")).where("drawn < need")
    missing = missing.select("k", F.explode(F.sequence("drawn", F.col("need") - 1)).alias("rank"))
    # a few blocks a source, by the sequence's discrepancy
    closing = missing.select((F.row_number().over(Window.orderBy("rank", "k")) - 1 + F.lit(slots)).cast("long").alias("slot"), "k", "rank")
    return ranked.unionByName(closing)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS,
        share: float = 1.5, repeats: int = 2, block: int = BLOCK_WORDS, seed: int = 7, keep: tuple[str, ...] = ()) -> Mix:
    """Mix documents to ``share`` times all words by source ``weights``.
    ``keep``: further columns for the result's ``documents``."""
    # the words are counted before the shuffle key is made, as both read the text
    slim = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), words(F.col(text_col)).alias("size"), *keep)
    sized = stage(slim.withColumn("h", F.xxhash64(F.lit(seed), "id", "source", "size")), "mix-sizes")
    sources, n_bytes = staged(source_targets(sized, weights, share, repeats), "mix-sources")
    small = broadcast_if_small(sources, n_bytes)
    scalars = sources.agg(F.sum("goal").alias("goal"), F.sum("rows").alias("rows")).first()
    slots = -(-(scalars["goal"] or 0) // block)
    line = stage(source_line(sized, small.select("source", "k", "source_size", "target", "goal"), scalars["rows"] or 0), "mix-line")
    # pass e of a source's line begins at e times its size
    passes = line.where("size > 0").withColumn("e", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    passes = passes.withColumn("from", F.col("start") + F.col("e") * F.col("source_size")).withColumn("to", F.least(F.col("from") + F.col("size"), F.col("goal"))).where("from < to")
    stretches = passes.withColumn("rank", F.explode(F.sequence(F.expr(f"from div {block}"), F.expr(f"(to - 1) div {block}"))))
    first = F.greatest(F.col("from"), F.col("rank") * F.lit(block))
    stretches = stretches.select("k", "bucket", "nth", "id", "rank", (first - F.col("from")).alias("first_word"), (F.least(F.col("to"), (F.col("rank") + 1) * F.lit(block)) - first).alias("n_words"))
    schedule = stretches.join(schedule_slots(small, slots, block), ["k", "rank"])
    taken = schedule.groupBy("k", "bucket", "nth").agg(F.sum("n_words").alias("taken"))
    documents = line.join(taken, ["k", "bucket", "nth"], "left").select(
        F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), *keep)
    return Mix(documents, schedule.withColumnRenamed("id", id_col), sources)
