"""Document fingerprints: a Merkle tree over sections and paragraphs.

Sections are what blank lines separate, paragraphs are the lines of a section.
A paragraph's leaves are the hashes of its blocks of ``LEAF_CHARS`` code
points; the hash of a paragraph is over its leaves, that of a section over its
paragraphs, and the root's over the sections. Equal roots mean equal texts
(but for line breaks between sections: their exact number is part of the
first section's hash input), and where roots differ, comparing children leads
to the edit.

The fingerprint is the tree written out: the root, then for each section its
hash and the leaves of its paragraphs, shortened to 8 digits. DataFrame
operations only.

Defined cases: null text is empty; the empty text has one section of one
paragraph without leaves; two texts without leaves are alike (1.0), one with
and one without are not (0.0); documents of equal id stand in order of their
text's hash; null ids come first; a single document is its own successor.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

LEAF_CHARS = 32
#: Ranges of ids with about as many rows each, and rows in a window within one.
ID_RANGES, ROWS_PER_WINDOW = 256, 1_024


def _hash64(x: Column) -> Column:
    return F.lpad(F.lower(F.hex(F.xxhash64(x))), 16, "0")


def _paragraph(text: Column) -> Column:
    leaves = F.transform(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{LEAF_CHARS}}}"), F.lit(0)), _hash64)
    return F.struct(F.sha2(F.array_join(leaves, ""), 256).alias("hash"), leaves.alias("leaves"))


def tree(text: Column) -> Column:
    """struct(root, sections: array of (hash, paragraphs: array of (hash, leaves)))."""
    sections = F.transform(F.split(text, "\n{2,}"), lambda s: F.transform(F.split(s, "\n"), _paragraph))
    nodes = F.transform(sections, lambda ps: F.struct(F.sha2(F.array_join(F.transform(ps, lambda p: p["hash"]), ""), 256).alias("hash"), ps.alias("paragraphs")))
    # the breaks between sections may be longer than one blank line
    breaks = F.array_join(F.transform(F.regexp_extract_all(text, F.lit("\n{2,}"), F.lit(0)), lambda b: F.length(b).cast("string")), ",")
    return F.struct(breaks.alias("breaks"), nodes.alias("sections"))


def root(t: Column) -> Column:
    return F.sha2(F.concat(t["breaks"], F.lit("/"), F.array_join(F.transform(t["sections"], lambda s: s["hash"]), "")), 256)


def fingerprint(t: Column) -> Column:
    """The tree as text."""
    def section(s: Column) -> Column:
        paragraphs = F.transform(s["paragraphs"], lambda p: F.array_join(F.transform(p["leaves"], lambda x: F.substring(x, 1, 8)), ""))
        return F.concat(F.substring(s["hash"], 1, 16), F.lit(":"), F.array_join(paragraphs, ","))

    return F.concat(root(t), F.lit("|"), F.array_join(F.transform(t["sections"], section), "|"))


def leaves(t: Column) -> Column:
    """The distinct leaves of a tree."""
    return F.array_distinct(F.flatten(F.flatten(F.transform(t["sections"], lambda s: F.transform(s["paragraphs"], lambda p: p["leaves"])))))


def likeness(a: Column, b: Column) -> Column:
    """Twice the shared leaves over all leaves of both (0 to 1)."""
    total = F.size(a) + F.size(b)
    return F.when(total == 0, 1.0).otherwise(2.0 * F.size(F.array_intersect(a, b)) / total)


def differing_branches(a: Column, b: Column) -> Column:
    """Where two trees differ: array of (section, paragraph), from 0. A branch
    that only one tree has differs."""
    def pairs(s: Column, x: Column, y: Column) -> Column:
        n = F.greatest(F.size(x["paragraphs"]), F.size(y["paragraphs"]))
        def hash_at(z, i):
            return F.get(z["paragraphs"], i)["hash"]

        differ = F.filter(F.sequence(F.lit(0), n - 1), lambda i: ~hash_at(x, i).eqNullSafe(hash_at(y, i)))
        return F.transform(differ, lambda i: F.struct(s.alias("section"), i.alias("paragraph")))

    sections = F.sequence(F.lit(0), F.greatest(F.size(a["sections"]), F.size(b["sections"])) - 1)
    changed = F.filter(sections, lambda s: ~F.get(a["sections"], s)["hash"].eqNullSafe(F.get(b["sections"], s)["hash"]))
    empty = F.struct(F.lit("").alias("hash"), F.slice(a["sections"][0]["paragraphs"], 1, 0).alias("paragraphs"))
    return F.flatten(F.transform(changed, lambda s: pairs(s, F.coalesce(F.get(a["sections"], s), empty), F.coalesce(F.get(b["sections"], s), empty))))


def with_next(docs: DataFrame, id_col: str, text_col: str, name: str) -> DataFrame:
    """(id, text, ``name``): the text of the next document by ascending id,
    after the last one the first.

    Ids are cut into ranges of about as many rows each, ranges into windows of
    equal width; each window's last row takes the first row of the window
    behind it, from a table of one row a window.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    stats = rows.agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi"),
                     F.percentile_approx("id", [i / ID_RANGES for i in range(1, ID_RANGES)], 10_000).alias("at")).first()
    lo = stats["lo"] or 0
    bounds = [lo, *sorted({x for x in stats["at"] or [] if x > lo})]
    # how many windows a range has, and how wide each of them is
    per_range = max(1, -(-(stats["n"] or 0) // (len(bounds) * ROWS_PER_WINDOW)))
    ends = [*bounds[1:], (stats["hi"] or 0) + 1]
    widths = [max(1.0, (b - a) / per_range) for a, b in zip(bounds, ends, strict=True)]
    starts = F.array(*(F.lit(b).cast("long") for b in bounds))
    in_range = F.greatest(F.size(F.filter(starts, lambda b: b <= F.col("id"))) - 1, F.lit(0))
    rows = rows.withColumn("range", F.when(F.col("id").isNull(), -1).otherwise(in_range))
    offset = F.col("id").cast("double") - F.get(starts, F.col("range")).cast("double")
    width = F.get(F.array(*(F.lit(w) for w in widths)), F.col("range"))

    rows = rows.withColumn("window", F.coalesce(F.floor(offset / width), F.lit(0)))
    rows = rows.withColumn("h", F.xxhash64("text"))
    heads = rows.groupBy("range", "window").agg(F.min(F.struct("id", "h")).alias("head"))
    across = heads.groupBy("range").agg(F.min_by("head", "window").alias("head"))
    order = Window.orderBy("range")  # at most ID_RANGES + 1 rows
    first = F.first("head").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    across = across.select("range", F.coalesce(F.lead("head").over(order), first).alias("far"))
    after = heads.withColumn("near", F.lead("head").over(Window.partitionBy("range").orderBy("window"))).join(F.broadcast(across), "range")
    after = after.select("range", "window", F.coalesce("near", "far").alias("key"))
    texts = rows.select(F.struct("id", "h").alias("key"), "text").join(after.select("key").distinct(), "key", "left_semi")
    behind = after.join(texts.dropDuplicates(["key"]), "key").select("range", "window", F.col("text").alias("behind"))
    inside = rows.withColumn("ahead", F.lead("text").over(Window.partitionBy("range", "window").orderBy("id", "h")))
    return inside.join(behind, ["range", "window"]).select("id", "text", F.coalesce("ahead", "behind").alias(name))


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document, its edited text (its last quarter replaced by the next
    document's beginning), their trees' fingerprints and likenesses."""
    rows = with_next(docs, id_col, text_col, "next").withColumn("n_chars", F.length("text").cast("long"))
    quarter = F.expr("cast(n_chars div 4 as int)")
    kept = F.expr("cast(n_chars - n_chars div 4 as int)")
    rows = rows.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), kept), F.substring(F.col("next"), F.lit(1), quarter)))
    rows = rows.select("id", "n_chars", "edited", tree(F.col("text")).alias("own"), tree(F.col("edited")).alias("other"), leaves(tree(F.col("next"))).alias("next_leaves"))
    rows = rows.select("*", leaves(F.col("own")).alias("own_leaves"))
    return rows.select(
        F.col("id").alias(id_col), "n_chars", "edited", "own", "other",
        fingerprint(F.col("own")).alias("fingerprint"), fingerprint(F.col("other")).alias("edited_fingerprint"),
        likeness(F.col("own_leaves"), leaves(F.col("other"))).alias("near_edited"), likeness(F.col("own_leaves"), F.col("next_leaves")).alias("near_next"))
