"""SimHash near-duplicates by multi-index hashing.

A document's fingerprint has a bit set where more than half of its shingles'
hashes have it set. Two fingerprints link at ``distance`` or fewer differing
bits. The fingerprint is cut into segments; of two linked fingerprints some
segment differs in at most distance / segments bits. So a table lists every
distinct fingerprint under each segment's value, and every fingerprint looks
up the small Hamming ball around its segments. What a table entry returns is
verified over all bits inside its task, which passes on a spanning forest of
the verified links and never the pairs; the forests' components are the
result.

Equal fingerprints are one entry, so copies make no larger buckets: a hot
group of copies is pre-aggregated before anything is shuffled by segment. A
bucket of many distinct fingerprints is a grid of parts, blocks of entries
against blocks of seekers, which tasks share.

Defined cases: null and wordless texts have fingerprint zero, linked like any
other; texts of fewer words than a shingle have one shingle of all of them;
repeated rows are copies; an empty table gives no rows; a document with a null
id gets the component of its group (null if no id in it is known).
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from revlens.llm.common import batches, broadcast_if_small, small_batches, stage, staged, texts_of
from revlens.llm.components import components

SHINGLE_WORDS, DISTANCE, SEED, SEGMENTS = 3, 3, 42, 2
#: Entries that are compared with one block of lookups at once.
BLOCK = 2_048
#: Entries of a bucket beyond which it is dealt into parts of about as many.
BUCKET_ROWS = 4_096


def fingerprint(text: str, words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """The 64-bit SimHash of a text, unsigned."""
    import xxhash

    # bytes are lower-cased in A-Z only, and split at the six ASCII blanks only
    tokens = text.encode("utf-8", "replace").lower().split()
    if not tokens:
        return 0
    if len(tokens) < words:
        shingles = [b" ".join(tokens)]
    else:
        shingles = map(b" ".join, zip(*(tokens[i:] for i in range(words)), strict=False))
    digest = xxhash.xxh64_intdigest
    ones, n, shingles = np.zeros(64, dtype=np.int64), 0, iter(shingles)
    while some := [digest(s, seed) for s in itertools.islice(shingles, 65_536)]:
        h = np.array(some, dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(some)
    bits = np.packbits(2 * ones > n, bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS, seed: int = SEED) -> DataFrame:
    """fp, a signed long, of text, and all other columns (longs)."""
    kept = [c for c in docs.columns if c != "text"]
    build = batches({c: pa.int64() for c in (*kept, "fp")})

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(it):
            fps = np.array([fingerprint(t, words, seed) for t in texts_of(batch)], dtype="<u8").view(np.int64)
            yield build(*(batch.column(c) for c in kept), fps)

    return docs.mapInArrow(run, ", ".join(f"{c} long" for c in (*kept, "fp")))


def _spans(segments: int) -> list[tuple[int, int]]:
    """(first bit, width) of each segment."""
    ends = [64 * (i + 1) // segments for i in range(segments)]
    return [(a, b - a) for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def _ball(width: int, radius: int) -> np.ndarray:
    """All masks of ``width`` bits with at most ``radius`` set."""
    masks = {0}
    for _ in range(radius):
        masks |= {m ^ (1 << b) for m in masks for b in range(width)}
    return np.array(sorted(masks), dtype=np.uint64)


def lookups(fps: DataFrame, distance: int, segments: int) -> DataFrame:
    """(segment, value, fp): a row for each value in the ball around each
    segment of each distinct fingerprint; the one of the segment itself is
    also its table entry."""
    build = batches({"segment": pa.int32(), "value": pa.int64(), "fp": pa.int64()})
    plan = [(s, first, width, _ball(width, distance // segments)) for s, (first, width) in enumerate(_spans(segments))]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            fp = batch.column("fp").to_numpy(zero_copy_only=False)
            for s, first, width, ball in plan:
                own = (fp.view(np.uint64) >> np.uint64(first)) & np.uint64((1 << width) - 1)
                values = (own[:, None] ^ ball[None, :]).ravel()
                yield build(np.full(len(values), s, dtype=np.int32), values.view(np.int64), np.repeat(fp, len(ball)))

    return fps.mapInArrow(run, "segment int, value long, fp long")


def _forest(entries: np.ndarray, seekers: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between entries and seekers of a bucket:
    in each round every part takes its first link to another part."""
    nodes = np.unique(np.concatenate([entries, seekers]))
    label = np.arange(len(nodes))
    at, of = np.searchsorted(nodes, entries), np.searchsorted(nodes, seekers)
    out = []
    for x in range(0, len(entries), BLOCK):
        for y in range(0, len(seekers), BLOCK):
            a, b = entries[x : x + BLOCK].view(np.uint64), seekers[y : y + BLOCK].view(np.uint64)
            i, j = np.nonzero(np.bitwise_count(a[:, None] ^ b[None, :]) <= distance)
            u, v = at[x + i], of[y + j]
            while True:
                apart = np.flatnonzero(label[u] != label[v])
                if not len(apart):
                    break
                u, v = u[apart], v[apart]
                first = np.full(len(nodes), len(u))
                for side in (label[u], label[v]):
                    mine = np.full(len(nodes), len(u))
                    mine[side[::-1]] = np.arange(len(u))[::-1]  # the first link of each part stays
                    first = np.minimum(first, mine)
                taken = np.unique(first[first < len(u)])
                out += zip(nodes[u[taken]].tolist(), nodes[v[taken]].tolist(), strict=True)
                label = _merged(label, label[u[taken]], label[v[taken]])
    return out


def _merged(label: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Labels after parts ``left`` and ``right`` are joined: the smallest of each."""
    parent = np.arange(len(label))
    while True:
        p, q = parent[left], parent[right]
        if (p == q).all():
            return parent[label]
        np.minimum.at(parent, np.maximum(p, q), np.minimum(p, q))
        while (parent[parent] != parent).any():
            parent = parent[parent]


def _own(fp: Column, first: int, width: int) -> Column:
    """The value of a segment."""
    return F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << width) - 1 if width < 64 else -1))


def hot_buckets(fps: DataFrame, distance: int, segments: int, rows: int) -> DataFrame:
    """(segment, value, n_entry, n_seeker): into how many parts the entries and
    the seekers of a bucket are dealt, for buckets of over ``rows`` entries and
    those that such a bucket's entries look up. Another bucket has at most
    ``rows`` entries, and seekers from as small buckets only."""
    spans = _spans(segments)
    values = F.array(*[F.struct(F.lit(s).alias("segment"), _own(F.col("fp"), *span).alias("value")) for s, span in enumerate(spans)])
    hot = fps.select(F.inline(values)).groupBy("segment", "value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > rows)
    balls = [_ball(width, distance // segments) for _, width in spans]
    build = batches({"segment": pa.int32(), "value": pa.int64(), "entries": pa.int64(), "seekers": pa.int64()})

    def around(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            segment, value, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("segment", "value", "n"))
            for s, ball in enumerate(balls):
                v, count = value[segment == s], np.repeat(n[segment == s], len(ball))
                found = (v.view(np.uint64)[:, None] ^ ball[None, :]).ravel()
                yield build(np.full(len(found), s, dtype=np.int32), found.view(np.int64), np.where(np.tile(ball, len(v)) == 0, count, 0), count)

    wide = hot.mapInArrow(around, "segment int, value long, entries long, seekers long").groupBy("segment", "value").agg(F.max("entries").alias("e"), F.sum("seekers").alias("s"))
    parts = {"n_entry": F.greatest(F.ceil(F.col("e") / rows), F.lit(1)), "n_seeker": F.ceil(F.col("s") / rows)}
    return wide.select("segment", "value", *(c.cast("long").alias(name) for name, c in parts.items()))


def dealt_lookups(fps: DataFrame, distance: int, segments: int, rows: int = BUCKET_ROWS) -> DataFrame:
    """(segment, value, part, fp, role): the lookups by bucket. Role is 1 for
    an entry, 2 for a seeker, 3 for both. A hot bucket is a grid of parts, each
    a block of entries against a block of seekers, so that tasks share it."""
    hot, size = staged(hot_buckets(fps, distance, segments, rows), "simhash-hot")
    found = lookups(fps, distance, segments).join(broadcast_if_small(hot, size), ["segment", "value"], "left")
    own = F.lit(False)
    for s, span in enumerate(_spans(segments)):
        own = F.when(F.col("segment") == s, _own(F.col("fp"), *span) == F.col("value")).otherwise(own)
    found = found.withColumn("own", own)

    def cell(part: Column, role: Column) -> Column:
        return F.struct(part.cast("long").alias("part"), role.cast("int").alias("role"))

    draw = F.xxhash64(F.lit(SEED), "fp")
    e, s = F.pmod(draw, F.col("n_entry")), F.pmod(F.shiftrightunsigned(draw, 20), F.col("n_seeker"))
    seeks = F.transform(F.sequence(F.lit(0), F.col("n_entry") - 1), lambda k: cell(k * F.col("n_seeker") + s, F.lit(2)))
    enters = F.transform(F.sequence(F.lit(0), F.col("n_seeker") - 1), lambda k: cell(e * F.col("n_seeker") + k, F.lit(1)))
    whole = F.array(cell(F.lit(0), F.when(F.col("own"), 3).otherwise(2)))
    cells = F.when(F.col("n_entry").isNull(), whole).when(F.col("own"), F.concat(seeks, enters)).otherwise(seeks)
    return found.select("segment", "value", "fp", F.inline(cells))


def verified_links(found: DataFrame, distance: int) -> DataFrame:
    """(a, b): spanning forests of the links that the buckets hold.

    ``found`` is dealt by (segment, value, part) and sorted, so a part's rows
    come one after another; only parts with an entry and another fingerprint
    are looked at.
    """
    keys = ("segment", "value", "part")
    build = batches({"a": pa.int64(), "b": pa.int64()})

    def parts(it: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
        """Runs of whole parts: keys, fp and role."""
        held: list[np.ndarray] = []
        for batch in it:
            now = [batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (*keys, "fp", "role")]
            if not len(now[0]):
                continue
            now = [np.concatenate(x) for x in zip(held, now, strict=True)] if held else now
            last = np.flatnonzero(np.any([k != k[-1] for k in now[:3]], axis=0))
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                yield [x[:cut] for x in now]
            held = [x[cut:] for x in now]
        if held:
            yield held

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for segment, value, part, fp, role in parts(it):
            new = np.flatnonzero(np.any([np.diff(k) != 0 for k in (segment, value, part)], axis=0)) + 1
            starts = np.concatenate([[0], new])
            sizes = np.diff(np.concatenate([starts, [len(fp)]]))
            entries = np.add.reduceat(role & 1, starts)
            pairs: list[tuple[int, int]] = []
            for k in np.flatnonzero((sizes > 1) & (entries > 0)):
                rows = slice(starts[k], starts[k] + sizes[k])
                pairs += _forest(fp[rows][(role[rows] & 1) > 0], fp[rows][(role[rows] & 2) > 0], distance)
            if pairs:
                yield build(*zip(*pairs, strict=True))

    return found.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long")


def _grouped(distinct: DataFrame, distance: int, segments: int) -> DataFrame:
    """``distinct`` (fp, ...) with the group that links reach: its smallest fingerprint."""
    links = verified_links(dealt_lookups(distinct.select("fp"), distance, segments), distance)
    groups = components(links).select(F.col("node").alias("fp"), F.col("component").alias("group"))
    return distinct.join(groups, "fp", "left").withColumn("group", F.coalesce("group", "fp"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS,
                    distance: int = DISTANCE, segments: int = SEGMENTS, seed: int = SEED) -> DataFrame:
    """(id, fingerprint, component_id): the component is the smallest id that
    links of ``distance`` or fewer bits reach."""
    own = stage(fingerprints(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), words, seed), "simhash")
    distinct = stage(own.groupBy("fp").agg(F.min("id").alias("least")), "simhash-distinct")
    member = _grouped(distinct, distance, segments)
    smallest = member.groupBy("group").agg(F.min("least").alias("component_id"))
    member = member.join(smallest, "group").select("fp", "component_id")
    return own.join(member, "fp").select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS,
             distance: int = DISTANCE, segments: int = SEGMENTS, seed: int = SEED) -> DataFrame:
    """One row of each group of near-duplicates, all columns: the one of the
    smallest id (null after all others), and of its rows the one of the
    smallest text hash. Ids may be null or come again, as rows have numbers."""
    # numbered once, in what is written; later jobs read the numbers
    base = stage(docs.withColumn("__row", F.monotonically_increasing_id()), "simhash-rows")
    slim = base.select(F.col(id_col).cast("long").alias("id"), F.col("__row").alias("row"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("h"), F.col(text_col).alias("text"))
    first = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "h", "row")).alias("first")
    distinct = stage(fingerprints(slim, words, seed).groupBy("fp").agg(first), "simhash-distinct")
    chosen = _grouped(distinct, distance, segments).groupBy("group").agg(F.min("first").alias("first")).select(F.col("first.row").alias("__row"))
    # numbers only: their bytes are checked before they may be broadcast
    chosen, size = staged(chosen, "simhash-kept")
    return base.join(broadcast_if_small(chosen, size), "__row", "left_semi").select(*docs.columns)
