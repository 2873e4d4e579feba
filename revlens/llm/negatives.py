"""Hard-negative mining: rows of another label that score nearly as high as an anchor's positives.

Method: candidates lie along a Hilbert curve within each label and are written
as Parquet in blocks of ``BLOCK_ROWS`` rows, some tens of blocks to a page (a
Parquet row). Beside a block's vectors stands its zone map, each dimension's
least and greatest value. Interval arithmetic on it bounds the inner product
of an anchor with any row of the block; an anchor reads only the blocks whose
bounds meet what it looks for. Its positives are looked for above the score
that its own block already offers, the negatives of each positive in that
positive's window of scores, and within a page in falling order of the bound,
so that full lists rule out later blocks. The plan of what is read needs the
zone columns alone, and pages that no anchor of a bucket needs aren't joined.

How much the bounds rule out is up to the data: rows that cluster are skipped
by the block; unit vectors without any structure in 64 dimensions overlap in
every dimension, and nearly all blocks are read. The result is exact anyway.

Everything is Spark jobs over pages and buckets of anchors, both of bounded
bytes; a page meets a bucket in one row. No list grows with the rows: of a
page an anchor keeps the first few for each window.

Scores are inner products of the components floor(``scale`` * x). They are
computed in doubles where all sums are below 2^53 and in whole numbers of any
size elsewhere; components are held to 32 bits and scores to 62.

Defined cases: rows with a null label or vector, or with a null or non-finite
component, take no part. Vectors of different lengths have no score, so they
are neither positives nor negatives of each other; empty vectors score 0. A
null id comes last among equal scores and is no anchor if the condition on the
id is null. Equal ids stay rows of their own (an equal id's row is an "other"
row); their order is that of the curve. An anchor with fewer positives or
negatives returns all there are, one without returns no rows. Other columns
are left out. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from revlens.llm.common import small_arrow_batches, stage

BLOCK_ROWS = 256
#: Bytes of vectors in a page and in a bucket of anchors.
PAGE_BYTES, BUCKET_BYTES = 4 << 20, 1 << 19
#: Pages and buckets that a table is cut into at least, so that a small one keeps the cores busy.
LEAST_PAGES, LEAST_BUCKETS = 32, 4
NO_ID = np.iinfo(np.int64).max
FAR = 1 << 62


# -- the curve -----------------------------------------------------------------

def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places along the Hilbert curve as rows of bytes (big-endian), for cells
    of ``bits`` bits a dimension."""
    x = cells.astype(np.uint32).T.copy()
    dims = len(x)
    for level in range(bits - 1, 0, -1):
        low = np.uint32((1 << level) - 1)
        for d in range(dims):
            up = (x[d] >> np.uint32(level)) & 1 == 1
            # in an upper half the lower bits of the first dimension turn over, in a lower one they change places
            swap = np.where(up, 0, (x[0] ^ x[d]) & low).astype(np.uint32)
            x[0] = np.where(up, x[0] ^ low, x[0] ^ swap)
            if d:
                x[d] ^= swap
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    turn = np.zeros(x.shape[1], dtype=np.uint32)
    for level in range(bits - 1, 0, -1):
        turn ^= np.where((x[-1] >> np.uint32(level)) & 1 == 1, (1 << level) - 1, 0).astype(np.uint32)
    x ^= turn
    planes = [(x >> np.uint32(level)) & 1 for level in range(bits - 1, -1, -1)]
    return np.packbits(np.concatenate(planes).T.astype(np.uint8), axis=1)


def bits_for(dims: int) -> int:
    return int(np.clip(256 // max(dims, 1), 1, 16))


def whole(values: np.ndarray, scale: int) -> np.ndarray:
    return np.clip(np.floor(values * scale), -(2**31), 2**31 - 1).astype(np.int32)


def vectors_of(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of each length, as (row numbers, matrix of doubles)."""
    sizes = np.asarray(column.value_lengths())
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        yield at, column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), size).astype(np.float64)


def on_curve(rows: DataFrame, low: float, high: float, scale: int) -> DataFrame:
    """(id, label, anchor, dims, key, vec): whole-numbered vectors with their places on the curve."""
    names = ["id", "label", "anchor", "dims", "key", "vec"]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for at, m in vectors_of(batch.column("v")):
                dims = m.shape[1]
                bits = bits_for(dims)
                cells = np.clip((m - low) / max(high - low, 1e-300) * (1 << bits), 0, (1 << bits) - 1).astype(np.uint32)
                keys = [k.tobytes() for k in hilbert_keys(cells, bits)] if dims else [b""] * len(at)
                take = pa.array(at)
                yield pa.RecordBatch.from_arrays([
                    batch.column("id").take(take), batch.column("label").take(take), batch.column("anchor").take(take), pa.array(np.full(len(at), dims, dtype=np.int32)),
                    pa.array(keys, type=pa.binary()), pa.array([v.tobytes() for v in whole(m, scale)], type=pa.binary())], names=names)

    return rows.mapInArrow(run, "id long, label long, anchor boolean, dims int, key binary, vec binary")


# -- pages of blocks, buckets of anchors ---------------------------------------------

PAGE = "page long, dims int, labels binary, ends binary, low binary, high binary, ids binary, anchors binary, vecs binary"
BUCKET = "bucket long, dims int, ids binary, labels binary, pages binary, nths binary, floors binary, vecs binary"


def gathered(it: Iterator[pa.RecordBatch], columns: dict[str, type], room_of) -> Iterator[tuple[int, dict[str, np.ndarray], np.ndarray]]:
    """(dims, columns, matrix) of consecutive rows of equal dims, at most ``room_of(dims)`` at once."""
    held: dict[str, list] = {}
    dims, n = -1, 0

    def out():
        cols = {c: np.concatenate(held[c]) for c in columns}
        vecs = np.frombuffer(b"".join(held["vec"]), dtype=np.int32).reshape(n, dims)
        return dims, cols, vecs

    for batch in it:
        size = batch.column("dims").to_numpy()
        vec = batch.column("vec").to_pylist()
        plain = {}
        for c in columns:
            a = batch.column(c)
            plain[c] = a.fill_null(NO_ID).to_numpy() if c == "id" else a.to_numpy(zero_copy_only=False)
        at = 0
        while at < len(size):
            if dims != size[at] or n >= room_of(dims):
                if n:
                    yield out()
                dims, n, held = int(size[at]), 0, {c: [] for c in [*columns, "vec"]}
            same = np.flatnonzero(size[at:] != dims)
            to = min(at + (int(same[0]) if len(same) else len(size) - at), at + room_of(dims) - n)
            for c in columns:
                held[c].append(plain[c][at:to])
            held["vec"].extend(vec[at:to])
            n += to - at
            at = to
    if n:
        yield out()


def room(most_bytes: int, most_rows: int):
    return lambda dims: max(1, min(most_rows, most_bytes // (4 * max(dims, 1))))


def cut_blocks(labels: np.ndarray, block_rows: int) -> np.ndarray:
    """Ends of blocks of equal labels and at most ``block_rows`` rows."""
    runs = np.concatenate((np.flatnonzero(np.diff(labels)) + 1, [len(labels)]))
    ends, at = [], 0
    for to in runs:
        ends.extend(range(at + block_rows, int(to), block_rows))
        ends.append(int(to))
        at = int(to)
    return np.array(ends, dtype=np.int32)


def write_pages(curve: DataFrame, rows: int, block_rows: int) -> DataFrame:
    """The candidates as pages of blocks with their zone maps, written in the order of label and curve."""
    most = room(PAGE_BYTES, max(block_rows, -(-rows // LEAST_PAGES)))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k = TaskContext.get().partitionId(), 0
        for dims, cols, vecs in gathered(it, {"id": int, "label": int, "anchor": bool}, most):
            ends = cut_blocks(cols["label"], block_rows)
            begins = np.concatenate(([0], ends[:-1]))
            low, high = (f.reduceat(vecs, begins, axis=0) if dims else vecs[begins] for f in (np.minimum, np.maximum))
            values = ((part << 32) + k, dims, cols["label"][begins].astype(np.int64).tobytes(), ends.tobytes(), low.tobytes(), high.tobytes(), cols["id"].astype(np.int64).tobytes(),
                      np.flatnonzero(cols["anchor"]).astype(np.int32).tobytes(), vecs.tobytes())
            k += 1
            yield pa.RecordBatch.from_arrays([pa.array([v], type=t) for v, t in zip(values, [pa.int64(), pa.int32(), *[pa.binary()] * 7], strict=True)], names=[c.split()[0] for c in PAGE.split(", ")])

    parts = max(1, -(-rows // 65_536))
    # copies that share an id, or have none, are dealt by their place in the input
    order = ["dims", "label", "key", "id", "row"]
    curve = curve.withColumn("row", F.monotonically_increasing_id())
    laid = curve.repartitionByRange(max(parts, min(rows, LEAST_PAGES)), *order).sortWithinPartitions(*order)
    return stage(laid.mapInArrow(run, PAGE), "pages")


def anchor_buckets(pages: DataFrame, anchors: int, k: int) -> DataFrame:
    """The anchors in the order of the curve, in buckets; ``floors`` is the
    k-th best score among the other rows of an anchor's own block."""
    names = ["id", "label", "page", "nth", "floor", "dims", "vec"]

    def offer(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for page in rows_of(it):
            at = page["anchors"]
            if not len(at):
                continue
            block = np.searchsorted(page["ends"], at, side="right")
            floors = np.full(len(at), -FAR, dtype=np.int64)
            for b in np.unique(block):
                lo, hi = (0 if b == 0 else page["ends"][b - 1]), page["ends"][b]
                mine = np.flatnonzero(block == b)
                if hi - lo > k:
                    s = products(page["vecs"][at[mine]], page["vecs"][lo:hi])
                    s[np.arange(len(mine)), at[mine] - lo] = -FAR
                    floors[mine] = np.partition(s, hi - lo - k, axis=1)[:, hi - lo - k]
            yield pa.RecordBatch.from_arrays([
                pa.array(page["ids"][at]), pa.array(page["labels"][block]), pa.array(np.full(len(at), page["page"])), pa.array(at.astype(np.int32)), pa.array(floors),
                pa.array(np.full(len(at), page["dims"], dtype=np.int32)), pa.array([v.tobytes() for v in page["vecs"][at]], type=pa.binary())], names=names)

    most = room(BUCKET_BYTES, max(1, -(-anchors // LEAST_BUCKETS)))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        for dims, cols, vecs in gathered(it, {"id": int, "label": int, "page": int, "nth": int, "floor": int}, most):
            values = ((part << 32) + n, dims, *(cols[c].astype(np.int64).tobytes() for c in ("id", "label", "page", "nth", "floor")), vecs.tobytes())
            n += 1
            yield pa.RecordBatch.from_arrays([pa.array([v], type=t) for v, t in zip(values, [pa.int64(), pa.int32(), *[pa.binary()] * 6], strict=True)], names=[c.split()[0] for c in BUCKET.split(", ")])

    offered = pages.mapInArrow(offer, "id long, label long, page long, nth int, floor long, dims int, vec binary")
    order = ["dims", "label", "page", "nth"]
    laid = offered.repartitionByRange(max(LEAST_BUCKETS, -(-anchors // 65_536)), *order).sortWithinPartitions(*order)
    return stage(laid.mapInArrow(run, BUCKET), "anchors")


KINDS = {"labels": np.int64, "ends": np.int32, "ids": np.int64, "anchors": np.int32, "pages": np.int64, "nths": np.int64, "floors": np.int64}


def rows_of(it: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows with their binary columns as arrays; a bucket's columns come with the prefix ``a_``."""
    for batch in it:
        for n in range(batch.num_rows):
            row = {c: batch.column(c)[n].as_py() for c in batch.schema.names}
            for c, v in row.items():
                bare = c.removeprefix("a_")
                if bare in KINDS:
                    row[c] = np.frombuffer(v, dtype=KINDS[bare])
                elif bare in ("vecs", "low", "high"):
                    row[c] = np.frombuffer(v, dtype=np.int32)
            for c, like in (("vecs", "ids"), ("low", "labels"), ("high", "labels"), ("a_vecs", "a_ids")):
                if c in row:
                    row[c] = row[c].reshape(len(row[like]), row["dims"])
            yield row


# -- scores and bounds ---------------------------------------------------------------

def numbers_like(*matrices: np.ndarray) -> type:
    """Doubles where all sums of products stay below 2^53, else Python's whole numbers."""
    most = sorted(int(np.abs(m.astype(np.int64)).max(initial=0)) for m in matrices)
    return np.float64 if most[-1] * most[-2] * max(matrices[0].shape[1], 1) < 1 << 52 else object


def held(scores: np.ndarray) -> np.ndarray:
    return np.clip(scores, 1 - FAR, FAR - 1).astype(np.int64) if scores.dtype == object else scores.astype(np.int64)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products of two matrices of whole numbers, exact below 2^62 and held there."""
    kind = numbers_like(a, b)
    return held(a.astype(kind) @ b.T.astype(kind))


def bounds(a: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of each vector with any vector between ``low`` and ``high``."""
    kind = numbers_like(a, low, high)
    up, down, low, high = np.maximum(a, 0).astype(kind), np.minimum(a, 0).astype(kind), low.T.astype(kind), high.T.astype(kind)
    return held(up @ low + down @ high), held(up @ high + down @ low)


def needed(labels: np.ndarray, block_labels: np.ndarray, least: np.ndarray, most: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool) -> np.ndarray:
    """Which blocks each anchor must read: those of its own label (or of
    others) whose bounds meet one of the anchor's windows ``low`` to ``high``."""
    meet = ((most[:, None, :] >= low[:, :, None]) & (least[:, None, :] <= high[:, :, None]) & (low <= high)[:, :, None]).any(axis=1)
    return meet & ((labels[:, None] == block_labels[None, :]) == same)


class Firsts:
    """The first k rows of each (anchor, window): highest score, then smallest
    id, then order along the curve."""

    def __init__(self, low: np.ndarray, high: np.ndarray, k: int):
        self.low, self.high, self.k = low.copy(), high, k
        self.cols = [np.zeros(0, dtype=np.int64) for _ in range(5)]  # anchor, window, score, id, nth

    def add(self, anchors: np.ndarray, scores: np.ndarray, ids: np.ndarray, nths: np.ndarray) -> None:
        """Scores of some anchors (rows) with a block's rows."""
        low, high = self.low[anchors], self.high[anchors]
        row, col = np.nonzero(scores >= low.min(axis=1)[:, None])
        if not len(row):
            return
        s = scores[row, col]
        new = [[], [], [], [], []]
        for w in range(low.shape[1]):
            fit = np.flatnonzero((s >= low[row, w]) & (s <= high[row, w]))
            for c, v in zip(new, (anchors[row[fit]], np.full(len(fit), w), s[fit], ids[col[fit]], nths[col[fit]]), strict=True):
                c.append(v)
        cols = [np.concatenate([a, *b]) for a, b in zip(self.cols, new, strict=True)]
        order = np.lexsort((cols[4], cols[3], -cols[2], cols[1], cols[0]))
        cols = [c[order] for c in cols]
        first = np.concatenate(([True], (np.diff(cols[0]) != 0) | (np.diff(cols[1]) != 0))) if len(order) else np.zeros(0, bool)
        begin = np.flatnonzero(first)
        rank = np.arange(len(order)) - np.repeat(begin, np.diff([*begin, len(order)]))
        self.cols = [c[rank < self.k] for c in cols]
        # a full list asks for scores like its last one's or higher
        full = rank == self.k - 1
        self.low[cols[0][full], cols[1][full]] = cols[2][full]


def search(buckets: DataFrame, pages: DataFrame, n_buckets: int, windows, same: bool, k: int, extra: str, describe) -> DataFrame:
    """The first ``k`` rows of each anchor's windows, of each page.

    ``windows(bucket row)`` gives (anchors x windows) least and greatest
    scores; ``describe(bucket row, anchors, windows)`` the extra columns' values.
    """
    names = [c.split()[0] for c in extra.split(", ")]
    cols = [F.col(c).alias(c if c in ("bucket", "dims") else f"a_{c}") for c in buckets.columns]
    anchors = buckets.select(*cols)

    def plan(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(it):
            low, high = windows(row)
            least, most = bounds(row["a_vecs"], row["low"], row["high"])
            need = needed(row["a_labels"], row["labels"], least, most, low, high, same)
            if need.any():
                yield pa.RecordBatch.from_arrays([pa.array([row["bucket"]]), pa.array([row["page"]])], names=["bucket", "page"])

    def read(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(it):
            low, high = windows(row)
            least, most = bounds(row["a_vecs"], row["low"], row["high"])
            need = needed(row["a_labels"], row["labels"], least, most, low, high, same)
            firsts = Firsts(low, high, k)
            begins = np.concatenate(([0], row["ends"][:-1]))
            for b in np.argsort(-np.where(need, most, -FAR).max(axis=0), kind="stable"):
                # by now full lists may rule the block out for some anchors
                still = need[:, b] & ((most[:, b, None] >= firsts.low) & (firsts.low <= high)).any(axis=1)
                who = np.flatnonzero(still)
                if not len(who):
                    continue
                nths = np.arange(begins[b], row["ends"][b], dtype=np.int64)
                s = products(row["a_vecs"][who], row["vecs"][nths])
                if same:  # not the anchor's own row
                    own = (row["a_pages"][who] == row["page"]) & (row["a_nths"][who] >= begins[b]) & (row["a_nths"][who] < row["ends"][b])
                    s[np.flatnonzero(own), row["a_nths"][who][own] - begins[b]] = -FAR - 1
                firsts.add(who, s, row["ids"][nths], nths)
            a, w, score, ids, nth = firsts.cols
            if len(a):
                values = describe(row, a, w)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(a), row["bucket"])), pa.array(a.astype(np.int32)), pa.array(w.astype(np.int32)), pa.array(score), pa.array(ids),
                    pa.array(np.full(len(a), row["page"])), pa.array(nth), *[pa.array(v) for v in values]], names=["bucket", "anchor", "window", "score", "id", "page", "nth", *names])

    # every bucket meets every page's zone map once, dealt by a number of as many values as there are buckets
    zones = pages.select("page", "dims", "labels", "low", "high").withColumn("__deal", F.explode(F.sequence(F.lit(0), F.lit(max(1, n_buckets) - 1))))
    met = anchors.withColumn("__deal", F.pmod(F.xxhash64("bucket"), F.lit(max(1, n_buckets))).cast("int")).join(zones, ["__deal", "dims"])
    reads = met.drop("__deal").mapInArrow(plan, "bucket long, page long")
    cells = reads.join(anchors, "bucket").join(pages.drop("anchors", "dims"), "page")
    found = cells.mapInArrow(read, f"bucket long, anchor int, window int, score long, id long, page long, nth long, {extra}")
    first = F.row_number().over(Window.partitionBy("bucket", "anchor", "window").orderBy(F.desc("score"), "id", "page", "nth"))
    return found.withColumn("rank", first).where(F.col("rank") <= k)


def mine(vectors: DataFrame, anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = 256,
         positives: int = 5, negatives: int = 5, least_pct: int = 80, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score): for each row that meets ``anchor`` and each of its first
    ``positives`` other rows of its label, the first ``negatives`` rows of
    other labels whose scores are ``least_pct`` of a hundred of the positive's
    to all of it."""
    spark = vectors.sparkSession
    small_arrow_batches(spark)
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"),
                          F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.where(F.col("label").isNotNull() & F.col("v").isNotNull() & good)
    seen = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("anchor").alias("anchors"), F.min(F.array_min("v")).alias("low"), F.max(F.array_max("v")).alias("high")).first()
    low, high = (0.0 if x is None else x for x in (seen["low"], seen["high"]))
    pages = write_pages(on_curve(rows, low, high, scale), seen["n"], block_rows)
    buckets = anchor_buckets(pages, seen["anchors"], positives)
    n = buckets.count()

    def above(row: dict) -> tuple[np.ndarray, np.ndarray]:
        return row["a_floors"][:, None], np.full((len(row["a_ids"]), 1), FAR)

    best = stage(search(buckets, pages, n, above, True, positives, "anchor_id long", lambda row, a, w: [row["a_ids"][a]]), "positives")
    lists = best.groupBy("bucket").agg(F.collect_list(F.struct("anchor", F.col("rank").cast("int").alias("rank"), "id", "score")).alias("best"))

    def within(row: dict) -> tuple[np.ndarray, np.ndarray]:
        n_anchors = len(row["a_ids"])
        low, high, ids = np.full((n_anchors, positives), FAR), np.full((n_anchors, positives), -FAR), np.zeros((n_anchors, positives), dtype=np.int64)
        for x in row["a_best"]:
            # below zero no score is both least_pct of the positive's and at most the positive's
            low[x["anchor"], x["rank"] - 1], high[x["anchor"], x["rank"] - 1] = -(-least_pct * x["score"] // 100), x["score"]
            ids[x["anchor"], x["rank"] - 1] = x["id"]
        row["positive_ids"], row["positive_scores"] = ids, high
        return low, high

    found = search(buckets.join(lists, "bucket"), pages, n, within, False, negatives, "anchor_id long, positive_id long, positive_score long",
                   lambda row, a, w: [row["a_ids"][a], row["positive_ids"][a, w], row["positive_scores"][a, w]])
    known = lambda c: F.when(F.col(c) != int(NO_ID), F.col(c)).alias(c)
    return found.withColumnRenamed("id", "negative_id").withColumnRenamed("score", "negative_score").select(
        known("anchor_id"), known("positive_id"), F.col("rank").cast("int").alias("rank"), known("negative_id"), "positive_score", "negative_score")
