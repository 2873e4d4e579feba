"""Embedding near-dedup by a pivot-permutation index.

Pivots are reference vectors, a bounded sample of the table. Every vector is
described by its ``nearest`` pivots in order, and stands in the inverted list
of each of them, within its label. Vectors that share at least ``shared`` of
their nearest pivots are candidates, and candidates are verified by their
cosine in double precision. A pair is looked at in the list of its first
shared pivot only, so no link counts twice.

Equal vectors of a label are one entry with a count, so copies cost nothing.
The number of pivots follows the square root of the entries; lists of more
than ``LIST_ROWS`` entries are compared in blocks, each pair of blocks a task
of its own. Lists pass on a link count and the smallest entry of each of their
connected parts, never the pairs.

The index is approximate: links whose ends share too few pivots are missed
(tests measure the recall). Defined cases: a vector that is null, zero or has
null or non-finite components, and one without a label, links with nothing and
is its own component; vectors of different length never link; rows without an
id get no component; repeated rows are vectors of their own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from revlens.llm.common import same, stage
from revlens.llm.components import components

COSINE = 0.93
NEAREST, SHARED = 8, 2
LIST_ROWS = 2_048
MOST_PIVOTS = 4_096


def _usable() -> Column:
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col("label").isNotNull() & F.col("id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0)


def pivot_count(entries: int) -> int:
    """A power of two near the square root of the entries."""
    return int(min(MOST_PIVOTS, max(32, 2 ** round(np.log2(max(1.0, entries) ** 0.5)))))


def units(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors; components are first scaled by powers of two, exactly, so
    that no norm overflows or vanishes."""
    top = np.frexp(np.abs(vectors).max(axis=1, keepdims=True))[1]
    scaled = np.ldexp(np.ldexp(vectors, -(top // 2)), top // 2 - top)  # in two steps: 2 ** -top may not be a double
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def choose_pivots(entries: DataFrame, count: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Unit pivots by vector length, with their numbers: the ``count`` entries
    of the smallest hash."""
    rows = entries.orderBy(F.xxhash64("v"), "entry").limit(count).select("v").collect()
    by: dict[int, list] = {}
    for n, r in enumerate(rows):
        by.setdefault(len(r["v"]), []).append((n, r["v"]))
    out = {}
    for size, found in by.items():
        m = np.array([v for _, v in found], dtype=np.float64)
        out[size] = (np.array([n for n, _ in found], dtype=np.int32), units(m))
    return out


def describe(entries: DataFrame, pivots: dict, nearest: int) -> DataFrame:
    """A row for each of an entry's nearest pivots: its unit vector (doubles)
    and all its nearest pivots, nearest first."""
    schema = pa.schema([("label", pa.int64()), ("dims", pa.int32()), ("pivot", pa.int32()), ("entry", pa.int64()), ("copies", pa.int64()), ("near", pa.binary()), ("unit", pa.binary())])

    def run(it):
        for batch in it:
            vectors = batch.column("v")
            sizes = np.array([len(v) for v in vectors])
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                m = units(np.array(vectors.take(pa.array(at)).to_pylist(), dtype=np.float64))
                numbers, points = pivots.get(int(size), (np.array([-1], dtype=np.int32), np.ones((1, size))))
                k = min(nearest, len(numbers))
                near = numbers[np.argsort(-(m @ points.T), axis=1, kind="stable")[:, :k]]
                rows = pa.array(np.repeat(at, k))
                yield pa.RecordBatch.from_arrays([
                    batch.column("label").take(rows), pa.array(np.full(len(rows), size, dtype=np.int32)), pa.array(near.ravel()), batch.column("entry").take(rows), batch.column("copies").take(rows),
                    pa.array([x.tobytes() for x in near for _ in range(k)], type=pa.binary()), pa.array([x.tobytes() for x in m for _ in range(k)], type=pa.binary())], schema=schema)

    return entries.mapInArrow(run, "label long, dims int, pivot int, entry long, copies long, near binary, unit binary")


def compare_list(pivot: int, near: list[np.ndarray], unit: np.ndarray, side: np.ndarray | None, shared: int, cosine: float) -> np.ndarray:
    """Which entries of a list link: candidates share pivots, and this list's
    is the first they share. ``side``: two blocks, compared with each other."""
    numbers, local = np.unique(np.concatenate(near), return_inverse=True)
    owner = np.repeat(np.arange(len(near)), [len(x) for x in near])
    has = np.zeros((len(near), len(numbers)), dtype=np.float32)
    has[owner, local] = 1
    before = has[:, numbers < pivot]
    need = min(shared, min(len(x) for x in near))
    linked = (has @ has.T >= need) & (before @ before.T == 0)
    linked &= unit @ unit.T >= cosine
    np.fill_diagonal(linked, False)
    if side is not None:
        linked &= side[:, None] != side[None, :]
    return linked


def _roots(linked: np.ndarray) -> np.ndarray:
    """The smallest index that each entry reaches."""
    root = np.arange(len(linked))
    while True:
        near = np.where(linked, root[None, :], len(linked)).min(axis=1)
        new = np.minimum(root, near)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def links_in_lists(described: DataFrame, shared: int, cosine: float, list_rows: int) -> DataFrame:
    """(entry, links, root) for every entry that links within a list."""
    keys = ["label", "dims", "pivot"]
    sizes = described.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / F.lit(list_rows)).alias("blocks"))
    dealt = described.join(sizes, keys).withColumn("block", F.pmod(F.xxhash64("entry"), F.col("blocks")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))

    def compare(table: pa.Table) -> pa.Table:
        low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
        unit = np.stack([np.frombuffer(x, dtype=np.float64) for x in table.column("unit").to_pylist()])
        near = [np.frombuffer(x, dtype=np.int32) for x in table.column("near").to_pylist()]
        side = table.column("block").to_numpy() if low != high else None
        linked = compare_list(table.column("pivot")[0].as_py(), near, unit, side, shared, cosine)
        copies, entry = table.column("copies").to_numpy(), table.column("entry").to_numpy()
        order = np.argsort(entry)  # roots are the smallest entries
        linked = linked[np.ix_(order, order)]
        hit = np.flatnonzero(linked.any(axis=1))
        root = entry[order][_roots(linked)]
        return pa.table({"entry": entry[order][hit], "links": (linked @ copies[order])[hit], "root": root[hit]})

    return dealt.groupBy(*keys, "low", "high").applyInArrow(compare, "entry long, links long, root long")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE,
                    nearest: int = NEAREST, shared: int = SHARED, list_rows: int = LIST_ROWS) -> DataFrame:
    """(id, n_links, component_id, kept) of every vector."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("v"))
    grouped = rows.where(_usable()).groupBy("label", "v").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("least"))
    # an entry's number is fixed by what is written
    entries = stage(grouped.withColumn("entry", F.monotonically_increasing_id()), "vectors")
    pivots = choose_pivots(entries, pivot_count(entries.count()))
    found = stage(links_in_lists(describe(entries.select("label", "v", "entry", "copies"), pivots, nearest), shared, cosine, list_rows), "vector-links")
    links = found.groupBy("entry").agg(F.sum("links").alias("links"))
    parts = components(found.select(F.col("entry").alias("a"), F.col("root").alias("b"))).select(F.col("node").alias("entry"), "component")
    whole = entries.join(parts, "entry", "left").join(links, "entry", "left").withColumn("component", F.coalesce("component", "entry"))
    least = whole.groupBy("component").agg(F.min("least").alias("component_id"))
    whole = whole.join(least, "component").select(F.col("label").alias("__label"), F.col("v").alias("__v"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    ready = rows.withColumn("usable", F.coalesce(_usable(), F.lit(False)))
    out = ready.join(whole, F.col("usable") & same(ready["label"], F.col("__label")) & same(ready["v"], F.col("__v")), "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("id") == component).alias("kept"))
