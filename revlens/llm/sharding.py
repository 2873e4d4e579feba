"""Sharding by bytes: the minimax contiguous partition of ordered groups.

Documents of equal text form an atomic group that no cut may split. Groups are
ordered by a hash of their text, and the shards are contiguous runs of that
order whose largest size in bytes is as small as possible. That size is found
by binary search: a capacity is feasible if filling shard after shard greedily
needs no more shards than there are.

The search needs the prefix sizes of the groups, of which there may be as many
as documents. So the driver holds a coarse line only: cells of the hash range
with their sizes. Cells that a cut may fall into are refined by a Spark job
until every such cell is one group, which makes the result the exact optimum.

Defined cases: null text has no bytes and its rows form one group; empty texts
form one group; every document weighs its bytes plus one, so empty ones are
spread by their number; repeated rows are equal texts; an empty table has no
rows; a shard may be empty when groups are few or one outweighs the others.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from revlens.llm.common import stage

#: Bits of the hash that the first line of cells tells apart, and that each refinement adds.
FIRST_BITS, MORE_BITS = 12, 8
#: Rows that are numbered together.
ROWS_PER_BUCKET = 32_768


@dataclass
class Line:
    """Cells of the hash range in order: first hash, bits, bytes, groups."""

    start: np.ndarray
    bits: np.ndarray
    size: np.ndarray
    groups: np.ndarray

    @property
    def ends(self) -> np.ndarray:
        return np.cumsum(self.size)

    def fill(self, capacity: int, shards: int, split: bool) -> list[int]:
        """Byte positions up to which shard after shard reaches. ``split``: a
        cell of several groups may be cut anywhere, else nowhere."""
        ends, at, out = self.ends, 0, []
        total = int(ends[-1]) if len(ends) else 0
        for _ in range(shards):
            reach = at + capacity
            if reach >= total:
                reach = total
            else:
                k = int(np.searchsorted(ends, reach, side="right"))  # the cell that the reach falls into
                if not (split and self.groups[k] > 1):
                    reach = max(at, int(ends[k] - self.size[k]))
            out.append(reach)
            at = reach
        return out

    def smallest(self, shards: int, split: bool) -> int:
        """The smallest feasible capacity, by binary search."""
        total = int(self.size.sum())
        low, high = 0, total  # low isn't feasible, high is
        while high - low > 1:
            mid = (low + high) // 2
            if self.fill(mid, shards, split)[-1] >= total:
                high = mid
            else:
                low = mid
        return high

    def doubtful(self, shards: int) -> np.ndarray:
        """Cells of several groups into which a cut of the optimum may fall."""
        least, most = self.smallest(shards, split=True), self.smallest(shards, split=False)
        first, last = self.fill(least, shards, split=False), self.fill(most, shards, split=True)
        ends = self.ends
        begins = ends - self.size
        hit = np.zeros(len(ends), dtype=bool)
        for a, b in zip(first, last, strict=True):
            hit |= (begins <= b) & (ends > a) & (ends > 0)
        return np.flatnonzero(hit & (self.groups > 1) & (self.bits < 64))

    def cuts(self, shards: int) -> list[int]:
        """The first hash of each shard but the first."""
        capacity = self.smallest(shards, split=False)
        begins = self.ends - self.size
        reached = self.fill(capacity, shards, split=False)[:-1]
        return [int(self.start[np.searchsorted(begins, r)]) for r in reached if r < begins[-1] + self.size[-1]]


def _cells(groups: DataFrame, bits: int) -> DataFrame:
    return groups.groupBy(F.shiftright("group", 64 - bits).alias("cell")).agg(F.sum("size").alias("size"), F.sum("groups").alias("groups"))


def _line(rows: list, bits: int) -> Line:
    rows = sorted(rows, key=lambda r: r["cell"])
    return Line(np.array([r["cell"] << (64 - bits) for r in rows], dtype=np.int64), np.full(len(rows), bits),
                np.array([r["size"] for r in rows], dtype=np.int64), np.array([r["groups"] for r in rows], dtype=np.int64))


def minimax_cuts(groups: DataFrame, shards: int) -> list[int]:
    """Cut hashes of (group, size) for the smallest possible largest shard.

    At most 2^FIRST_BITS cells come to the driver, and 2^MORE_BITS for each
    cell that a cut may fall into (at most about shards^2 of them a round).
    """
    groups = groups.withColumn("groups", F.lit(1).cast("long"))
    line = _line(_cells(groups, FIRST_BITS).collect(), FIRST_BITS)
    if not len(line.size):
        return []
    while len(doubt := line.doubtful(shards)):
        fine = []
        for bits in np.unique(line.bits[doubt]):
            cells = [int(x) >> (64 - int(bits)) for x in line.start[doubt][line.bits[doubt] == bits]]
            to = min(64, int(bits) + MORE_BITS)
            chosen = groups.where(F.shiftright("group", 64 - int(bits)).isin(cells))
            fine.append(_line(_cells(chosen, to).collect(), to))
        kept = np.ones(len(line.size), dtype=bool)
        kept[doubt] = False
        parts = [Line(line.start[kept], line.bits[kept], line.size[kept], line.groups[kept]), *fine]
        order = np.argsort(np.concatenate([p.start for p in parts]), kind="stable")
        line = Line(*(np.concatenate([getattr(p, f) for p in parts])[order] for f in ("start", "bits", "size", "groups")))
    return line.cuts(shards)


def numbered(df: DataFrame, by: str, order: list[str], spread: Column, rows: int, name: str) -> DataFrame:
    """Number the rows of each ``by`` from 0 without gaps, in many tasks: rows
    are dealt into buckets by ``spread``, numbered there, and shifted by the
    sizes of the buckets before."""
    dealt = df.withColumn("__bucket", F.pmod(spread, F.lit(max(16, rows // ROWS_PER_BUCKET))))
    counts = dealt.groupBy(by, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(by).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(by, "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    within = F.row_number().over(Window.partitionBy(by, "__bucket").orderBy(*order)) - 1
    return dealt.withColumn("__within", within).join(base, [by, "__bucket"]).withColumn(name, F.col("__base") + F.col("__within")).drop("__bucket", "__base", "__within")


def shard(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, shard, slot) of every document."""
    slim = stage(docs.select(
        F.col(id_col),
        (F.coalesce(F.octet_length(text_col), F.lit(0)) + F.lit(1)).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text_col), F.lit(""))).alias("text_crc32"),
        F.xxhash64(text_col).alias("group")), "sharding")
    groups = stage(slim.groupBy("group").agg(F.sum("size").alias("size")), "sharding-groups")
    cuts = minimax_cuts(groups, shards)
    place = F.lit(0)
    for cut in cuts:
        place = place + F.when(F.col("group") >= F.lit(cut), 1).otherwise(0)
    placed = slim.withColumn("shard", place.cast("int"))
    spread = F.xxhash64(id_col, "text_crc32", "size")
    return numbered(placed, "shard", [id_col, "text_crc32", "size"], spread, slim.count(), "slot").select(id_col, "size", "text_crc32", "shard", "slot")


def write_shards(docs: DataFrame, path: str, rows_per_file: int = 100_000) -> None:
    """Write documents that carry shard and slot as a folder per shard; a large
    shard is written by many tasks."""
    part = F.floor(F.col("slot") / F.lit(rows_per_file))
    docs.withColumn("__part", part).repartition("shard", "__part").drop("__part").write.partitionBy("shard").parquet(path)
