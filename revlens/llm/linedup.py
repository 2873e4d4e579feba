"""Line dedup by pairwise alignment.

A line of a document goes if it lies in a block, a run of consecutive lines of
at least ``min_chars`` code points, that an earlier document has as well.

Each line begins a shortest run of that size and ends another; a long line is
a run of its own. Every line of a block lies in one of these runs that is
inside the block. So a document is compared only with the earliest holder of
each of its runs, and a run that g documents share gives g - 1 pairs and not
all g^2. Rare runs (in at most ``rare`` documents) are looked up first; runs in
more documents are looked up in a second round, only where the first left one
of their lines standing. What goes doesn't depend on ``rare``.

Each pair is aligned with patience diff on its line hashes: common ends, then
the lines unique in both in their longest rising order, then again between
them. Where lines are left that may lie in a block (repeated or in another
order), the longest run of the earlier document that ends at each of them is
found with its suffix automaton. What is deleted stands in an earlier
document, and the earliest one that has a line never loses it.

Later means a larger id, null ids after all others; rows of equal id are told
apart by their place in the staged input.

Defined cases: null text is empty and stays as it is; a document may lose all
of its lines and then has an empty text; blank and short lines are deleted
only as part of a block; repeated rows lose all but the first one's lines; an
empty table gives no rows. Lines are compared without white space at their
ends, which counts in a block's size; documents that pad a block differently
are compared if it has ``min_chars`` without that.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from revlens.llm.common import batches, broadcast_if_small, stage, staged

#: A run in at most so many documents is rare.
RARE = 64
#: A block of fewer code points is no overlap, and a shorter run no reason to compare.
MIN_CHARS = 24
#: Base of the runs' hashes (odd, so that it has an inverse).
BASE = 0x9E3779B97F4A7C15
#: Stands between lines; no line equals it.
_BREAK = object()


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs (in order of the first) that rises in the second."""
    tails: list[int] = []
    at: list[int] = []
    before: list[int] = []
    for n, (_, j) in enumerate(pairs):
        k = bisect_left(tails, j)
        before.append(at[k - 1] if k else -1)
        if k == len(tails):
            tails.append(j)
            at.append(n)
        else:
            tails[k], at[k] = j, n
    out, n = [], at[-1] if at else -1
    while n >= 0:
        out.append(pairs[n])
        n = before[n]
    return out[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned positions of two sequences, in order."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, i_end, j, j_end = todo.pop()
        while i < i_end and j < j_end and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < i_end and j < j_end and a[i_end - 1] == b[j_end - 1]:
            i_end, j_end = i_end - 1, j_end - 1
            out.append((i_end, j_end))
        if i == i_end or j == j_end:
            continue
        in_a, in_b = Counter(a[i:i_end]), Counter(b[j:j_end])
        place = {x: n for n, x in enumerate(b[j:j_end], j) if in_b[x] == 1}
        anchors = _rising([(n, place[x]) for n, x in enumerate(a[i:i_end], i) if in_a[x] == 1 and x in place])
        for p, q in anchors:
            todo.append((i, p, j, q))
            out.append((p, q))
            i, j = p + 1, q + 1
        if anchors:
            todo.append((i, i_end, j, j_end))
    return sorted(out)


def longest_runs(a: list[int], b: list[int]) -> list[int]:
    """For each position in b, the lines of the longest run ending there that a
    has. By the suffix automaton of a, in linear time."""
    steps: list[dict] = [{}]
    link, length, last = [-1], [0], 0
    for x in a:
        now = len(steps)
        steps.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and x not in steps[p]:
            steps[p][x] = now
            p = link[p]
        if p >= 0:
            q = steps[p][x]
            if length[p] + 1 < length[q]:
                copy = len(steps)
                steps.append(dict(steps[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and steps[p].get(x) == q:
                    steps[p][x] = copy
                    p = link[p]
                link[q] = q = copy
            link[now] = q
        last = now
    out: list[int] = []
    at, n = 0, 0
    for x in b:
        while at and x not in steps[at]:
            at = link[at]
            n = length[at]
        at = steps[at].get(x, 0)
        n = n + 1 if at else 0
        out.append(n)
    return out


def common_blocks(a: list[int], b: list[int], chars: list[int], min_chars: int) -> list[int]:
    """Positions in b of the lines in blocks of at least ``min_chars`` code
    points that a has."""
    gone: set[int] = set()
    block: list[int] = []
    last = (-2, -2)
    for i, j in [*patience(a, b), (-9, -9)]:
        if (i - 1, j - 1) != last:
            if sum(chars[k] for k in block) >= min_chars:
                gone.update(block)
            block = []
        block.append(j)
        last = (i, j)
    known = set(a)
    left: list[range] = []
    j = 0
    while len(gone) < len(b) and j < len(b):
        i = j
        while j < len(b) and b[j] in known:
            j += 1
        if sum(chars[i:j]) >= min_chars and not gone.issuperset(range(i, j)):
            left.append(range(i, j))
        j += 1
    if not left:
        return sorted(gone)
    # lines of no use are breaks, on both sides
    wanted = {b[j] for some in left for j in some}
    rest = [x if x in wanted else None for x in a]
    rest = [x for x, y in zip(rest, [0, *rest], strict=False) if x is not None or y is not None]
    places = [j for some in left for j in (*some, -1)]
    found = longest_runs(rest, [b[j] if j >= 0 else _BREAK for j in places])
    upto = [0, *accumulate(chars)]
    free = 0  # lines before it are seen to
    for at, (j, n) in enumerate(zip(places, found, strict=True)):
        # a run that the next line carries on lies in that one's
        if n and found[at + 1] <= n and upto[j + 1] - upto[j + 1 - n] >= min_chars:
            gone.update(range(max(free, j + 1 - n), j + 1))
            free = j + 1
    return sorted(gone)


def _runs(docs: DataFrame, min_chars: int) -> DataFrame:
    """(uid, id, run): hashes of the shortest runs of ``min_chars`` that a line
    begins or ends, once a document; only those with a line that isn't in
    ``deleted``."""
    columns = ["uid", "id", "lines", "chars", "bare", "deleted"]
    schema = f"uid long, id {docs.schema['id'].dataType.simpleString()}, run long"
    base, inverse = np.uint64(BASE), np.uint64(pow(BASE, -1, 1 << 64))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            count = batch.column("lines").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            h = batch.column("lines").flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            if not len(h):
                continue
            end = np.cumsum(count)
            owner = np.repeat(np.arange(len(count)), count)
            stands = np.ones(len(h), dtype=np.int64)
            gone = batch.column("deleted")
            n_gone = gone.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            stands[np.repeat(end - count, n_gone) + gone.flatten().to_numpy(zero_copy_only=False).astype(np.int64)] = 0
            standing = np.concatenate([[0], np.cumsum(stands)])
            powers = np.full(len(h) + 1, base)
            back = np.full(len(h) + 1, inverse)
            powers[0] = back[0] = 1
            powers, back = np.cumprod(powers), np.cumprod(back)
            sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(h * powers[:-1])])
            line = np.arange(len(h))
            first, to = [], []
            sizes = [batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("chars", "bare")]
            for size in sizes if (sizes[0] != sizes[1]).any() else sizes[:1]:
                upto = np.concatenate([[0], np.cumsum(size)])
                stop = np.maximum(np.searchsorted(upto, upto[:-1] + min_chars, side="left"), line + 1)
                start = np.minimum(np.searchsorted(upto, upto[1:] - min_chars, side="right") - 1, line)
                ahead, behind = stop <= end[owner], start >= (end - count)[owner]
                first += [line[ahead], start[behind]]
                to += [stop[ahead], line[behind] + 1]
            first, to = np.concatenate(first), np.concatenate(to)
            some = standing[to] > standing[first]
            first, to = first[some], to[some]
            key = (sums[to] - sums[first]) * back[first] ^ (to - first - 1).astype(np.uint64) * base
            of = owner[first]
            order = np.lexsort((key, of))
            key, of = key[order], of[order]
            once = np.ones(len(key), dtype=bool)
            once[1:] = (key[1:] != key[:-1]) | (of[1:] != of[:-1])
            rows = pa.array(of[once])
            yield pa.RecordBatch.from_arrays([batch.column("uid").take(rows), batch.column("id").take(rows), pa.array(key[once].view(np.int64))], names=["uid", "id", "run"])

    return docs.select(*columns).mapInArrow(run, schema)


def _partners(runs: DataFrame, shared: DataFrame) -> DataFrame:
    """(a, b): for each shared run of document b, the earliest document a."""
    found = runs.join(shared, "run").where("uid <> first.uid")
    return found.select(F.col("first.uid").alias("a"), F.col("uid").alias("b")).distinct()


def _align(pairs: DataFrame, docs: DataFrame, min_chars: int) -> DataFrame:
    """(uid, deleted): positions of the later document's lines in common blocks."""
    build = batches({"uid": pa.int64(), "deleted": pa.list_(pa.int32())})

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows = zip(*(batch.column(c).to_pylist() for c in ("b", "of_a", "of_b", "chars")), strict=True)
            found = [(uid, common_blocks(x, y, chars, min_chars)) for uid, x, y, chars in rows]
            found = [f for f in found if f[1]]
            if found:
                yield build(*zip(*found, strict=True))

    left = docs.select(F.col("uid").alias("a"), F.col("lines").alias("of_a"))
    right = docs.select(F.col("uid").alias("b"), F.col("lines").alias("of_b"), "chars")
    return pairs.join(left, "a").join(right, "b").select("b", "of_a", "of_b", "chars").mapInArrow(run, "uid long, deleted array<int>")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rare: int = RARE, min_chars: int = MIN_CHARS) -> DataFrame:
    """All columns of ``docs`` with the remaining text, and ``__n_lines``,
    ``__deleted`` (positions of the deleted lines, ascending)."""
    # numbered once, in what is written; later jobs read the numbers
    base = stage(docs.withColumn("__uid", F.monotonically_increasing_id()), "line-docs")
    split = base.select(F.col("__uid").alias("uid"), F.col(id_col).alias("id"), F.split(F.coalesce(F.col(text_col), F.lit("")), "\n").alias("text"))
    bare = F.transform("text", lambda x: F.trim(F.regexp_replace(x, "[\\t\\r\\f\\x0B]", " ")))
    split = split.select("uid", "id", "text", bare.alias("bare"))
    hashed = split.select("uid", "id", F.transform("bare", lambda x: F.xxhash64(x)).alias("lines"), F.transform("text", F.length).alias("chars"), F.transform("bare", F.length).alias("bare"))
    hashed = stage(hashed, "line-hashes")
    runs = _runs(hashed.withColumn("deleted", F.lit(None).cast("array<int>")), min_chars)
    shared = runs.groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.col("id").isNull().alias("last"), "id", "uid")).alias("first")).where("n > 1")
    shared = stage(shared, "line-shared")
    deleted = stage(_align(_partners(runs, shared.where(F.col("n") <= rare)), hashed, min_chars), "line-deleted")
    standing = _runs(hashed.join(_gathered(deleted), "uid", "left"), min_chars)
    more = stage(_align(_partners(standing, shared.where(F.col("n") > rare)), hashed, min_chars), "line-deleted")
    gone, size = staged(_gathered(deleted.unionByName(more)).withColumnRenamed("uid", "__uid").withColumnRenamed("deleted", "__deleted"), "line-gone")
    whole = base.join(broadcast_if_small(gone, size), "__uid", "left")
    whole = whole.withColumn("__gone", F.coalesce(F.array_sort("__deleted"), F.array().cast("array<int>"))).withColumn("__lines", F.split(F.coalesce(F.col(text_col), F.lit("")), "\n"))
    rest = F.array_join(F.filter("__lines", lambda x, i: ~F.array_contains("__gone", i)), "\n")
    kept = [F.when(F.size("__gone") == 0, F.col(text_col)).otherwise(rest).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns if c not in ("__n_lines", "__deleted")]
    return whole.select(*kept, F.size("__lines").alias("__n_lines"), F.col("__gone").alias("__deleted"))


def _gathered(deleted: DataFrame) -> DataFrame:
    """One row a document; its lines bound what is gathered for one partner,
    and its shared lines the number of partners."""
    return deleted.select("uid", F.explode("deleted").alias("i")).groupBy("uid").agg(F.collect_set("i").alias("deleted"))
