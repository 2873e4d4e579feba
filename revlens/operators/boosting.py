"""Gradient boosting of regression trees over binned sufficient statistics (M9).

Rows are read twice. The first pass counts each feature's values in a
log-linear histogram, which gives at most ``max_bins`` - 1 cuts a feature. The
second turns every row into the tuple of its bins, and equal tuples become one
cell: the number of rows and the sum of their labels, which is all that a
squared error needs. Cells are dealt into blocks that stay in memory.

Trees grow by level. One pass over the blocks gives, for each node, feature
and bin, the sums of gradients and of rows; these histograms are added up
(in groups, so that the driver gets a bounded number of them), and the driver
picks each node's cut by the second-order gain with leaf penalty. As the
trees of a batch fit the same gradient, each on its own draw of rows and
columns, a pass serves all of them: 300 trees of depth 5 in batches of 15 are
100 passes instead of 1,500. A batch of 1 is plain sequential boosting.

A pass costs cells x trees, so that it does little for each: columns of few
bins are counted jointly and summed up apart at the block's end; at the root
only the rows that a tree doesn't see are counted and taken off the sums of
all, which the batch shares; below it only the smaller child of each node. A
cell's node follows from comparisons of whole columns of bytes.

Results don't depend on the input's partitioning: label sums are exact whole
numbers (units of the largest label times 2^-30), the cells are dealt by their
bins, draws depend on seed, tree and block, and histograms are added in the
order of the blocks. What a batch adds is kept beside its blocks; the lineage
of that is cut by a reliable checkpoint every few batches.

NULL and NaN features go left at every cut, before the smallest value; a cut may
part them from all values.
"""

from __future__ import annotations

import functools
import gc
import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.plans.materialize import materialize
from revlens.session import checkpoint_dir

#: Cells of a block; blocks that fewer cells are dealt into, and the cells that each of them has at least.
BLOCK_CELLS, FEWER = 524_288, ((48, 65_536), (8, 4_096))
#: Rows that are predicted at once (a multiple of 64).
PREDICTED_ROWS = 65_536
#: Cells that a pass works on at once, bins of columns that are counted jointly, levels whose nodes are told apart one by one.
CHUNK_CELLS, JOINT_BINS, MASKED_LEVELS = 65_536, 2_048, 6
#: Along one input: the places of a tree's table at most, and sums of rows and turns held at once.
STEP_PLACES, STEP_SUMS = 1 << 16, 1 << 20
#: Rows of a cell and cells with as many rows from which on draws are looked up in a table.
TABLE_ROWS, TABLE_CELLS = 4_096, 256
#: Histograms that are added up at once, batches between checkpoints.
MERGED, CHECKPOINT_EVERY = 64, 8
#: The bin of a node that has no cut: no code is above it.
NO_CUT = 255
#: Mantissa bits of the value histogram's keys (0.1 % steps); whole numbers below ``COUNTED`` are counted without a sort.
KEY_BITS, COUNTED = 10, 4_096


@dataclass(frozen=True)
class BoostParams:
    trees: int = 300
    step: float = 0.05
    depth: int = 5
    row_rate: float = 0.8
    column_rate: float = 0.8
    min_rows: float = 10.0
    leaf_penalty: float = 1.0
    max_bins: int = 64
    batch: int = 15
    seed: int = 42


# ------------------------------------------------------------------ the ensemble
@dataclass
class Trees:
    """Complete binary trees as arrays (trees x nodes): inner node i sends rows
    with value > cut to 2i + 2, others to 2i + 1. Where a tree ends early, the
    cuts below are infinite. ``leaf`` has the bottom level's values."""
    features: tuple[str, ...]
    base: float
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    gain: np.ndarray

    @property
    def depth(self) -> int:
        return int(math.log2(self.leaf.shape[1]))

    @staticmethod
    def of(features: Sequence[str], base: float, trees: Sequence) -> Trees:
        """Trees written as nested tuples (feature, cut, left, right) with numbers as leaves."""
        deep = lambda t: 1 + max(deep(t[2]), deep(t[3])) if isinstance(t, tuple) else 0
        depth = max([1, *map(deep, trees)])
        out = Trees.empty(features, base, len(trees), depth)
        for n, tree in enumerate(trees):
            todo = [(0, tree)]
            while todo:
                i, t = todo.pop()
                if i >= out.cut.shape[1]:
                    out.leaf[n, i - out.cut.shape[1]] = t
                elif isinstance(t, tuple):
                    out.feature[n, i], out.cut[n, i] = out.features.index(t[0]), t[1]
                    todo += [(2 * i + 1, t[2]), (2 * i + 2, t[3])]
                else:
                    todo += [(2 * i + 1, t)]
        return out

    @staticmethod
    def empty(features: Sequence[str], base: float, trees: int, depth: int) -> Trees:
        inner = 2 ** depth - 1
        return Trees(tuple(features), float(base), np.zeros((trees, inner), np.int16), np.full((trees, inner), np.inf),
                     np.zeros((trees, inner + 1)), np.zeros((trees, inner)))

    def binned(self) -> tuple[list[np.ndarray], np.ndarray]:
        """Each feature's cuts in ascending order and every node's place among them (-1: no cut)."""
        if "_binned" not in self.__dict__:
            real = self.cut < np.inf
            cuts = [np.unique(self.cut[real & (self.feature == j)]) for j in range(len(self.features))]
            place = np.full(self.cut.shape, -1)
            for j, c in enumerate(cuts):
                at = real & (self.feature == j)
                place[at] = np.searchsorted(c, self.cut[at])
            self.__dict__["_binned"] = cuts, place
        return self.__dict__["_binned"]

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Predictions for rows of ``x`` (rows x features)."""
        out = np.full(len(x), self.base)
        for at in range(0, len(x), PREDICTED_ROWS):
            part = x[at : at + PREDICTED_ROWS]
            for leaf, node in zip(self.leaf, self._leaves_by_bits(part) if self.depth <= MASKED_LEVELS else self._leaves(part)):
                out[at : at + PREDICTED_ROWS] += leaf.take(node)
        return out

    def _leaves(self, x: np.ndarray) -> Iterator[np.ndarray]:
        """Each row's leaf in one tree after another."""
        cuts, places = self.binned()
        codes = [bins_of(x[:, j], c, np.uint8 if len(c) < 256 else np.uint32) for j, c in enumerate(cuts)]
        for feature, place in zip(self.feature, places):
            yield nodes_at(codes, feature, place, self.depth, none=-1)

    def _leaves_by_bits(self, x: np.ndarray) -> Iterator[np.ndarray]:
        """``_leaves`` with a bit per row and cut. The trees share few cuts, so
        each is compared once; a level then picks among its nodes' bits by the
        levels above, 64 rows at a time, and gives one bit of the leaf's place."""
        cuts, places = self.binned()
        first = np.cumsum([1, *map(len, cuts)])
        words = -(-len(x) // 64)
        above = np.zeros((first[-1], words * 8), np.uint8)  # the first row has no bits: a node without a cut
        for j, c in enumerate(cuts):
            column = np.ascontiguousarray(x[:, j])
            for k, cut in enumerate(c.tolist()):
                bits = np.packbits(column > cut, bitorder="little")
                above[first[j] + k, : len(bits)] = bits
        above = above.view(np.uint64)
        for at in np.where(places < 0, 0, first[self.feature] + places):
            node, chosen = np.zeros(words * 64, np.uint8), []
            for level in range(self.depth):
                bits = above[at[2 ** level - 1 : 2 ** (level + 1) - 1]]
                for way in reversed(chosen):
                    bits = bits[0::2] ^ ((bits[0::2] ^ bits[1::2]) & way)
                chosen.append(bits[0])
                np.add(node, node, out=node)
                np.add(node, np.unpackbits(bits[0].view(np.uint8), bitorder="little"), out=node)
            yield node[: len(x)]

    def transform(self, df: DataFrame, then: Callable[[np.ndarray], np.ndarray] = np.asarray) -> DataFrame:
        """``df`` with a column ``prediction``; ``then`` is run on the predictions."""
        trees = self

        @F.pandas_udf("double")
        def predicted(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            held, rows = [], 0  # a tree costs as much for few rows as for some thousands
            for columns in batches:
                columns = columns if isinstance(columns, tuple) else (columns,)  # a single feature comes as it is
                held.append(np.column_stack([c.to_numpy(dtype=np.float64, na_value=np.nan) for c in columns]))
                rows += len(held[-1])
                if rows >= PREDICTED_ROWS:
                    yield pd.Series(then(trees.predict(np.concatenate(held))))
                    held, rows = [], 0
            if held:
                yield pd.Series(then(trees.predict(np.concatenate(held))))

        return df.withColumn("prediction", predicted(*[F.col(c).cast("double") for c in self.features]))

    def importances(self) -> list[tuple[str, float]]:
        """Mean gain of a feature's cuts, as a share of all features' (largest first)."""
        cuts = self.cut < np.inf
        mean = np.array([self.gain[cuts & (self.feature == j)].mean() if (cuts & (self.feature == j)).any() else 0.0
                         for j in range(len(self.features))])
        share = mean / mean.sum() if mean.sum() > 0 else mean
        return sorted(zip(self.features, share.tolist()), key=lambda t: (-t[1], t[0]))

    def to_table(self, spark: SparkSession) -> DataFrame:
        """A row per node: tree, node, feature (NULL on the bottom level), cut, value, gain."""
        inner = self.cut.shape[1]
        n, i = np.divmod(np.arange(self.cut.size), inner)
        k, b = np.divmod(np.arange(self.leaf.size), inner + 1)
        pdf = pd.DataFrame({
            "tree": np.concatenate([n, k]), "node": np.concatenate([i, b + inner]),
            "feature": [*np.array(self.features, dtype=object)[self.feature.ravel()], *[None] * self.leaf.size],
            "cut": np.concatenate([self.cut.ravel(), np.zeros(self.leaf.size)]),
            "value": np.concatenate([np.zeros(self.cut.size), self.leaf.ravel()]),
            "gain": np.concatenate([self.gain.ravel(), np.zeros(self.leaf.size)]), "base": self.base})
        return spark.createDataFrame(pdf, "tree int, node int, feature string, cut double, value double, gain double, base double")

    @staticmethod
    def from_table(table: DataFrame, features: Sequence[str]) -> Trees:
        """The ensemble of ``to_table``'s rows; there are as many as the trees have nodes."""
        pdf = table.toPandas()
        nodes = int(pdf["node"].max()) + 1
        out = Trees.empty(features, pdf["base"].iloc[0], int(pdf["tree"].max()) + 1, int(math.log2(nodes + 1)) - 1)
        inner = out.cut.shape[1]
        up, down = pdf[pdf["node"] < inner], pdf[pdf["node"] >= inner]
        at = up["tree"].to_numpy(), up["node"].to_numpy()
        out.feature[at] = [out.features.index(f) for f in up["feature"]]
        out.cut[at], out.gain[at] = up["cut"], up["gain"]
        out.leaf[down["tree"].to_numpy(), down["node"].to_numpy() - inner] = down["value"]
        return out

    # -------------------------------------------------------------- along one input
    def steps(self, x: np.ndarray, grid: np.ndarray, moving: dict[str, np.ndarray]) -> np.ndarray:
        """Predictions of every row at every point of a grid (rows x points).

        Some features move with the grid: ``moving`` has their values (rows x
        points, or points alone), which must not fall along it. A cut on one of
        them holds from some point on: its turn, which is the same for all rows
        if the values are, and else the row's own. So a leaf adds its value to a
        row, if the row's other features reach it, from the later of two turns
        to the earlier of two others, each time a row's own and a common one.
        Per tree, a table has these sums for all ways in which the other
        features can fall (``_turning``); a row costs a look-up for each pair of
        turns, and its own turns only count once, after all trees. Trees whose
        table would be large are walked down (``_walk``).
        """
        number = {self.features.index(f): v for f, v in moving.items()}
        own = [j for j, v in number.items() if v.ndim == 2]
        plan = self._turning({j: v for j, v in number.items() if v.ndim == 1}, own, len(grid)) if len(own) < 2 else None
        if plan is None:
            return self._walk(x, grid, number, range(len(self.cut)))
        out = np.empty((len(x), len(grid)))
        rows = max(256, STEP_SUMS // max(1, len(plan.pairs)))
        for at in range(0, len(x), rows):
            part = {j: v[at : at + rows] if v.ndim == 2 else v for j, v in number.items()}
            out[at : at + rows] = self._turned(plan, x[at : at + rows], own, part, len(grid))
            if plan.others:
                out[at : at + rows] += self._walk(x[at : at + rows], grid, part, plan.others) - self.base
        return out

    def _turning(self, common: dict[int, np.ndarray], own: list[int], points: int) -> Turning:
        """The tables of ``steps`` for features that move alike for all rows
        (``common``) and at most one that moves by row."""
        key = (tuple((j, v.tobytes()) for j, v in sorted(common.items())), tuple(own), points)
        made = self.__dict__.setdefault("_tables", {})
        if key not in made:
            made[key] = turning_tables(self, common, own, points)
        return made[key]

    def _turned(self, plan: Turning, x: np.ndarray, own: list[int], moving: dict[int, np.ndarray], points: int) -> np.ndarray:
        rows = len(x)
        cuts, _ = self.binned()
        codes = []
        for group in plan.groups:
            code = np.zeros(rows, np.intp)
            for j in group:
                code = code * (len(cuts[j]) + 1) + bins_of(np.ascontiguousarray(x[:, j]), cuts[j], np.intp)
            codes.append(code)
        sums = [np.zeros(rows) for _ in plan.pairs]
        place, spare = np.empty((2, rows), np.intp)
        held = np.empty((max([1, *[len(t[2]) for t in plan.trees]]), rows))
        for looks, kinds, columns, table in plan.trees:
            place[:] = 0
            for i, look in looks:
                look.take(codes[i], out=spare, mode="clip")
                np.add(place, spare, out=place)
            kinds.take(place, out=spare, mode="clip")
            table.take(spare, axis=1, out=held[: len(columns)], mode="clip")
            for column, values in zip(columns, held):
                total = sums[column]
                np.add(total, values, out=total)
        # what is added from the later turn of each pair on
        change = np.zeros((points + 1, rows))
        change[0] = self.base
        flat, each = change.reshape(-1), np.arange(rows)
        mine = np.unique([cut for cut, _ in plan.pairs if cut > -np.inf])
        if len(mine):
            # the points whose value is above no more than so many of the cuts
            below = bins_of(moving[own[0]].reshape(-1), mine, np.intp) + np.repeat(each * (len(mine) + 1), points)
            turns = np.cumsum(np.bincount(below, minlength=rows * (len(mine) + 1)).reshape(rows, -1), axis=1).T * rows + each
        for (cut, turn), value in zip(plan.pairs, sums):
            if cut == -np.inf:
                change[turn] += value
            else:
                flat[np.maximum(turns[np.searchsorted(mine, cut)], turn * rows + each)] += value
        return np.cumsum(change[:points], axis=0).T

    def _walk(self, x: np.ndarray, grid: np.ndarray, number: dict[int, np.ndarray], trees: Sequence[int]) -> np.ndarray:
        """``steps`` of some trees, walked down: a row carries the stretch of the
        grid that reaches a node; a cut on a moving feature splits the stretch,
        another one sends it whole to one side. Each leaf so reached adds its
        value where its stretch begins and takes it off where it ends; the
        running sum is the step function. A row costs as much as it reaches
        leaves, not points times trees."""
        rows, points = len(x), len(grid)
        width = points + 1
        change = np.zeros(rows * width)
        change[::width] = self.base
        columns = np.ascontiguousarray(x.T)
        turns: dict[tuple[int, float], np.ndarray] = {}

        def turn(j: int, cut: float) -> np.ndarray:
            """The first point of each row whose value is above the cut."""
            if (j, cut) not in turns:
                if number[j].ndim == 1:
                    turns[j, cut] = np.full(rows, np.count_nonzero(~(number[j] > cut)))
                else:
                    turns[j, cut] = np.count_nonzero(~(number[j] > cut), axis=1)
            return turns[j, cut]

        def some(keep: np.ndarray, *parts: np.ndarray) -> tuple:
            at = np.flatnonzero(keep)
            return parts if len(at) == len(keep) else tuple(p.take(at) for p in parts)

        inner = self.cut.shape[1]
        first = (np.arange(rows), np.zeros(rows, np.int64), np.full(rows, points))
        places, values = [], []
        for n, t in enumerate(trees):
            feature, cuts, leaf = self.feature[t].tolist(), self.cut[t].tolist(), self.leaf[t]
            todo = [(0, *first)]
            while todo:
                node, who, begin, end = todo.pop()
                if not len(who):
                    continue
                if node >= inner:
                    row = who * width
                    places += [row + begin, row + end]
                    values += [np.full(len(who), leaf[node - inner]), np.full(len(who), -leaf[node - inner])]
                    continue
                j, cut = feature[node], cuts[node]
                if cut == np.inf:
                    todo.append((2 * node + 1, who, begin, end))
                elif j in number:
                    k = turn(j, cut).take(who)
                    left, right = np.minimum(end, k), np.maximum(begin, k)
                    todo.append((2 * node + 1, *some(begin < left, who, begin, left)))
                    todo.append((2 * node + 2, *some(right < end, who, right, end)))
                else:
                    right = columns[j].take(who) > cut
                    todo.append((2 * node + 1, *some(~right, who, begin, end)))
                    todo.append((2 * node + 2, *some(right, who, begin, end)))
            if n % 16 == 15 or n == len(trees) - 1:
                change += np.bincount(np.concatenate(places), np.concatenate(values), len(change))
                places, values = [], []
        return np.cumsum(change.reshape(rows, width)[:, :points], axis=1)


@dataclass
class Turning:
    """The tables of ``Trees.steps``: groups of the still features that are
    looked up jointly; the pairs of a row's own cut (-inf: none) and a common
    turn; for each tree, what each group adds to a place, the kind of row at
    each place, the tree's pairs, and their values for each kind. ``others``
    are trees without a table."""
    groups: list[list[int]]
    pairs: list[tuple[float, int]]
    trees: list[tuple]
    others: list[int]


def turning_tables(model: Trees, common: dict[int, np.ndarray], own: list[int], points: int) -> Turning:
    cuts, places = model.binned()
    widths = [len(c) + 1 for c in cuts]
    still = [j for j in range(len(cuts)) if j not in common and j not in own and len(cuts[j])]
    groups = [[still[i] for i in g] for g in joined_columns([widths[j] for j in still])]
    # every bin of each feature in a group's joint code
    bins = {}
    for g in groups:
        code = np.arange(math.prod(widths[j] for j in g))
        for j in reversed(g):
            code, bins[j] = np.divmod(code, widths[j])
    pairs: dict[tuple[float, int], int] = {}
    trees, others = [], []
    for n, (feature, cut, place, leaf) in enumerate(zip(model.feature.tolist(), model.cut.tolist(), places.tolist(), model.leaf.tolist())):
        inner = len(cut)
        used = {j: sorted({place[i] for i in range(inner) if feature[i] == j and cut[i] < np.inf}) for j in still}
        size = math.prod(len(u) + 1 for u in used.values())
        if size > STEP_PLACES or len(leaf) > 64:
            others.append(n)
            continue
        stride, looks, at = 1, [np.zeros(len(bins[g[0]]), np.intp) for g in groups], {}
        for k, g in enumerate(groups):
            for j in g:
                if used[j]:
                    # a bin is above the cuts whose places are below it
                    looks[k] += np.searchsorted(used[j], bins[j]) * stride
                    at[j] = np.arange(size) // stride % (len(used[j]) + 1)
                    stride *= len(used[j]) + 1
        # the leaves that each place reaches, and from which to which turns
        reached, values = np.zeros(size, np.uint64), []
        todo = [(0, np.ones(size, bool), -np.inf, np.inf, 0, points)]
        while todo:
            i, here, low, high, begin, end = todo.pop()
            if low >= high or begin >= end or not here.any():
                continue
            if i >= inner:
                reached[here] |= np.uint64(1 << len(values))
                worth: dict[tuple[float, int], float] = {}
                for c, t, v in ((low, begin, 1), (high, begin, -1), (low, end, -1), (high, end, 1)):
                    if c < np.inf and t < points:  # others never turn
                        worth[c, t] = v * leaf[i - inner]
                values.append(worth)
            elif cut[i] == np.inf:
                todo.append((2 * i + 1, here, low, high, begin, end))
            elif feature[i] in common:
                turn = int(np.count_nonzero(~(common[feature[i]] > cut[i])))
                todo += [(2 * i + 1, here, low, high, begin, min(end, turn)), (2 * i + 2, here, low, high, max(begin, turn), end)]
            elif feature[i] in own:
                todo += [(2 * i + 1, here, low, min(high, cut[i]), begin, end), (2 * i + 2, here, max(low, cut[i]), high, begin, end)]
            else:
                above = at[feature[i]] > used[feature[i]].index(place[i])
                todo += [(2 * i + 1, here & ~above, low, high, begin, end), (2 * i + 2, here & above, low, high, begin, end)]
        kinds, kind = np.unique(reached, return_inverse=True)
        mine = sorted({pair for worth in values for pair in worth})
        table = (kinds[:, None] >> np.arange(len(values), dtype=np.uint64) & np.uint64(1)).astype(np.float64) @ np.array([[w.get(pair, 0.0) for pair in mine] for w in values])
        columns = [pairs.setdefault(pair, len(pairs)) for pair in mine]
        trees.append(([(k, look) for k, look in enumerate(looks) if look.any()], kind.reshape(-1).astype(np.intp), columns, np.ascontiguousarray(table.T)))
    return Turning(groups, list(pairs), trees, others)


# ------------------------------------------------------------------ bins and cells
def value_keys(x: np.ndarray) -> np.ndarray:
    """Log-linear keys in the order of the values."""
    bits = (x + 0.0).view(np.int64) >> np.int64(52 - KEY_BITS)
    return np.where(x < 0, -(bits & ((1 << (11 + KEY_BITS)) - 1)) - 1, bits)


def key_counts(x: np.ndarray) -> tuple[np.ndarray, ...]:
    """The keys of some values in ascending order, each with its number of values,
    the least and the greatest of them. Codes and other small whole numbers, which
    most features have, are counted; the others are sorted."""
    if x.min() >= 0 and x.max() < COUNTED and (whole := x.astype(np.int64)).astype(np.float64).tobytes() == (x + 0.0).tobytes():
        n = np.bincount(whole)
        value = np.flatnonzero(n).astype(np.float64)
        key, first = np.unique(value_keys(value), return_index=True)
        ends = np.append(first[1:], len(value)) - 1
        return key, np.add.reduceat(n[n > 0], first), value[first], value[ends]
    x = np.sort(x)
    key, at, n = np.unique(value_keys(x), return_index=True, return_counts=True)
    return key, n, x[at], x[at + n - 1]


def value_histogram(data: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, key, n, low, high): rows, least and greatest value of each key."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for j in range(len(features)):
                x = batch.column(j).to_numpy(zero_copy_only=False).astype(np.float64)
                missing = int(np.isnan(x).sum())
                if missing:  # before all values, so that a cut can part it from them
                    yield pa.RecordBatch.from_arrays([pa.array([j], pa.int32()), pa.array([-(1 << 62)]), pa.array([missing]), pa.array([-np.inf]), pa.array([-np.inf])],
                                                     names=["feature", "key", "n", "low", "high"])
                    x = x[~np.isnan(x)]
                if len(x):
                    key, n, low, high = key_counts(x)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), j, np.int32)), pa.array(key), pa.array(n), pa.array(low), pa.array(high)],
                                                     names=["feature", "key", "n", "low", "high"])

    rows = data.select(*[F.col(c).cast("double").alias(c) for c in features]).mapInArrow(run, "feature int, key long, n long, low double, high double")
    return rows.groupBy("feature", "key").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))


def choose_cuts(histogram: pd.DataFrame, features: int, max_bins: int) -> list[np.ndarray]:
    """Cuts halfway between neighbouring values, at equal shares of the rows
    where a feature has more keys than bins."""
    out = []
    for j in range(features):
        h = histogram[histogram["feature"] == j].sort_values("key")
        low, high, n = h["low"].to_numpy(), h["high"].to_numpy(), h["n"].to_numpy()
        between = (high[:-1] + low[1:]) / 2
        if len(h) > max_bins:
            upto = np.cumsum(n)
            # the key in which each share of the rows ends
            ends = np.searchsorted(upto, upto[-1] * np.arange(1, max_bins) / max_bins)
            between = between[np.unique(np.minimum(ends, len(between) - 1))]
        out.append(np.unique(between))
    return out


def bins_of(x: np.ndarray, cuts: np.ndarray, kind: type = np.uint8) -> np.ndarray:
    """Cuts below each value; NaN has none below."""
    return np.where(np.isnan(x), 0, np.searchsorted(cuts, x, side="left")).astype(kind)


def cells_of(data: DataFrame, features: Sequence[str], label: str, cuts: list[np.ndarray], unit: float) -> DataFrame:
    """(key, n, high, low): rows of each tuple of bins and their labels' sum,
    ``(high * 2^15 + low) * unit``, as exact whole numbers."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows, width = batch.num_rows, len(features)
            codes = np.empty((rows, width), np.uint8)
            for j in range(width):
                codes[:, j] = bins_of(batch.column(j).to_numpy(zero_copy_only=False).astype(np.float64), cuts[j])
            y = np.rint(batch.column(width).to_numpy(zero_copy_only=False) / unit).astype(np.int64)
            # Spark adds up the rows of one tuple, in the map tasks already
            ends = pa.py_buffer(np.arange(0, (rows + 1) * width, width, dtype=np.int32))
            key = pa.Array.from_buffers(pa.binary(), rows, [None, ends, pa.py_buffer(codes)])
            yield pa.RecordBatch.from_arrays([key, pa.array(np.ones(rows, np.int64)), pa.array(y >> 15), pa.array(y & 32767)], names=["key", "n", "high", "low"])

    rows = data.select(*[F.col(c).cast("double").alias(c) for c in features], F.col(label).cast("double").alias("__label")).mapInArrow(run, "key binary, n long, high long, low long")
    return rows.groupBy("key").agg(*[F.sum(c).alias(c) for c in ("n", "high", "low")])


STATE = "block long, codes binary, n binary, g binary"


def blocks_of(cells: DataFrame, parts: int, features: int, unit: float, base: float) -> DataFrame:
    """The cells in blocks of arrays: codes (features x cells), rows, and how far
    a row's prediction so far lies above its label, in the cell's mean."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in it if b.num_rows]
        if held:
            table = pa.Table.from_batches(held)
            codes = np.concatenate([key_codes(chunk, features) for chunk in table.column("key").chunks])
            n = table.column("n").to_numpy().astype(np.float64)
            s = (table.column("high").to_numpy() * 32768.0 + table.column("low").to_numpy()) * unit
            few = np.argsort(n, kind="stable")  # cells of as many rows are drawn from together
            # a block's number is fixed by its cells
            yield state_row(int.from_bytes(table.column("key")[0].as_py()[:7], "big"), np.ascontiguousarray(codes[few].T), n[few], base - s[few] / n[few])

    dealt = cells.repartition(parts, "key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, STATE)


def key_codes(keys: pa.Array, features: int) -> np.ndarray:
    """The bytes of keys that are ``features`` bytes each (cells x features), without a copy."""
    first = int(np.frombuffer(keys.buffers()[1], np.int32)[keys.offset]) if len(keys) else 0
    return np.frombuffer(keys.buffers()[2], np.uint8, len(keys) * features, first).reshape(-1, features)


def state_row(block: int, codes: np.ndarray, n: np.ndarray, g: np.ndarray) -> pa.RecordBatch:
    """A block as a row. ``n`` ascends, so that its values and where each begins are enough."""
    first = np.flatnonzero(np.diff(n, prepend=0.0))
    runs = np.concatenate([n[first], first, [len(n)]])
    return pa.RecordBatch.from_arrays([pa.array([block]), *[pa.array([v.tobytes()], type=pa.binary()) for v in (codes, runs, g)]], names=["block", "codes", "n", "g"])


@functools.cache
def keep_modules() -> None:
    """Leave what a worker has loaded so far out of its garbage collections: one
    runs after each task, and a fit has thousands of short tasks."""
    gc.freeze()


def state_of(it: Iterator[pa.RecordBatch], features: int) -> Iterator[tuple]:
    keep_modules()
    for batch in it:
        for k in range(batch.num_rows):
            codes, runs, g = (np.frombuffer(batch.column(c)[k].as_buffer(), np.uint8 if c == "codes" else np.float64) for c in ("codes", "n", "g"))
            values = len(runs) // 2
            n = np.repeat(runs[:values], np.diff(runs[values:]).astype(np.int64))
            yield batch.column("block")[k].as_py(), codes.reshape(features, -1), n, g


# ------------------------------------------------------------------ growing trees
def drawn(n: np.ndarray, rate: float, seed: int, tree: int, block: int, first: np.ndarray | None = None) -> np.ndarray:
    """How many rows of each cell a tree sees: every row with probability
    ``rate`` (in steps of 2^-16). ``n`` ascends; where it is 1 throughout, the
    result is boolean. ``first``: where its values begin (``value_starts``)."""
    rng = np.random.Generator(np.random.SFC64([seed, tree, block]))
    bits = rng.integers(0, 1 << 64, -(-len(n) // 4), dtype=np.uint64).view(np.uint16)[: len(n)]
    if n[-1] == 1:
        return bits < round(rate * 65536)
    # as few bytes as the most rows of a cell take
    out = np.empty(len(n), np.uint16 if n[-1] <= TABLE_ROWS else np.float64)
    first = value_starts(n) if first is None else first
    for at, to in zip(first, [*first[1:], len(n)]):
        rows = int(n[at])
        if rows == 1:
            np.less(bits[at:to], round(rate * 65536), out=out[at:to], casting="unsafe")
        elif rows <= TABLE_ROWS and to - at >= TABLE_CELLS and 0 < rate < 1:
            out[at:to] = draw_table(rows, rate).take(bits[at:to])
        else:
            out[at:to] = rng.binomial(rows, rate, to - at)
    return out


def value_starts(n: np.ndarray) -> np.ndarray:
    """Where each value of an ascending array begins."""
    return np.flatnonzero(np.diff(n, prepend=0.0))


@functools.lru_cache(maxsize=128)
def draw_table(rows: int, rate: float) -> np.ndarray:
    """How many of ``rows`` are drawn, for each of 2^16 equal shares of the chances."""
    k = np.arange(rows + 1)
    log_factorial = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, rows + 1)))])
    log_share = log_factorial[-1] - log_factorial - log_factorial[::-1] + k * math.log(rate) + (rows - k) * math.log1p(-rate)
    return np.searchsorted(np.cumsum(np.exp(log_share))[:-1], (np.arange(65536) + 0.5) / 65536, side="right").astype(np.uint16)


def nodes_at(codes: Sequence[np.ndarray], feature: np.ndarray, bin_: np.ndarray, levels: int, none: int = NO_CUT) -> np.ndarray:
    """Each cell's place among its level's nodes after ``levels`` levels of a
    tree. A node without a cut (``none``) sends all cells to its left, where
    there's no cut either. The upper levels compare whole columns with each
    node's cut; further down, where nodes are many, each cell looks up its own."""
    node = np.zeros(len(codes[0]), np.uint8)
    spare = tuple(np.empty(len(node), bool) for _ in range(3))
    for level in range(min(levels, MASKED_LEVELS)):
        right = above_cut(codes, feature, bin_, level, node, none, spare=spare)
        np.add(node, node, out=node)
        np.add(node, right.view(np.uint8), out=node)
    if levels > MASKED_LEVELS:
        node, rows, every = node.astype(np.int64), np.stack(codes), np.arange(len(node))
        for level in range(MASKED_LEVELS, levels):
            at = node + (2 ** level - 1)
            cut = bin_[at]
            node = 2 * node + ((cut != none) & (rows[feature[at], every] > cut))
    return node


def above_cut(codes: Sequence[np.ndarray], feature: np.ndarray, bin_: np.ndarray, level: int, node: np.ndarray, none: int,
              turned: np.ndarray | None = None, spare: tuple | None = None) -> np.ndarray:
    """Which cells lie above the cut of their node; in nodes that are ``turned``,
    which don't. ``spare``: three boolean arrays to work in."""
    out, above, here = spare or tuple(np.empty(len(node), bool) for _ in range(3))
    out[:] = False
    nodes = slice(2 ** level - 1, 2 ** (level + 1) - 1)
    flip = [False] * 2 ** level if turned is None else turned[nodes].tolist()
    for i, (j, cut, below) in enumerate(zip(feature[nodes].tolist(), bin_[nodes].tolist(), flip)):
        if cut != none:
            (np.less_equal if below else np.greater)(codes[j], cut, above)
            if level:
                np.equal(node, i, here)
                np.logical_and(above, here, above)
            np.logical_or(out, above, out)
    return out


def joined_columns(widths: Sequence[int]) -> list[list[int]]:
    """Columns in groups whose bins together are at most ``JOINT_BINS`` (or one column)."""
    groups: list[list[int]] = []
    for j in sorted(range(len(widths)), key=lambda j: -widths[j]):
        fits = [g for g in groups if math.prod(widths[k] for k in g) * widths[j] <= JOINT_BINS]
        (fits[0] if fits else groups.append([]) or groups[-1]).append(j)
    return groups


def block_sums(out: np.ndarray, block: int, codes: np.ndarray, n: np.ndarray, s: np.ndarray, f: np.ndarray, level: int, grown: list[tuple],
               widths: Sequence[int], params: BoostParams) -> None:
    """Add a block's sums of gradients and rows to ``out``: of cells with the
    label sums ``s`` and the predictions ``f``."""
    mean_sums(out, block, codes, n, (n * f - s) / n, level, grown, widths, params)


def mean_sums(out: np.ndarray, block: int, codes: np.ndarray, n: np.ndarray, mean: np.ndarray, level: int, grown: list[tuple],
              widths: Sequence[int], params: BoostParams) -> None:
    """``block_sums`` by the mean gradient of each cell's rows."""
    groups = joined_columns(widths)
    size = [math.prod(widths[j] for j in g) for g in groups]
    joint = []
    for g in groups:
        code = np.zeros(len(n), np.uint16)
        for j in g:
            code = code * np.uint16(widths[j]) + codes[j]
        joint.append(code)
    single, first = n[-1] == 1, value_starts(n)
    nodes = out.shape[2]
    spare_places = np.empty(CHUNK_CELLS, np.intp)

    def count(sums: list, used: list[int], rows: np.ndarray, at: int, seen: np.ndarray, parent: np.ndarray | None) -> None:
        # n ascends: where a chunk's last cell has one row, those seen are counted without weights
        h = None if n[at : at + CHUNK_CELLS][-1] == 1 else rows.take(seen).astype(np.float64)
        g = mean[at : at + CHUNK_CELLS].take(seen)
        if h is not None:
            g *= h
        place = spare_places[: len(seen)]
        for i in used:
            where = joint[i][at : at + CHUNK_CELLS].take(seen)
            if parent is None:
                place[:] = where
            else:
                np.multiply(parent, size[i], out=place)
                np.add(place, where, out=place)
            sums[i][0] += np.bincount(place, g, nodes * size[i])
            sums[i][1] += np.bincount(place, h, nodes * size[i])

    def empty(used: list[int]) -> list:
        return [np.zeros((2, nodes * k)) if i in used else None for i, k in enumerate(size)]

    chunks = range(0, len(n), CHUNK_CELLS)
    if level == 0:
        every = list(range(len(groups)))
        whole = empty(every)
        for at in chunks:
            rows = n[at : at + CHUNK_CELLS]
            count(whole, every, rows, at, np.arange(len(rows)), None)
    for k, (tree, columns, feature, bin_, right_child) in enumerate(grown):
        used = [i for i, g in enumerate(groups) if any(j in g for j in columns)]
        rows = drawn(n, params.row_rate, params.seed, tree, block, first)
        sums = empty(used)
        for at in chunks:
            part, parent = codes[:, at : at + CHUNK_CELLS], None
            left = rows[at : at + CHUNK_CELLS]
            if level == 0:  # the rows left out
                left = ~left if single else n[at : at + CHUNK_CELLS] - left
            some = left if single else left > 0
            if level == 0:
                seen = np.flatnonzero(some)
            else:
                node = nodes_at(part, feature, bin_, level - 1)
                if level - 1 < MASKED_LEVELS:
                    child = above_cut(part, feature, bin_, level - 1, node, NO_CUT, ~right_child)
                else:
                    place = node + (2 ** (level - 1) - 1)
                    child = ((nodes_at(part, feature, bin_, level) & 1) == right_child[place]) & (bin_[place] != NO_CUT)
                seen = np.flatnonzero(child & some)
                parent = node.take(seen).astype(np.int64)
            count(sums, used, left, at, seen, parent)
        for i in used:
            cube = (whole[i] - sums[i] if level == 0 else sums[i]).reshape(2, nodes, *[widths[j] for j in groups[i]])
            for axis, j in enumerate(groups[i]):
                c = np.flatnonzero(columns == j)
                if len(c):
                    others = tuple(2 + x for x in range(len(groups[i])) if x != axis)
                    out[k, :, :, c[0], : widths[j]] += cube.sum(axis=others) if others else cube


def histograms(state: DataFrame, parts: int, features: int, widths: Sequence[int], level: int, grown: list[tuple], params: BoostParams,
               above: np.ndarray | None = None) -> np.ndarray:
    """Sums of gradients and rows: (trees, 2, nodes of the level, columns, bins).

    ``grown`` has, for each tree of the batch, its number, its columns, its
    cuts so far (feature and bin of each node) and for each node whether its
    right child has fewer rows. Below the root only the smaller children are
    summed up: with ``above``, the level before, they give the others.
    ``widths`` has each feature's number of bins."""
    nodes = max(1, 2 ** level // 2)
    width = len(grown[0][1])
    shape = (len(grown), 2, nodes, width, max(widths))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, first = np.zeros(shape), None
        for block, codes, n, g in state_of(it, features):
            first = block if first is None else first
            mean_sums(out, block, codes, n, g, level, grown, widths, params)
        if first is not None:
            yield pa.RecordBatch.from_arrays([pa.array([first]), pa.array([out.tobytes()], type=pa.binary())], names=["block", "sums"])

    rows = state.mapInArrow(run, "block long, sums binary")
    while parts > MERGED:
        parts = -(-parts // MERGED)

        def add(table: pa.Table) -> pa.Table:
            order = np.argsort(table.column("block").to_numpy())
            sums = table.column("sums")
            total = sum(np.frombuffer(sums[int(i)].as_buffer()) for i in order)
            return pa.table({"block": [table.column("block")[int(order[0])].as_py()], "sums": pa.array([total.tobytes()], type=pa.binary())})

        rows = rows.groupBy(F.pmod(F.xxhash64("block"), F.lit(parts))).applyInArrow(add, "block long, sums binary")
    few = rows.toArrow()  # at most MERGED rows
    total = np.zeros(shape)
    for i in np.argsort(few.column("block").to_numpy()):
        total += np.frombuffer(few.column("sums")[int(i)].as_buffer()).reshape(shape)
    if above is None:
        return total
    both = np.empty((shape[0], 2, 2 * nodes, *shape[3:]))
    turned = np.stack([right_child[nodes - 1 : 2 * nodes - 1] for *_, right_child in grown])[:, None, :, None, None]
    both[:, :, 0::2], both[:, :, 1::2] = np.where(turned, above - total, total), np.where(turned, total, above - total)
    return both


def best_cuts(sums: np.ndarray, params: BoostParams) -> tuple[np.ndarray, ...]:
    """The best cut of each (tree, node): gain, column, bin, and the sums left
    and right of it. Ties go to the first column and the first bin. A cut has
    at least ``min_rows`` rows on both sides; a gain of 0 means there is none."""
    g, h = sums[:, 0].cumsum(axis=-1), sums[:, 1].cumsum(axis=-1)
    gt, ht = g[..., -1:], h[..., -1:]
    pen = params.leaf_penalty
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = g**2 / (h + pen) + (gt - g) ** 2 / (ht - h + pen) - gt**2 / (ht + pen)
    gain = np.where((h >= params.min_rows) & (ht - h >= params.min_rows), gain, 0.0)
    flat = gain.reshape(*gain.shape[:2], -1)
    best = flat.argmax(axis=-1)
    pick = lambda a: np.take_along_axis(np.broadcast_to(a, gain.shape).reshape(flat.shape), best[..., None], axis=-1)[..., 0]
    column, bin_ = np.divmod(best, gain.shape[-1])
    return np.maximum(pick(gain), 0.0), column, bin_, pick(g), pick(h), pick(gt - g), pick(ht - h)


def add_trees(state: DataFrame, features: int, depth: int, grown: list[tuple], leaves: np.ndarray) -> DataFrame:
    """The blocks with what a batch's trees add to their predictions."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, codes, n, g in state_of(it, features):
            g = g.copy()
            for at in range(0, len(n), CHUNK_CELLS):
                part = codes[:, at : at + CHUNK_CELLS]
                for (_, _, feature, bin_, _), leaf in zip(grown, leaves):
                    g[at : at + CHUNK_CELLS] += leaf.take(nodes_at(part, feature, bin_, depth))
            yield state_row(block, codes, n, g)

    return state.mapInArrow(run, STATE)


def fit(data: DataFrame, features: Sequence[str], label: str = "label", params: BoostParams = BoostParams()) -> Trees:
    """Boost regression trees on the rows of ``data`` (written or cheap to read
    twice). Rows without a label are left out; none at all is an error."""
    spark = data.sparkSession
    checkpoint_dir(spark)
    data = data.where(F.col(label).isNotNull() & ~F.isnan(F.col(label).cast("double")))
    most = data.agg(F.max(F.abs(F.col(label).cast("double")))).first()[0]
    if most is None:
        raise ValueError("no labelled rows to fit")
    unit = 2.0 ** (math.frexp(most or 1.0)[1] - 30)
    bins = min(params.max_bins, NO_CUT + 1)
    # a row per feature and key; the keys are bounded by KEY_BITS
    cuts = choose_cuts(value_histogram(data, features).toPandas(), len(features), bins)
    cells = materialize(cells_of(data, features, label, cuts, unit), "cells")
    size = cells.agg(F.count(F.lit(1)).alias("cells"), F.sum("n").alias("n"), F.sum("high").alias("high"), F.sum("low").alias("low")).first()
    base = (size["high"] * 32768 + size["low"]) * unit / size["n"]
    parts = max(-(-size["cells"] // BLOCK_CELLS), *[min(most, -(-size["cells"] // least)) for most, least in FEWER])
    widths = [len(c) + 1 for c in cuts]

    state = blocks_of(cells, parts, len(features), unit, base).persist(StorageLevel.MEMORY_AND_DISK)
    width = max(1, int(params.column_rate * len(features)))
    inner = 2 ** params.depth - 1
    out = Trees.empty(features, base, params.trees, params.depth)
    before = None
    # a batch's steps add up: beyond a whole step they would run past the labels
    batch = max(1, min(params.batch, int(1 / params.step)))
    for number, first in enumerate(range(0, params.trees, batch)):
        numbers = range(first, min(first + batch, params.trees))
        grown = []
        for t in numbers:
            columns = np.sort(np.random.default_rng([params.seed, t]).choice(len(features), width, replace=False))
            grown.append((t, columns, np.zeros(inner, np.int64), np.full(inner, NO_CUT), np.zeros(inner, bool)))
        value = np.zeros((len(grown), 2 * inner + 1))
        sums = None
        for level in range(params.depth):
            sums = histograms(state, parts, len(features), widths, level, grown, params, sums)
            if level == 0:
                if before is not None:  # the pass has read the new state
                    before.unpersist()
                g, h = sums[:, 0, 0, 0].sum(axis=-1), sums[:, 1, 0, 0].sum(axis=-1)
                value[:, 0] = -g / (h + params.leaf_penalty) * params.step
            gain, column, bin_, gl, hl, gr, hr = best_cuts(sums, params)
            for k, (t, columns, feature, cut_bin, right_child) in enumerate(grown):
                for i in range(2 ** level):
                    node = 2 ** level - 1 + i
                    if gain[k, i] > 0:
                        j = int(columns[column[k, i]])
                        feature[node], cut_bin[node], right_child[node] = j, bin_[k, i], hr[k, i] < hl[k, i]
                        out.feature[t, node], out.cut[t, node], out.gain[t, node] = j, cuts[j][bin_[k, i]], gain[k, i]
                        value[k, 2 * node + 1] = -gl[k, i] / (hl[k, i] + params.leaf_penalty) * params.step
                        value[k, 2 * node + 2] = -gr[k, i] / (hr[k, i] + params.leaf_penalty) * params.step
                    else:  # the branch ends: its value goes down the left
                        value[k, 2 * node + 1] = value[k, node]
        leaves = value[:, inner:]
        out.leaf[list(numbers)] = leaves
        if first + batch < params.trees:
            before, state = state, add_trees(state, len(features), params.depth, grown, leaves)
            if (number + 1) % CHECKPOINT_EVERY == 0:
                state = state.checkpoint(eager=True)
            state = state.persist(StorageLevel.MEMORY_AND_DISK)
    state.unpersist()
    return out


def split_gains(data: DataFrame, features: Sequence[str], label: str, cuts: Sequence[Sequence[float]], params: BoostParams = BoostParams()) -> DataFrame:
    """The best root cut of each feature among given cuts, on all rows: feature,
    cut, gain and the rows on either side. Features without a cut that leaves
    ``min_rows`` rows on both sides are left out."""
    spark, cuts = data.sparkSession, [np.array(c, dtype=np.float64) for c in cuts]
    data = data.where(F.col(label).isNotNull() & ~F.isnan(F.col(label).cast("double")))
    most = data.agg(F.max(F.abs(F.col(label).cast("double")))).first()[0] or 1.0
    unit = 2.0 ** (math.frexp(most)[1] - 30)
    cells = materialize(cells_of(data, features, label, cuts, unit), "cells")
    size = cells.agg(F.count(F.lit(1)).alias("cells"), F.sum("n").alias("n"), F.sum("high").alias("high"), F.sum("low").alias("low")).first()
    base = (size["high"] * 32768 + size["low"]) * unit / size["n"] if size["n"] else 0.0
    parts = max(1, -(-size["cells"] // BLOCK_CELLS))
    rows = []
    every = BoostParams(row_rate=1.0, min_rows=params.min_rows, leaf_penalty=params.leaf_penalty, seed=params.seed)
    widths = [len(c) + 1 for c in cuts]
    for j, name in enumerate(features):
        grown = [(0, np.array([j]), np.zeros(1, np.int64), np.full(1, NO_CUT), np.zeros(1, bool))]
        sums = histograms(blocks_of(cells, parts, len(features), unit, base), parts, len(features), widths, 0, grown, every)
        gain, _, bin_, _, left, _, right = (a[0, 0] for a in best_cuts(sums, every))
        if gain > 0:
            rows.append((name, float(cuts[j][bin_]), float(gain), int(left), int(right)))
    return spark.createDataFrame(rows, "feature string, cut double, gain double, rows_left long, rows_right long")
