import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from revlens.operators import boosting as B

NAMES = ("a", "b", "c", "d")


def frame(spark, n=3000, seed=0):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.normal(size=n).round(2), rng.integers(0, 5, n), rng.lognormal(0, 2, n), rng.integers(0, 2, n)]).astype(float)
    x[rng.random(n) < 0.3, 1] = 2  # a hot value
    y = np.where(x[:, 0] > 0.3, 1.0, -1.0) * (x[:, 1] == 2) + 0.2 * np.log(x[:, 2]) + 0.05 * rng.normal(size=n)
    pdf = pd.DataFrame(x, columns=list(NAMES)).assign(label=y)
    return pdf, spark.createDataFrame(pdf)


def brute_tree(x, g, h, params, level=0):
    """One tree by trying every cut between values, in nested tuples of (column, cut)."""
    value = -g.sum() / (h.sum() + params.leaf_penalty) * params.step
    best = (1e-9, None)
    for j in range(x.shape[1]) if level < params.depth else ():
        v = np.unique(x[:, j])
        for c in (v[1:] + v[:-1]) / 2:
            left = x[:, j] <= c
            if left.sum() >= params.min_rows and (~left).sum() >= params.min_rows:
                score = lambda m: g[m].sum() ** 2 / (h[m].sum() + params.leaf_penalty)
                gain = score(left) + score(~left) - score(np.ones(len(g), bool))
                if gain > best[0] + 1e-9:
                    best = (gain, (j, c, left))
    if best[1] is None:
        return value
    j, c, left = best[1]
    return (NAMES[j], c, brute_tree(x[left], g[left], h[left], params, level + 1), brute_tree(x[~left], g[~left], h[~left], params, level + 1))


def test_first_trees_match_every_cut_tried(spark):
    pdf, _ = frame(spark, 400)
    pdf["a"], pdf["c"] = pdf["a"].round(1), np.log(pdf["c"]).round(0)
    params = B.BoostParams(trees=3, step=0.3, depth=3, row_rate=1.0, column_rate=1.0, max_bins=200, batch=1)
    got = B.fit(spark.createDataFrame(pdf).repartition(5), NAMES, "label", params)
    x, y = pdf[list(NAMES)].to_numpy(), pdf["label"].to_numpy()
    f = np.full(len(y), y.mean())
    for n in range(3):
        tree = B.Trees.of(NAMES, 0.0, [brute_tree(x, f - y, np.ones(len(y)), params)])
        f = f + tree.predict(x)
        mine = B.Trees(NAMES, 0.0, got.feature[n : n + 1], got.cut[n : n + 1], got.leaf[n : n + 1], got.gain[n : n + 1])
        assert np.allclose(mine.predict(x), tree.predict(x), atol=1e-6)


def test_fit_learns_and_follows_the_rows_only(spark):
    pdf, df = frame(spark)
    params = B.BoostParams(trees=45, step=0.1, depth=4, batch=15, max_bins=32)
    one, two = B.fit(df, NAMES, "label", params), B.fit(df.repartition(7), NAMES, "label", params)
    assert (one.cut == two.cut).all() and (one.leaf == two.leaf).all() and one.importances() == two.importances()
    y, p = pdf["label"].to_numpy(), one.predict(pdf[list(NAMES)].to_numpy())
    assert 1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum() > 0.95
    assert {n for n, v in one.importances() if v > 0.05} >= {"a", "b"} and abs(sum(v for _, v in one.importances()) - 1) < 1e-9
    got = one.transform(df).toPandas()["prediction"].to_numpy()
    assert np.allclose(got, p)


def test_many_blocks_and_merged_histograms(spark, monkeypatch):
    _, df = frame(spark)
    params = B.BoostParams(trees=4, depth=3, row_rate=1.0, batch=2, max_bins=16)
    whole = B.fit(df, NAMES, "label", params)
    monkeypatch.setattr(B, "BLOCK_CELLS", 100)
    monkeypatch.setattr(B, "MERGED", 3)
    parts = B.fit(df, NAMES, "label", params)
    assert (whole.cut == parts.cut).all() and np.allclose(whole.leaf, parts.leaf, atol=1e-12)


def test_equal_rows_are_cells(spark):
    """Copies weigh as rows: a table repeated is the same fit as sums and counts doubled."""
    pdf, _ = frame(spark, 500)
    params = B.BoostParams(trees=2, depth=2, row_rate=1.0, column_rate=1.0, leaf_penalty=0.0, min_rows=20, batch=1)
    twice = B.fit(spark.createDataFrame(pd.concat([pdf, pdf])), NAMES, "label", params)
    once = B.fit(spark.createDataFrame(pdf), NAMES, "label", B.BoostParams(**{**params.__dict__, "min_rows": 10}))
    assert (once.cut == twice.cut).all() and np.allclose(once.leaf, twice.leaf)


def test_awkward_labels_and_features(spark):
    df = spark.createDataFrame([(None, 1.0, 1.0), (float("nan"), 2.0, 1.0), (5.0, None, 2.0), (6.0, 1.0, None), (7.0, 1.0, float("nan"))] * 20, "a double, b double, label double")
    t = B.fit(df, ("a", "b"), "label", B.BoostParams(trees=30, step=0.5, min_rows=5, row_rate=1.0, column_rate=1.0))
    rows = {r["a"]: r["prediction"] for r in t.transform(df.where("label is not null and not isnan(label)").distinct().na.fill(-1.0, ["a"])).collect()}
    assert abs(rows[5.0] - 2.0) < 0.05
    with pytest.raises(ValueError):
        B.fit(df.where("a = 6.0"), ("a", "b"), "label")
    flat = B.fit(spark.createDataFrame([(1.0, 3.0)] * 30, "a double, label double"), ("a",), "label", B.BoostParams(trees=2))
    assert flat.predict(np.array([[9.0]]))[0] == pytest.approx(3.0) and flat.importances() == [("a", 0.0)]


TREES = B.Trees.of(NAMES, 0.5, [("a", 0.0, ("b", 1.5, 1.0, ("c", 2.0, 2.0, 3.0)), -1.0), ("c", 5.0, ("d", 0.5, 0.1, ("c", 1.0, 0.2, 0.3)), ("b", 2.5, 0.4, ("c", 7.5, 0.5, 0.6))), 0.25])


def test_trees_as_tables(spark):
    again = B.Trees.from_table(TREES.to_table(spark), NAMES)
    x = np.random.default_rng(1).normal(2, 3, (200, 4))
    assert (again.predict(x) == TREES.predict(x)).all() and again.base == 0.5
    assert TREES.predict(np.array([[-1.0, 2.0, 3.0, 1.0], [1.0, 9.0, 8.0, 0.0]])).tolist() == [0.5 + 3.0 + 0.3 + 0.25, 0.5 - 1.0 + 0.6 + 0.25]


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10_000))
def test_steps_equal_separate_predictions(seed):
    rng = np.random.default_rng(seed)
    grid = np.round(np.arange(81) * 0.1, 2)
    x = rng.normal(1, 2, (30, 4))
    scale = np.abs(rng.normal(0, 2, 30)) * (rng.random(30) < 0.9)
    along = grid[None, :] * scale[:, None]
    got = TREES.steps(x, grid, {"c": along, "d": (grid > 3).astype(float)})
    for i, d in enumerate(grid):
        full = x.copy()
        full[:, 2], full[:, 3] = along[:, i], float(d > 3)
        assert np.allclose(got[:, i], TREES.predict(full), atol=1e-12)


@pytest.mark.parametrize("places", [1 << 16, 30, 1])
def test_steps_look_trees_up_where_tables_are_small(places, monkeypatch):
    rng = np.random.default_rng(places)
    trees = B.Trees.empty(NAMES, 0.25, 20, 5)
    trees.feature[:] = rng.integers(0, 4, trees.feature.shape)
    trees.cut[:] = np.where(rng.random(trees.cut.shape) < 0.9, np.round(rng.normal(2, 2, trees.cut.shape), 1), np.inf)
    trees.leaf[:] = rng.normal(size=trees.leaf.shape)
    for i in range(trees.cut.shape[1] // 2):  # a branch that ends has no cuts below
        for child in (2 * i + 1, 2 * i + 2):
            trees.cut[:, child] = np.where(trees.cut[:, i] == np.inf, np.inf, trees.cut[:, child])
    monkeypatch.setattr(B, "STEP_PLACES", places)
    monkeypatch.setattr(B, "STEP_SUMS", 1)  # more than one chunk of rows
    walked, walk = [], B.Trees._walk
    monkeypatch.setattr(B.Trees, "_walk", lambda self, x, grid, number, which: walked.append(len(which)) or walk(self, x, grid, number, which))
    x, grid = rng.normal(1, 2, (600, 4)), np.round(np.arange(41) * 0.2, 2)
    x[rng.random(x.shape) < 0.05] = np.nan
    along = grid * np.abs(rng.normal(0, 2, 600))[:, None]
    got = trees.steps(x, grid, {"c": along, "d": (grid > 3).astype(float)})
    assert not walked if places > 30 else 0 < max(walked) <= 20
    for i, d in enumerate(grid):
        full = x.copy()
        full[:, 2], full[:, 3] = along[:, i], float(d > 3)
        assert np.allclose(got[:, i], trees.predict(full), atol=1e-12)


def test_value_keys_follow_the_values():
    rng = np.random.default_rng(2)
    x = np.sort(np.concatenate([rng.normal(size=500), rng.lognormal(0, 20, 500), -rng.lognormal(0, 20, 500), [0.0, -0.0, 1e-308, -1e-308]]))
    assert (np.diff(B.value_keys(x)) >= 0).all()


def test_draws_follow_the_rows_of_a_cell():
    n = np.repeat([1.0, 2.0, 6.0, 60.0, 5000.0], [40_000, 40_000, 40_000, 40_000, 300])
    rows = B.drawn(n, 0.8, 42, 3, 7)
    for k in np.unique(n):
        got = rows[n == k] / k
        assert abs(got.mean() - 0.8) < 0.01 and abs(got.var() * k - 0.16) < 0.02 and got.max() <= 1
    assert (B.drawn(n, 1.0, 42, 3, 7) == n).all() and B.drawn(n[:9], 0.8, 1, 2, 3).dtype == bool
    assert (B.drawn(n, 0.8, 42, 3, 7) == rows).all() and (B.drawn(n, 0.8, 42, 4, 7) != rows).any()


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 10_000), st.booleans(), st.integers(1, 8))
def test_block_sums_are_the_sums_of_each_node(seed, single, depth):
    """Joint columns, left-out rows and smaller children against a sum over the cells themselves."""
    rng = np.random.default_rng(seed)
    widths, cells, inner = [40, 3, 7, 60, 1], 400, 2**depth - 1
    codes = np.stack([rng.integers(0, w, cells) for w in widths]).astype(np.uint8)
    n = np.ones(cells) if single else np.sort(rng.integers(1, 5, cells)).astype(float)
    s, f = rng.normal(size=cells), rng.normal(size=cells)
    columns = np.sort(rng.choice(5, 3, replace=False))
    feature = rng.choice(columns, inner)
    bin_ = np.array([rng.integers(0, widths[j]) if rng.random() < 0.9 else B.NO_CUT for j in feature])
    side = rng.random(inner) < 0.5
    params = B.BoostParams()
    rows = B.drawn(n, params.row_rate, params.seed, 4, 9).astype(float)
    node = np.zeros(cells, int)
    for level in range(depth):
        if level:
            at = node + 2 ** (level - 1) - 1
            right = (bin_[at] != B.NO_CUT) & (codes[feature[at], np.arange(cells)] > bin_[at])
            counted, place = (right == side[at]) & (bin_[at] != B.NO_CUT), node
            node = 2 * node + right
        else:
            counted, place = np.ones(cells, bool), node
        assert (B.nodes_at(codes, feature, bin_, level) == node).all()
        got = np.zeros((1, 2, max(1, 2**level // 2), 3, 60))
        B.block_sums(got, 9, codes, n, s, f, level, [(4, columns, feature, bin_, side)], widths, params)
        want = np.zeros_like(got)
        for c, j in enumerate(columns):
            np.add.at(want[0, 0, :, c], (place[counted], codes[j][counted]), ((n * f - s) / n * rows)[counted])
            np.add.at(want[0, 1, :, c], (place[counted], codes[j][counted]), rows[counted])
        assert np.allclose(got, want, atol=1e-9)


@pytest.mark.parametrize("x", [[3.0, 0.0, 3.0, 4095.0, 2049.0, 2050.0], [0.5, 1.0, 0.25], [-1.0, 2.0, 2.0], [-0.0, 0.0, 7.0], [4096.0, 1.0], [np.inf, 1.0, -np.inf]])
def test_keys_are_counted_as_by_sorting(x):
    x = np.array(x)
    y = np.sort(x)
    key, at, n = np.unique(B.value_keys(y), return_index=True, return_counts=True)
    for got, want in zip(B.key_counts(x), (key, n, y[at], y[at + n - 1])):
        assert np.array_equal(got, want)


def test_a_block_has_17_bytes_a_cell(spark):
    rng = np.random.default_rng(5)
    n = np.sort(rng.integers(1, 9, 10_000)).astype(float)
    codes, g = rng.integers(0, 64, (9, len(n))).astype(np.uint8), rng.normal(size=len(n))
    row = B.state_row(7, codes, n, g)
    ((block, codes2, n2, g2),) = B.state_of(iter([row]), 9)
    assert block == 7 and np.array_equal(codes, codes2) and np.array_equal(n, n2) and np.array_equal(g, g2)
    assert sum(len(row.column(c)[0].as_py()) for c in ("codes", "n", "g")) <= 17 * len(n) + 200


def some_trees(rng, trees, depth, features=4):
    """Trees with branches that end early and cuts that several trees share."""
    out = B.Trees.empty([f"f{j}" for j in range(features)], 0.25, trees, depth)
    out.feature[:] = rng.integers(0, features, out.feature.shape)
    out.cut[:] = rng.integers(0, 8, out.cut.shape) + 0.5
    for n in range(trees):
        for i in range(out.cut.shape[1]):
            if rng.random() < 0.2 or (i and out.cut[n, (i - 1) // 2] == np.inf):
                out.cut[n, i] = np.inf
    out.leaf[:] = rng.normal(size=out.leaf.shape)
    return out


@pytest.mark.parametrize("depth", [1, 2, 5, 6, 7])
@pytest.mark.parametrize("rows", [1, 64, 301])
def test_predictions_follow_each_tree_down(monkeypatch, depth, rows):
    monkeypatch.setattr(B, "PREDICTED_ROWS", 128)
    rng = np.random.default_rng(depth * 1000 + rows)
    trees = some_trees(rng, 7, depth)
    x = rng.integers(-1, 10, (rows, 4)) / 1.0
    x[rng.random(x.shape) < 0.1] = np.nan
    want = np.full(rows, 0.25)
    for r in range(rows):
        for feature, cut, leaf in zip(trees.feature, trees.cut, trees.leaf):
            node = 0
            while node < len(cut):
                node = 2 * node + (2 if x[r, feature[node]] > cut[node] else 1)
            want[r] += leaf[node - len(cut)]
    assert (trees.predict(x) == want).all()


def test_arrow_batches_are_predicted_together(spark):
    """As many rows at once as ``PREDICTED_ROWS``, not as Arrow's batches have."""
    trees = some_trees(np.random.default_rng(3), 5, 3, features=1)
    df = spark.range(0, 30_000, 1, 1).withColumn("f0", (F.col("id") % 11).cast("double"))
    got = trees.transform(df, lambda p: p + 1000.0 * len(p)).orderBy("id").toPandas()
    want = trees.predict(got[["f0"]].to_numpy()) + 1000.0 * 30_000
    assert (got["prediction"].to_numpy() == want).all()
