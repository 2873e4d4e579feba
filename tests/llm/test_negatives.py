import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from revlens.llm import negatives, queries

SCHEMA = "vec_id long, embedding array<float>, label int, page string, `rank` string, id string, score string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, label, "x", "x", "x", "x") for i, v, label in rows], SCHEMA)


def brute(rows, anchor, positives=5, keep=5, least=80):
    """All rows against all anchors, in Python's whole numbers."""
    ok = [(i, [max(-(2**31), min(2**31 - 1, math.floor(256 * float(np.float32(x))))) for x in v], label) for i, v, label in rows
          if label is not None and v is not None and all(x is not None and math.isfinite(np.float32(x)) for x in v)]
    out = []
    order = lambda s: (-s[0], s[1] is None, s[1])
    for n, (i, v, label) in enumerate(ok):
        if i is None or not anchor(i):
            continue
        scores = [(sum(a * b for a, b in zip(v, w, strict=True)), j, m, other) for m, (j, w, other) in enumerate(ok) if m != n and len(w) == len(v)]
        for ps, p, _, _ in sorted((s for s in scores if s[3] == label), key=order)[:positives]:
            fit = sorted((s for s in scores if s[3] != label and least * ps <= 100 * s[0] <= 100 * ps), key=order)[:keep]
            out.extend((i, p, r, s[1], ps, s[0]) for r, s in enumerate(fit, 1))
    return out


def moved(rows):
    return [(i, v, (label + 1) % 10 if label is not None and i % 7 == 0 else label) for i, v, label in rows]


def test_query_matches_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    got = sorted(tuple(r) for r in queries.op12_hilbert_negatives(spark, sf_dir).collect())
    assert got and got == sorted(brute(moved(rows), lambda i: i % 100 == 0))


def planted(seed, n=600, dims=12):
    """Clusters of several labels, copies, scaled copies and ties."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(8, dims))
    out = []
    for i in range(n):
        kind = rng.random()
        if i > 20 and kind < 0.3:
            v = out[rng.integers(0, len(out))][1]
        else:
            v = np.round(centres[rng.integers(0, 8)] + 0.2 * rng.normal(size=dims), 2)
        out.append((i, [float(np.float32(x)) for x in v], int(rng.choice([0, 0, 0, 1, 2]))))
    return out


@pytest.mark.parametrize("block_rows", [8, 256])
def test_clusters_and_ties(spark, block_rows, monkeypatch):
    monkeypatch.setattr(negatives, "LEAST_PAGES", 7)
    rows = planted(3)
    got = sorted(tuple(r) for r in negatives.mine(frame(spark, rows), F.col("vec_id") % 9 == 0, block_rows=block_rows).collect())
    assert len(got) > 500 and got == sorted(brute(rows, lambda i: i % 9 == 0))
    got = sorted(tuple(r) for r in negatives.mine(frame(spark, rows), F.col("vec_id") % 50 == 0, positives=2, negatives=30, least_pct=10, block_rows=block_rows).collect())
    assert got == sorted(brute(rows, lambda i: i % 50 == 0, 2, 30, 10))


def test_awkward_rows(spark):
    v = [1.0, 2.0, 3.0]
    nan, inf = float("nan"), float("inf")
    rows = [(1, v, 1), (2, v, 1), (2, v, 1), (3, [1.0, 2.0, 2.9], 2), (4, v, 2), (5, v, None), (6, None, 1), (7, [0.0, 0.0, 0.0], 1), (8, [1.0, None, 3.0], 1), (9, [1.0, nan, 3.0], 2),
            (10, [1.0, inf, 3.0], 2), (11, [], 1), (12, [1.0, 2.0], 1), (13, [-1.0, -2.0, -3.0], 1), (14, [0.0, 0.0, -0.0], 2), (15, [], 2), (16, [1.0, 2.0], 3), (None, v, 2), (17, v, 1), (18, [], 1),
            (19, [1e30, 1e30, -1e30], 4), (20, [1e30, 1e30, -1e30], 4), (21, [3e29, 1e30, -1e30], 5), (22, [5e6, 1.0, 0.0], 4), (23, [4.9e6, 1.0, 0.0], 5), (24, [5e6, 0.5, 0.0], 5)]
    got = [tuple(r) for r in negatives.mine(frame(spark, rows), F.col("vec_id") > 0).collect()]
    want = brute(rows, lambda i: i > 0)
    big = lambda r: abs(r[4]) >= 2**62 or abs(r[5]) >= 2**62  # noqa: E731 - held to 62 bits
    assert sorted((r for r in got if r[0] not in (19, 20, 21)), key=repr) == sorted((r for r in want if r[0] not in (19, 20, 21) and not big(r)), key=repr)
    assert any(r[3] is None for r in got) and any(r[0] in (11, 18) for r in got)
    assert negatives.mine(frame(spark, rows), F.col("vec_id") > 100).count() == 0
    assert negatives.mine(frame(spark, []), F.col("vec_id") > 0).count() == 0
    assert negatives.mine(frame(spark, [(None, v, 1), (None, v, 2)]), F.col("vec_id") > 0).count() == 0


@pytest.mark.parametrize("dims, bits", [(1, 5), (2, 4), (3, 3), (4, 2), (5, 1)])
def test_the_curve_takes_single_steps(dims, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)), dtype=np.uint32)
    keys = [k.tobytes() for k in negatives.hilbert_keys(cells, bits)]
    assert len(set(keys)) == len(cells)
    walk = cells[np.argsort(np.array(keys, dtype=object))].astype(int)
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_bounds_hold_and_skip():
    rng = np.random.default_rng(0)
    a, rows = rng.integers(-50, 50, (9, 6)).astype(np.int32), rng.integers(-50, 50, (4, 30, 6)).astype(np.int32)
    least, most = negatives.bounds(a, rows.min(axis=1), rows.max(axis=1))
    s = np.einsum("ad,brd->abr", a, rows)
    assert (least <= s.min(axis=2)).all() and (s.max(axis=2) <= most).all()
    # clusters far from the anchor's window aren't read
    low, high = negatives.bounds(np.array([[100, 0]], dtype=np.int32), np.array([[90, -5], [-99, -5]], dtype=np.int32), np.array([[99, 5], [-90, 5]], dtype=np.int32))
    need = negatives.needed(np.array([1]), np.array([2, 2]), low, high, np.array([[8_000]]), np.array([[9_500]]), False)
    assert need.tolist() == [[True, False]]
    huge = np.full((1, 3), 2**31 - 1, dtype=np.int32)
    assert negatives.products(huge, huge)[0, 0] == 2**62 - 1 and negatives.bounds(huge, -huge, huge)[0][0, 0] == 1 - 2**62
