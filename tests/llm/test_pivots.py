import itertools
import math

import numpy as np

from revlens.llm import pivots, queries
from tests.llm.test_simhash import brute_components


def brute(rows, cosine=0.93):
    ok = {}
    for n, (i, v, label) in enumerate(rows):
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            continue
        x = np.array(v, dtype=np.float64)
        ok[n] = (label, x / np.linalg.norm(x))
    links = [(a, b) for a, b in itertools.combinations(ok, 2) if ok[a][0] == ok[b][0] and len(ok[a][1]) == len(ok[b][1]) and ok[a][1] @ ok[b][1] >= cosine]
    comp = brute_components(range(len(rows)), links)
    least, degree = {}, np.zeros(len(rows), dtype=int)
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    for n, r in enumerate(rows):
        if r[0] is not None:
            least[comp[n]] = min(least.get(comp[n], r[0]), r[0])
    return links, [(r[0], int(degree[n]), least.get(comp[n]), None if r[0] is None else r[0] == least[comp[n]]) for n, r in enumerate(rows)]


def planted(seed, n=500, dims=32, angle=(0.0, 0.45)):
    """Vectors with copies, scaled copies and turned ones around the threshold."""
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        if i > 20 and rng.random() < 0.5:
            _, v, label = out[rng.integers(0, len(out))]
            v = np.array(v)
            z = rng.normal(size=dims)
            z -= (z @ v) / (v @ v) * v
            t = rng.uniform(*angle)
            v = v if rng.random() < 0.3 else np.cos(t) * v + np.sin(t) * z / np.linalg.norm(z) * np.linalg.norm(v)
        else:
            v, label = rng.normal(size=dims), int(rng.choice([0, 0, 0, 1, 2]))
        out.append((i, [float(np.float32(x)) for x in v], label))
    return out


SCHEMA = "vec_id long, embedding array<float>, label int, entry string, block string"


def test_query_matches_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    got = sorted(tuple(r) for r in queries.op2_pivot_near_dedup(spark, sf_dir).collect())
    assert got == sorted(brute(rows)[1])


def test_recall_and_precision(spark):
    rows = planted(1)
    links, want = brute(rows)
    for list_rows in (pivots.LIST_ROWS, 8):
        got = sorted(tuple(r) for r in pivots.near_duplicates(spark.createDataFrame([(*r, "x", "x") for r in rows], SCHEMA), list_rows=list_rows).collect())
        found = sum(r[1] for r in got) / 2
        assert len(links) > 100 and 0.97 * len(links) <= found <= len(links)
        assert sum(a == b for a, b in zip(got, sorted(want), strict=True)) > 0.95 * len(rows)


def test_every_pair_counts_in_one_list():
    rng = np.random.default_rng(2)
    unit = rng.normal(size=(40, 8))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    near = [rng.permutation(10)[:4].astype(np.int32) for _ in range(40)]
    seen = np.zeros((40, 40), dtype=int)
    for p in range(10):
        at = np.array([i for i in range(40) if p in near[i]])
        seen[np.ix_(at, at)] += pivots.compare_list(p, [near[i] for i in at], unit[at], None, 2, 0.2)
    want = (unit @ unit.T >= 0.2) & np.array([[len(set(a) & set(b)) >= 2 for b in near] for a in near])
    np.fill_diagonal(want, False)
    assert (seen == want).all()


def test_awkward_rows(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v, 1), (2, v, 1), (2, v, 1), (3, [2.0, 4.0, 6.0], 1), (4, v, 2), (5, v, None), (6, None, 1), (7, [0.0, 0.0, 0.0], 1), (8, [1.0, None, 3.0], 1),
            (9, [1.0, float("nan"), 3.0], 1), (10, [1.0, float("inf"), 3.0], 1), (11, [], 1), (12, [1.0, 2.0], 1), (13, [-1.0, -2.0, -3.0], 1), (14, [0.0, 0.0, -0.0], 1)]
    frame = spark.createDataFrame([(*r, "x", "x") for r in rows], SCHEMA)
    got = sorted((tuple(r) for r in pivots.near_duplicates(frame).collect()), key=repr)
    assert got == sorted(brute(rows)[1], key=repr)
    assert pivots.near_duplicates(frame.limit(0)).count() == 0
    assert pivots.near_duplicates(spark.createDataFrame([(None, v, 1, "", "")], SCHEMA)).collect()[0][1:] == (0, None, None)


def test_very_large_and_very_small_components(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(3, 8))
    rows = [(3 * k + n, [float(x * scale) for x in v], 0) for k, scale in enumerate((1.0, 1e200, 1e-200, 1e307, 1e-310)) for n, v in enumerate(base)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in pivots.near_duplicates(frame).collect()}
    assert got == {i: (4, i % 3) for i, _, _ in rows}
    v = rng.normal(size=(50, 8))
    assert (pivots.units(v) == v / np.linalg.norm(v, axis=1, keepdims=True)).mean() > 0.9 and np.allclose(pivots.units(v), v / np.linalg.norm(v, axis=1, keepdims=True), rtol=1e-15)
