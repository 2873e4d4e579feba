import numpy as np
import pandas as pd

from revlens.operators.quantiles import group_quantile
from revlens.operators.sequence import with_row_number


def test_group_quantile_matches_pandas_on_skewed_keys(spark):
    rng = np.random.default_rng(7)
    pdf = pd.DataFrame({"k": rng.choice(["hot", "b", "c"], 4001, p=[0.8, 0.15, 0.05]),
                        "v": rng.normal(size=4001).round(3)})
    df = spark.createDataFrame(pdf).repartition(9)
    for q in (0.5, 0.25, 0.9):
        got = group_quantile(df, ["k"], "v", q=q).toPandas().set_index("k")["median"].sort_index()
        exp = pdf.groupby("k")["v"].quantile(q).sort_index()
        assert np.allclose(got.values, exp.values, atol=1e-12)
    g = group_quantile(df, [], "v").first()[0]
    assert abs(g - pdf.v.median()) < 1e-12


def test_group_quantile_narrows_its_brackets(spark):
    """Small limits force the passes; ties, outliers, nulls and one-row groups."""
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({"k": rng.choice(["hot", "b", None], 6000, p=[0.7, 0.2, 0.1]),
                        "v": np.where(rng.random(6000) < 0.3, 7.0, rng.lognormal(0, 4, 6000))})
    pdf.loc[0, "v"] = 1e300
    pdf = pd.concat([pdf, pd.DataFrame({"k": ["one", "none"], "v": [3.5, None]})])
    df = spark.createDataFrame(pdf.replace({np.nan: None}), "k string, v double").repartition(5)
    for q in (0.5, 0.01, 0.99):
        got = {r["k"]: r["m"] for r in group_quantile(df, ["k"], "v", q=q, out="m", few_rows=20).collect()}
        exp = pdf.dropna(subset="v").groupby("k", dropna=False)["v"].quantile(q)
        assert set(got) == {"hot", "b", "one", None}
        for k, v in exp.items():
            mine = got[None if pd.isna(k) else k]
            assert mine == v or abs(mine - v) <= 1e-9 * abs(v)


def test_one_page_needs_no_numbering(spark):
    from revlens.operators.explore import page
    df = spark.createDataFrame([(i % 10, f"x{i:03d}") for i in range(101)], "a int, b string").repartition(4)
    every = {(r.a, r.b): (r.row_number, r.page) for r in page(df, ["a", "b"], None, 8).collect()}
    for number, want in ((1, 1), (0, 1), (7, 7), (12, 12), (13, 13), (99, 13)):
        rows = page(df, ["a", "b"], number, 8).collect()
        assert {r.page for r in rows} == {want} and {r.total_pages for r in rows} == {13}
        assert {(r.a, r.b): (r.row_number, r.page) for r in rows} == {k: v for k, v in every.items() if v[1] == want}
    assert page(df.limit(0), ["a", "b"], 3, 8).count() == 0


def test_row_number_is_dense_and_ordered(spark):
    pdf = pd.DataFrame({"a": np.arange(1000) % 7, "b": np.arange(1000)[::-1]})
    df = spark.createDataFrame(pdf).repartition(5)
    out = with_row_number(df, ["a", "b"]).toPandas().sort_values("row_number")
    assert list(out.row_number) == list(range(1, 1001))
    exp = pdf.sort_values(["a", "b"]).reset_index(drop=True)
    assert (out[["a", "b"]].reset_index(drop=True) == exp).all().all()


def test_pages_by_rank_selection(spark, monkeypatch):
    """Fences, hot keys, nulls and few different keys, against a full sort."""
    from revlens.operators import explore as EX
    rng = np.random.default_rng(3)
    n = 5000
    a = rng.choice(np.array(["x", "y", "z", None, "w"], dtype=object), n, p=[0.5, 0.2, 0.1, 0.1, 0.1])
    b = rng.integers(0, 400, n)
    many = pd.DataFrame({"a": a, "b": b, "c": rng.permutation(n)})
    few = many.assign(b=many["b"] % 2, c=0)
    one = many.assign(a="x", b=1, c=2)
    monkeypatch.setattr(EX, "SAMPLED", 300)
    monkeypatch.setattr(EX, "FENCED", 50)
    for pdf in (many, few, one):
        df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "a string, b int, c int").repartition(6)
        keys = sorted(((r.a is not None, r.a or "", r.b, r.c) for r in df.collect()))
        for skip, rows in ((0, 7), (2500, 12), (4990, 10), (1, 1), (3333, 40), (4999, 1)):
            got = EX.rows_between_ranks(df, ["a", "b", "c"], skip, rows)
            assert sorted((r.a is not None, r.a or "", r.b, r.c) for r in got.collect()) == keys[skip : skip + rows]
    assert EX.rows_between_ranks(df, ["a"], 10, 0).count() == 0
    plan = EX.rows_between_ranks(spark.createDataFrame(many.drop(columns="a")), ["b", "c"], 2500, 12)._jdf.queryExecution().toString()
    limits = [int(x) for x in __import__("re").findall(r"limit=(\d+)", plan)]
    assert all(x <= 50 for x in limits)


def test_file_rows_are_numbered_by_scan_split(spark, tmp_path):
    from pyspark.sql import functions as F
    for k, rows in enumerate((700, 1, 300, 0)):
        (tmp_path / f"{k}.csv").write_text("v,w\n" + "".join(f"{k}-{i},{'x' * (i % 50)}\n" for i in range(rows)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        raw = spark.read.option("header", True).csv(str(tmp_path))
        out = with_row_number(raw.where(F.col("v") != "0-5"), name="n")
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "RDD" not in plan and "Sort" not in plan
        got = {r["n"]: r["v"] for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    want = [f"{k}-{i}" for k, rows in enumerate((700, 1, 300, 0)) for i in range(rows) if (k, i) != (0, 5)]
    assert [got[i] for i in range(1, len(got) + 1)] == want
