import pytest
from pyspark.sql import functions as F

from revlens.functions import expressions as X
from revlens.operators import alerts as AL
from revlens.operators import context as CX
from revlens.operators import margin as MG
from revlens.operators import personas as PS


def test_ceiling_takes_largest_passing_discount_not_first_failure(spark):
    # non-monotone predictions: passes at 0.00-0.02, fails at 0.03, passes at 0.05
    preds = [(0.0, 0.2), (0.01, 0.1), (0.02, 0.06), (0.03, 0.01), (0.04, 0.02), (0.05, 0.07), (0.06, 0.0)]
    scored = spark.createDataFrame([("S", "R", d, p) for d, p in preds],
                                   "segment string, region string, discount double, prediction double")
    got = (scored.groupBy("segment", "region")
                 .agg(F.round(F.coalesce(F.max(F.when(F.col("prediction") > 0.05, F.col("discount"))),
                                         F.lit(0.0)), 2).alias("c")).first().c)
    assert got == 0.05


def test_encode_unknown_is_minus_one_only_for_unknown(spark):
    tx = spark.createDataFrame([("a", "x", "i", "p"), ("b", "y", "j", "q")],
                               "segment string, region string, industry string, product string")
    enc = MG.fit_encoders(tx)
    codes = {(r.column, r.value): r.code for r in enc.collect()}
    assert codes[("segment", "a")] == 0 and codes[("segment", "b")] == 1
    deals = spark.createDataFrame([("b", "zzz", "i", "p")], "segment string, region string, industry string, "
                                                            "product string")
    r = MG.encode(deals, enc).first()
    assert (r.segment_enc, r.region_enc, r.industry_enc, r.product_enc) == (1, -1, 0, 0)
    assert len(r.warnings) == 1 and "zzz" in r.warnings[0]


def test_too_few_rows_for_margin_model(spark):
    tx = spark.createDataFrame([("S", "R", "I", "P", 1.0, 10.0, 0.1, 0.2)] * 99,
                               "segment string, region string, industry string, product string, quantity double, "
                               "sales double, discount double, margin_rate double")
    with pytest.raises(MG.MarginModelError):
        MG.train_margin_model(tx, MG.MarginParams(max_iter=2))


def test_persona_precedence_volume_over_seekers_over_champions(spark):
    # cluster 0 has the highest margin AND highest sales -> Volume wins
    stats = spark.createDataFrame([(0, 900.0, 0.30, 0.10, 5), (1, 100.0, 0.10, 0.40, 5), (2, 50.0, 0.2, 0.2, 5),
                                   (3, 20.0, 0.05, 0.05, 5)],
                                  "cluster int, avg_sales double, avg_margin double, avg_discount double, "
                                  "n_customers long")
    named = {r.cluster: r.persona for r in PS.name_personas(stats).collect()}
    assert named == {0: "Volume Accounts", 1: "Discount Seekers", 2: "At-Risk", 3: "At-Risk"}


def test_too_few_customers(spark):
    tx = spark.createDataFrame([(f"c{i}", 10.0, 0.1, 0.2) for i in range(19)],
                               "customer string, sales double, discount double, margin_rate double")
    with pytest.raises(PS.SegmentationError):
        PS.cluster_customers(tx)


def test_rule_expressions(spark):
    df = spark.createDataFrame([(6000.0, 0.1, 0.2), (6000.0, 0.25, 0.1), (100.0, 0.22, 0.12), (100.0, 0.0, 0.0)],
                               "v double, d double, m double")
    got = df.select(X.persona_label("v", "d", "m").alias("l"), X.churn_risk("d", "m").alias("c")).collect()
    assert [(r.l, r.c) for r in got] == [("Champion", "low"), ("Value Seeker", "high"), ("At Risk", "medium"),
                                         ("Standard", "high")]


def test_alert_rules(spark):
    fvc = spark.createDataFrame([("A", -0.001, "flat"), ("B", 0.2, "up"), ("C", -0.3, "down")],
                                "segment string, pct_change_vs_current double, trend_direction string")
    per = spark.createDataFrame([("low",)], "churn_risk string")
    ids = sorted(r.alert_id for r in AL.alerts(fvc, per).collect())
    assert ids == ["fc-A", "fc-C"]
    assert sorted(r.alert_id for r in AL.alerts(fvc, per, strict_trend=True).collect()) == ["fc-C"]
    calm = fvc.where("segment = 'B'")
    assert [r.type for r in AL.alerts(calm, per).collect()] == ["info"]
    assert AL.count_alerts(AL.alerts(calm, per)).first()[0] == 0


def test_context_packet_respects_budget_and_drops_deals_first(spark):
    fvc = spark.createDataFrame([(f"S{i}", 1000.0 * i, 900.0, 1100.0, 1000.0 * i, 0.01 * i, "up", 0.3) for i in range(3)],
                                "segment string, next_period_revenue double, confidence_lower double, "
                                "confidence_upper double, current_revenue double, pct_change_vs_current double, trend_direction string, "
                                "r2_validation double")
    personas = spark.createDataFrame([("Champions", "Champion", 10.0, 0.1, 0.2, "low", "X", 3)],
                                     "persona string, persona_label string, avg_customer_sales double, "
                                     "avg_discount double, avg_margin double, churn_risk string, top_region string, "
                                     "cluster_size long")
    deals = spark.createDataFrame([(f"d{i}", "S0", "R", 0.01 * i, 0.3, "Revise.") for i in range(8)],
                                  "deal_id string, segment string, region string, predicted_margin_rate double, "
                                  "discount double, recommendation string")
    groups = spark.createDataFrame([("R",), ("Q",)], "region string")
    ceilings = spark.createDataFrame([("S0", "R", 0.2), ("S1", "R", 0.1)], "segment string, region string, ceiling double")
    avg = spark.createDataFrame([("S0", 0.2), ("S1", 0.1)], "segment string, avg_margin double")
    facts = CX.ModelFacts(0.9, 4, 0.353)

    def packet(region, tokens=600):
        rows = CX.context_packets(fvc, deals, personas, groups, ceilings, avg, facts, budget_tokens=tokens).collect()
        r = next(x for x in rows if x.region == region)
        return r, json.loads(r.json)

    import json
    full, js = packet("R")
    assert full.n_items_kept == 3 + 1 + 5 and full.token_estimate <= 600
    assert js["forecast"]["global_summary"] == {"global_yhat": 3000.0, "total_next_period_revenue": 3000.0,
                                                "aggregate_pct_change": "0.0%", "aggregate_trend": "→"}
    assert [x["trend"] for x in js["forecast"]["segments"]] == ["↑"] * 3
    assert js["margin"]["model_r2"] == 0.9 and js["margin"]["avg_margin_by_segment"] == {"S0": "20.0%", "S1": "10.0%"}
    assert js["margin"]["discount_ceiling"] == {"S0/R": "20.0%", "S1/R": "10.0%"}
    assert [d["id"] for d in js["margin"]["at_risk_deals"]] == ["d0", "d1", "d2", "d3", "d4"]
    assert js["margin"]["at_risk_deals"][0]["action"] == "Revise."
    assert js["segmentation"]["n_clusters"] == 4 and js["segmentation"]["silhouette"] == 0.35
    other, js = packet("Q")
    assert js["margin"]["at_risk_deals"] == [] and js["margin"]["discount_ceiling"] == {}
    small, js = packet("R", full.token_estimate - 60)
    assert small.token_estimate <= full.token_estimate - 60
    assert small.pruning_log[0].startswith("dropped") and "deal" in small.pruning_log[0]
    assert len(js["forecast"]["segments"]) == 3 and len(js["segmentation"]["personas"]) == 1
    tiny, js = packet("R", 40)
    assert tiny.n_items_kept == 0 and js["margin"]["discount_ceiling"] == {} and "dropped the discount ceilings" in tiny.pruning_log
    with pytest.raises(CX.EmptyPacketError):
        CX.check_packets(fvc.limit(0), deals.limit(0), personas.limit(0))


def test_encoders_have_no_null_class(spark):
    from revlens.operators import ingest as IN
    tx = spark.createDataFrame([("b", None, "r", "p", 2.0, 0.1, 5.0), ("a", "x", None, "p", 1.0, 0.4, 3.0)],
                               "segment string, industry string, region string, product string, quantity double, "
                               "discount double, sales double")
    feats = IN.deal_features(tx)
    enc = MG.fit_encoders(feats)
    assert {(r.column, r.value): r.code for r in enc.collect()} == {
        ("segment", "a"): 0, ("segment", "b"): 1, ("industry", "Unknown"): 0, ("industry", "x"): 1,
        ("region", "Unknown"): 0, ("region", "r"): 1, ("product", "p"): 0}
    assert all(r.industry_enc >= 0 and r.region_enc >= 0 for r in MG.encode(feats, enc).collect())
    assert MG.fit_encoders(tx).where("value is null").count() == 0


def test_hold_out_follows_the_rows_not_the_partitions(spark, sf_small):
    from revlens.operators import rollups as R
    from revlens.sources import tables as S
    tx = R.margin_features(S.transactions(spark, sf_small))
    p = MG.MarginParams(max_iter=3)
    one, two = MG.train_margin_model(tx, p), MG.train_margin_model(tx.repartition(13), p)
    assert (one.r2, one.mae) == (two.r2, two.mae) and one.importances == two.importances


def test_models_save_and_load(spark, tmp_path):
    from revlens.plans import models as MD
    tx = spark.createDataFrame([(f"c{i % 40}", float(i), i % 7 / 20, i % 5 / 10) for i in range(400)],
                               "customer string, sales double, margin_rate double, discount double")
    clustered, _, (model, scaling) = PS.cluster_customers(tx, PS.PersonaParams(n_init=2))
    MD.save_clusters(model, scaling, str(tmp_path / "c"))
    again, rows = MD.load_clusters(spark, str(tmp_path / "c"))
    assert [c.tolist() for c in again.clusterCenters()] == [c.tolist() for c in model.clusterCenters()]
    assert rows.first() == scaling.first()
    MD.save_forecast(clustered, str(tmp_path / "f"))
    assert MD.load_forecast(spark, str(tmp_path / "f")).count() == 40


def test_rule_recovery_and_sweep_curve(spark):
    deals = spark.createDataFrame([("Tech", "Enterprise API", "Enterprise", "Europe", 1000, 10000.0, 0.30),
                                   ("Finance", "Basic", "SMB", "APAC", 0, 5000.0, 0.05)],
                                  "industry string, product string, segment string, region string, quantity int, "
                                  "sales double, discount double")
    r = {x.industry: x for x in MG.rule_recovery(deals).collect()}
    assert r["Tech"].safe_ceiling_pct == 27.0 and r["Tech"].cliff_pct == 42.0
    assert abs(r["Tech"].recovery - 10000.0 * 3 / 100) < 1e-9
    assert r["Finance"].safe_ceiling_pct == 9.0 and r["Finance"].recovery == 0.0
    sw = {(x.industry, x.discount_pct): x for x in MG.discount_sweep(deals).collect()}
    # Tech deal offset: -2.5 (Enterprise) + 1.5 (Europe) + 4.0 (Enterprise API) - 1.5 (1000 units) = 1.5
    assert sw[("Tech", 0)].margin_pct == 29.5 and sw[("Tech", 10)].margin_pct == 17.5
    assert sw[("Tech", 30)].margin_pct == 3.5 and sw[("Tech", 80)].margin_pct == -15.0
    assert sw[("Tech", 35)].zone == "healthy" and sw[("Tech", 36)].zone == "danger"
    assert len([k for k in sw if k[0] == "Finance"]) == 81


def test_exact_silhouette_matches_numpy_on_all_rows_and_on_a_sample(spark):
    import numpy as np
    import pandas as pd
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame(rng.normal(size=(700, 2)) + 3 * rng.integers(0, 3, 700)[:, None], columns=["x", "y"])
    pdf["cluster"] = np.where(pdf.x + pdf.y < 3, 0, np.where(pdf.x < 5, 1, 2))
    pdf.loc[0, "cluster"] = 7  # a cluster of one

    def numpy_form(p):
        v, c = p[["x", "y"]].to_numpy(), p["cluster"].to_numpy()
        d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(-1))
        out = []
        for i in range(len(v)):
            own = (c == c[i]).sum()
            a = d[i, c == c[i]].sum() / max(own - 1, 1)
            b = min(d[i, c == k].mean() for k in set(c) - {c[i]})
            out.append((b - a) / max(a, b) if own > 1 else 0.0)
        return np.mean(out)

    df = spark.createDataFrame(pdf)
    r = PS.exact_silhouette(df, ["x", "y"]).first()
    assert abs(r.silhouette - numpy_form(pdf)) < 1e-9 and (r.n_rows, r.n_clusters) == (700, 4)
    s = PS.exact_silhouette(df.repartition(5), ["x", "y"], most=200).first()
    assert 196 <= s.n_rows <= 204 and s.n_clusters == 4 and abs(s.silhouette - r.silhouette) < 0.1
    assert PS.exact_silhouette(df.where("cluster = 1"), ["x", "y"]).first().silhouette is None


def test_exact_silhouette_takes_all_rows_however_many(spark, monkeypatch):
    import numpy as np
    import pandas as pd
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame(rng.normal(size=(10_500, 2)), columns=["x", "y"])
    pdf["cluster"] = np.where(pdf.x < 0, 3, 5)

    def numpy_form(p):
        v, own = p[["x", "y"]].to_numpy(), p["cluster"].to_numpy()
        out = np.empty(len(v))
        for at in range(0, len(v), 500):
            d = np.sqrt(((v[at : at + 500, None] - v[None]) ** 2).sum(-1))
            far = {c: d[:, own == c].sum(axis=1) for c in (3, 5)}
            for i, c in enumerate(own[at : at + 500]):
                a, b = far[c][i] / ((own == c).sum() - 1), far[8 - c][i] / (own == 8 - c).sum()
                out[at + i] = (b - a) / max(a, b)
        return out.mean()

    r = PS.exact_silhouette(spark.createDataFrame(pdf), ["x", "y"]).first()
    assert (r.n_rows, r.n_clusters) == (10_500, 2) and abs(r.silhouette - numpy_form(pdf)) < 1e-9
    # many blocks, whose sums are added up in several steps
    few = pdf[:300]
    for name, value in (("SILHOUETTE_BLOCK", 30), ("SILHOUETTE_LEAST", 7), ("MERGED_SUMS", 2), ("DISTANCE_TILE", (5, 4))):
        monkeypatch.setattr(PS, name, value)
    r = PS.exact_silhouette(spark.createDataFrame(few).repartition(3), ["x", "y"]).first()
    assert r.n_rows == 300 and abs(r.silhouette - numpy_form(few)) < 1e-9


def test_sweep_rates_are_rounded_like_sparks(spark):
    """Ties of the shortest decimal go up, away from zero, with both ways of rounding."""
    import numpy as np
    from pyspark.sql import functions as F
    from revlens.operators import margin as MG
    rng = np.random.default_rng(5)
    p = np.concatenate([rng.normal(0, 0.7, 500), (rng.integers(-9999, 9999, 500) + 0.5) / 1e4, [0.00005, -0.00005, 1.5, -2.0, 0.0, -0.00001]])
    want = spark.createDataFrame([(i, float(v)) for i, v in enumerate(p)], "i int, p double").orderBy("i").select(
        (F.round(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("p"))), 4) + 0.0).alias("r")).toPandas()["r"].to_numpy()
    assert (MG.rounded_rates(p) == want).all() and (MG.rounded_rates(p.reshape(2, -1)).ravel() == want).all()


def test_training_encodes_the_rows_once(spark, sf_small, monkeypatch):
    from revlens.operators.rollups import margin_features
    from revlens.sources import tables as S

    # rows without a margin don't train the model, but they are deals
    tx = margin_features(S.transactions(spark, sf_small)).withColumn("margin_rate", F.when(F.col("line_number") > 1, F.col("margin_rate")))
    encodings, encode = [], MG.encode
    monkeypatch.setattr(MG, "encode", lambda *a, **k: encodings.append(1) or encode(*a, **k))
    model = MG.train_margin_model(tx, MG.MarginParams(max_iter=2))
    assert len(encodings) == 1
    want = MG.representative_deals(encode(MG.deal_features(tx), model.encoders, warn=False), model.encoders)
    assert model.representatives.schema.simpleString() == want.schema.simpleString()
    assert sorted(map(tuple, model.representatives.collect())) == sorted(map(tuple, want.collect()))


def test_rate_text_is_the_percent_text_of_every_rate(spark):
    rates = spark.range(-10_000, 10_001).select((F.col("id") / 10_000).alias("r")).union(spark.createDataFrame([(None,)], "r double"))
    assert rates.where(~X.rate_text("r").eqNullSafe(X.pct_text("r", 1))).count() == 0


def test_scored_deals_come_from_the_clean_table(spark, sf_small, monkeypatch):
    """The star join is run once, for the clean table; its rows are the deals."""
    from revlens.plans import catalog
    from revlens.sources import tables as S

    joins, transactions = [], S.transactions
    monkeypatch.setattr(S, "transactions", lambda *a, **k: joins.append(1) or transactions(*a, **k))
    catalog.MD.clear(spark)
    scored = catalog.QUERIES["deal_scores_fixed"](spark, sf_small)
    assert len(joins) == 1
    columns = ["deal_id", "segment", "region", "industry", "product", "quantity", "sales", "discount"]
    assert sorted(map(tuple, scored.select(columns).collect())) == sorted(map(tuple, S.deals(spark, sf_small).select(columns).collect()))


def test_scored_trees_round_and_warn_like_any_predictor(spark, sf_small):
    """Rates rounded in Python, texts of whole numbers, warnings of the rare rows only."""
    from revlens.plans import catalog

    model = catalog._fixed_tree_model(spark, sf_small)
    deals = spark.createDataFrame([("a", "BUILDING", "ASIA", "Brand#1", "ECONOMY", 10, 900.0, 0.1), ("b", "NOWHERE", "ASIA", "Brand#1", None, 10, 900.0, 0.6),
                                   ("c", "BUILDING", "MARS", "Brand#1", "ECONOMY", 0, 900.0, 0.3), ("d", "NOWHERE", None, "x", "y", 30, -1.0, 0.45)],
                                  "deal_id string, segment string, region string, industry string, product string, quantity int, sales double, discount double")
    ceilings = spark.createDataFrame([("BUILDING", "ASIA", 0.17)], "segment string, region string, ceiling double")

    class Plain:  # the same predictions, rounded and told by Spark
        def transform(self, df):
            return model.model.transform(df)

    rows = {r.deal_id: r for r in MG.score_deals(model, deals, ceilings).collect()}
    plain = MG.MarginModel(model=Plain(), encoders=model.encoders, medians=model.medians, importances=[])
    assert rows == {r.deal_id: r for r in MG.score_deals(plain, deals, ceilings).collect()}
    assert rows["a"].warnings == [] and rows["a"].recommendation.count(" Safe ceiling for BUILDING/ASIA: 17%.") == 1
    assert rows["b"].warnings == ["Unknown segment 'NOWHERE' encoded as -1.", "Unknown product '' encoded as -1."]
    assert [w.split()[0] for w in rows["c"].warnings] == ["No", "Unknown"] and "ceiling" not in rows["c"].recommendation
    assert [w.split()[0] for w in rows["d"].warnings] == ["No", *["Unknown"] * 4]
