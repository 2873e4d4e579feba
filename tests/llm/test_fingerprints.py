import hashlib

from pyspark.sql import functions as F

from revlens.llm import fingerprints as fp, queries
from tests.llm.conftest import AWKWARD


def brute(docs):
    rows = sorted(docs, key=lambda d: d[0])
    out = {}
    for i, (id_, text) in enumerate(rows):
        text, after = text or "", rows[(i + 1) % len(rows)][1] or ""
        k = len(text) // 4
        edited = text[: len(text) - k] + after[:k]
        out[id_] = (len(text), edited, after)
    return out


def test_query_edits_and_likeness(spark, sf_dir, documents):
    want = brute([d[:2] for d in documents])
    rows = queries.op7_merkle_fingerprints(spark, sf_dir).collect()
    assert len(rows) == len(documents)
    texts, near, far = {}, [], []
    for r in rows:
        n, edited, after = want[r["doc_id"]]
        assert r["n_chars"] == n and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        own = next(d[1] for d in documents if d[0] == r["doc_id"])
        assert texts.setdefault(own, r["fingerprint"]) == r["fingerprint"]
        assert texts.setdefault(edited, r["edited_fingerprint"]) == r["edited_fingerprint"]
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        near.append(r["near_edited"])
        far.append(r["near_next"])
    assert len(set(texts.values())) == len(texts)
    assert sum(near) / len(near) > 0.6 and sum(far) / len(far) < 0.2


def test_awkward_rows(spark, awkward, no_documents):
    rows = fp.fingerprint_edits(awkward).collect()
    assert len(rows) == len(AWKWARD)
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    assert by[1][0]["n_chars"] == 0 and by[1][0]["near_edited"] == 1.0 and by[1][0]["near_next"] == 1.0
    assert by[4][0]["fingerprint"] == by[5][0]["fingerprint"] != by[10][0]["fingerprint"]
    assert len(by[5]) == 2 and by[4][0]["near_next"] == 1.0
    assert fp.fingerprint_edits(no_documents).count() == 0
    assert fp.fingerprint_edits(awkward.where("doc_id = 9")).select("near_next").first()[0] == 1.0


def test_order_over_clustered_ids(spark):
    ids = [*range(0, 3000), *(2**40 + i for i in range(3000)), 2**62, -(2**62), -5]
    got = fp.with_next(spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string"), "doc_id", "text", "after").collect()
    ids.sort()
    assert {r["id"]: r["after"] for r in got} == {a: f"t{b}" for a, b in zip(ids, [*ids[1:], ids[0]], strict=True)}


def test_differing_branches_locate_the_edit(spark):
    a, b = "one\ntwo\n\nthree\nfour", "one\ntwo\n\nthree\nFOUR\nfive"
    frame = spark.createDataFrame([(a, b)], "a string, b string").select(fp.tree(F.col("a")).alias("a"), fp.tree(F.col("b")).alias("b"))
    found = frame.select(fp.differing_branches(F.col("a"), F.col("b")).alias("d"), fp.differing_branches(F.col("a"), F.col("a")).alias("e")).first()
    assert [tuple(x) for x in found["d"]] == [(1, 1), (1, 2)] and found["e"] == []
    breaks = spark.createDataFrame([("x\n\ny",), ("x\n\n\ny",)], "t string").select(fp.root(fp.tree(F.col("t"))).alias("r")).collect()
    assert breaks[0]["r"] != breaks[1]["r"]
