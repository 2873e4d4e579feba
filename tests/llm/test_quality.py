import zlib

import numpy as np

from revlens.llm import quality, queries
from tests.llm.conftest import AWKWARD


def test_query_on_held_out_rows(spark):
    rows = queries.op6_quality_classifier(spark, "/root/testdata/sf0.1").collect()
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    held = [(labels[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    good, bad = [p for y, p in held if y == 1], [p for y, p in held if y == 0]
    assert len(bad) > 50 and np.mean(good) > 0.98 and np.mean(bad) < 0.2


def test_gradients_match_differences():
    rng = np.random.default_rng(3)
    texts = ["ab cd" * 40, "xyz " * 300, "q", "hello world, this is text " * 30]
    net = quality.Network(rng.normal(0, 0.3, (quality.WIDTH, 256, quality.FILTERS)), rng.normal(0, 0.1, quality.FILTERS), rng.normal(0, 0.3, 3 * quality.FILTERS + 2), np.array([0.1]))
    label = np.array([1.0, 0.0, 1.0, 0.0])

    def loss():
        p = quality.score_texts(texts, net, net.tables())
        return -np.mean(label * np.log(p) + (1 - label) * np.log(1 - p))

    grads = quality._gradients(quality.arrange(texts), label, net)
    for p, g in ((net.shift, grads[1]), (net.out, grads[2]), (net.bias, grads[3])):
        for k in range(0, len(p) - len(p) % 2, 7) if len(p) > 1 else [0]:
            p[k] += 1e-4
            up = loss()
            p[k] -= 2e-4
            down = loss()
            p[k] += 1e-4
            assert abs((up - down) / 2e-4 - g[k]) < 2e-3


def test_pooling_covers_the_whole_text():
    net = quality.fit([], [])
    net.out[:] = 0.05
    net.shift[:] = 0.5
    filler, mark = "a" * 5_000, "#@!%&*()"
    plain = quality.score_texts([filler], net, net.tables())[0]
    for at in (0, 1, 2_000, 4_999):
        assert abs(quality.score_texts([filler[:at] + mark + filler[at:]], net, net.tables())[0] - plain) > 1e-6
    together = quality.score_texts([filler, "", mark, filler + mark], net, net.tables())
    alone = [quality.score_texts([t], net, net.tables())[0] for t in (filler, "", mark, filler + mark)]
    assert np.allclose(together, alone)


def test_awkward_rows(spark, awkward, no_documents):
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 11)] + [(3, None), (None, 1)], "doc_id long, quality int")
    net = quality.train(awkward, labels)
    rows = quality.score(awkward, net)
    assert rows.columns == [*awkward.columns, "__score"] and {r["score"] for r in rows.collect()} == {"x"}
    assert all(0 <= r["__score"] <= 1 for r in rows.collect()) and rows.count() == len(AWKWARD)
    assert quality.score(no_documents, net).count() == 0
    assert quality.score(awkward, quality.train(awkward, labels.limit(0))).agg({"__score": "max"}).first()[0] == 0.5


def test_an_id_that_comes_again_gives_one_text(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(300)] + [(2, "b"), (3, None), (4, "d")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in (1, 1, 2, 3, 4)], "doc_id long, quality int")
    texts, marks = quality.training_sample(docs, labels, "doc_id", "text", "quality", most=10)
    assert len(texts) == len(marks) <= 3 and texts.count("text 0") <= 1 and not any(t.startswith("text ") for t in texts if t != "text 0")


def test_the_sample_is_bounded_in_bytes_and_keeps_long_texts_whole(spark):
    long = "long text " * 20_000
    docs = spark.createDataFrame([(i, long if i % 10 == 1 else f"short {i}") for i in range(100)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)], "doc_id long, quality int")
    every, _ = quality.training_sample(docs, labels, "doc_id", "text", "quality")
    trained = [i for i in range(100) if zlib.crc32(str(i).encode()) % 5]
    assert len(every) == len(trained) and every.count(long) == sum(i % 10 == 1 for i in trained) > 1
    some, _ = quality.training_sample(docs, labels, "doc_id", "text", "quality", most_bytes=len(long) + 2_000)
    assert some.count(long) == 1 and len(some) == len(trained) - every.count(long) + 1


def test_peaks_do_not_depend_on_the_cut():
    net = quality.fit([], [])
    b = quality.arrange(["ab cd" * 4_000, "q", "xyz " * 300])
    whole, parts = quality.peaks(b, net.tables(), places=True), quality.peaks(b, net.tables(), most=7, places=True)
    assert all((w == p).all() for w, p in zip(whole, parts, strict=True)) and whole[1].max() < quality.BLOCK
