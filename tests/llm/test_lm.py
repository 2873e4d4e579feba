import math
import re
import zlib
from collections import Counter

import numpy as np

from revlens.llm import lm, queries
from tests.llm.conftest import AWKWARD

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs):
    """(id, held, n_tokens, n_known, base, N) by the contract's words."""
    rows = []
    for i, text in docs:
        text = re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), text or "")
        rows.append((i, True if i is None else zlib.crc32(str(i).encode()) % 10 == 0, [*WORD.findall(text), ""]))
    c = Counter(t for _, held, ts in rows if not held for t in ts)
    n, v = sum(c.values()), len(c)
    return sorted(((i, held, len(ts), sum(c[t] > 0 for t in ts), round(sum(math.log10((c[t] + 0.1) / (n + 0.1 * (v + 1))) for t in ts), 6), n) for i, held, ts in rows), key=repr)


def rows_of(rows):
    return sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], round(r["base_score"], 6), r["train_tokens"]) for r in rows), key=repr)


def close(a, b):
    assert [x[:4] + x[5:] for x in a] == [x[:4] + x[5:] for x in b]
    assert np.allclose([x[4] for x in a], [x[4] for x in b], rtol=1e-9, atol=1e-5)


def test_query_matches_brute_force_and_beats_the_base(spark, documents, sf_dir):
    rows = queries.op9_maxent_scoring(spark, sf_dir).collect()
    close(rows_of(rows), brute([d[:2] for d in documents]))
    assert all(r["score"] <= 0 and math.isfinite(r["score"]) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_small_chunks_change_nothing_but_order(spark, documents):
    frame = spark.createDataFrame([d[:2] for d in documents[:60]], "doc_id long, text string")
    close(rows_of(lm.score(frame, chunk_bytes=3_000, rounds=0).collect()), brute([d[:2] for d in documents[:60]]))


def test_awkward_rows(spark, awkward, no_documents):
    rows = lm.score(awkward).collect()
    close(rows_of(rows), brute([r[:2] for r in AWKWARD]))
    assert lm.score(no_documents).count() == 0
    alone = lm.score(awkward.where("doc_id is null")).collect()
    assert [(r["n_known"], r["train_tokens"], r["score"], r["base_score"]) for r in alone] == [(0, 0, 0.0, 0.0)]


def test_probabilities_add_up_and_rounds_help(spark, documents):
    frame = spark.createDataFrame([d[:2] for d in documents], "doc_id long, text string").selectExpr("doc_id id", "text", "false held")
    cut = lm.stage(lm.chunks(frame), "test-lm")
    per_chunk, sums = lm.with_corpus_counts(cut)
    likely = []
    for rounds in (0, 1, 3):
        model = lm.train(cut, sums, rounds)
        likely.append(sum(r["score"] for r in lm.score_chunks(cut, per_chunk, model, sums, "doc_id").collect()))
    assert likely[0] < likely[1] < likely[2]
    # the classes' shares of their words and the history's of the classes
    words = Counter(t for d in documents for t in [*lm.words_of(d[1] or ""), lm.END])
    kinds = np.array([lm.bucket_of(w) for w in words])
    counts = np.array(list(words.values()), dtype=float)
    p = lm.class_probabilities([np.array([3], dtype=np.uint16)] * lm.KINDS, model.weights, model.bias)[0]
    total = (1 - model.unknown) * (p[model.class_of[kinds]] * counts / model.mass[model.class_of[kinds]]).sum() + model.unknown
    assert abs(total - 1) < 1e-4


def test_features_stay_within_their_text():
    kind = np.array([5, 6, 7, 8, 9], dtype=np.uint16)
    one, two, _, _ = lm.features(kind, np.array([0, 3]))
    assert one.tolist() == [0, 5, 6, 0, 8] and two.tolist() == [0, 0, 5, 0, 0]


def test_words_are_hashed_by_letters():
    def kind(word):
        return lm.bucket_of(word.encode())

    # the last three letters, not bytes: "été" and "ité" differ three letters from the end
    assert kind("abété") != kind("abité") and kind("abxété") == kind("abyyété")
    assert kind("éàx...fin") != kind("éùx...fin") and kind("日本x語学者") == kind("日本yy語学者") != kind("日曜x語学者")
    assert kind("") == 0 and kind("unhappiness") == kind("unless")


def test_model_has_24_classes():
    table = np.random.default_rng(1).random((lm.BUCKETS, lm.NEIGHBOURS + 1))
    assert lm.CLASSES == 24 and len(set(lm.make_classes(table).tolist())) == 24
