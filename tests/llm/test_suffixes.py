import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from revlens.llm import queries, suffixes
from tests.llm.conftest import AWKWARD


def brute(docs, depth=200):
    raw = [(i, (t or "").encode()) for i, t in docs]
    seen = Counter(b[k : k + depth] for _, b in raw for k in range(len(b) - depth + 1))
    out = []
    for i, b in raw:
        gone = np.zeros(len(b) + 1, dtype=bool)
        for k in range(len(b) - depth + 1):
            if seen[b[k : k + depth]] > 1:
                gone[k : k + depth] = True
        kept = bytes(np.frombuffer(b, dtype=np.uint8)[~gone[:-1]])
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out.append((i, len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(((r["doc_id"], r["n_bytes"], r["n_bytes"] - len(r["kept"]), len(r["firsts"]), hashlib.sha256(r["kept"]).hexdigest()) for r in df.collect()), key=repr)


def test_query_matches_brute_force(spark, sf_dir, documents):
    got = sorted((tuple(r) for r in queries.op5_suffix_dedup(spark, sf_dir).collect()), key=repr)
    assert got == brute([d[:2] for d in documents])
    assert any(r[2] for r in got)


@pytest.mark.parametrize("hot", [suffixes.HOT, 3])
def test_planted_repeats(spark, hot):
    rng = random.Random(6)
    text = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    shared = [text(n) for n in (199, 200, 201, 260, 700)]
    docs = [(i, text(rng.randrange(400)) + rng.choice(shared) + text(rng.randrange(400)) + rng.choice(shared)) for i in range(60)]
    docs += [(100, "ab" * 400), (101, "x" * 200), (102, "x" * 199), (103, shared[4]), (104, "y" * 201)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows_of(suffixes.remove_repeats(frame, hot=hot)) == brute(docs)


def test_awkward_rows(awkward, no_documents):
    got = suffixes.remove_repeats(awkward)
    assert rows_of(got) == brute([r[:2] for r in AWKWARD])
    assert suffixes.remove_repeats(no_documents).count() == 0


def test_long_documents_are_sampled_in_slices(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "SLICE", 500)
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("abcdef") for _ in range(n))
    shared = text(900)
    docs = [(1, text(3000) + shared + text(100)), (2, shared), (3, text(499)), (4, text(700) + shared[:650])]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    raw = {i: t.encode() for i, t in docs}
    for i, b in raw.items():
        data = np.frombuffer(b, dtype=np.uint8)
        rows = suffixes.sampled_runs(frame.where(f"doc_id = {i}").selectExpr("doc_id id", "text", "doc_id hash")).collect()
        assert rows[0]["n_windows"] == len(b) - 199 and rows[0]["starts"][0] == 0 and rows[0]["starts"] == sorted(rows[0]["starts"])
        assert len(data) == len(b)
    assert rows_of(suffixes.remove_repeats(frame)) == brute(docs)


def test_first_digits_are_the_windows_own():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 101, 3000).astype(np.uint8)
    doubled = np.concatenate([data[:900], data[200:1500]])
    found = {}
    doc, start, digit = suffixes.first_digits(doubled, np.array([900, 2200]))
    for d, (lo, hi) in enumerate(((0, 900), (900, 2200))):
        s, g = start[doc == d], digit[doc == d]
        for k in range(hi - lo - 199):
            found.setdefault(bytes(doubled[lo + k : lo + k + 200]), set()).add(int(g[np.searchsorted(s, k, side="right") - 1]))
    assert all(len(v) == 1 for v in found.values())
