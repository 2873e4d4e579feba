import re
from collections import Counter, defaultdict

import pytest

from revlens.llm import mixing, queries
from tests.llm.conftest import AWKWARD

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def targets(sizes, weights=(3, 1, 2), share=1.5, repeats=2):
    """Shares by weight; what a source can't take is shared again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, open_, rest = {}, set(names), share * sum(sizes.values())
    while open_:
        level = rest / sum(w[s] for s in open_)
        over = {s for s in open_ if level * w[s] > repeats * sizes[s]}
        if not over:
            return out | {s: level * w[s] for s in open_}
        for s in over:
            out[s] = repeats * sizes[s]
            rest -= out[s]
        open_ -= over
    return out


def check(rows, docs):
    size = sorted((repr(d[0]), len(WORD.findall(d[1] or ""))) for d in docs)
    assert sorted((repr(r["doc_id"]), r["size"]) for r in rows) == size
    sizes, taken = Counter(), Counter()
    for d in docs:
        sizes[d[2]] += len(WORD.findall(d[1] or ""))
    want, source_of = targets(sizes), defaultdict(set)
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"]
    for d in docs:
        source_of[d[0]].add(d[2])
    for r in rows:
        (s,) = source_of[r["doc_id"]]
        taken[s] += r["taken"]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s], rel=1e-9, abs=1e-9)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 1


def test_query_meets_every_target(spark, sf_dir, documents):
    rows = queries.op4_source_mixing(spark, sf_dir).collect()
    check(rows, documents)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, queries.op4_source_mixing(spark, sf_dir).collect()))


def test_awkward_rows(awkward, no_documents):
    docs = [(i, *r[1:]) for i, r in enumerate(AWKWARD)]
    rows = mixing.mix(awkward.sparkSession.createDataFrame(docs, "doc_id long, text string, source string"), block=16).documents.collect()
    check(rows, docs)
    assert mixing.mix(awkward).documents.count() == len(AWKWARD)
    assert mixing.mix(no_documents).documents.count() == 0
    assert mixing.mix(awkward.where("length(coalesce(text, '')) = 0")).documents.agg({"taken": "sum"}).first()[0] == 0


def test_schedule_is_well_spread(spark, sf_dir):
    m = mixing.mix(spark.read.parquet(f"{sf_dir}/documents.parquet"), block=32)
    slots = m.schedule.select("slot", "k", "rank").distinct().collect()
    assert len({r["slot"] for r in slots}) == len(slots) == len({(r["k"], r["rank"]) for r in slots})
    share = {r["k"]: r["hi"] - r["lo"] for r in m.sources.collect()}
    seen, n = Counter(), 0
    for r in sorted(slots):
        seen[r["k"]] += 1
        n += 1
        assert all(abs(seen[k] - n * p) < 8 for k, p in share.items())
    # ranks of a source rise with its slots, but for the closing ones
    blocks = m.schedule.groupBy("slot").agg({"n_words": "sum"}).collect()
    assert max(r[1] for r in blocks) == 32
