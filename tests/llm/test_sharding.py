import zlib
from collections import defaultdict

import numpy as np

from revlens.llm import queries, sharding
from tests.llm.conftest import AWKWARD


def optimum(sizes, shards):
    """The smallest largest sum of a contiguous partition, by search."""
    low, high = max(sizes, default=0), sum(sizes)
    while low < high:
        mid = (low + high) // 2
        used, room = 1, mid
        for s in sizes:
            if s > room:
                used, room = used + 1, mid
            room -= s
        low, high = (low, mid) if used <= shards else (mid + 1, high)
    return low


def check(rows, docs, shards):
    want = sorted(((d[0], len((d[1] or "").encode()) + 1, zlib.crc32((d[1] or "").encode())) for d in docs), key=repr)
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in rows), key=repr) == want
    by, of = defaultdict(list), defaultdict(set)
    for r in rows:
        by[r["shard"]].append(r["slot"])
        of[(r["text_crc32"], r["size"])].add(r["shard"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert set(by) <= set(range(shards))
    return of


def groups_in_order(spark, docs):
    frame = spark.createDataFrame([(d[1],) for d in docs], "text string")
    rows = frame.selectExpr("xxhash64(text) g", "coalesce(octet_length(text), 0) + 1 s").groupBy("g").sum("s").orderBy("g").collect()
    return [r[1] for r in rows]


def test_query_is_the_exact_optimum(spark, sf_dir, documents):
    rows = queries.op3_minimax_sharding(spark, sf_dir).collect()
    of = check(rows, documents, 16)
    assert all(len(v) == 1 for v in of.values())
    sums = defaultdict(int)
    for r in rows:
        sums[r["shard"]] += r["size"]
    assert max(sums.values()) == optimum(groups_in_order(spark, documents), 16)
    assert {r["law"] for r in rows} == {"bytes"} and {r["grown_shard"] for r in rows} == {None}


def test_awkward_rows(spark, awkward, no_documents, tmp_path):
    for shards in (1, 3, 16):
        rows = sharding.shard(awkward, shards).collect()
        check(rows, AWKWARD, shards)
        sums = defaultdict(int)
        for r in rows:
            sums[r["shard"]] += r["size"]
        assert max(sums.values()) == optimum(groups_in_order(spark, AWKWARD), shards)
    assert sharding.shard(no_documents).count() == 0


def test_cuts_by_refinement_match_the_whole_line(spark):
    rng = np.random.default_rng(5)
    # close hashes force many refinements
    keys = np.unique(np.concatenate([rng.integers(-(2**62), 2**62, 300), 1234567 + rng.integers(0, 5000, 300)]))
    sizes = rng.integers(1, 400, len(keys))
    groups = spark.createDataFrame([(int(k), int(s)) for k, s in zip(keys, sizes, strict=True)], "group long, size long")
    for shards in (2, 7, 16):
        cuts = sharding.minimax_cuts(groups, shards)
        place = np.searchsorted(np.array(cuts), keys, side="right")
        assert max(sizes[place == i].sum() for i in range(shards)) == optimum(sizes.tolist(), shards)


def test_shards_are_written(spark, awkward, tmp_path):
    docs = sharding.shard(awkward, 4)
    sharding.write_shards(docs, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(AWKWARD)
