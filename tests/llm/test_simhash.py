import itertools
import random
import re

import numpy as np
import xxhash

from revlens.llm import components as cc, queries, simhash
from tests.llm.conftest import AWKWARD


def brute_fp(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(nodes, links):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def brute(docs):
    fps = {d[0]: brute_fp(d[1]) for d in docs}
    links = [(a, b) for a, b in itertools.combinations(fps, 2) if (fps[a] ^ fps[b]).bit_count() <= 3]
    comp = brute_components(fps, links)
    return sorted((i, f"{fp:016x}", comp[i]) for i, fp in fps.items())


def test_query_matches_brute_force(spark, sf_dir, documents):
    got = sorted(tuple(r) for r in queries.op8_simhash_near_dedup(spark, sf_dir).collect())
    assert got == brute([d[:2] for d in documents])


def test_awkward_rows(awkward, no_documents):
    rows = simhash.near_duplicates(awkward).collect()
    by = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(AWKWARD)
    assert by[1]["fingerprint"] == "0" * 16 and by[6]["component_id"] == by[3]["component_id"] == 1
    assert by[5]["component_id"] == 4 and by[8]["fingerprint"] == f"{brute_fp('word ' * 9):016x}"
    assert simhash.near_duplicates(no_documents).count() == 0
    kept = simhash.keep_one(awkward)
    assert kept.columns == awkward.columns
    ids = [r[0] for r in kept.select("doc_id").collect()]
    assert len(ids) == len(set(ids)) and {1, 4, 7, 8, 9} <= set(ids) and not {2, 3, 5, 6} & set(ids)


def test_multi_index_finds_every_link(spark):
    rng = random.Random(4)
    fps = set()
    for _ in range(60):  # dense clusters and chains
        x = rng.getrandbits(64)
        for _ in range(8):
            fps.add(x)
            x ^= sum(1 << b for b in rng.sample(range(64), rng.choice([1, 2, 3, 4])))
    fps = sorted(np.array(sorted(fps), dtype=np.uint64).view(np.int64).tolist())
    mask = (1 << 64) - 1
    links = [(a, b) for a, b in itertools.combinations(fps, 2) if ((a ^ b) & mask).bit_count() <= 3]
    for segments, rows in ((2, simhash.BUCKET_ROWS), (2, 1), (2, 3), (4, 2)):
        frame = spark.createDataFrame([(f,) for f in fps], "fp long")
        pairs = [tuple(r) for r in simhash.verified_links(simhash.dealt_lookups(frame, 3, segments, rows), 3).collect()]
        assert all(((a ^ b) & mask).bit_count() <= 3 for a, b in pairs)
        assert brute_components(fps, pairs) == brute_components(fps, links)


def test_a_hot_bucket_is_shared_by_tasks(spark):
    rng = np.random.default_rng(5)
    low = rng.integers(0, 1 << 32, 20_000, dtype=np.uint64)
    bucket = (np.uint64(0x1234_5678) << np.uint64(32)) | low  # one upper half
    beside = bucket[:6_000] ^ np.uint64(1 << 40)  # looks up the hot bucket
    fps = np.unique(np.concatenate([bucket, beside])).view(np.int64)
    frame = spark.createDataFrame([(int(f),) for f in fps], "fp long")
    dealt = simhash.dealt_lookups(frame, 3, 2, 1_000).persist()
    largest = dealt.groupBy("segment", "value", "part").count().agg({"count": "max"}).first()[0]
    assert largest < 4_000  # the bucket has 26,000 rows
    pairs = [tuple(r) for r in simhash.verified_links(dealt, 3).collect()]
    x, links = fps.view(np.uint64), []
    for at in range(0, len(x), 1_000):
        i, j = np.nonzero(np.bitwise_count(x[at : at + 1_000, None] ^ x[None, :]) <= 3)
        links += [(int(fps[at + a]), int(fps[b])) for a, b in zip(i, j, strict=True) if at + a < b]
    assert len(links) >= 6_000 and set(map(frozenset, pairs)) <= set(map(frozenset, links))
    assert brute_components(fps.tolist(), pairs) == brute_components(fps.tolist(), links)
    dealt.unpersist()


def test_forest_of_a_dense_block():
    fps = np.arange(4_096, dtype=np.int64)  # every one links with its neighbours
    pairs = simhash._forest(fps, fps, 3)
    assert len(pairs) == len(fps) - 1 and set(brute_components(fps.tolist(), pairs).values()) == {0}


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 200), (200, 150), (300, 300)] + [(500, x) for x in range(501, 540)]
    got = {r["node"]: r["component"] for r in cc.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == brute_components({x for e in edges for x in e}, edges)
    assert cc.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_keep_one_with_null_and_repeated_ids(spark):
    rng = random.Random(8)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(30)) for _ in range(8)]
    docs = [(None, texts[0]), (None, texts[1]), (None, texts[1]), (None, texts[2]),  # three groups without an id
            (5, texts[3]), (5, texts[4]), (5, texts[4]),  # one id, two groups
            (6, texts[5]), (7, texts[5]), (7, texts[6]),  # 7 is chosen in one group and not in the other
            (None, texts[7]), (9, texts[7])]
    rows = simhash.keep_one(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    want = [(None, texts[0]), (None, texts[1]), (None, texts[2]), (5, texts[3]), (5, texts[4]), (6, texts[5]), (7, texts[6]), (9, texts[7])]
    assert sorted(map(tuple, rows), key=repr) == sorted(want, key=repr)
