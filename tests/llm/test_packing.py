import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from revlens.llm import packing, queries


def brute_pieces(rows, capacity):
    t = Tokenizer.from_file(queries.packing_tokenizer())
    out = []
    for id_, text in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        out += [(id_, p, at, len(ids[at : at + capacity]), zlib.crc32(ids[at : at + capacity].tobytes())) for p, at in enumerate(range(0, len(ids), capacity))]
    return sorted(out, key=repr)


def check_layout(rows, capacity):
    """Sequences are gapless from 0 and within the capacity; how many there are."""
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_query_matches_the_tokenizer(spark, sf_dir, documents):
    rows = queries.op1_best_fit_packing(spark, sf_dir).collect()
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows), key=repr) == brute_pieces([d[:2] for d in documents], 4096)
    n = check_layout(rows, 4096)
    assert n <= 1.01 * -(-sum(r["length"] for r in rows) // 4096) + 1


def test_awkward_rows(awkward, no_documents):
    rows = packing.pack(awkward, queries.packing_tokenizer(), capacity=64).collect()
    check_layout(rows, 64)
    want = brute_pieces([r[:2] for r in __import__("tests.llm.conftest", fromlist=["AWKWARD"]).AWKWARD], 64)
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], zlib.crc32(r["ids"])) for r in rows), key=repr) == want
    assert packing.pack(no_documents, queries.packing_tokenizer()).count() == 0


@pytest.mark.parametrize("text", ["a<|endoftext|>b, x", "1 2,3. \t x\x1cy", "é, É. ﬁ, ab́.", "it's. I'm,", "\x85 a　b İ, ß.", "", " , . "])
def test_words_encode_as_the_whole_text(text):
    enc = packing.encoder(queries.packing_tokenizer())
    assert enc.encode([text], None)[0] == np.array(enc.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


def test_plan_is_near_the_volume_bound():
    rng = np.random.default_rng(3)
    for sizes in (rng.integers(1, 4097, 3000), rng.lognormal(5.5, 1, 20_000).astype(int).clip(1, 4096), np.full(100, 1366), np.array([4096, 1])):
        lengths, counts = np.unique(sizes, return_counts=True)
        plan = packing.plan_sequences(lengths, counts)
        placed = defaultdict(int)
        for a, b, times in plan:
            assert (a * b).sum() <= 4096
            for x, n in zip(a.tolist(), b.tolist(), strict=True):
                placed[x] += n * times
        assert dict(placed) == dict(zip(lengths.tolist(), counts.tolist(), strict=True))
        used, bins = sum(p[2] for p in plan), []
        for x in sorted(sizes.tolist(), reverse=True):  # first fit, longest first
            for i, room in enumerate(bins):
                if room >= x:
                    bins[i] -= x
                    break
            else:
                bins.append(4096 - x)
            if len(bins) > 2000:
                break
        else:
            assert used <= 1.01 * len(bins) + 1
        assert used >= -(-int(sizes.sum()) // 4096)


def test_best_configuration_is_the_knapsack_optimum():
    lengths, price = np.array([3, 5, 7]), np.array([3.1, 5.5, 7.2])
    for most in ((9, 9, 9), (1, 1, 1), (2, 0, 1), (0, 3, 0)):
        best = packing.best_configuration(price, lengths, np.array(most), 17)
        brute = max(a * 3.1 + b * 5.5 + c * 7.2 for a in range(most[0] + 1) for b in range(most[1] + 1) for c in range(most[2] + 1) if 3 * a + 5 * b + 7 * c <= 17)
        assert (best * lengths).sum() <= 17 and (best <= most).all() and abs((best * price).sum() - brute) < 1e-9


def test_the_program_places_nearly_all_tokens():
    import pyarrow.parquet as pq

    texts = pq.read_table("/root/testdata/sf0.1/documents.parquet").column("text").to_pylist()
    ids = [len(x) // 4 for x in packing.encoder(queries.packing_tokenizer()).encode([t or "" for t in texts], 1)]
    sizes = [y for n in ids for y in [4096] * (n // 4096) + ([n % 4096] if n % 4096 else [])]
    lengths, counts = np.unique(sizes, return_counts=True)
    program = packing.by_program(lengths, counts)
    placed = sum(int((a * b).sum()) * times for a, b, times in program if len(a) > 1 or a[0] < 4096)
    assert placed >= 0.9 * (lengths * counts)[lengths < 4096].sum()
    plan = packing.plan_sequences(lengths, counts)
    assert sum(x[2] for x in plan) == -(-int((lengths * counts).sum()) // 4096)
    # the plan begins with the program's configurations
    assert [x[2] for x in plan[: len(program)]] == [x[2] for x in program]


def test_words_that_differ_in_case_or_marks_are_met_once(monkeypatch):
    import pyarrow as pa

    enc, met = packing.WordEncoder(queries.packing_tokenizer()), []
    new = enc._new
    monkeypatch.setattr(enc, "_new", lambda words: met.extend(words) or new(words))
    texts = ["Zutzer zutzer, ZUTZER!!\n(x) zutzer.\t9a", None, "", "naïve Naïve. zutzer$$$ don't \x0b\x1c x1", " a" * 100]
    got = enc.encode(pa.array(texts), 1)
    assert got == [np.array([*enc.tokenizer.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4").tobytes() for t in texts]
    assert met.count("zutzer") == 1 and not {"Zutzer", "zutzer,", "ZUTZER!!", "zutzer$$$"} & set(met)
    assert enc.encode(pa.array(texts).slice(1, 3), None) == [x[:-4] for x in got[1:4]] and enc.encode([], 1) == []
