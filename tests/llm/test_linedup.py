import random

from revlens.llm import linedup, queries
from tests.llm.conftest import AWKWARD


def brute(docs, min_chars=linedup.MIN_CHARS):
    """Aligns each document with every earlier one that is the first to have
    one of its lines."""
    rows = sorted(docs, key=lambda d: (d[0] is None, d[0]))
    split = [(d[1] or "").split("\n") for d in rows]
    bare = [[x.strip(" \t\r\f\x0b") for x in ls] for ls in split]
    first, out = {}, []
    for n, (row, ls) in enumerate(zip(rows, split, strict=True)):
        wanted = {first[x] for x, y in zip(bare[n], ls, strict=True) if len(y) >= min_chars and x in first}
        gone = set()
        for m in wanted:
            gone |= set(linedup.common_blocks(bare[m], bare[n], [len(x) for x in ls], min_chars))
        for x, y in zip(bare[n], ls, strict=True):
            if len(y) >= min_chars:
                first.setdefault(x, n)
        out.append((row[0], row[1] if not gone else "\n".join(x for i, x in enumerate(ls) if i not in gone)))
    return sorted(out, key=repr)


def test_query_matches_brute_force(spark, sf_dir, documents):
    rows = queries.op10_line_dedup(spark, sf_dir).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in rows), key=repr) == brute([d[:2] for d in documents])
    assert any(r["n_removed"] for r in rows) and all(0 <= r["n_removed"] <= r["n_lines"] for r in rows)


def test_common_lines_take_the_second_round(spark):
    rng = random.Random(2)
    lines = [f"this is the shared line number {i} of them all" for i in range(40)]
    docs = [(i, "\n".join([*(lines[k] for k in sorted(rng.sample(range(40), 12))), f"an own line that only document {i} has"])) for i in range(90)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    want = brute(docs)
    for rare in (1, 20, 1000):
        got = sorted(((r["doc_id"], r["text"]) for r in linedup.dedup_lines(frame, rare=rare).collect()), key=repr)
        left = {x for _, t in got for x in t.split("\n")}
        assert left == {x for _, t in docs for x in t.split("\n")}  # nothing vanishes
        if rare == 1000:
            assert got == want


def test_awkward_rows(awkward, no_documents):
    out = linedup.dedup_lines(awkward, min_chars=5)
    rows = out.collect()
    assert len(rows) == len(AWKWARD) and set(awkward.columns) <= set(out.columns)
    assert sorted((r["text"] or "") for r in rows if r["doc_id"] in (4, 5)) == ["", "", "one two  three\n\nfour"]
    assert [r["text"] for r in rows if r["doc_id"] == 1] == [None] and next(r for r in rows if r["doc_id"] == 10)["text"] == "five"
    assert linedup.dedup_lines(no_documents).count() == 0


def test_patience_is_an_alignment():
    rng = random.Random(9)
    for _ in range(200):
        a, b = ([rng.randrange(12) for _ in range(rng.randrange(15))] for _ in range(2))
        pairs = linedup.patience(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
    assert len(linedup.patience(list(range(500)), [*range(100, 500), *range(100)])) == 400


def brute_all(docs, min_chars=linedup.MIN_CHARS):
    """Deletes every line in a run of ``min_chars`` that any earlier document
    has, from the definition and without the module's alignment."""
    rows = sorted(docs, key=lambda d: (d[0] is None, d[0] or 0))
    bare = [[x.strip(" \t\r\f\x0b") for x in (d[1] or "").split("\n")] for d in rows]
    out = []
    for n, (i, text) in enumerate(rows):
        ls, gone = (text or "").split("\n"), set()
        held = {tuple(b[s:t]) for b in bare[:n] for s in range(len(b)) for t in range(s + 1, len(b) + 1)}
        for s in range(len(ls)):
            for t in range(s + 1, len(ls) + 1):
                if sum(map(len, ls[s:t])) >= min_chars and tuple(bare[n][s:t]) in held:
                    gone |= set(range(s, t))
        out.append((i, text if not gone else "\n".join(x for k, x in enumerate(ls) if k not in gone)))
    return sorted(out, key=repr)


def texts_after(spark, docs, **settings):
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    return sorted(((r["doc_id"], r["text"]) for r in linedup.dedup_lines(frame, **settings).collect()), key=repr)


L, K = "a long line that many documents share", "another long line of some documents"


def test_repeated_and_reordered_lines_go(spark):
    docs = [(1, f"{L}\n{K}\nmine"), (2, f"{L}\nx\n{L}\ny\n{L}\n{K}\n{K}"), (3, f"{K}\nz\n{L}"), (4, f"{L}\n{L}\nw\n{L}")]
    got = texts_after(spark, docs)
    assert got == brute_all(docs) == [(1, docs[0][1]), (2, "x\ny"), (3, "z"), (4, "w")]


def test_passages_of_short_lines_go(spark):
    verse = [f"verse {k} of it" for k in range(8)]
    docs = [(1, "\n".join(["own", *verse])), (2, "\n".join([*verse, "else"])), (3, "\n".join(verse)), (4, "\n".join(["p", *verse[2:5], "q", verse[7]])), (None, "日本語の短い行\n二つ目の短い行です\n三つ目\n四つ目の行です"), (5, "日本語の短い行\n二つ目の短い行です\n三つ目\n四つ目の行です")]
    got = texts_after(spark, docs)
    assert got == brute_all(docs) and dict(got) == {1: docs[0][1], 2: "else", 3: "", 4: f"p\nq\n{verse[7]}", 5: docs[5][1], None: ""}


def test_any_rare_gives_the_same(spark):
    docs = [(0, f"{L}\ns1\ns2"), (1, f"{K}\n{L}"), (2, f"{K}\n{L}\ns1\ns2"), (3, f"s0\n{L}\ns1"), (4, f"s0\n{L}\ns1\nnew"), *((i, f"own {i}\n{L}") for i in range(5, 75))]
    want = brute_all(docs)
    assert dict(want)[2] == K[:0] and dict(want)[4] == "new"
    for rare in (1, 8, 64, 1000):
        assert texts_after(spark, docs, rare=rare) == want


def test_random_documents_match_all_pairs(spark):
    rng = random.Random(5)
    lines = ["", "a", "bb ", "ccc", " dddd", "eeeee", "ffffff", "a line of twelve", "a line of more than twelve"]
    docs = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randrange(1, 9)))) for i in range(60)]
    want = brute_all(docs, 12)
    for rare in (1, 5, 1000):
        assert texts_after(spark, docs, rare=rare, min_chars=12) == want
