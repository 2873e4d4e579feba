import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from revlens.llm import infill, queries
from tests.llm.conftest import AWKWARD


def brute(id_, text, seed=7, rate=100, spm=50):
    """Lines, form, prefix, middle and output by slicing lists of lines."""
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if id_ is None else id_}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_query_matches_brute_force(spark, sf_dir, documents):
    rows = {r["doc_id"]: r for r in queries.op13_displacement_infill(spark, sf_dir).collect()}
    assert len(rows) == len(documents) and {r["form"] for r in rows.values()} >= {"psm", "spm"}
    for id_, text, _ in documents:
        n, form, p, m, out = brute(id_, text)
        assert tuple(rows[id_]) == (id_, n, form, p, m, sha(out), sha(text or ""))


TRICKY = [(20, "<P>\n"), (21, "a<\nS>b\n<"), (22, "<<P\n>\n<M"), (23, "\n\n\n"), (24, "no break"), (25, "é\n🙂\nﬁn"), (26, "<M>"), (27, "x\n" * 5_000 + "end")]


@pytest.mark.parametrize("width", [7, 1 << 20])
def test_awkward_rows_and_slices(spark, awkward, no_documents, monkeypatch, width):
    more = spark.createDataFrame([(i, t, "a") for i, t in TRICKY], "doc_id long, text string, source string")
    # a session's workers don't see the patch: the width goes through the plain functions below
    rows = infill.restore(infill.fill_in_middle(awkward.unionByName(more, allowMissingColumns=True))).collect()
    want = [(i, t or "", *brute(i, t)) for i, t, *_ in [*AWKWARD, *TRICKY]]
    got = [(r["doc_id"], r["restored"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in rows]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert infill.restore(infill.fill_in_middle(no_documents)).count() == 0
    monkeypatch.setattr(infill, "SLICE", width)
    check([t for _, t in TRICKY], [(0, 3), (1, 1), (2, 5), (1, 3), (0, 1), (1, 2), (0, 0), (17, 4_000)], [1, 2, 1, 2, 2, 1, 0, 1])


def check(texts, cuts, forms):
    """The scans, the scatter and the gather on texts, against slices of lists of lines."""
    import pyarrow as pa

    buf, at = infill.buffer_of(pa.array([None, *texts])[1:])
    n, before = infill.count_units(buf, at)
    units = [re.findall(r"[^\n]*\n|[^\n]+", t) for t in texts]
    assert n.tolist() == [len(u) for u in units]
    marked = {int(r) for r in infill.marks_in(buf, at)[1]}
    assert marked == {i for i, t in enumerate(texts) if re.search("<[PSM]>", t)}
    a, b = (np.minimum(np.array([c[k] for c in cuts]), n) for k in (0, 1))
    form = np.array([0 if i in marked or not t else f for i, (t, f) in enumerate(zip(texts, forms, strict=True))])
    low = np.where(form > 0, infill.unit_ends(buf, at, before, a), at[:-1])
    high = np.where(form > 0, infill.unit_ends(buf, at, before, b), at[1:])
    out, out_at = infill.cut(buf, at, low, high, form)
    outputs = infill.texts_from(out, out_at).to_pylist()
    for t, u, i, j, f, o in zip(texts, units, a, b, form, outputs, strict=True):
        p, m, s = ("".join(x) for x in (u[:i], u[i:j], u[j:]))
        assert o == (t if f == 0 else f"<P>{p}<S>{s}<M>{m}" if f == 1 else f"<S>{s}<P>{p}<M>{m}")
    back, back_at = infill.uncut(out, out_at, form)
    assert infill.texts_from(back, back_at).to_pylist() == texts
    assert infill.chars_before(buf, at).tolist() == np.cumsum([0, *map(len, texts)]).tolist()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="ab<>PSM\né🙂", max_size=40), st.integers(0, 9), st.integers(0, 9), st.integers(0, 2)), min_size=1, max_size=8), st.sampled_from([3, 11, 1 << 20]))
def test_round_trip(rows, width):
    now = infill.SLICE
    infill.SLICE = width
    try:
        check([r[0] for r in rows], [tuple(sorted(r[1:3])) for r in rows], [r[3] for r in rows])
    finally:
        infill.SLICE = now


def test_rates_and_other_ids(spark):
    frame = spark.createDataFrame([(f"d{i}", "a\nb\nc\n") for i in range(400)], "doc_id string, text string")
    rows = infill.fill_in_middle(frame, rate_pct=40, spm_pct=0, seed=3).collect()
    assert {r["form"] for r in rows} == {"plain", "psm"}
    for r in rows:
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == brute(r["doc_id"], "a\nb\nc\n", 3, 40, 0)
