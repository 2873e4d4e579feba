import math
import re

import pytest

from revlens.llm import licenses, queries
from revlens.llm.licenses import TEMPLATES, Template, phrase
from tests.llm.conftest import AWKWARD

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(texts, templates=TEMPLATES, slack=licenses.SLACK):
    """Every template tried at every word of every text."""
    split = [words(t) for t in texts]
    sets = [set(w) for w in split]
    rarity = {w: math.log1p((len(texts) + 1) / (sum(w in s for s in sets) + 1)) for t in templates for w in words(t.text)}
    out = []
    for doc in split:
        found = []
        stands = {}
        for t in templates:
            text, keys = words(t.text), [words(k) for k in t.keys]
            for k in keys:
                stands.setdefault(tuple(k), [i for i in range(len(doc)) if doc[i : i + len(k)] == k])
            offset = [next(i for i in range(len(text)) if text[i : i + len(k)] == k) for k in keys]
            hits = []
            for i in stands[tuple(keys[0])]:
                begin = i - offset[0]
                if all(any(abs(j - begin - o) <= slack for j in stands[tuple(k)]) for k, o in zip(keys[1:], offset[1:], strict=True)):
                    got = sum(rarity[w] for q, w in enumerate(text) if w in doc[max(0, begin + q - slack) : max(0, begin + q + slack + 1)])
                    score = 1.0 if t.base else got / sum(rarity[w] for w in text)
                    if score >= t.least - 1e-12:
                        hits.append((i, score))
            if hits:
                found.append((t.label, t.base, len(hits), min(hits)[0], max(hits)[0], round(min(1.0, max(s for _, s in hits)), 9)))
        out.append((len(doc), found))
    return out


def rounded(row):
    return row["n_words"], [(*tuple(x)[:5], round(x["score"], 9)) for x in row["found"]]


def digest(n, found):
    base = [f for f in found if f[1]]
    join = lambda x: ",".join(sorted({f[0] for f in x}))
    return (n, sum(f[2] for f in base), min((f[3] for f in base), default=None), max((f[4] for f in base), default=None), join(base), join(found), max((f[5] for f in found), default=0.0))


def test_query_matches_brute_force(spark, sf_dir, documents):
    rows = {r["doc_id"]: r for r in queries.op11_license_scan(spark, sf_dir).collect()}
    assert len(rows) == len(documents)
    for (id_, text, _), (n, found) in zip(documents, brute([d[1] for d in documents]), strict=True):
        r = rows[id_]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"], round(r["score"], 9)) == digest(n, found)


MIT = TEMPLATES[6].text
TEXTS = [
    "Released under the MIT License.", "the MIT-License, the mit\nlicense and the mit  license", "MIT licenses; Permit license", "Licensed under CC BY-NC 4.0.", "cc by nc sa 4.0",
    "Licensed, today, under the very new Apache License, Version 2.0.", "Apache License 2.0", "GNU General Public License, version 3. Lesser General Public License",
    "MIT " * 50 + "license " * 50, "Copyright (c) X\n" + MIT.replace(" ", "  ").upper(), "Permission is hereby granted, free of charge, to any person. " + "word " * 40 + "to deal in the Software without restriction",
    "Permission is hereby granted, free of charge, to all who deal in it", "é" * 10 + "mit license" + "ü" * 10, "mit license", "license mit license apache license mit license", "general public", "",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "neither the name of Example Inc. nor the names of others may be used to endorse or promote products derived from this software without specific prior written permission",
]


@pytest.mark.parametrize("width", [5, 1 << 20])
def test_places_in_slices(width):
    code = {w: k for k, w in enumerate(licenses.vocabulary(TEMPLATES))}
    for text in TEXTS:
        n, places = licenses.places_of(text.encode(), code, {b"mit", b"license", b"free", b"cc"}, width)
        split = [w.encode() for w in words(text)]
        assert n == len(split)
        if {b"mit", b"license", b"free", b"cc"} & set(split):
            assert {c: p.tolist() for c, p in places.items()} == {code[w]: [i for i, x in enumerate(split) if x == w] for w in set(split) & set(code)}
        else:
            assert not places


def test_templates_against_brute_force(spark):
    got = licenses.scan(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")).collect()
    want = brute(TEXTS)
    for r in got:
        assert rounded(r) == want[r["doc_id"]], TEXTS[r["doc_id"]]
    named = {TEXTS[i][:12]: {f[0] for f in found} for i, (_, found) in enumerate(want)}
    assert named["Released und"] == {"mit"} and named["Licensed und"] == {"cc-by-nc-4.0"} and named["Licensed, to"] == {"apache", "apache-2.0"}
    assert named["Redistributi"] == {"bsd"} and named["neither the "] == {"bsd-3-clause"} and named["Copyright (c"] == {"mit"} and not named["Permission i"]


def test_other_templates_and_slack(spark):
    own = (phrase("x", "a a b"), Template("y", "one two three four five", ("two three", "five"), 0.7))
    texts = ["a a a b a a b", "one two three four five", "two three and four or five", "two three " + "z " * 9 + "five", "one two three four", None]
    for slack in (0, 2, 20):
        got = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), own, slack=slack).collect()
        assert sorted((r["doc_id"], *rounded(r)) for r in got) == [(i, n, f) for i, (n, f) in enumerate(brute(texts, own, slack))]
    with pytest.raises(ValueError):
        licenses.Index((Template("z", "a b", ("c",)),), {b"a": 1.0, b"b": 1.0, b"c": 1.0})


def test_awkward_rows(spark, awkward, no_documents):
    got = sorted(((r["doc_id"], *rounded(r)) for r in licenses.scan(awkward).collect()), key=repr)
    want = brute([r[1] for r in AWKWARD])
    assert got == sorted(((r[0], n, f) for r, (n, f) in zip(AWKWARD, want, strict=True)), key=repr)
    assert licenses.labels(licenses.scan(no_documents)).count() == 0
    long = spark.createDataFrame([(1, "mit license " * 300_000), (2, "x" * 3_000_000 + " MIT license"), (3, None)], "doc_id long, text string")
    rows = sorted(tuple(r) for r in licenses.labels(licenses.scan(long)).collect())
    assert rows == [(1, 600_000, 300_000, 0, 599_998, "mit", "mit", 1.0), (2, 3, 1, 1, 1, "mit", "mit", 1.0), (3, 0, 0, None, None, "", "", 0.0)]
