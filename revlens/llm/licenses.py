"""Licence scan: which licences a text names or grants, and where.

Method: a positional index of rare tokens. The templates' words have postings
(template, position); how rare a word is, is counted over all documents. A
file's licence words are taken from the rarest on. Those that lead a template
(the rarest word of its first key phrase, without which it can't match) are
looked up; the postings of the phrase's other words, again rarest first, are
intersected with theirs by relative position, which leaves the places where
the phrase stands. At each place the template's other key phrases must stand
near where the template has them (``SLACK`` words of play), and the share of
the template's words found near their positions, weighted by rarity, must
reach the template's least score. So no candidate is cut off: every match has
its key phrases, and every place of the first one is looked at.

Base phrases are templates of one phrase; they match exactly and score 1.

The first pass over the texts counts documents per template word (a row per
task and word, then at most one row a word for the driver); the second scans.
A text is split into words in slices, and of a text only the template words'
positions are held, and only if it has a leading word.

Defined cases: a null or empty text has no words, no labels and score 0; a
null id is kept; rows are scanned each on its own, so repeated rows count as
documents of their own; overlapping places all count; other columns are left
out. An empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from revlens.llm.common import batches, small_batches

#: Words of play around a template's positions.
SLACK = 6
#: Bytes of a text that are split into words at once.
SLICE = 1 << 20
#: Words are runs of digits, ASCII letters (in lower case) and all code points from 0x80 on.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


@dataclass(frozen=True)
class Template:
    """A licence's wording. ``keys`` must stand in it and in every match."""
    label: str
    text: str
    keys: tuple[str, ...]
    least: float = 0.8
    base: bool = False


def phrase(label: str, text: str) -> Template:
    return Template(label, text, (text,), 1.0, True)


# Phrases that name a licence family.
BASE = (phrase("mit", "mit license"), phrase("apache", "apache license"), phrase("gpl", "general public license"))

# Wording of common public licences' notices and grants.
NOTICES = (
    Template("apache-2.0", "licensed under the apache license version 2.0", ("apache license version 2.0",)),
    Template("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at apache.org/licenses/license-2.0",
             ("except in compliance with the license", "apache.org/licenses/license-2.0")),
    Template("mit", "released under the mit license", ("the mit license",)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in "
             "the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and/or sell copies of the software",
             ("permission is hereby granted free of charge", "to deal in the software without restriction")),
    Template("gpl-2.0", "gnu general public license version 2", ("general public license version 2",)),
    Template("gpl-2.0", "under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
             ("general public license as published by the free software foundation", "version 2 of the license")),
    Template("gpl-3.0", "gnu general public license version 3", ("general public license version 3",)),
    Template("gpl-3.0", "under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
             ("general public license as published by the free software foundation", "version 3 of the license")),
    Template("lgpl", "gnu lesser general public license", ("lesser general public license",)),
    Template("agpl", "gnu affero general public license", ("affero general public license",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
             ("redistribution and use in source and binary forms", "following conditions are met")),
    Template("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without "
             "specific prior written permission", ("to endorse or promote products derived from this software",), 0.7),
    Template("isc", "permission to use copy modify and/or distribute this software for any purpose with or without fee is hereby granted",
             ("for any purpose with or without fee is hereby granted",)),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2.0", ("mozilla public license v 2.0",), 0.6),
    Template("epl-2.0", "made available under the terms of the eclipse public license 2.0", ("eclipse public license 2.0",), 0.6),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software released into the public domain",)),
    Template("boost-1.0", "distributed under the boost software license version 1.0", ("boost software license version 1.0",)),
    Template("cc0-1.0", "cc0 1.0 universal", ("cc0 1.0",), 0.6),
    Template("cc-by-4.0", "licensed under cc by 4.0", ("cc by 4.0",), 0.6),
    Template("cc-by-sa-4.0", "licensed under cc by-sa 4.0", ("cc by-sa 4.0",), 0.6),
    Template("cc-by-nd-4.0", "licensed under cc by-nd 4.0", ("cc by-nd 4.0",), 0.6),
    Template("cc-by-nc-4.0", "licensed under cc by-nc 4.0", ("cc by-nc 4.0",), 0.6),
    Template("cc-by-nc-sa-4.0", "licensed under cc by-nc-sa 4.0", ("cc by-nc-sa 4.0",), 0.6),
    Template("cc-by-4.0", "creative commons attribution 4.0 international license", ("creative commons attribution 4.0",)),
    Template("cc-by-sa-4.0", "creative commons attribution sharealike 4.0 international license", ("creative commons attribution sharealike 4.0",)),
    Template("cc-by-nc-4.0", "creative commons attribution noncommercial 4.0 international license", ("creative commons attribution noncommercial 4.0",)),
)
TEMPLATES = BASE + NOTICES


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(WORD_BYTES).split()


def word_slices(raw: bytes, width: int) -> Iterator[list[bytes]]:
    """The words of a text, some ``width`` bytes at a time (a longer word whole)."""
    raw = raw.translate(WORD_BYTES)
    at = 0
    while at < len(raw):
        to = len(raw)
        if at + width < to:
            to = raw.rfind(b" ", at, at + width)
            if to <= at:
                to = raw.find(b" ", at + width)
                to = len(raw) if to < 0 else to
        yield raw[at:to].split()
        at = to


def near(places: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For each interval, whether one of the sorted places lies in it."""
    return np.searchsorted(places, high, side="right") > np.searchsorted(places, low, side="left")


class Index:
    """The templates' postings, with words ordered by rarity."""

    def __init__(self, templates: tuple[Template, ...], rarity: dict[bytes, float]):
        self.rarity = rarity
        self.codes = {w: k for k, w in enumerate(vocabulary(templates))}
        self.weight = np.array([rarity[w] for w in self.codes])
        self.templates, self.leads = [], {}
        for n, t in enumerate(templates):
            text = [self.codes[w] for w in words_of(t.text)]
            keys = []
            for key in t.keys:
                words = [self.codes.get(w, -1) for w in words_of(key)]
                begins = [i for i in range(len(text) - len(words) + 1) if text[i : i + len(words)] == words]
                if not words or not begins:
                    raise ValueError(f"key phrase {key!r} doesn't stand in its template")
                # the phrase's words by falling rarity; equally rare ones in the order of the vocabulary
                keys.append((begins[0], sorted(enumerate(words), key=lambda x: (-self.weight[x[1]], x[1], x[0]))))
            self.templates.append((t, text, keys))
            self.leads.setdefault(keys[0][1][0][1], []).append(n)
        self.lead_words = {w for w, k in self.codes.items() if k in self.leads}

    def starts(self, key, places: dict[int, np.ndarray]) -> np.ndarray:
        """Where a phrase stands: its words' places intersected by relative position."""
        _, words = key
        none = np.zeros(0, dtype=np.int64)
        at = None
        for offset, code in words:
            here = places.get(code, none) - offset
            at = here if at is None else at[np.isin(at, here, assume_unique=True)]
            if not len(at):
                return none
        return at[at >= 0]

    def find(self, places: dict[int, np.ndarray], slack: int) -> list[tuple]:
        """(template, places, first, last, score) of the templates that match,
        given the sorted places of a file's licence words."""
        out = []
        known: dict[tuple, np.ndarray] = {}
        for code in sorted(places, key=lambda c: (-self.weight[c], c)):
            for n in self.leads.get(code, ()):
                t, text, keys = self.templates[n]
                name = words_key(keys[0])
                if name not in known:
                    known[name] = self.starts(keys[0], places)
                first = known[name]
                begin = first - keys[0][0]  # where the template would begin
                for key in keys[1:]:
                    if len(begin):
                        other = self.starts(key, places)
                        ok = near(other, begin + key[0] - slack, begin + key[0] + slack)
                        first, begin = first[ok], begin[ok]
                if not len(begin):
                    continue
                if t.base:
                    score = np.ones(len(begin))
                else:
                    score, total = np.zeros(len(begin)), 0.0
                    for q, c in enumerate(text):
                        total += self.weight[c]
                        if c in places:
                            score += self.weight[c] * near(places[c], begin + q - slack, begin + q + slack)
                    score = np.minimum(score / total, 1.0)
                    first, score = first[score >= t.least], score[score >= t.least]
                if len(first):
                    out.append((n, len(first), int(first.min()), int(first.max()), float(score.max())))
        return sorted(out)


def words_key(key) -> tuple:
    return tuple(key[1])


def vocabulary(templates: tuple[Template, ...]) -> list[bytes]:
    """The templates' words, in byte order."""
    return sorted({w for t in templates for w in words_of(t.text)})


def document_counts(docs: DataFrame, templates: tuple[Template, ...]) -> tuple[int, dict[bytes, int]]:
    """Documents, and documents that hold each template word, over all rows of (id, text)."""
    words = vocabulary(templates)
    known = set(words)
    code = {w: k for k, w in enumerate(words)}
    build = batches({"word": pa.int32(), "n": pa.int64()})

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in small_batches(it):
            for raw in batch.column("text").cast(pa.binary()).to_pylist():
                counts[-1] += 1
                if raw:
                    held: set[bytes] = set()
                    for part in word_slices(raw, SLICE):
                        held |= known.intersection(part)
                    counts.update(code[w] for w in held)
        yield build(list(counts), list(counts.values()))

    rows = docs.select("text").mapInArrow(run, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()  # a row a template word
    n = {r["word"]: r["n"] for r in rows}
    return n.get(-1, 0), {w: n.get(k, 0) for k, w in enumerate(words)}


def rarity_of(documents: int, counts: dict[bytes, int]) -> dict[bytes, float]:
    """Inverse document frequency, above 0 for every word."""
    return {w: float(np.log1p((documents + 1) / (n + 1))) for w, n in counts.items()}


FOUND = T.ArrayType(T.StructType([
    T.StructField("label", T.StringType()), T.StructField("base", T.BooleanType()), T.StructField("places", T.LongType()),
    T.StructField("first", T.LongType()), T.StructField("last", T.LongType()), T.StructField("score", T.DoubleType())]))


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text", slack: int = SLACK) -> DataFrame:
    """A row per document: ``id_col``, n_words and found, an entry for each
    template that matches: its label, whether it is a base phrase, how many
    places it has, the first and last (words from 0) and its best score."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rarity = rarity_of(*document_counts(rows, templates))
    index = Index(templates, rarity)
    codes, leads = index.codes, index.lead_words
    labels = [(t.label, t.base) for t in templates]
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_words", T.LongType()), T.StructField("found", FOUND)])
    found_type = pa.list_(pa.struct([("label", pa.string()), ("base", pa.bool_()), ("places", pa.int64()), ("first", pa.int64()), ("last", pa.int64()), ("score", pa.float64())]))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(it):
            counts, found = [], []
            for raw in batch.column("text").cast(pa.binary()).to_pylist():
                n, places = places_of(raw or b"", codes, leads, SLICE)
                counts.append(n)
                found.append([dict(zip(("label", "base", "places", "first", "last", "score"), (*labels[t], *rest), strict=True)) for t, *rest in index.find(places, slack)] if places else [])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(counts, type=pa.int64()), pa.array(found, type=found_type)], names=schema.names)

    return rows.mapInArrow(run, schema)


def places_of(raw: bytes, codes: dict[bytes, int], leads: set[bytes], width: int) -> tuple[int, dict[int, np.ndarray]]:
    """A text's number of words, and the sorted places of its licence words
    (nothing if it has no leading word)."""
    n, led, at, code = 0, False, [], []
    whole = len(raw) <= width
    for words in word_slices(raw, width):
        here = not leads.isdisjoint(words)
        led |= here
        if here or not whole:
            hits = [(k, codes[w]) for k, w in enumerate(words) if w in codes]
            if hits:
                pairs = np.array(hits, dtype=np.int64)
                at.append(pairs[:, 0] + n)
                code.append(pairs[:, 1].astype(np.int16))
        n += len(words)
    if not led:
        return n, {}
    at, code = np.concatenate(at), np.concatenate(code)
    order = np.argsort(code, kind="stable")
    at, code = at[order], code[order]
    ends = np.flatnonzero(np.diff(code, append=-1)) + 1
    return n, {int(code[a]): at[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)}


def labels(scanned: DataFrame) -> DataFrame:
    """The scan's rows with n_base, first_word, last_word, base_labels, labels
    (distinct, sorted, comma-joined) and score in place of ``found``."""
    base = F.filter("found", lambda x: x["base"])
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda x: x["label"]))), ",")
    return scanned.select(
        *[F.col(f"`{c}`") for c in scanned.columns if c != "found"],
        F.aggregate(base, F.lit(0).cast("long"), lambda a, x: a + x["places"]).alias("n_base"),
        F.array_min(F.transform(base, lambda x: x["first"])).alias("first_word"),
        F.array_max(F.transform(base, lambda x: x["last"])).alias("last_word"),
        joined(base).alias("base_labels"), joined(F.col("found")).alias("labels"),
        F.coalesce(F.array_max(F.transform("found", lambda x: x["score"])), F.lit(0.0)).alias("score"))
