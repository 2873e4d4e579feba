"""LM scoring by a hashed maximum-entropy model.

A token's probability is its class's, given the tokens before it, times its
share of the class: a softmax factored by classes. The class's log-odds add up
weights of hashed features of the history: the last token, the one before it
(a skip), both together, and the third last (a longer skip). Words are hashed
by their ends (first two and last three letters), so tables are bounded
whatever the vocabulary; words of a kind share them.

1. Texts are cut into chunks, each with a dictionary of its own. Joining the
   dictionaries by word gives every chunk the corpus counts of its words
   without a table of all words in one place.
2. One pass gathers each hashed word's neighbours over all training tokens;
   words of like neighbours form the classes (k-means on the driver, over a
   table of fixed size).
3. Further passes gather, per feature and class, what the training tokens show
   and what the model expects of them. Weights start from the shown shares and
   move by the gradient (shown minus expected) over the expected counts.
4. All texts are scored in sparse numpy batches.

Tokens are words in A-Z lower case, and one end for each text. A token that
training doesn't know is one event, as in the base score, of the probability
that a training token comes but once. Probabilities of all known tokens and of
the unknown one add up to 1.

Defined cases: null text is empty and has its end only; rows without an id are
held out; repeated rows are learned and scored each on its own; without
training tokens every token scores 0; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from revlens.llm.common import small_batches, stage

#: The end of a text; no word is empty.
END = b""
#: Hashed words; hashed features of each kind; neighbour columns; classes.
BUCKETS, FEATURES, NEIGHBOURS, CLASSES = 1 << 14, 1 << 14, 48, 24
#: Text bytes of a chunk; gradient rounds; tokens of a numpy batch.
CHUNK_BYTES, ROUNDS, TOKENS = 4 << 20, 2, 1 << 14
#: Tokens whose probabilities are added up at once.
ADDED = 1 << 17
RATE, PRIOR = 0.7, 2.0
#: Rows of a parameter table that travel together.
BLOCK = 1 << 10


def words_of(text: str) -> list[bytes]:
    """UTF-8 words. Bytes are lower-cased in A-Z only, and split at the six
    ASCII blanks only."""
    return text.encode("utf-8", "replace").lower().split()


def bucket_of(word: bytes) -> int:
    """The hashed kind of a word: its first two and last three letters."""
    if not word:
        return 0
    if word.isascii():
        ends = word[:2] + b"\x00" + word[-3:]
    else:
        letters = word.decode()
        ends = f"{letters[:2]}\x00{letters[-3:]}".encode()
    return 1 + zlib.crc32(ends) % (BUCKETS - 1)


class Places(dict):
    """Numbers words in the order in which they are met."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


# -- chunks with dictionaries -------------------------------------------------

CHUNK_SCHEMA = "chunk long, ids array<long>, held array<boolean>, lengths array<int>, tokens binary, words array<string>, counts array<int>, buckets binary"
_ARROW_CHUNK = pa.schema([("chunk", pa.int64()), ("ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("lengths", pa.list_(pa.int32())),
                          ("tokens", pa.binary()), ("words", pa.list_(pa.string())), ("counts", pa.list_(pa.int32())), ("buckets", pa.binary())])


def chunks(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """A row per chunk of (id, text, held): its documents' tokens as numbers of
    its own dictionary, and the dictionary with training counts and buckets."""

    def row(number: int, ids: list, held: list, texts: list[str]) -> pa.RecordBatch:
        place = Places()
        parts, lengths = [], []
        for text in texts:
            tokens = words_of(text)
            tokens.append(END)
            parts.append(np.fromiter(map(place.__getitem__, tokens), dtype=np.int32, count=len(tokens)))
            lengths.append(len(tokens))
        tokens = np.concatenate(parts)
        learned = np.repeat(~np.array(held, dtype=bool), lengths)
        counts = np.bincount(tokens[learned], minlength=len(place)).astype(np.int32)
        buckets = np.fromiter(map(bucket_of, place), dtype="<u2", count=len(place))
        values = (number, ids, held, lengths, tokens.astype("<i4").tobytes(), [w.decode() for w in place], counts, buckets.tobytes())
        return pa.RecordBatch.from_arrays([pa.array([v], type=f.type) for v, f in zip(values, _ARROW_CHUNK, strict=True)], schema=_ARROW_CHUNK)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids, held, texts, size = [], [], [], 0
        for batch in small_batches(it, most_bytes=chunk_bytes // 2):
            ids += batch.column("id").to_pylist()
            held += batch.column("held").to_pylist()
            found = [t or "" for t in batch.column("text").to_pylist()]
            texts += found
            size += sum(map(len, found))
            if size >= chunk_bytes:
                yield row(number, ids, held, texts)
                number, ids, held, texts, size = number + 1, [], [], [], 0
        if ids:
            yield row(number, ids, held, texts)

    return docs.mapInArrow(run, CHUNK_SCHEMA)


def with_corpus_counts(parts: DataFrame) -> tuple[DataFrame, dict]:
    """(chunk, i, c): corpus counts of the words of each chunk's dictionary, and the corpus's sums.

    A word has one row per chunk that it is in, whatever its frequency.
    """
    entries = parts.select("chunk", F.posexplode("words").alias("i", "word"), "counts").select("chunk", "i", "word", F.get("counts", F.col("i")).alias("n"))
    same_word = Window.partitionBy("word")
    counted = entries.withColumn("c", F.sum("n").over(same_word)).withColumn("nth", F.row_number().over(same_word.orderBy("chunk")))
    counted = stage(counted.select("chunk", "i", "c", (F.col("nth") == 1).alias("first")), "lm-counts")
    once = F.col("first") & (F.col("c") > 0)
    sums = counted.where(once).agg(F.sum("c").alias("N"), F.count(F.lit(1)).alias("V"), F.sum((F.col("c") == 1).cast("long")).alias("once")).first()
    return counted.select("chunk", "i", "c"), {k: int(sums[k] or 0) for k in ("N", "V", "once")}


# -- the model ------------------------------------------------------------------

@dataclass
class Model:
    class_of: np.ndarray  # of each bucket
    weights: list[np.ndarray]  # per kind of feature: (FEATURES, CLASSES)
    bias: np.ndarray
    mass: np.ndarray  # training tokens of each class
    unknown: float  # probability of the unknown token
    tokens: int = field(default=0)


def features(kind: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """Hashed features of each token's history. ``kind``: buckets of tokens end
    to end, ``first``: where texts begin (their history is ends)."""
    def back(n: int) -> np.ndarray:
        out = np.zeros_like(kind)
        out[n:] = kind[:-n] if n < len(kind) else kind[:0]
        for k in range(n):  # tokens nearer than n to their text's begin
            at = first + k
            out[at[at < len(out)]] = 0
        return out

    one, two, three = back(1).astype(np.uint32), back(2).astype(np.uint32), back(3).astype(np.uint32)
    pair = (one * np.uint32(0x9E3779B1) ^ two * np.uint32(0x85EBCA77)) >> np.uint32(18)
    skip = (one * np.uint32(0xC2B2AE3D) ^ three * np.uint32(0x27D4EB2F)) >> np.uint32(18)
    return [one.astype(np.uint16), two.astype(np.uint16), pair.astype(np.uint16), skip.astype(np.uint16)]


KINDS = 4


def class_probabilities(found: list[np.ndarray], weights: list[np.ndarray], bias: np.ndarray) -> np.ndarray:
    logits = weights[0].take(found[0], axis=0)
    for f, w in zip(found[1:], weights[1:], strict=True):
        logits += w.take(f, axis=0)
    logits += bias
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=1, keepdims=True)
    return logits


def _added(out: np.ndarray, rows: list[np.ndarray], values: np.ndarray) -> None:
    """Add a column of values (classes x tokens) to the column of each of its
    features (classes x features of all kinds)."""
    for k, found in enumerate(rows):
        cell = found.astype(np.int64)
        for c, v in enumerate(values):
            out[c, k * FEATURES : (k + 1) * FEATURES] += np.bincount(cell, weights=v, minlength=FEATURES)


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per chunk: buckets of its tokens, where texts begin, which tokens are
    learned, tokens as dictionary numbers."""
    for lengths, held, tokens, buckets in zip(*(batch.column(c).to_pylist() for c in ("lengths", "held", "tokens", "buckets")), strict=True):
        number = np.frombuffer(tokens, dtype="<i4")
        kind = np.frombuffer(buckets, dtype="<u2")[number]
        length = np.array(lengths, dtype=np.int64)
        yield kind, np.cumsum(length) - length, np.repeat(~np.array(held, dtype=bool), length), number


def summed(parts: DataFrame, gather, rows: int, columns: int) -> np.ndarray:
    """Add up a (rows, columns) table that ``gather`` makes from the chunks of a
    task. Tables travel in blocks, which are added as they arrive."""
    schema = pa.schema([("block", pa.int32()), ("sums", pa.binary())])

    def make(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((rows, columns), dtype=np.float32)
        for batch in it:
            for at in range(batch.num_rows):
                gather(batch.slice(at, 1), table)
        for k in range(0, rows, BLOCK):
            part = table[k : k + BLOCK]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([k // BLOCK], type=pa.int32()), pa.array([part.tobytes()], type=pa.binary())], schema=schema)

    def add(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in it:
            for block, raw in zip(*(batch.column(c).to_pylist() for c in ("block", "sums")), strict=True):
                part = np.frombuffer(raw, dtype=np.float32).astype(np.float64)
                sums[block] = sums[block] + part if block in sums else part
        for block, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([block], type=pa.int32()), pa.array([total.tobytes()], type=pa.binary())], schema=schema)

    kind = "block int, sums binary"
    found = parts.select("lengths", "held", "tokens", "buckets").mapInArrow(make, kind).repartition("block").mapInArrow(add, kind)
    out = np.zeros((rows, columns))
    # rows / BLOCK rows of fixed size
    for r in found.collect():
        part = np.frombuffer(bytes(r["sums"]), dtype=np.float64).reshape(-1, columns)
        out[r["block"] * BLOCK : r["block"] * BLOCK + len(part)] = part
    return out


def neighbours(parts: DataFrame) -> np.ndarray:
    """Training counts of each bucket, and of its hashed neighbours."""
    half = NEIGHBOURS // 2

    def gather(chunk: pa.RecordBatch, table: np.ndarray) -> None:
        for kind, first, learned, _ in _texts(chunk):
            kind = kind.astype(np.int64)
            inner = np.ones(len(kind), dtype=bool)
            inner[first] = False
            pairs = np.flatnonzero(inner & learned)
            for rows, other, base in ((kind[pairs], kind[pairs - 1], 1), (kind[pairs - 1], kind[pairs], 1 + half)):
                cell = rows * (NEIGHBOURS + 1) + base + (other * 2654435761 >> 7) % half
                table += np.bincount(cell, minlength=table.size).reshape(table.shape)
            cell = kind[learned] * (NEIGHBOURS + 1)
            table += np.bincount(cell, minlength=table.size).reshape(table.shape)

    return summed(parts, gather, BUCKETS, NEIGHBOURS + 1)


def make_classes(table: np.ndarray, classes: int = CLASSES, seed: int = 5) -> np.ndarray:
    """A class for each bucket: k-means on the square roots of its neighbours'
    shares, weighted by its tokens. Buckets that training hasn't go to class 0."""
    weight = table[:, 0]
    shares = np.sqrt(table[:, 1:] / np.maximum(table[:, 1:].sum(axis=1, keepdims=True), 1))
    live = np.flatnonzero(weight > 0)
    out = np.zeros(len(table), dtype=np.int64)
    if not len(live):
        return out
    x, w = shares[live], np.sqrt(weight[live])
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(live), size=min(classes, len(live)), replace=False, p=w / w.sum())]
    for _ in range(25):
        near = ((centres**2).sum(axis=1)[None, :] - 2 * x @ centres.T).argmin(axis=1)
        for k in range(len(centres)):
            mine = near == k
            if mine.any():
                centres[k] = np.average(x[mine], axis=0, weights=w[mine])
    out[live] = near
    return out


def shown_and_expected(parts: DataFrame, class_of: np.ndarray, model: Model | None) -> np.ndarray:
    """Sums over the training tokens of the class shown (no model) or of the
    classes' probabilities (a model), for every feature."""
    spark = parts.sparkSession
    shared = spark.sparkContext.broadcast((class_of, model))

    def gather(chunk: pa.RecordBatch, table: np.ndarray) -> None:
        class_of_, model_ = shared.value
        for kind, first, learned, _ in _texts(chunk):
            found = [f[learned] for f in features(kind, first)]
            if model_ is None:
                shown = class_of_[kind[learned]]
                for k, f in enumerate(found):
                    cell = f.astype(np.int64) * CLASSES + shown
                    table[k * FEATURES : (k + 1) * FEATURES] += np.bincount(cell, minlength=FEATURES * CLASSES).reshape(FEATURES, CLASSES)
                continue
            by_class = np.zeros(table.shape[::-1])
            for at in range(0, len(found[0]), ADDED):
                group = [f[at : at + ADDED] for f in found]
                p = np.empty((CLASSES, len(group[0])))
                for k in range(0, len(group[0]), TOKENS):
                    p[:, k : k + TOKENS] = class_probabilities([f[k : k + TOKENS] for f in group], model_.weights, model_.bias).T
                _added(by_class, group, p)
            table += by_class.T

    return summed(parts, gather, KINDS * FEATURES, CLASSES)


def train(parts: DataFrame, sums: dict, rounds: int = ROUNDS) -> Model:
    """Fit the model on the training tokens of all chunks."""
    table = neighbours(parts)
    class_of = make_classes(table)
    mass = np.bincount(class_of, weights=table[:, 0], minlength=CLASSES)
    bias = np.log((mass + 0.5) / (mass.sum() + 0.5 * CLASSES))
    shown = shown_and_expected(parts, class_of, None)
    prior = np.exp(bias)
    start = np.log((shown + PRIOR * prior) / (shown.sum(axis=1, keepdims=True) + PRIOR)) - bias
    weights = [(start[k * FEATURES : (k + 1) * FEATURES] / KINDS * 1.5).astype(np.float32) for k in range(KINDS)]
    unknown = min(max(sums["once"] / sums["N"], 1e-9), 0.5) if sums["N"] else 1.0
    model = Model(class_of, weights, bias.astype(np.float32), mass, unknown, sums["N"])
    for _ in range(rounds if sums["N"] else 0):
        expected = shown_and_expected(parts, class_of, model)
        step = RATE / KINDS * (shown - expected) / (expected + PRIOR * prior + 0.25 * shown)
        model.weights = [w + step[k * FEATURES : (k + 1) * FEATURES].astype(np.float32) for k, w in enumerate(model.weights)]
    return model


def score_chunks(parts: DataFrame, per_chunk: DataFrame, model: Model, sums: dict, id_col: str) -> DataFrame:
    shared = parts.sparkSession.sparkContext.broadcast(model)
    n, v = sums["N"], sums["V"]
    schema = pa.schema([(id_col, pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def run(chunk: pa.Table, counts: pa.Table) -> pa.Table:
        m = shared.value
        corpus = np.zeros(counts.num_rows)
        corpus[counts.column("i").to_numpy()] = counts.column("c").to_numpy()
        ((kind, first, _, number),) = _texts(chunk)
        count = corpus[number]
        base = np.log10((corpus + 0.1) / (n + 0.1 * (v + 1)))[number]
        found, likely = features(kind, first), np.empty(len(kind))
        for k in range(0, len(kind), TOKENS):
            part = [f[k : k + TOKENS] for f in found]
            p = class_probabilities(part, m.weights, m.bias)
            likely[k : k + TOKENS] = p[np.arange(len(p)), m.class_of[kind[k : k + TOKENS]]]
        with np.errstate(divide="ignore", invalid="ignore"):
            known = np.log10(np.maximum(likely, 1e-30) * (1 - m.unknown) * count / m.mass[m.class_of[kind]])
        token = np.where(count > 0, known, np.log10(m.unknown))
        flat = [chunk.column(c).combine_chunks().flatten() for c in ("ids", "held", "lengths")]
        return pa.Table.from_arrays([
            *flat[:2], flat[2].cast(pa.int64()),
            pa.array(np.add.reduceat((count > 0).astype(np.int64), first)), pa.array(np.add.reduceat(base, first)), pa.array(np.add.reduceat(token, first))], schema=schema)

    # a chunk is one row, its dictionary's counts are bounded by its bytes
    texts, counts = parts.select("chunk", "ids", "held", "lengths", "tokens", "buckets"), per_chunk
    scored = texts.groupBy("chunk").cogroup(counts.groupBy("chunk")).applyInArrow(
        run, f"`{id_col}` long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.withColumn("train_tokens", F.lit(n).cast("long"))


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int = 10, rounds: int = ROUNDS, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Score every text: (id, held_out, n_tokens, n_known, base_score, score,
    train_tokens). Rows whose crc32 of the id leaves 0 aren't learned from."""
    held = F.coalesce(F.crc32(F.col(id_col).cast("string")) % parts == 0, F.lit(True))
    cut = stage(chunks(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), held.alias("held")), chunk_bytes), "lm-chunks")
    per_chunk, sums = with_corpus_counts(cut)
    model = train(cut, sums, rounds)
    return score_chunks(cut, per_chunk, model, sums, id_col)
