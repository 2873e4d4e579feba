"""Quality classifier: a byte-level convolutional network in numpy.

Filters of ``WIDTH`` bytes run over the whole document at every other byte;
the response of a filter is the sum of a learned weight for each byte at each
place. Responses are max-pooled over overlapping chunks (of ``CHUNK`` bytes,
each overlapping the next by half), the chunks' pooled responses are combined
over the document by mean, maximum and minimum, and a logistic layer makes one
probability of them. Mean and minimum show text that repeats itself: its
chunks excite few filters.

The network is fitted by Adam on a bounded sample of labelled rows: at most
``TRAIN_DOCS`` documents in the order of a hash of their id, whole, each that
still fits into ``TRAIN_BYTES`` bytes in all. Every document is scored whole
in Spark tasks.

Defined cases: null and empty texts score by the bias alone; a text shorter
than a filter is padded with zero bytes; without labels of both kinds the
score is their mean (0.5 without any); repeated rows score alike; an empty
table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from revlens.llm.common import batches, small_batches, texts_of

WIDTH, FILTERS, CHUNK = 6, 24, 256
TRAIN_DOCS, TRAIN_BYTES = 3_000, 16 << 20
EPOCHS, BATCH, RATE = 14, 48, 0.01
#: Documents that score below are rejected.
THRESHOLD = 0.3
#: Places per block; a chunk is two blocks, and blocks step through the document.
BLOCK = CHUNK // 4


@dataclass
class Network:
    weights: np.ndarray  # (WIDTH, 256, FILTERS)
    shift: np.ndarray  # (FILTERS,)
    out: np.ndarray  # (3 * FILTERS + 2,)
    bias: np.ndarray  # (1,)

    def tables(self) -> list[np.ndarray]:
        """Responses to byte pairs (low byte first) at each pair of places."""
        w = self.weights.astype(np.float32)
        return [(w[j + 1][:, None, :] + w[j][None, :, :]).reshape(65_536, FILTERS) for j in range(0, WIDTH, 2)]


@dataclass
class Batch:
    """Documents end to end: byte pairs, which places count, blocks, chunks."""

    pairs: np.ndarray
    padding: np.ndarray  # places to leave out
    first_block: np.ndarray  # of each document with text
    blocks: np.ndarray
    rows: np.ndarray  # the documents with text
    places: np.ndarray  # of each of them


def arrange(texts: list[str]) -> Batch:
    pad, parts, padding, blocks, rows, counted = WIDTH - 2, [], [], [], [], []
    at = 0
    for i, text in enumerate(texts):
        raw = text.encode("utf-8", "replace")
        if not raw:
            continue
        places = max(1, -(-(len(raw) - pad) // 2))
        whole = -(-(places + pad // 2) // BLOCK) * BLOCK
        parts.append(raw.ljust(2 * whole, b"\0"))  # no filter reaches the next document
        padding.append(np.arange(at + places, at + whole))
        blocks.append(whole // BLOCK)
        at += whole
        rows.append(i)
        counted.append(places)
    data = b"".join(parts) + b"\0" * (2 * WIDTH)
    counts = np.array(blocks, dtype=np.int64)
    return Batch(np.frombuffer(data, dtype="<u2"), np.concatenate(padding) if padding else np.arange(0), np.cumsum(counts) - counts, counts, np.array(rows, dtype=np.int64), np.array(counted, dtype=np.int64))


def peaks(b: Batch, tables: list[np.ndarray], most: int = 2_048, places: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """(blocks, filters): the highest response of each block and, if asked for,
    its place in the block; some blocks at a time, so that a long document
    needs no more memory than a short one."""
    total = int(b.blocks.sum())
    out = np.empty((total, FILTERS), dtype=np.float32)
    where = np.empty((total, FILTERS), dtype=np.int64) if places else None
    for at in range(0, total, most):
        first, last = at * BLOCK, min(total, at + most) * BLOCK
        part = tables[0].take(b.pairs[first:last], axis=0)
        for j, table in enumerate(tables[1:], 1):
            part += table.take(b.pairs[first + j : last + j], axis=0)
        left_out = b.padding[np.searchsorted(b.padding, first) : np.searchsorted(b.padding, last)]
        part[left_out - first] = -np.inf
        part = part.reshape(-1, BLOCK, FILTERS)
        out[at : at + most] = part.max(axis=1)
        if places:
            where[at : at + most] = part.argmax(axis=1)
    return out, where


def chunk_of(b: Batch) -> tuple[np.ndarray, np.ndarray]:
    """The two blocks of each chunk (a document of one block has one chunk)."""
    n = np.maximum(b.blocks - 1, 1)
    first = np.repeat(b.first_block - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    second = np.minimum(first + 1, np.repeat(b.first_block + b.blocks - 1, n))
    return first, second


def combine(b: Batch, pooled: np.ndarray) -> np.ndarray:
    """(documents with text, 3 * FILTERS + 2) from the chunks' activations; the
    last two tell how much of a chunk a short document fills."""
    n = np.maximum(b.blocks - 1, 1)
    starts = np.cumsum(n) - n
    fill = np.minimum(b.places / (2.0 * BLOCK), 1.0)[:, None]
    return np.concatenate([np.add.reduceat(pooled, starts) / n[:, None], np.maximum.reduceat(pooled, starts), np.minimum.reduceat(pooled, starts), fill, np.log(fill)], axis=1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def score_texts(texts: list[str], net: Network, tables: list[np.ndarray]) -> np.ndarray:
    score = np.full(len(texts), _sigmoid(net.bias)[0], dtype=np.float64)
    b = arrange(texts)
    if len(b.rows):
        peak, _ = peaks(b, tables)
        first, second = chunk_of(b)
        pooled = np.maximum(np.maximum(peak[first], peak[second]).astype(np.float64) + net.shift, 0)
        score[b.rows] = _sigmoid((combine(b, pooled) * net.out).sum(axis=1) + net.bias[0])
    return score


def _gradients(b: Batch, label: np.ndarray, net: Network) -> list[np.ndarray]:
    peak, where = peaks(b, net.tables(), places=True)
    peak = peak.astype(np.float64)
    first, second = chunk_of(b)
    left = peak[first] >= peak[second]
    pooled = np.maximum(np.where(left, peak[first], peak[second]) + net.shift, 0)
    features = combine(b, pooled)
    error = (_sigmoid(features @ net.out + net.bias[0]) - label[b.rows]) / max(1, len(b.rows))
    n = np.maximum(b.blocks - 1, 1)
    doc = np.repeat(np.arange(len(n)), n)
    back = (error[:, None] * net.out[None, :])[doc]
    most, least = features[:, FILTERS : 2 * FILTERS], features[:, 2 * FILTERS : 3 * FILTERS]
    up = back[:, :FILTERS] / n[doc][:, None]
    for k, best in ((1, most), (2, least)):
        hit = (pooled == best[doc]).astype(np.float64)  # chunks of equal activation share the gradient
        hit /= np.add.reduceat(hit, np.cumsum(n) - n)[doc]
        up += hit * back[:, k * FILTERS : (k + 1) * FILTERS]
    up *= pooled > 0
    place = np.where(left, first[:, None] * BLOCK + where[first], second[:, None] * BLOCK + where[second])
    grad = np.zeros_like(net.weights)
    data = b.pairs.view(np.uint8)
    filters = np.broadcast_to(np.arange(FILTERS), place.shape)
    for j in range(WIDTH):
        cell = data[2 * place + j].astype(np.int64) * FILTERS + filters
        grad[j] = np.bincount(cell.ravel(), weights=up.ravel(), minlength=256 * FILTERS).reshape(256, FILTERS)
    return [grad, up.sum(axis=0), features.T @ error, np.array([error.sum()])]


def fit(texts: list[str], labels: list[int], seed: int = 11, epochs: int = EPOCHS) -> Network:
    """Fit the network on a sample that fits into memory."""
    label = np.array(labels, dtype=np.float64)
    rng = np.random.default_rng(seed)
    share = float(np.clip(label.mean(), 0.01, 0.99)) if len(label) else 0.5
    net = Network(rng.normal(0, 0.3, (WIDTH, 256, FILTERS)), np.zeros(FILTERS), rng.normal(0, 0.05, 3 * FILTERS + 2), np.array([np.log(share / (1 - share))]))
    if len(set(labels)) < 2:
        net.out[:] = 0
        return net
    params = [net.weights, net.shift, net.out, net.bias]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), BATCH):
            rows = order[at : at + BATCH]
            b = arrange([texts[i] for i in rows])
            if not len(b.rows):
                continue
            step += 1
            for p, g, mean, square in zip(params, _gradients(b, label[rows], net), m, v, strict=True):
                mean += 0.1 * (g - mean)
                square += 0.001 * (g * g - square)
                p -= RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return net


def training_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, most: int = TRAIN_DOCS, most_bytes: int = TRAIN_BYTES) -> tuple[list[str], list[int]]:
    """Texts and labels of at most ``most`` labelled documents whose id isn't
    held out, of at most ``most_bytes`` bytes in all."""
    known = labels.where(F.col(label_col).isin(0, 1) & (held_out_remainder(F.col(id_col), 5) != 0))
    known = known.groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).alias("__label"))
    chosen = known.withColumn("__order", F.xxhash64("__id")).orderBy("__order", "__id").limit(most)
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).where(F.col("__text").isNotNull())
    # `chosen` has at most `most` rows of three numbers; an id that comes again gives one text
    found = texts.join(F.broadcast(chosen), "__id").groupBy("__id", "__label", "__order").agg(F.min("__text").alias("__text"))
    sizes = found.select("__order", "__id", F.octet_length("__text").alias("__bytes")).collect()
    fit_in, total = [], 0
    for r in sorted(sizes, key=lambda r: (r["__order"], r["__id"])):
        if total + r["__bytes"] <= most_bytes:
            total += r["__bytes"]
            fit_in.append(r["__id"])
    rows = found.where(F.col("__id").isin(fit_in)).collect() if fit_in else []
    rows = sorted(rows, key=lambda r: r["__id"])
    return [r["__text"] for r in rows], [int(r["__label"]) for r in rows]


def held_out_remainder(id_: Column, parts: int) -> Column:
    return F.crc32(id_.cast("string")) % parts


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = TRAIN_DOCS, most_bytes: int = TRAIN_BYTES) -> Network:
    return fit(*training_sample(docs, labels, id_col, text_col, label_col, most, most_bytes))


def score(docs: DataFrame, net: Network, text_col: str = "text") -> DataFrame:
    """(all columns of ``docs``, ``__score``)."""
    from collections.abc import Iterator as Series  # evaluated by pandas_udf below

    import pandas as pd

    def scored(parts):
        tables = net.tables()
        build = batches({"text": pa.string()})
        for part in parts:
            found = [score_texts(texts_of(b), net, tables) for b in small_batches([build(part.tolist())], most_bytes=1 << 18)]
            yield pd.Series(np.concatenate(found) if found else np.zeros(0))

    scored.__annotations__ = {"parts": Series[pd.Series], "return": Series[pd.Series]}
    udf = F.pandas_udf(scored, "double")
    return docs.select(*(F.col(f"`{c}`") for c in docs.columns if c != "__score"), udf(F.col(text_col)).alias("__score"))
