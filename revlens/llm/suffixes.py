"""Suffix-array dedup: repeated byte windows by a depth-limited radix sort.

A byte goes if a string of ``DEPTH`` bytes that covers it also starts anywhere
else. Suffixes need ordering only through their first ``DEPTH`` bytes: groups
that are equal that far are exactly the repeated windows. They are sorted by
most-significant-digit passes, each of which drops the groups of one:

1. The first digit is a sample of the window that depends on its bytes only:
   the ``GRAM`` bytes in it whose hash is smallest (the leftmost of equals).
   Equal windows have equal first digits, and neighbouring windows mostly have
   the same one, so a document gives a row for about each 75 bytes. Spark
   counts the digits; those that come once are dropped.
2. Windows of the digits left are dealt by digit, with the bytes that they
   need, and ordered inside the tasks by three more digits (the hashes of
   their bytes 0-63, 64-127 and 128-199). A digit that more than ``hot`` rows
   share takes another distributed pass instead: its windows are dealt by the
   hash of all their bytes, so no digit is gathered in one task.

Spans of repeated windows are merged for each document and cut out.

Documents are named by id and text hash, so repeated rows are judged as the
copies that they are. Defined cases: null text is empty; a text shorter than
``DEPTH`` loses nothing; an empty table gives no rows; null ids are a document
each (named by their text).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from revlens.llm.common import batches, broadcast_if_small, same, small_batches, stage, staged

DEPTH, GRAM = 200, 48
#: Ends of the digits of the second pass.
DIGITS = ((0, 64), (64, 64), (128, 72))
HOT = 50_000
#: Bytes of a long document that are sampled at a time.
SLICE = 4 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_TABLE = np.random.default_rng(20_240_229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)


def rolling(data: np.ndarray, widths: tuple[int, ...]) -> dict[int, np.ndarray]:
    """Hashes of all strings of each width, by doubling: a string's hash is
    its left part's, shifted, plus its right part's."""
    power = lambda n: np.uint64(pow(_BASE, n, 1 << 64))
    doubled = {1: _TABLE[data]}
    w = 1
    while 2 * w <= max(widths):
        h = doubled[w]
        doubled[2 * w] = h[:-w] * power(w) + h[w:] if len(h) > w else h[:0]
        w *= 2
    out = {}
    for width in widths:
        total, done = None, 0
        for part in sorted((p for p in doubled if p & width), reverse=True):
            n = max(0, len(data) - width + 1)
            h = doubled[part][done : done + n]
            total = h if total is None else total * power(part) + h
            done += part
        out[width] = total
    return out


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    w = 1
    while 2 * w <= width:
        x = np.minimum(x[:-w], x[w:])
        w *= 2
    rest = width - w
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def first_digits(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, first window, digit) of every run of windows that share their
    sampled gram; documents end to end in ``data`` stop at ``ends``."""
    starts = np.concatenate([[0], ends[:-1]])
    if len(data) < DEPTH:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    grams = _mix(rolling(data, (GRAM,))[GRAM])
    keyed = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    chosen = (_sliding_min(keyed, DEPTH - GRAM + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    counts = np.maximum(ends - starts - DEPTH + 1, 0)  # windows of each document
    doc = np.repeat(np.arange(len(ends)), counts)
    at = np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
    gram = chosen[at]
    new = np.flatnonzero(np.diff(gram, prepend=-1) | np.diff(doc, prepend=-1))
    return doc[new], at[new] - starts[doc[new]], grams[gram[new]].view(np.int64)


def _bytes_of(batch: pa.RecordBatch, column: str) -> tuple[np.ndarray, np.ndarray]:
    """A binary column end to end, and where each row ends."""
    raw = [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]
    return np.frombuffer(b"".join(raw), dtype=np.uint8), np.cumsum([len(x) for x in raw], dtype=np.int64)


def sampled_runs(docs: DataFrame) -> DataFrame:
    """(id, hash, digits, starts, n_windows) of every document of at least DEPTH bytes."""
    schema = pa.schema([("id", pa.int64()), ("hash", pa.int64()), ("digits", pa.list_(pa.int64())), ("starts", pa.list_(pa.int32())), ("n_windows", pa.int32())])

    def found(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
        if len(ends) > 1 or len(data) <= SLICE:
            return first_digits(data, ends)
        # a long document in slices that share DEPTH - 1 bytes: each window is in one of them
        parts = [(at, *first_digits(part := data[at : at + SLICE + DEPTH - 1], np.array([len(part)]))) for at in range(0, len(data) - DEPTH + 1, SLICE)]
        return tuple(np.concatenate(x) for x in ([p[1] for p in parts], [p[0] + p[2] for p in parts], [p[3] for p in parts]))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(it, most_bytes=1 << 20):
            data, ends = _bytes_of(batch, "text")
            doc, start, digit = found(data, ends)
            offsets = pa.array(np.searchsorted(doc, np.arange(len(ends) + 1)).astype(np.int32))
            sizes = np.diff(np.concatenate([[0], ends]))
            out = pa.RecordBatch.from_arrays([
                batch.column("id"), batch.column("hash"), pa.ListArray.from_arrays(offsets, pa.array(digit)),
                pa.ListArray.from_arrays(offsets, pa.array(start.astype(np.int32))), pa.array((sizes - DEPTH + 1).astype(np.int32))], schema=schema)
            yield out.filter(pa.array(sizes >= DEPTH))

    return docs.mapInArrow(run, "id long, hash long, digits array<long>, starts array<int>, n_windows int")


def _contexts(chosen: DataFrame) -> DataFrame:
    """(digit, n, id, hash, start, bytes): the bytes that a run's windows need."""
    build = batches({"digit": pa.int64(), "n": pa.int64(), "id": pa.int64(), "hash": pa.int64(), "start": pa.int32(), "bytes": pa.binary()})

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(it, most_bytes=1 << 20):
            rows: list[tuple] = []
            for id_, hash_, text, runs in zip(*(batch.column(c).to_pylist() for c in ("id", "hash", "text", "runs")), strict=True):
                raw = text.encode()
                rows += [(r["digit"], r["n"], id_, hash_, r["start"], raw[r["start"] : r["end"] + DEPTH]) for r in runs]
            yield build(*zip(*rows, strict=True))

    return chosen.mapInArrow(run, "digit long, n long, id long, hash long, start int, bytes binary")


def _windows(ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, position) of every window of byte strings end to end."""
    starts = np.concatenate([[0], ends[:-1]])
    counts = ends - starts - DEPTH + 1
    row = np.repeat(np.arange(len(ends)), counts)
    return row, np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))


def repeated_windows(group: np.ndarray, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, position) of the windows whose bytes come again in their group, by
    most-significant-digit passes that keep groups of two and more."""
    row, at = _windows(ends)
    hashes = rolling(data, tuple(sorted({w for _, w in DIGITS})))
    bucket = group[row].view(np.uint64)
    for offset, width in DIGITS:
        digit = _mix(bucket) ^ _mix(hashes[width][at + offset] + np.uint64(offset))
        order = np.argsort(digit)
        edge = np.flatnonzero(np.diff(digit[order], prepend=~digit[order[:1]]))
        sizes = np.diff(np.concatenate([edge, [len(order)]]))
        again = np.repeat(sizes > 1, sizes)
        order = order[again]
        row, at, bucket = row[order], at[order], digit[order]
        if not len(row):
            break
    return row, at


def _spans_of(row: np.ndarray, at: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first byte, end) of the runs of neighbouring windows, in the row's bytes."""
    order = np.argsort(at)
    row, at = row[order], at[order]
    new = np.flatnonzero((np.diff(at, prepend=-9) != 1) | (np.diff(row, prepend=-1) != 0))
    last = np.concatenate([new[1:], [len(at)]]) - 1
    base = np.concatenate([[0], ends[:-1]])[row[new]]
    return row[new], at[new] - base, at[last] - base + DEPTH


_SPANS = "id long, hash long, first int, end int"
_span_columns = {"id": pa.int64(), "hash": pa.int64(), "first": pa.int32(), "end": pa.int32()}


def _ordered_in_tasks(contexts: DataFrame) -> DataFrame:
    """Spans of repeated windows; a digit's rows come one after another."""
    build = batches(_span_columns)

    def whole_digits(it: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held: list[pa.RecordBatch] = []
        for batch in small_batches(it, "bytes", 1 << 20):
            digit = batch.column("digit").to_numpy()
            inner = np.flatnonzero(digit != digit[-1])
            cut = int(inner[-1]) + 1 if len(inner) else 0
            if held and cut == 0 and held[-1].column("digit")[-1].as_py() != digit[0]:
                yield pa.Table.from_batches(held)  # the digit ended with the last batch
                held = []
            if cut:
                yield pa.Table.from_batches([*held, batch.slice(0, cut)])
                held = []
            held.append(batch.slice(cut))
        if held:
            yield pa.Table.from_batches(held)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_digits(it):
            (batch,) = table.combine_chunks().to_batches()
            if batch.num_rows < 2:
                continue
            data, ends = _bytes_of(batch, "bytes")
            row, at = repeated_windows(batch.column("digit").to_numpy(), data, ends)
            if len(row):
                row, first, end = _spans_of(row, at, ends)
                start = batch.column("start").to_numpy()[row]
                ids, hashes = batch.column("id").take(pa.array(row)), batch.column("hash").take(pa.array(row))
                yield build(ids, hashes, first + start, end + start)

    return contexts.repartition("digit").sortWithinPartitions("digit").mapInArrow(run, _SPANS)


def _dealt_by_window(contexts: DataFrame) -> DataFrame:
    """Spans of repeated windows of hot digits: one more distributed pass, by
    the hash of all bytes of a window."""
    build = batches({"window": pa.int64(), "id": pa.int64(), "hash": pa.int64(), "first": pa.int32()})

    def explode(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(it, "bytes", 1 << 18):
            data, ends = _bytes_of(batch, "bytes")
            row, at = _windows(ends)
            h = _mix(rolling(data, (DEPTH,))[DEPTH][at]).view(np.int64)
            first = at - np.concatenate([[0], ends[:-1]])[row] + batch.column("start").to_numpy()[row]
            yield build(h, batch.column("id").take(pa.array(row)), batch.column("hash").take(pa.array(row)), first)

    windows = contexts.mapInArrow(explode, "window long, id long, hash long, first int")
    again = windows.groupBy("window").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("window")
    return windows.join(again, "window", "left_semi").select("id", "hash", "first", (F.col("first") + DEPTH).alias("end"))


def repeated_spans(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """(id, hash, spans) of (id, text, hash): merged spans (first, end) of the
    bytes that repeated windows cover; documents without any are left out."""
    # numbered once, in what is written
    runs = stage(sampled_runs(docs).withColumn("uid", F.monotonically_increasing_id()), "suffix-runs")
    rows = runs.select("uid", F.posexplode("digits").alias("i", "digit"), "starts", "n_windows").select(
        "digit", "uid", F.get("starts", F.col("i")).alias("start"), (F.coalesce(F.get("starts", F.col("i") + 1), F.col("n_windows")) - 1).alias("end"))
    # written, so that the join's two sides are plain shuffles, of which Spark can split a hot digit
    counts = stage(rows.groupBy("digit").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "suffix-digits")
    # the runs of one document; a repeated row's are the same ones
    again = rows.join(counts, "digit").groupBy("uid").agg(F.collect_list(F.struct("digit", "n", "start", "end")).alias("runs"))
    again = stage(again.join(runs.select("uid", "id", "hash"), "uid").select(F.col("id").alias("__id"), F.col("hash").alias("__hash"), "runs"), "suffix-again")

    def chosen(wanted) -> DataFrame:
        runs_ = again.withColumn("runs", F.filter("runs", wanted)).where(F.size("runs") > 0)
        return runs_.dropDuplicates(["__id", "__hash"])

    def contexts(some: DataFrame) -> DataFrame:
        texts = docs.join(some, (docs["hash"] == F.col("__hash")) & same(docs["id"], F.col("__id")))
        return _contexts(texts.select("id", "hash", "text", "runs"))

    spans = _ordered_in_tasks(contexts(chosen(lambda r: r["n"] <= hot)))
    rest, size = staged(chosen(lambda r: r["n"] > hot), "suffix-hot-runs")
    if rest.limit(1).count():
        # few documents mostly: their texts needn't be shuffled again then
        spans = spans.unionByName(_dealt_by_window(stage(contexts(broadcast_if_small(rest, size)), "suffix-hot")))
    return _merged(spans)


def _merged(spans: DataFrame) -> DataFrame:
    """One row a document, overlapping and touching spans as one. A document
    has at most a span for each of its bytes."""
    both = F.array_sort(F.collect_set(F.struct("first", "end")))
    gathered = spans.groupBy("id", "hash").agg(both.alias("all"))
    build = pa.schema([("id", pa.int64()), ("hash", pa.int64()), ("firsts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32()))])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            firsts, ends = [], []
            for spans_ in batch.column("all").to_pylist():
                a = np.array([s["first"] for s in spans_])
                b = np.maximum.accumulate([s["end"] for s in spans_])
                new = np.flatnonzero(np.concatenate([[True], a[1:] > b[:-1]]))
                firsts.append(a[new])
                ends.append(b[np.concatenate([new[1:], [len(a)]]) - 1])
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("hash"), pa.array(firsts, type=build.field("firsts").type), pa.array(ends, type=build.field("ends").type)], schema=build)

    return gathered.mapInArrow(run, "id long, hash long, firsts array<int>, ends array<int>")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """(id, n_bytes, firsts, ends, kept): the removed spans and the bytes that
    remain of every document."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("hash"))
    spans, size = staged(repeated_spans(rows, hot), "suffix-spans")
    spans = spans.select(F.col("id").alias("__id"), F.col("hash").alias("__hash"), "firsts", "ends")
    found = rows.join(broadcast_if_small(spans, size), (rows["hash"] == F.col("__hash")) & same(rows["id"], F.col("__id")), "left").select("id", "text", "firsts", "ends")
    schema = pa.schema([(id_col, pa.int64()), ("n_bytes", pa.int64()), ("firsts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32())), ("kept", pa.binary())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(it):
            size_, firsts, ends, kept = [], [], [], []
            for text_, a, b in zip(*(batch.column(c).to_pylist() for c in ("text", "firsts", "ends")), strict=True):
                raw = (text_ or "").encode()
                size_.append(len(raw))
                firsts.append(a or [])
                ends.append(b or [])
                kept.append(b"".join(raw[i:j] for i, j in zip([0, *(b or [])], [*(a or []), len(raw)], strict=True)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(v, type=schema.field(n).type) for n, v in (("n_bytes", size_), ("firsts", firsts), ("ends", ends), ("kept", kept)))], schema=schema)

    return found.mapInArrow(run, f"`{id_col}` long, n_bytes long, firsts array<int>, ends array<int>, kept binary")

