"""Fill-in-middle: prefix, middle and suffix of a text in another order.

Method: displacement scatter. A batch's texts lie one after another in one
byte buffer. A scan finds the units (lines) and the two cuts of each text. All
that a text's bytes do is move: each of its three parts by one amount, which a
difference array notes where the part begins. The array's cumulative sum is
every byte's shift, and one numpy scatter puts the batch's bytes where they
belong between the marks. Restoring finds the marks in the output, notes the
same shifts and gathers with them, the other way round.

The buffer is worked on in slices, so what is held beside it and its output is
bounded by ``SLICE`` whatever a text's length; only counts go from one slice
to the next.

Defined cases: null text is empty; an empty text, one that holds a mark, and
one that the rate leaves out are plain (output = text, no cuts). A text
without a line break is one unit. Rows are treated each on its own, so equal
ids give equal cuts; the id of a null id is the empty text. Other columns are
left out. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from revlens.llm.common import batches, small_batches

# The marks of the three parts.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
#: Bytes of the buffer that are looked at at once.
SLICE = 1 << 20


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column, one text after another, and where each begins (and the last ends)."""
    a = column.cast(pa.large_binary())
    if a.null_count:
        a = a.fill_null(b"")
    _, offsets, data = a.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[a.offset : a.offset + len(a) + 1]
    raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def texts_from(buffer: np.ndarray, at: np.ndarray) -> pa.Array:
    """A text column of a buffer, without a copy of it."""
    if at[-1] >= 1 << 31:
        raise ValueError("a text of 2 GB and more doesn't fit into Arrow's strings")
    return pa.Array.from_buffers(pa.string(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(buffer)])


def slices(n: int, width: int = 0) -> Iterator[tuple[int, int]]:
    width = width or SLICE
    for at in range(0, n, width):
        yield at, min(n, at + width)


def draws(ids: list, seed: int) -> np.ndarray:
    """Four unsigned 32-bit numbers for each id, from the SHA-256 of seed and id."""
    digests = b"".join(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).digest()[:16] for i in ids)
    return np.frombuffer(digests, dtype=">u4").astype(np.int64).reshape(-1, 4)


# -- scans --------------------------------------------------------------------

def count_units(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lines of each text, and the line breaks of the buffer before each text."""
    before = np.zeros(len(at), dtype=np.int64)
    for lo, hi in slices(len(buf)):
        breaks = np.flatnonzero(buf[lo:hi] == 10) + lo
        # a text that begins in or behind this slice has these breaks before it
        before += np.searchsorted(breaks, at, side="left")
    begin, end = at[:-1], at[1:]
    n = before[1:] - before[:-1]
    last = buf[np.maximum(end - 1, 0)] if len(buf) else np.zeros(len(begin), np.uint8)
    return n + ((end > begin) & (last != 10)), before[:-1]


def unit_ends(buf: np.ndarray, at: np.ndarray, before: np.ndarray, units: np.ndarray) -> np.ndarray:
    """Where the given number of units of each text ends in the buffer."""
    end = np.where(units > 0, at[1:], at[:-1])  # the last unit may have no line break
    wanted = before + units - 1                 # which line break of the buffer ends it
    seen = 0
    for lo, hi in slices(len(buf)):
        breaks = np.flatnonzero(buf[lo:hi] == 10) + lo
        here = (units > 0) & (wanted >= seen) & (wanted < seen + len(breaks))
        if here.any():
            end[here] = np.minimum(end[here], breaks[wanted[here] - seen] + 1)
        seen += len(breaks)
    return end


def chars_before(buf: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """Code points of the buffer before each position (on a code point's first byte)."""
    out = np.zeros(len(positions), dtype=np.int64)
    total = 0
    for lo, hi in slices(len(buf)):
        firsts = np.cumsum((buf[lo:hi] & 0xC0) != 0x80)
        here = (positions > lo) & (positions <= hi)
        out[here] = total + firsts[positions[here] - lo - 1]
        total += int(firsts[-1])
    return out


def marks_in(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions, texts and middle letters of all marks that lie within one text."""
    found = []
    for lo, hi in slices(len(buf)):
        p = np.flatnonzero(buf[lo:hi] == 60) + lo
        p = p[p + 2 < len(buf)]
        p = p[(buf[p + 2] == 62) & np.isin(buf[p + 1], (PREFIX[1], SUFFIX[1], MIDDLE[1]))]
        found.append(p)
    pos = np.concatenate(found) if found else np.zeros(0, dtype=np.int64)
    row = np.searchsorted(at, pos, side="right") - 1
    whole = pos + 3 <= at[row + 1]
    pos, row = pos[whole], row[whole]
    return pos, row, buf[pos + 1]


# -- the scatter ----------------------------------------------------------------

def shifts(begins: np.ndarray, moves: np.ndarray, n: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """Every byte's shift, slice by slice: parts begin at ``begins`` (ascending,
    empty parts may share a place) and move by ``moves``. A difference array
    takes each part's change, its cumulative sum is the shift."""
    change = np.diff(moves, prepend=0)
    carry = 0
    for lo, hi in slices(n):
        a, b = np.searchsorted(begins, (lo, hi))
        diff = np.zeros(hi - lo, dtype=np.int64)
        np.add.at(diff, begins[a:b] - lo, change[a:b])
        if len(diff):
            diff[0] += carry
        shift = np.cumsum(diff)
        carry = int(shift[-1])
        yield lo, hi, shift


def cut(buf: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Outputs of texts with cuts ``low`` and ``high`` (places in the buffer);
    ``form`` is 0 for plain, 1 for prefix-suffix-middle, 2 for suffix-prefix-middle."""
    begin, end = at[:-1], at[1:]
    size = end - begin + np.where(form > 0, 9, 0)
    out_at = np.concatenate(([0], np.cumsum(size)))
    o = out_at[:-1]
    p, s = low - begin, end - high
    # where each part goes; plain texts move whole
    to_p = np.where(form == 1, o + 3, np.where(form == 2, o + 6 + s, o))
    to_s = np.where(form == 1, o + 6 + p, np.where(form == 2, o + 3, o + (high - begin)))
    to_m = np.where(form > 0, o + 9 + p + s, o + p)
    begins = np.stack([begin, low, high], axis=1).ravel()
    moves = np.stack([to_p - begin, to_m - low, to_s - high], axis=1).ravel()
    out = np.empty(int(out_at[-1]), dtype=np.uint8)
    for lo, hi, shift in shifts(begins, moves, len(buf)):
        out[np.arange(lo, hi) + shift] = buf[lo:hi]
    cutting = form > 0
    for mark, place in ((PREFIX, to_p), (SUFFIX, to_s), (MIDDLE, to_m)):
        for k in range(3):
            out[place[cutting] - 3 + k] = mark[k]
    return out, out_at


def uncut(buf: np.ndarray, at: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts of outputs: the marks say which part lies where, and the texts are
    gathered from there."""
    begin, end = at[:-1], at[1:]
    pos, row, letter = marks_in(buf, at)
    place = {}
    for mark in (PREFIX, SUFFIX, MIDDLE):
        mine = (letter == mark[1]) & (form[row] > 0)
        place[mark] = begin.copy()
        place[mark][row[mine]] = pos[mine] + 3
    psm = form == 1
    from_p = np.where(form > 0, place[PREFIX], begin)
    from_s = np.where(form > 0, place[SUFFIX], end)
    from_m = np.where(form > 0, place[MIDDLE], end)
    p = np.where(psm, from_s - 3 - from_p, np.where(form > 0, from_m - 3 - from_p, end - begin))
    s = np.where(psm, from_m - 3 - from_s, np.where(form > 0, from_p - 3 - from_s, 0))
    m = np.where(form > 0, end - from_m, 0)
    out_at = np.concatenate(([0], np.cumsum(p + s + m)))
    o = out_at[:-1]
    begins = np.stack([o, o + p, o + p + m], axis=1).ravel()
    moves = np.stack([from_p - o, from_m - (o + p), from_s - (o + p + m)], axis=1).ravel()
    out = np.empty(int(out_at[-1]), dtype=np.uint8)
    for lo, hi, shift in shifts(begins, moves, len(out)):
        out[lo:hi] = buf[np.arange(lo, hi) + shift]
    return out, out_at


# -- the Spark operators ----------------------------------------------------------

FORMS = (PLAIN, PSM, SPM)


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 7, rate_pct: int = 100, spm_pct: int = 50) -> DataFrame:
    """A row per document: ``id_col``, n (its lines), form, prefix_chars and
    middle_chars (null if plain) and output.

    The cuts come after two drawn numbers of lines (0 to n); ``rate_pct`` of a
    hundred documents are cut, and ``spm_pct`` of a hundred of those have the
    suffix first. Draws depend on ``seed`` and the id alone.
    """
    id_type = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, id_type), T.StructField("n", T.LongType()), T.StructField("form", T.StringType()),
                           T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(it):
            buf, at = buffer_of(batch.column("text"))
            n, before = count_units(buf, at)
            h = draws(batch.column("key").to_pylist(), seed)
            a, b = h[:, 0] % (n + 1), h[:, 1] % (n + 1)
            _, marked, _ = marks_in(buf, at)
            cutting = (n > 0) & (h[:, 2] % 100 < rate_pct)
            cutting[marked] = False
            form = np.where(cutting, np.where(h[:, 3] % 100 < spm_pct, 2, 1), 0)
            low = np.where(cutting, unit_ends(buf, at, before, np.minimum(a, b)), at[:-1])
            high = np.where(cutting, unit_ends(buf, at, before, np.maximum(a, b)), at[1:])
            out, out_at = cut(buf, at, low, high, form)
            chars = chars_before(buf, np.concatenate([at[:-1], low, high])).reshape(3, -1)
            plain = form == 0
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(n), pa.array(np.array(FORMS, dtype=object)[form], type=pa.string()), pa.array(chars[1] - chars[0], mask=plain),
                 pa.array(chars[2] - chars[1], mask=plain), texts_from(out, out_at)], names=schema.names)

    return docs.select(F.col(id_col).alias("id"), F.col(id_col).cast("string").alias("key"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def restore(rows: DataFrame, output_col: str = "output", form_col: str = "form", text_col: str = "restored") -> DataFrame:
    """The rows with ``text_col``, the text rebuilt from output and form alone."""
    keep = [c for c in rows.columns if c != text_col]
    schema = T.StructType([rows.schema[c] for c in keep] + [T.StructField(text_col, T.StringType())])
    number = {name: k for k, name in enumerate(FORMS)}

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(it, column=output_col):
            buf, at = buffer_of(batch.column(output_col))
            form = np.array([number.get(x, 0) for x in batch.column(form_col).to_pylist()], dtype=np.int64)
            out, out_at = uncut(buf, at, form)
            yield pa.RecordBatch.from_arrays([*batch.columns, texts_from(out, out_at)], names=schema.names)

    return rows.select(*[F.col(f"`{c}`") for c in keep]).mapInArrow(run, schema)
