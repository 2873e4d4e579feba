"""Best-fit packing of documents into sequences of bounded length.

Method: the configuration linear program over the length histogram. A
configuration is a multiset of lengths that fits into one sequence; the
program covers every length's count by as few configurations as possible. It
is solved by multiplicative weights: each length has a price that falls as it
gets covered, and a bounded knapsack dynamic program over the open pieces
finds a configuration of nearly the highest price. Each is taken a whole
number of times, rounded down to what is open, and the few pieces that fill
no further sequence go best-fit into the last ones.

The histogram has at most ``capacity`` rows whatever the input, so the program
is solved on the driver. Everything that grows with the documents is a Spark
job: tokenizing, counting, ranking the pieces of a length, and looking up the
sequence of each rank.

Defined cases: null text is empty and has the closing id only; an empty table
gives no rows; repeated rows are packed each on its own; a text of any length
is cut into pieces of ``capacity`` ids, its last piece may be shorter.
"""

from __future__ import annotations

import itertools
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F, types as T

from revlens.llm.common import batches, small_batches, stage

CAPACITY = 4096
END_ID = 1
#: Words whose ids a worker remembers; others are encoded when met.
REMEMBERED_WORDS = 500_000
#: Letters of a plain word, marks that may close a word of letters.
ASCII_LETTERS = string.ascii_letters
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Most rounds of multiplicative weights; each covers a length at least (a length may take several).
ROUNDS = 20_000
#: How strongly a covered length loses price, how much dearer a token of a longer piece is; lengths that a knapsack looks at first.
ETA, BEND, LOOKED = 1.0, 0.5, 64
#: Share of the best price that a configuration must have, share of a sequence that it must fill.
NEAR, FULL = 0.8, 0.999

_encoders: dict[str, WordEncoder] = {}


class WordEncoder:
    """Token ids of texts by a tokenizer that drops white space.

    Such a tokenizer's ids of a text are its words' ids one after another, so
    words are encoded once each and looked up afterwards. Words that only
    differ in case or by the marks that close them share their letters' ids,
    and unknown words are encoded many at once with a digit between them, which
    is a token of its own. All this holds for tokenizers that split letters,
    digits and other marks from each other; others encode whole words.
    """

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {"": b""}
        self._remembered = self._as_arrays()
        self.mark = self._ids(["1"])[0]
        probe = self.tokenizer.encode("ab 1 cd 1", add_special_tokens=False).ids
        whole = b"".join(self._ids(["ab", "1", "cd", "1"]))
        self.joins = len(self.mark) == 4 and np.array(probe, dtype="<u4").tobytes() == whole and all(
            b"".join(self._ids(["ab", x])) == self._ids([f"ab{x}"])[0] for x in (",", "!!", "-", "$$$", "."))
        # ids of the runs of marks that close words
        self.marks: dict[str, bytes] = {}
        self.letters = self._for_letters()

    def _for_letters(self):
        """The same vocabulary without the steps that leave lower-case ASCII
        letters between blanks as they are."""
        import json

        from tokenizers import Tokenizer

        settings = json.loads(self.tokenizer.to_str())
        steps = (settings.get("pre_tokenizer") or {}).get("pretokenizers", [])
        if [x["type"] for x in steps] != ["Split", "ByteLevel"] or not self.joins or '"Lowercase"' not in json.dumps(settings.get("normalizer")):
            return None
        settings |= {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}}
        return Tokenizer.from_str(json.dumps(settings))

    def _as_arrays(self) -> tuple[pa.Array, pa.Array]:
        """The remembered words and their ids."""
        return pa.array(self.known.keys(), pa.large_string()), pa.array(self.known.values(), pa.large_binary())

    def _ids(self, texts: list[str], tokenizer=None) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in (tokenizer or self.tokenizer).encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, words: list[str], tokenizer=None) -> Iterator[tuple[str, bytes]]:
        groups = [words[k : k + 400] for k in range(0, len(words), 400)]
        mark = np.frombuffer(self.mark, dtype="<u4")
        for group, ids in zip(groups, self._ids([" 1 ".join(g) for g in groups], tokenizer), strict=True):
            cuts = (np.flatnonzero(np.frombuffer(ids, dtype="<u4") == mark) * 4).tolist()
            at = 0
            for w, cut in zip(group, [*cuts, len(ids)], strict=True):
                yield w, ids[at:cut]
                at = cut + 4

    def _encode(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        """Words with their ids."""
        plain = [w for w in words if "1" not in w and "<" not in w and len(w) <= 64] if self.joins else []
        rest = set(words).difference(plain)
        yield from self._joined(plain)
        yield from zip(rest, self._ids(list(rest)), strict=True)

    def _new(self, words: set[str]) -> dict[str, bytes]:
        """Ids of words that aren't remembered: a word's are its letters' and
        those of the marks that close it. As many as there is room for are
        remembered."""
        known, marks = self.known, self.marks
        whole: list[str] = []
        stems: list[str] = []
        letters: set[str] = set()
        others: set[str] = set()
        for w in words:
            stem = w.rstrip(MARKS)
            if stem.isascii():
                if stem.isalpha() and self.letters and len(stem) <= 64:
                    whole.append(w)
                    stem = stem.lower()
                    stems.append(stem)
                    if stem not in known:
                        letters.add(stem)
                    continue
            elif self.joins and max(stem) < "\u0250" and stem.lower().isalpha():
                whole.append(w)
                stems.append(stem)
                if stem not in known:
                    others.add(stem)
                continue
            others.add(w)
        found = dict(self._joined(list(letters), self.letters))
        found.update(self._encode(list(others)))
        get = known.get
        for w, stem in zip(whole, stems, strict=True):
            ids, run = get(stem), w[len(stem):]
            if ids is None:
                ids = found[stem]
            if run:
                if run not in marks:
                    marks[run] = self._ids([run])[0]
                ids += marks[run]
            found[w] = ids
        if len(marks) > 10_000:
            marks.clear()
        room = REMEMBERED_WORDS - len(known)
        if room > 0:
            known.update(itertools.islice(((w, x) for w, x in found.items() if len(w) <= 64), room))
        return found

    def _known_ids(self, words: pa.Array) -> pa.Array:
        """Ids of different words: the remembered ones are found by Arrow, the others in Python."""
        names, values = self._remembered
        place = pc.index_in(words, names)
        missing = words.filter(pc.is_null(place)).to_pylist()
        ids = list(map(self.known.get, missing))
        if None in ids:
            new = self._new({w for w, x in zip(missing, ids, strict=True) if x is None})
            ids = [new[w] if x is None else x for w, x in zip(missing, ids, strict=True)]
        at = pc.fill_null(place, -1).to_numpy().astype(np.int64)
        at[at < 0] = len(names) + np.arange(len(missing))
        if len(self.known) > 1.2 * len(names):
            self._remembered = self._as_arrays()
        return pa.concat_arrays([values, pa.array(ids, pa.large_binary())]).take(pa.array(at))

    def _word_ids(self, words: pa.Array) -> pa.Array:
        """Ids of different words. Those of ASCII letters and the marks that
        close them are put together of their letters' and their marks' ids."""
        stems = pc.utf8_rtrim(words, MARKS)
        plain = pc.and_(pc.ascii_is_alpha(stems), pc.less_equal(pc.binary_length(stems), 64))
        if not self.letters or not pc.any(plain).as_py():
            return self._known_ids(words)
        lower = pc.ascii_lower(stems.filter(plain)).dictionary_encode()
        runs = pc.ascii_ltrim(words.filter(plain), ASCII_LETTERS).dictionary_encode()
        marks = pa.array(self._ids(runs.dictionary.to_pylist()), pa.large_binary())
        put = pc.binary_join_element_wise(self._known_ids(lower.dictionary).take(lower.indices), marks.take(runs.indices), pa.scalar(b"", pa.large_binary()))
        rest = self._known_ids(words.filter(pc.invert(plain)))
        is_plain = plain.to_numpy(zero_copy_only=False)
        at = np.where(is_plain, np.cumsum(is_plain) - 1, len(put) + np.cumsum(~is_plain) - 1)
        return pa.concat_arrays([put, rest]).take(pa.array(at))

    def encode(self, texts: list[str] | pa.Array, end_id: int | None) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text (null: empty).

        Arrow splits the texts, numbers their different words and puts the
        words' ids together; Python sees each different word once, if it isn't
        remembered.
        """
        end = b"" if end_id is None else np.array([end_id], dtype="<u4").tobytes()
        column = pc.fill_null((texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())).cast(pa.large_string()), "")
        for blank in "\n\t\r":
            column = pc.replace_substring(column, blank, " ")
        words = pc.split_pattern(column, " ")
        numbered = words.flatten().dictionary_encode()
        joined = self._word_ids(numbered.dictionary).take(numbered.indices)
        _, ends, data = joined.buffers()
        if not data or not len(joined):
            return [end] * len(column)
        ends = np.frombuffer(ends, np.int64, len(joined) + 1, 8 * joined.offset)[words.offsets.to_numpy() - words.offsets[0].as_py()].tolist()
        data = memoryview(data)
        return [bytes(data[i:k]) + end for i, k in itertools.pairwise(ends)]


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


# -- the configuration program (driver, on the histogram only) ---------------

def best_configuration(price: np.ndarray, lengths: np.ndarray, most: np.ndarray, capacity: int) -> np.ndarray:
    """Counts of each length, at most ``most``, in the configuration of the
    highest total price: a bounded knapsack by dynamic programming over the
    space used, copies split into powers of two. Ties go to longer pieces."""
    items = []
    for i in np.argsort(-lengths, kind="stable"):
        left, k = min(int(most[i]), capacity // int(lengths[i])), 1
        while left > 0:
            k = min(k, left)
            items.append((int(i), k, int(lengths[i]) * k, float(price[i]) * k))
            left, k = left - k, 2 * k
    value = np.zeros(capacity + 1)
    taken = np.zeros((len(items), capacity + 1), dtype=bool)
    for n, (_, _, size, gain) in enumerate(items):
        if size <= capacity:
            with_it = value[: capacity + 1 - size] + gain
            np.greater(with_it, value[size:] * (1 + 1e-12), out=taken[n, size:])
            np.maximum(value[size:], with_it, out=value[size:])
    counts = np.zeros(len(lengths), dtype=np.int64)
    room = capacity
    for n in range(len(items) - 1, -1, -1):
        if taken[n, room]:
            counts[items[n][0]] += items[n][1]
            room -= items[n][2]
    return counts


def price_configuration(price: np.ndarray, lengths: np.ndarray, open_: np.ndarray, capacity: int) -> np.ndarray:
    """A configuration of open pieces whose price is near the best one's.
    ``lengths`` ascend.

    No configuration is worth more than the capacity filled at the highest
    price a token. The knapsack looks at the dearest lengths, at those that
    complete each of them, and at an even choice of the others; if what it
    finds is less than ``NEAR`` of that bound, at more of them, at last at all
    with all their pieces.
    """
    live = np.flatnonzero(open_ > 0)
    size = lengths[live]
    density = price[live] / size
    bound = density.max() * min(capacity, int((open_[live] * size).sum()))
    dearest = np.lexsort((-size, -density))
    looked, copies = LOOKED, 3
    while True:
        half, rest = dearest[: looked // 2], dearest[looked // 2 :]
        fits = np.searchsorted(size, capacity - size[half], side="right") - 1
        even = rest[np.linspace(0, len(rest) - 1, min(looked // 2, len(rest))).astype(int)] if len(rest) else rest
        chosen = live[np.unique(np.concatenate([half, fits[fits >= 0], even]))]
        last = len(chosen) == len(live) and copies > 3
        counts = best_configuration(price[chosen], lengths[chosen], open_[chosen] if last else np.minimum(open_[chosen], copies), capacity)
        if (counts * price[chosen]).sum() >= NEAR * bound or last:
            out = np.zeros(len(lengths), dtype=np.int64)
            out[chosen] = counts
            return out
        copies += len(chosen) == len(live)
        looked *= 8


def solve_program(lengths: np.ndarray, demand: np.ndarray, capacity: int, rounds: int) -> list[tuple[np.ndarray, int]]:
    """A cover of most of ``demand`` by configurations and how often each is
    used, by multiplicative weights: each round takes the configuration of
    (nearly) the best price as often as open pieces allow, a whole number of
    times, and lowers the prices of the lengths it covers. It ends when no
    configuration of open pieces fills ``FULL`` of a sequence any more.
    """
    open_ = demand.copy()
    found: list[tuple[np.ndarray, int]] = []
    for _ in range(rounds):
        if int((open_ * lengths).sum()) < capacity:
            break
        price = lengths * (lengths / capacity) ** BEND * np.exp(-ETA * (demand - open_) / demand)
        config = price_configuration(price, lengths, open_, capacity)
        if int((config * lengths).sum()) < FULL * capacity:
            # prices may favour a poor filling: the fullest one is the last word
            config = price_configuration(lengths.astype(np.float64), lengths, open_, capacity)
            if int((config * lengths).sum()) < FULL * capacity:
                break
        used = config > 0
        times = int(np.min(open_[used] // config[used]))
        open_ -= times * config
        found.append((config, times))
    return found


def plan_sequences(lengths: np.ndarray, counts: np.ndarray, capacity: int = CAPACITY, rounds: int = ROUNDS) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """Configurations and how often each is used: (lengths, counts, times).

    Every piece of the histogram is in exactly one sequence. The program
    places nearly all of them; the rest goes longest first into the open
    sequence that it fills best. Where most pieces are longer than half a
    sequence, few configurations are full and the program ends early; if best
    fit alone then needs fewer sequences, its plan is taken.
    """
    lengths, left = np.asarray(lengths, dtype=np.int64), np.asarray(counts, dtype=np.int64).copy()
    alone = list(_best_fit(lengths, left, capacity))
    out = by_program(lengths, left, capacity, rounds)
    for sizes, used, times in out:
        left[np.searchsorted(lengths, sizes)] -= used * times
    out.extend(_best_fit(lengths, left, capacity))
    return out if sum(x[2] for x in out) <= sum(x[2] for x in alone) else alone


def by_program(lengths: np.ndarray, counts: np.ndarray, capacity: int = CAPACITY, rounds: int = ROUNDS) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """The program's part of the plan; ``lengths`` ascend."""
    out = [(lengths[i : i + 1], np.ones(1, dtype=np.int64), int(counts[i])) for i in np.flatnonzero((lengths == capacity) & (counts > 0))]
    live = np.flatnonzero((lengths < capacity) & (counts > 0))
    for config, times in solve_program(lengths[live], counts[live], capacity, rounds):
        out.append((lengths[live][config > 0], config[config > 0], times))
    return out


def _best_fit(lengths: np.ndarray, left: np.ndarray, capacity: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Fill one sequence after another from what is left; a filling is used as
    often as it repeats."""
    left = left.copy()
    while left.any():
        live = np.flatnonzero(left > 0)
        config = _fill(lengths[live], left[live], capacity)
        used = config > 0
        times = int(np.min(left[live][used] // config[used]))
        left[live] -= times * config
        yield lengths[live][used], config[used], times


def _fill(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> np.ndarray:
    """Best fit: the longest piece that still fits, again and again."""
    config = np.zeros(len(lengths), dtype=np.int64)
    order = np.argsort(-lengths)
    room = capacity
    for i in order:
        take = min(int(counts[i]), room // int(lengths[i]))
        if take:
            config[i] = take
            room -= take * int(lengths[i])
        if room == 0:
            break
    return config


def lookup_table(plan: list[tuple[np.ndarray, np.ndarray, int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: from which rank on, which sequence, what step, what offset.

    A length's pieces are numbered; those from ``first`` on (up to the next
    entry's) go to sequences ``base``, ``base + 1``, ... at ``offset``.
    """
    rows: dict[int, list[tuple[int, int, int]]] = {}
    next_rank: dict[int, int] = {}
    base = 0
    for sizes, counts, times in plan:
        offset = 0
        for size, n in sorted(zip(sizes.tolist(), counts.tolist(), strict=True), reverse=True):
            for _ in range(n):
                rank = next_rank.get(size, 0)
                rows.setdefault(size, []).append((rank, base, offset))
                next_rank[size] = rank + times
                offset += size
        base += times
    return {size: tuple(np.array(x, dtype=np.int64) for x in zip(*r, strict=True)) for size, r in rows.items()}


# -- the Spark jobs -----------------------------------------------------------

PIECES = T.StructType([
    T.StructField("part", T.IntegerType()), T.StructField("nth", T.LongType()), T.StructField("id", T.LongType()),
    T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.IntegerType()),
    T.StructField("ids", T.BinaryType()),
])


def tokenize_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int | None = END_ID) -> DataFrame:
    """One row per piece of each document of (id, text): its ids, its task and
    how many pieces of the same length that task had before it."""
    build = batches({"part": pa.int32(), "nth": pa.int64(), "id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int32(), "ids": pa.binary()})

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, seen, part = encoder(tokenizer_path), {}, TaskContext.get().partitionId()
        for batch in small_batches(it, most_bytes=4 << 20):
            rows: list[list] = [[] for _ in range(7)]
            for id_, ids in zip(batch.column("id").to_pylist(), enc.encode(batch.column("text"), end_id), strict=True):
                n = len(ids) // 4
                for piece, at in enumerate(range(0, n, capacity)):
                    length = min(capacity, n - at)
                    nth = seen.get(length, 0)
                    seen[length] = nth + 1
                    for col, v in zip(rows, (part, nth, id_, piece, at, length, ids[4 * at : 4 * (at + length)]), strict=True):
                        col.append(v)
            yield build(*rows)

    return docs.mapInArrow(run, PIECES)


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
         end_id: int | None = END_ID, rounds: int = ROUNDS) -> DataFrame:
    """Pack documents: a row per piece with ``id_col``, piece, start, length,
    ids (little-endian unsigned 32-bit), sequence_id and offset."""
    pieces = stage(tokenize_pieces(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), tokenizer_path, capacity, end_id), "pieces")
    per_part = stage(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    # at most `capacity` rows
    histogram = per_part.groupBy("length").agg(F.sum("n").alias("n")).orderBy("length").collect()
    plan = plan_sequences(np.array([r["length"] for r in histogram], dtype=np.int64), np.array([r["n"] for r in histogram], dtype=np.int64), capacity, rounds)
    # its rows are bounded by the configurations found, not by the documents
    table = pieces.sparkSession.sparkContext.broadcast(lookup_table(plan))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = per_part.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(base, ["part", "length"]).select("id", "piece", "start", "length", "ids", (F.col("base") + F.col("nth")).alias("rank"))
    schema = T.StructType([T.StructField(id_col, T.LongType()), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
                           T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType()),
                           T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = table.value
        for batch in it:
            if not batch.num_rows:
                continue
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            seq, off = np.empty(len(rank), dtype=np.int64), np.empty(len(rank), dtype=np.int64)
            order = np.argsort(length, kind="stable")
            ends = np.flatnonzero(np.diff(length[order], append=-1)) + 1
            at = 0
            for to in ends:
                rows = order[at:to]
                first, base_, offset = found[int(length[rows[0]])]
                k = np.searchsorted(first, rank[rows], side="right") - 1
                seq[rows], off[rows] = base_[k] + rank[rows] - first[k], offset[k]
                at = to
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("piece"), batch.column("start"), pa.array(length.astype(np.int64)), batch.column("ids"), pa.array(seq), pa.array(off)],
                names=[f.name for f in schema])

    return ranked.mapInArrow(place, schema)
