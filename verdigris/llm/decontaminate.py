"""Benchmark decontamination by template windows, which also finds re-parameterised questions.

Texts become canonical words: a run of numbers is NUM, a unit after a number UNIT, a run of capitalised words inside a sentence
NAME, any other word itself in lower case, so that "twenty five" and "25", or "New York" and "Paris", are one placeholder each.
Every text is read in three ways: *plain*, all words as they are in lower case; *templates*, where capitalised words that begin
sentences are literal; and *names*, where they are names. Every window of ``WINDOW`` words of each reading is hashed (shorter items
use windows of their whole length), by placeholders where at least half of its words are literal, else by values,
so that rows of numbers are not all one template.

1. The benchmark's windows are a table. A Bloom filter of their hashes, of at most 2^``MOST_BITS`` bits, goes to the executors.
2. Documents are read once, whatever the size of the benchmark: windows that pass the filter become rows with their values.
3. They meet the benchmark's windows in a hash join, whose hot keys AQE splits, and each document and item that share windows
   are compared by their rows: a value of the item must always meet the same value in the document. Values that meet several along
   one alignment rule their windows out; alignments are then taken from the largest on, and a window that contradicts what was
   taken before does not count.

A document holds an item if consistent windows cover at least ``coverage`` of the windows of one of the item's readings, or if
``run`` or more consecutive words of a longer item match. An item of fewer than ``LEAST`` words is held where a whole sentence or line
equals it. One row tells which item, how much of it, and whether its values were changed.

Null and empty texts hold nothing. A letter of a script without spaces is a word. Items with equal text are compared once and
give a row for each different item_id; a null item_id is an item. Rows of documents with the same id and text are one
document here. Many items with one template in a document are a row each, as each is held.
"""

from __future__ import annotations

import re
import struct
from dataclasses import dataclass
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.llm.common import discard, map_batches, materialize, pick, read, release, small_slices, texts, unused

WINDOW, LEAST = 8, 5
#: Bits of the filter for each window, the most bits as a power of two, and those of one of its pieces.
BITS_EACH, MOST_BITS, PIECE_BITS = 256, 30, 20
#: Rows of 16 bytes that are broadcast at most.
NEAR_IDS = 8_000_000
#: Letters of scripts without spaces between words (Thai, Lao, Burmese, Khmer, kana, Han), each a word.
SPACELESS = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff"
TOKEN = re.compile(rf"\d+(?:[.,:/]\d+)*|[^\W\d_{SPACELESS}]+|(?=[^\W\d_])[{SPACELESS}]|[.!?:;,\n]")
#: The same for texts without such letters.
EASY, SPACELESS_LETTER = re.compile(r"\d+(?:[.,:/]\d+)*|[^\W\d_]+|[.!?:;,\n]"), re.compile(f"[{SPACELESS}]")
#: Words that are units after a number.
UNITS = frozenset(
    "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers kilometre kilometres "
    "g kg mg lb lbs oz ton tons gram grams kilogram kilograms pound pounds ounce ounces l ml liter liters litre litres gallon gallons cup cups "
    "s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years "
    "percent cent cents dollar dollars euro euros usd eur gbp mph kmh kph degree degrees celsius fahrenheit".split()
)
#: Words that are numbers.
NUMBERS = frozenset("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million".split())
LITERAL, NUM, UNIT, NAME, STOP, COMMA = range(6)
PLAIN, TEMPLATE, NAMED, SENTENCE = range(4)
SPECIAL = {",": COMMA} | dict.fromkeys(".!?:;\n", STOP) | dict.fromkeys(UNITS, UNIT) | dict.fromkeys(NUMBERS, NUM)
BASE = np.uint64(0x9E3779B97F4A7C15)
MARKS = np.array([0, 11, 22, 33, 44, 55], np.uint64) * np.uint64(0xD6E8FEB86659FD93)


def _kind(token: str, low: str) -> int:
    """The kind of a token, which is low in lower case."""
    if (special := SPECIAL.get(low)) is not None:
        return special
    first = token[0]
    if first.isupper():
        return NAME if len(token) == 1 or not token.isupper() else LITERAL
    return NUM if first.isdigit() else LITERAL


class Numbers(dict):
    """Numbers words in the order in which they are asked for."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


@dataclass
class Reading:
    """Words of some texts, end to end. code: what makes a template; value: what a word stands for; slot and head: whether it is
    a placeholder, and one that begins a sentence."""

    way: int
    code: np.ndarray
    value: np.ndarray
    slot: np.ndarray
    head: np.ndarray
    text: np.ndarray


class Canonicalizer:
    """Readings of texts; keeps what it knows of words between batches."""

    def __init__(self):
        self.rows = Numbers()
        self.kinds, self.hashes = np.zeros(0, np.int8), np.zeros(0, np.uint64)

    def __call__(self, batch: list[str]) -> tuple[list[Reading], np.ndarray]:
        """The readings, and where sentences begin in the plain one."""
        cut = [(EASY if t.isascii() or not SPACELESS_LETTER.search(t) else TOKEN).findall(t) for t in batch]
        if len(self.rows) > 200_000:
            self.rows, self.kinds, self.hashes = Numbers(), np.zeros(0, np.int8), np.zeros(0, np.uint64)
        known = len(self.kinds)
        sizes = np.array([len(c) for c in cut], np.int64)
        at = np.fromiter(map(self.rows.__getitem__, chain.from_iterable(cut)), np.int64, int(sizes.sum()))
        fresh = list(islice(self.rows, known, None))
        low = [w.lower() for w in fresh]
        self.kinds = np.append(self.kinds, np.fromiter(map(_kind, fresh, low), np.int8, len(fresh)))
        self.hashes = np.append(self.hashes, np.fromiter((xxhash.xxh3_64_intdigest(w) for w in low), np.uint64, len(low)))
        text = np.repeat(np.arange(len(cut)), sizes)
        kind, value = self.kinds[at], self.hashes[at]
        # the first word of a sentence or text; words that no comma or border parts from the one before
        keep = (kind != STOP) & (kind != COMMA)
        stops, commas = np.cumsum(kind == STOP)[keep], np.cumsum(kind == COMMA)[keep]
        kind, value, text = kind[keep].copy(), value[keep], text[keep]
        begins = np.ones(len(kind), bool)
        begins[1:] = (stops[1:] != stops[:-1]) | (text[1:] != text[:-1])
        apart = begins.copy()
        apart[1:] |= commas[1:] != commas[:-1]
        after = np.zeros(len(kind), bool)
        after[1:] = (kind[:-1] == NUM) & ~apart[1:]
        kind[(kind == UNIT) & ~after] = LITERAL
        head = begins & (kind == NAME)
        none = np.zeros(len(kind), bool)
        out = [Reading(PLAIN, value, value, none, none, text)]
        if (kind != LITERAL).any():
            out.append(_merged(TEMPLATE, np.where(head, LITERAL, kind), value, none, text, apart))
        if head.any():
            out.append(_merged(NAMED, kind, value, head, text, apart))
        return out, begins


def _merged(way: int, kind: np.ndarray, value: np.ndarray, head: np.ndarray, text: np.ndarray, apart: np.ndarray) -> Reading:
    """The reading in which runs of numbers and runs of names are one word each."""
    first = np.ones(len(kind), bool)
    first[1:] = (kind[1:] != kind[:-1]) | apart[1:] | (kind[1:] != NUM) & (kind[1:] != NAME)
    begin = np.flatnonzero(first)
    place = np.arange(len(kind)) - np.repeat(begin, np.diff(np.append(begin, len(kind))))
    whole = np.add.reduceat(value * (np.uint64(1) + place.astype(np.uint64) * BASE), begin)
    kind = kind[begin]
    return Reading(way, np.where(kind == LITERAL, whole, MARKS[kind]), whole, kind != LITERAL, head[begin], text[begin])


def _end(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    return h * np.uint64(0xBF58476D1CE4E5B9)


def windows(r: Reading, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of every window of that length inside one text."""
    n = len(r.code) - length + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    start = np.flatnonzero(r.text[:n] == r.text[length - 1 :])
    salt = np.uint64(length + 100 * (r.way == PLAIN))
    by_code = np.full(n, salt)
    for j in range(length):
        by_code = by_code * BASE + r.code[j : j + n]
    h = by_code[start]
    if r.way != PLAIN:
        slots = np.cumsum(np.append(0, r.slot & ~r.head))
        few = np.flatnonzero(2 * (slots[start + length] - slots[start]) > length)  # too few literal words: by value
        by_value = np.full(len(few), salt + np.uint64(200))
        for j in range(length):
            by_value = by_value * BASE + r.value[start[few] + j]
        h[few] = by_value
    return start, _end(h)


def sentences(r: Reading, begins: np.ndarray, lengths: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, words, hash) of every sentence of the plain reading with so many words."""
    begin = np.flatnonzero(begins)
    size = np.diff(np.append(begin, len(r.value)))
    begin, size = begin[np.isin(size, lengths)], size[np.isin(size, lengths)]
    h = size.astype(np.uint64) + np.uint64(300)
    for j in range(LEAST - 1):
        on = size > j
        h[on] = h[on] * BASE + r.value[begin[on] + j]
    return begin, size, _end(h)


ROW = "h long, way int, start int, words int, vals binary, slots int, heads int"


def _rows(r: Reading, way: int, start: np.ndarray, words: np.ndarray, h: np.ndarray) -> list[pa.Array]:
    """The columns of ROW."""
    vals, slots, heads = [], np.zeros(len(start), np.int32), np.zeros(len(start), np.int32)
    for s, n in zip(start.tolist(), words.tolist(), strict=True):
        vals.append(r.value[s : s + n].tobytes())
    for j in range(WINDOW):
        on = np.flatnonzero(words > j)
        slots[on] |= r.slot[start[on] + j].astype(np.int32) << j
        heads[on] |= r.head[start[on] + j].astype(np.int32) << j
    first = np.searchsorted(r.text, r.text[start]) if len(start) else start
    return [pa.array(h.view(np.int64)), pa.array(np.full(len(h), way, np.int32)), pa.array((start - first).astype(np.int32)), pa.array(words.astype(np.int32)), pa.array(vals, pa.binary()), pa.array(slots), pa.array(heads)]


NAMES = ["h", "way", "start", "words", "vals", "slots", "heads"]


def item_windows(items: DataFrame) -> DataFrame:
    """(item, total: the reading's windows, and ROW) of every window of items (item long, text)."""

    def run(batch):
        for part in small_slices(batch, 2 << 20):
            readings, begins = Canonicalizer()(texts(part))
            for r in readings:
                sizes = np.bincount(r.text, minlength=part.num_rows)
                for n in sorted({min(WINDOW, x) for x in sizes.tolist() if x >= LEAST}):
                    start, h = windows(r, n)
                    own = np.minimum(sizes, WINDOW)[r.text[start]] == n
                    start, h = start[own], h[own]
                    yield _item_batch(part, r, r.way, start, np.full(len(start), n), h, sizes[r.text[start]] - n + 1)
                if r.way == PLAIN and ((sizes > 0) & (sizes < LEAST)).any():
                    first = np.flatnonzero(np.r_[True, r.text[1:] != r.text[:-1]])
                    start, words, h = sentences(r, np.isin(np.arange(len(r.text)), first), list(range(1, LEAST)))
                    yield _item_batch(part, r, SENTENCE, start, words, h, np.ones(len(start), np.int64))

    return map_batches(items, run, f"item long, total long, {ROW}")


def _item_batch(part, r, way, start, words, h, total) -> pa.RecordBatch:
    return pa.record_batch([part.column("item").take(pa.array(r.text[start])), pa.array(total.astype(np.int64)), *_rows(r, way, start, words, h)], ["item", "total", *NAMES])


class Filter:
    """A Bloom filter of window hashes, two bits for each, and the lengths of the benchmark's windows and short items."""

    def __init__(self, power: int, pieces: list[tuple[int, bytes]], lengths: list[int], short: list[int]):
        self.power, self.lengths, self.short = power, lengths, short
        self.bits = np.zeros(1 << (power - 3), np.uint8)
        for i, data in pieces:
            self.bits[i << (PIECE_BITS - 3) : (i + 1) << (PIECE_BITS - 3)] = np.frombuffer(data, np.uint8)

    def holds(self, h: np.ndarray) -> np.ndarray:
        """Places in h that may be in the benchmark."""
        at = np.arange(len(h))
        for place in (bit_places(h, self.power)[0], None):
            place = bit_places(h[at], self.power)[1] if place is None else place
            at = at[(self.bits[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)]
        return at


def bit_places(h: np.ndarray, power: int) -> tuple[np.ndarray, np.ndarray]:
    right = np.uint64(64 - power)
    return (h >> right).astype(np.int64), ((h * BASE) >> right).astype(np.int64)


def filter_of(found: DataFrame) -> Filter:
    """The filter of item windows; its pieces are made where they lie, and its size is bounded by MOST_BITS."""
    facts = found.select("way", "words").groupBy("way", "words").agg(F.count("*").alias("n")).collect()  # a row for each reading and length
    power = min(MOST_BITS, max(PIECE_BITS, (BITS_EACH * sum(r["n"] for r in facts)).bit_length()))

    def places(batch):
        both = np.unique(np.concatenate(bit_places(batch.column("h").to_numpy().view(np.uint64), power)))
        yield pa.record_batch([pa.array((both >> PIECE_BITS).astype(np.int32)), pa.array((both & ((1 << PIECE_BITS) - 1)).astype(np.int32))], ["piece", "bit"])

    def piece(group: pa.Table) -> pa.Table:
        bits = np.zeros(1 << PIECE_BITS, np.uint8)
        bits[group["bit"].to_numpy()] = 1
        return pa.table({"piece": pa.array(group["piece"].to_numpy()[:1]), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    pieces = map_batches(found.select("h"), places, "piece int, bit int").distinct().groupBy("piece").applyInArrow(piece, "piece int, bits binary").collect()
    return Filter(power, [(r["piece"], r["bits"]) for r in pieces], sorted({r["words"] for r in facts if r["way"] != SENTENCE}), sorted({r["words"] for r in facts if r["way"] == SENTENCE}))


def document_windows(docs: DataFrame, shared) -> DataFrame:
    """(doc_id, text_hash, and ROW) of the windows of docs (doc_id, text_hash, text) that pass the broadcast filter."""

    def run(batches):
        canonical = Canonicalizer()
        for batch in batches:
            for part in small_slices(batch, 2 << 20):
                readings, begins = canonical(texts(part))
                for r in readings:
                    has = np.zeros(part.num_rows, bool)  # texts in which a reading says more than the one before it
                    has[r.text[r.slot if r.way == TEMPLATE else r.head]] = True
                    found = [(r.way, *windows(r, n), np.int64(n)) for n in shared.value.lengths]
                    if r.way == PLAIN and shared.value.short:
                        start, words, h = sentences(r, begins, shared.value.short)
                        found.append((SENTENCE, start, h, words))
                    for way, start, h, words in found:
                        at = shared.value.holds(h)
                        if r.way != PLAIN:
                            at = at[has[r.text[start[at]]]]
                        if len(at):
                            words = np.broadcast_to(words, len(h))[at]
                            own = pa.array(r.text[start[at]])
                            yield pa.record_batch([part.column("doc_id").take(own), part.column("text_hash").take(own), *_rows(r, way, start[at], words, h[at])], ["doc_id", "text_hash", *NAMES])
            release()

    return docs.mapInArrow(run, f"doc_id long, text_hash long, {ROW}")


def compare(hits: list[dict], coverage: float, run: int) -> tuple[float, int, bool] | None:
    """(coverage, longest run of words, whether any value differs) of one document and item by their common windows."""
    best = None
    for way in sorted({h["way"] for h in hits}):
        own = [h for h in hits if h["way"] == way]
        by: dict[tuple[int, int], list[dict]] = {}
        for h in own:
            n, same, pairs, literal = len(h["vals"]) // 8, h["vals"] == h["doc_vals"], frozenset(), 0
            if len(h["vals"]) != len(h["doc_vals"]) or not (same or h["slots"]):
                continue  # equal hashes of different windows
            if h["slots"]:
                each = list(zip(struct.unpack(f"<{n}Q", h["vals"]), struct.unpack(f"<{n}Q", h["doc_vals"]), strict=True))
                places = [j for j in range(n) if h["slots"] >> j & 1]
                if not same and any(x != y for j, (x, y) in enumerate(each) if j not in places):
                    continue
                pairs = {each[j] for j in places}
                literal = n - sum(not (h["heads"] >> j & 1 and each[j][0] == each[j][1]) for j in places)
            if same or 2 * literal >= n:
                by.setdefault((h["doc_way"], h["doc_start"] - h["start"]), []).append({"start": h["start"], "n": n, "pairs": pairs, "same": same})
        taken: dict[int, int] = {}
        covered: set[int] = set()
        longest, changed = 0, False
        alignments = []
        for key, ws in by.items():
            met: dict[int, set[int]] = {}
            for w in ws:
                for a, b in w["pairs"]:
                    met.setdefault(a, set()).add(b)
            good = [w for w in ws if w["same"] or all(len(met[a]) == 1 for a, _ in w["pairs"])]
            alignments.append((-len({w["start"] for w in good}), key, good))
        for _, _, good in sorted(alignments, key=lambda x: x[:2]):
            good = [w for w in good if all(taken.get(a, b) == b for a, b in w["pairs"])]
            for w in good:
                taken.update(w["pairs"])
            starts = sorted({w["start"] for w in good})
            covered.update(starts)
            changed |= not all(w["same"] for w in good)
            for i, s in enumerate(starts):
                if i == 0 or s != starts[i - 1] + 1:
                    first = s
                longest = max(longest, s - first + good[0]["n"])
        share = len(covered) / own[0]["total"]
        if covered and (share >= coverage or longest >= run):
            best = max([x for x in (best, (share, longest, changed)) if x], key=lambda x: (x[0], not x[2], x[1]))
    return best


MATCH = "doc_id long, item_id long, coverage double, longest_run long, changed boolean"


def _held(docs: DataFrame, benchmark: DataFrame, coverage: float, run: int, item_col: str, item_text_col: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_hash, item, coverage, longest_run, changed) of docs (doc_id, text_hash, text), and (item, item_id)."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("text")).where("text <> ''").withColumn("item", F.xxhash64("text"))
    found = materialize(item_windows(items.select("item", "text").dropDuplicates(["item"])), "item-windows")
    shared = docs.sparkSession.sparkContext.broadcast(filter_of(found))
    theirs = document_windows(docs, shared).select("doc_id", "text_hash", "h", F.col("way").alias("doc_way"), F.col("start").alias("doc_start"), F.col("vals").alias("doc_vals")).distinct()
    theirs = materialize(theirs, "document-windows")
    hits = theirs.join(found.select("h", "item", "total", "way", "start", "vals", "slots", "heads"), "h")

    def held(group: pa.Table) -> pa.Table:
        best = compare(group.to_pylist(), coverage, run)
        rows = [best] if best else []
        keys = {c: group[c].slice(0, len(rows)).combine_chunks() for c in ("doc_id", "text_hash", "item")}
        return pa.table({**keys, "coverage": pa.array([r[0] for r in rows], pa.float64()), "longest_run": pa.array([r[1] for r in rows], pa.int64()), "changed": pa.array([r[2] for r in rows], pa.bool_())})

    out = hits.groupBy("doc_id", "text_hash", "item").applyInArrow(held, "doc_id long, text_hash long, item long, coverage double, longest_run long, changed boolean")
    return materialize(out, "held-items"), items.select("item", "item_id").distinct()


def find_leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = 0.5, run: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """A row, as in MATCH, for every document and item that it holds."""
    own = pick(docs, id_col, text_col).withColumn("text_hash", F.xxhash64("text"))
    held, ids = _held(own, benchmark, coverage, run, item_col, item_text_col)
    return held.join(ids, "item").select("doc_id", "item_id", "coverage", "longest_run", "changed")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = 0.5, run: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", near_ids: int = NEAR_IDS) -> DataFrame:
    """docs without the rows that hold an item. The rows that go are broadcast if there are at most near_ids (16 bytes each), so that
    texts are not shuffled."""
    own = pick(docs, id_col, text_col).withColumn("text_hash", F.xxhash64("text"))
    held, _ = _held(own, benchmark, coverage, run, item_col, item_text_col)
    gone, digest = unused(docs, "_lost"), unused(docs, "_hash")
    lost = held.select(F.col("doc_id").alias(gone), F.col("text_hash").alias(digest)).distinct()
    same = F.col(id_col).cast("long").eqNullSafe(F.col(gone)) & (F.xxhash64(F.col(text_col).cast("string")) == F.col(digest))
    return docs.join(F.broadcast(lost) if lost.count() <= near_ids else lost, same, "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: doc_id, item_id, coverage, longest_run, changed."""
    return find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
