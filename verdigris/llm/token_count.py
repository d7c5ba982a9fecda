"""Token counts by rank-synchronous merging of ragged numpy arrays.

A batch's distinct pre-tokens are held as one flat array of symbols with sequence borders. In each round every
sequence applies its own pair of lowest rank, at all places that do not overlap, left to right; a sequence without
a ranked pair is done, and what is left of it is its number of tokens. Words of LONG bytes or more take the pairs from a heap, in the same
order, at a cost of about n log n. Normalisation and the rare characters'
pre-tokenization are the tokenizer library's own, so that no Unicode table is restated here.

A tokenizers file of another form is served by the library itself. Null texts count as empty. Special strings inside a text count one token each, as the library does by default.
"""

from __future__ import annotations

import json
import re
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.llm.bpe_units import WHITE, Units, byte_symbols, read_spec
from verdigris.llm.common import map_batches, pick, texts

#: Distinct chunks that a worker keeps between batches; a full cache is emptied, which changes no count.
CACHE = 400_000
#: Words of this many bytes or more are merged one by one, as a round over all symbols for each rank would cost the square of their length.
LONG = 256
EASY = re.compile("[\x21-\x7eÀ-ÖØ-öø-ž]*")


def merge_counts(words: list[bytes], model: Model) -> np.ndarray:
    """The number of tokens of each word, given as its bytes."""
    lengths = np.array([len(w) for w in words], np.int64)
    out = np.zeros(len(words), np.int64)
    symbols = model.first[np.frombuffer(b"".join(words), np.uint8)]
    seq = np.repeat(np.arange(len(words)), lengths)
    ends = np.cumsum(lengths)[lengths > 0] - 1
    symbols[ends] = model.last[np.frombuffer(b"".join(w[-1:] for w in words), np.uint8)] if model.last is not None else symbols[ends]
    out += lengths
    while len(symbols) > 1:
        rank, merged = model.look_up(symbols[:-1], symbols[1:])
        rank[seq[:-1] != seq[1:]] = model.none
        starts = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
        padded = np.append(rank, model.none)
        best = np.minimum.reduceat(padded, starts)
        alive = best < model.none
        if not alive.any():
            break
        own = np.repeat(best, np.diff(np.append(starts, len(seq))))
        hit = np.append(rank, model.none) == np.where(own < model.none, own, -1)
        # pairs that overlap are a run of hits (the pair of a symbol with itself): every other one merges
        at = np.flatnonzero(hit)
        run = np.flatnonzero(np.r_[True, np.diff(at) > 1])
        odd = (np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))) % 2
        at = at[odd == 0]
        symbols[at] = merged[at]
        np.subtract.at(out, seq[at], 1)
        keep = np.repeat(alive, np.diff(np.append(starts, len(seq))))
        keep[at + 1] = False
        symbols, seq = symbols[keep], seq[keep]
    return out


def merge_long(word: bytes, model: Model) -> int:
    """The number of tokens of one long word: a heap of (rank, place), in which only the neighbours of what has merged are looked at again."""
    symbols = model.first[np.frombuffer(word, np.uint8)].tolist()
    if model.last is not None:
        symbols[-1] = int(model.last[word[-1]])
    n, size, get = len(symbols), model.size, model.pairs().get
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [found[0] << 40 | i for i in range(n - 1) if (found := get(symbols[i] * size + symbols[i + 1]))]
    heapify(heap)
    left, place = n, (1 << 40) - 1
    while heap:
        top = heappop(heap)
        i = top & place
        j = after[i]
        if symbols[i] < 0 or j >= n or (found := get(symbols[i] * size + symbols[j])) is None or found[0] != top >> 40:
            continue  # one of the pair has merged since
        symbols[i], symbols[j] = found[1], -1
        left -= 1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            if found := get(symbols[i] * size + symbols[k]):
                heappush(heap, found[0] << 40 | i)
        if (h := before[i]) >= 0 and (found := get(symbols[h] * size + symbols[i])):
            heappush(heap, found[0] << 40 | h)
    return left


class Model:
    """Ranked pairs as a sorted array of keys."""

    def __init__(self, model: dict):
        vocab, merges = model["vocab"], [m.split(" ", 1) if isinstance(m, str) else m for m in model["merges"]]
        end = model.get("end_of_word_suffix") or ""
        self.size = 1 + max(vocab.values())
        pairs = np.array([[vocab[a], vocab[b], vocab[a + b]] for a, b in merges], np.int64).reshape(-1, 3)
        keys = pairs[:, 0] * self.size + pairs[:, 1]
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.merged = np.append(keys[order], np.iinfo(np.int64).max), np.append(order, len(order)), np.append(pairs[order, 2], 0)
        self.none = len(merges)
        self._pairs: dict[int, tuple[int, int]] | None = None
        self.first = np.array([vocab[s] for s in byte_symbols()], np.int64)
        self.last = np.array([vocab[s + end] for s in byte_symbols()], np.int64) if end else None

    def pairs(self) -> dict[int, tuple[int, int]]:
        """(rank, merged symbol) by key, made when a long word comes first."""
        if self._pairs is None:
            self._pairs = dict(zip(self.keys[:-1].tolist(), zip(self.rank[:-1].tolist(), self.merged[:-1].tolist(), strict=True), strict=True))
        return self._pairs

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left * self.size + right
        at = np.searchsorted(self.keys, key)
        found = self.keys[at] == key
        return np.where(found, self.rank[at], self.none), self.merged[at]


def fits(spec: dict) -> bool:
    """Whether a tokenizer file is byte-level BPE over words of a pattern, with ends of words; for others the library counts."""
    model, steps = spec["model"], (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
    words = [s.get("type") for s in steps] == ["Split", "ByteLevel"] and "Regex" in steps[0].get("pattern", {}) and steps[0].get("invert") and steps[0].get("behavior") == "Removed" and not steps[1].get("add_prefix_space")
    return bool(plain and words and model.get("end_of_word_suffix") and spec.get("normalizer"))


class Counter:
    """Counts tokens of texts; made once in each worker."""

    def __init__(self, spec: str):
        d = json.loads(spec)
        self.units = Units(spec)
        self.tok = self.units.tok
        self.model = Model(d["model"]) if fits(d) else None
        if self.model is None:
            return
        self.split = regex.compile(d["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.bytes_of = {s: bytes([b]) for b, s in enumerate(byte_symbols())}
        self.white = re.compile(f"[{WHITE}]+")
        self.odd_white = re.compile("[\x1c-\x1f]")  # white space to str.split() alone
        self.cache: dict[str, int] = {}

    def chunks(self, text: str) -> list[str]:
        """Pieces between white space; no pre-token reaches over it."""
        return [c for c in self.white.split(text) if c] if self.odd_white.search(text) else text.split()

    def parts(self, text: str) -> tuple[list[str], int]:
        """A text's chunks, and how many special strings it holds."""
        if self.units.split is None or self.units.hint not in text:
            return self.chunks(text), 0
        pieces = self.units.split.split(text)
        return [c for p in pieces[::2] for c in self.chunks(p)], len(pieces) // 2

    def pretokens(self, chunks: list[str]) -> list[list[bytes]]:
        whole = self.tok.normalizer.normalize_str(" ".join(chunks)).split(" ")
        if len(whole) != len(chunks):
            whole = [self.tok.normalizer.normalize_str(c) for c in chunks]
        return [[w.encode() for w in self.split.findall(c)] if EASY.fullmatch(c) else [b"".join(map(self.bytes_of.__getitem__, w)) for w, _ in self.tok.pre_tokenizer.pre_tokenize_str(c)] for c in whole]

    def learn(self, chunks: list[str]) -> None:
        pre = self.pretokens(chunks)
        words = list({w for ws in pre for w in ws})
        short = [w for w in words if len(w) < LONG]
        n = dict(zip(short, merge_counts(short, self.model).tolist(), strict=True)) if short else {}
        n.update((w, merge_long(w, self.model)) for w in words if len(w) >= LONG)
        self.cache.update((c, sum(map(n.__getitem__, ws))) for c, ws in zip(chunks, pre, strict=True))

    def count(self, batch: list[str]) -> list[int]:
        if self.model is None:
            return [len(e.ids) for e in self.tok.encode_batch(batch, add_special_tokens=False)]
        split = [self.parts(t) for t in batch]
        if len(self.cache) > CACHE:
            self.cache.clear()
        new: set[str] = set()
        for chunks, _ in split:
            new.update(chunks)
        new.difference_update(self.cache)
        if new:
            self.learn(list(new))
        get = self.cache.__getitem__
        return [sum(map(get, chunks)) + special for chunks, special in split]


_made: dict[str, Counter] = {}


def count_tokens(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every row, by the tokenizer file at that path."""
    spec = docs.sparkSession.sparkContext.broadcast(read_spec(tokenizer))

    def count(batch):
        from verdigris.llm import token_count  # the module's own state outlives a task in a reused worker

        counter = token_count._made.get(spec.value) or token_count._made.setdefault(spec.value, Counter(spec.value))
        for begin in range(0, batch.num_rows, 500):
            part = batch.slice(begin, 500)
            ts = texts(part)
            yield pa.record_batch([part.column("doc_id"), pa.array([len(t.encode()) for t in ts], pa.int64()), pa.array(counter.count(ts), pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return map_batches(pick(docs, id_col, text_col), count, "doc_id long, n_bytes long, n_tokens long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: doc_id, n_bytes, n_tokens, over_limit."""
    import public_tokenizers

    from verdigris.llm.common import read

    out = count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return out.withColumn("over_limit", F.col("n_tokens") > 2048)
