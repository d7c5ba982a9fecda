"""Language identification by a linear-chain conditional random field over words.

Each word's score for a language is a sum of learned weights: character 2- and 3-grams, affixes (the n-grams that
touch a word's border, up to four characters), the word itself, and membership of each language's lexicon, the
words seen often in its training text. Learned transition and start weights tie neighbours together, so that
forward-backward labels every word of code-switched text. A document's language is the one with the largest mean
of the words' marginals, which is also the score.

Training uses at most ``ROWS`` documents of each language, chosen by a hash of id and text, and every word of each, in pieces of
``SEGMENT_WORDS`` words; pieces of different languages are strung together so that transitions
see switches. This bound is the only one: prediction covers every word of every text. lang, source and doc_id are no
inputs of a prediction. Ids may be null or repeat.

A document whose text is null or has no letter is ``und`` with score 0. So is every document if there is nothing to
learn from. Words are runs of letters, lower-cased.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verdigris.llm.common import map_batches, pick, release, small_slices, texts

ROWS, SEGMENT_WORDS = 250, 25
BUCKETS = 1 << 16
CHUNK = 64
CACHE = 200_000
LETTERS = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    return LETTERS.findall(text.lower())


def mix(x: np.ndarray) -> np.ndarray:
    """Buckets of 64-bit numbers."""
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(64 - 16)).astype(np.int64)


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word index, bucket) of every feature of every word, in the words' order. Borders are a line feed."""
    flat = np.frombuffer(("\n" + "\n\n".join(words) + "\n").encode("utf-32-le"), np.uint32).astype(np.uint64)
    lengths = np.array([len(w) for w in words], np.int64)
    owner = np.repeat(np.arange(len(words)), lengths + 2)
    out_word, out_bucket = [], []
    code = flat.copy()
    begins = np.cumsum(lengths + 2) - (lengths + 2)
    place = (np.arange(len(flat)) - np.repeat(begins, lengths + 2)).astype(np.uint64)
    whole = np.add.reduceat((flat + np.uint64(1)) * (place * place + np.uint64(40_503)) * np.uint64(2_654_435_761), begins)
    out_word.append(np.arange(len(words)))
    out_bucket.append(mix(whole + np.uint64(7)))
    for n in (2, 3, 4):
        code = code[:-1] * np.uint64(1_000_003) + flat[n - 1 :]
        inside = owner[: len(code)] == owner[n - 1 :]
        if n == 4:  # four characters only at a border
            inside &= (flat[: len(code)] == 10) | (flat[n - 1 :] == 10)
        at = np.flatnonzero(inside)
        out_word.append(owner[at])
        out_bucket.append(mix(code[at] + np.uint64(n)))
    word, bucket = np.concatenate(out_word), np.concatenate(out_bucket)
    order = np.argsort(word, kind="stable")
    return word[order], bucket[order]


@dataclass
class Crf:
    langs: list[str]
    weights: np.ndarray  # bucket x language
    lexicon: dict[str, int]  # word to a bit for each language
    lexicon_weights: np.ndarray  # lexicon x language
    transitions: np.ndarray
    start: np.ndarray
    rows: dict[str, int] = field(default_factory=dict)
    table: np.ndarray | None = None

    def emissions(self, words: list[str]) -> np.ndarray:
        """Scores of distinct words for each language."""
        if not words:
            return np.zeros((0, len(self.langs)), np.float32)
        word, bucket = features(words)
        out = np.add.reduceat(self.weights[bucket], np.flatnonzero(np.r_[True, word[1:] != word[:-1]]), axis=0)
        return out + self.lexicon_hits(words) @ self.lexicon_weights

    def lexicon_hits(self, words: list[str]) -> np.ndarray:
        bits = np.array([self.lexicon.get(w, 0) for w in words], np.int64)
        return (bits[:, None] >> np.arange(len(self.langs)) & 1).astype(np.float32)

    def label(self, batch: list[str]) -> tuple[list[str], list[float]]:
        """The language and score of each text."""
        cut = [words_of(t) for t in batch]
        if self.table is None or len(self.rows) > CACHE:
            self.rows, self.table = {}, np.zeros((0, len(self.langs)), np.float32)
        new: set[str] = set()
        for c in cut:
            new.update(c)
        new.difference_update(self.rows)
        fresh = list(new)
        real = [w for w in fresh if any(map(str.isalpha, w))]
        self.rows.update((w, -1) for w in fresh)
        self.rows.update((w, len(self.table) + i) for i, w in enumerate(real))
        self.table = np.concatenate([self.table, self.emissions(real)])
        at = [np.fromiter(map(self.rows.__getitem__, c), np.int64, len(c)) for c in cut]
        at = [a[a >= 0] if len(a) and a.min() < 0 else a for a in at]
        lengths = np.array([len(a) for a in at], np.int64)
        if not lengths.any():
            return ["und"] * len(batch), [0.0] * len(batch)
        marginals = forward_backward(self.table[np.concatenate(at)], lengths[lengths > 0], self.transitions, self.start)
        means = np.add.reduceat(marginals, np.r_[0, np.cumsum(lengths[lengths > 0])[:-1]], axis=0, dtype=np.float64) / lengths[lengths > 0][:, None]
        best = iter(zip(means.argmax(axis=1).tolist(), means.max(axis=1).tolist(), strict=True))
        out = [next(best) if n else None for n in lengths.tolist()]
        return [self.langs[b[0]] if b else "und" for b in out], [min(1.0, b[1]) if b else 0.0 for b in out]


def forward_backward(scores: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Marginals of every position of sequences of these lengths, laid end to end.

    Sequences are cut into chunks; each chunk's transfer matrix is made for all chunks at once, the matrices are
    chained along each sequence, and then all chunks run forward and backward at once from known borders. A long
    text so takes CHUNK steps and one for each of its chunks instead of one for each word."""
    k = scores.shape[1]
    e = np.exp(scores - scores.max(axis=1, keepdims=True)).astype(np.float32)
    t = np.exp(transitions - transitions.max()).astype(np.float32)
    first = np.exp(start - start.max()).astype(np.float32)
    n_chunks = -(-lengths // CHUNK)
    seq = np.repeat(np.arange(len(lengths)), n_chunks)
    place = np.arange(len(seq)) - np.repeat(np.cumsum(n_chunks) - n_chunks, n_chunks)
    begin = np.repeat(np.cumsum(lengths) - lengths, n_chunks) + place * CHUNK
    size = np.minimum(CHUNK, np.repeat(lengths, n_chunks) - place * CHUNK)
    order = np.argsort(-size, kind="stable")  # full chunks first, so the active ones are always a prefix
    begin, size, m = begin[order], size[order], len(order)
    active = [int(np.searchsorted(-size, -s, side="left")) for s in range(CHUNK)]  # chunks longer than s
    at = [begin[: active[s]] + s for s in range(CHUNK)]
    transfer = np.broadcast_to(np.eye(k, dtype=np.float32), (m, k, k)).copy()
    for s in range(CHUNK):
        n = active[s]
        if n:
            x = (transfer[:n].reshape(-1, k) @ t).reshape(n, k, k) * e[at[s]][:, None, :]
            transfer[:n] = x / x.max(axis=(1, 2), keepdims=True)
    back = np.empty(m, np.int64)
    back[order] = np.arange(m)  # from the sequences' order to that of size
    heads = np.cumsum(n_chunks) - n_chunks
    into, out = np.empty((m, k), np.float32), np.empty((m, k), np.float32)
    state = np.ones((len(lengths), k), np.float32)
    longest = int(n_chunks.max())
    by_count = np.argsort(-n_chunks, kind="stable")
    alive = [int(np.searchsorted(-n_chunks[by_count], -c, side="left")) for c in range(longest)]
    # the first word has start in place of a transition: its chunk's transfer is corrected by a row vector
    for c in range(longest):
        who = by_count[: alive[c]]
        rows = back[heads[who] + c]
        into[rows] = state[who]
        if c == 0:
            x = _first_chunk(e, begin[rows], size[rows], t, first)
        else:
            x = np.einsum("ni,nij->nj", state[who], transfer[rows])
        state[who] = x / x.max(axis=1, keepdims=True)
    state = np.ones((len(lengths), k), np.float32)
    for c in range(longest - 1, -1, -1):
        who = by_count[: alive[c]]
        rows = back[heads[who] + c]
        out[rows] = state[who]
        x = np.einsum("nij,nj->ni", transfer[rows], state[who])
        state[who] = x / x.max(axis=1, keepdims=True)
    alpha = np.empty_like(e)
    is_first = np.zeros(m, bool)
    is_first[back[heads]] = True
    for s in range(CHUNK):
        n = active[s]
        if not n:
            break
        prior = into[:n] @ t
        if s == 0:
            prior[is_first[:n]] = first
        x = prior * e[at[s]]
        x /= x.max(axis=1, keepdims=True)
        alpha[at[s]] = x
        into[:n] = x
    for s in range(CHUNK - 1, -1, -1):
        n = active[s]
        if not n:
            continue
        a = alpha[at[s]] * out[:n]
        alpha[at[s]] = a / a.sum(axis=1, keepdims=True)
        x = (e[at[s]] * out[:n]) @ t.T
        out[:n] = x / x.max(axis=1, keepdims=True)
    return alpha


def _first_chunk(e, begin, size, t, first):
    """The state after the first chunk of each sequence."""
    x = first * e[begin]
    for s in range(1, CHUNK):
        on = np.flatnonzero(size > s)
        if not len(on):
            break
        y = (x[on] @ t) * e[begin[on] + s]
        x[on] = y / y.max(axis=1, keepdims=True)
    return x


def train(segments: list[tuple[str, list[str]]], epochs: int = 4, seed: int = 1) -> Crf | None:
    """A model of these (language, words) pieces; AdaGrad on the conditional likelihood of strung-together pieces."""
    langs = sorted({lang for lang, _ in segments})
    if not langs:
        return None
    k, rng = len(langs), np.random.default_rng(seed)
    number = {lang: i for i, lang in enumerate(langs)}
    seen: list[Counter[str]] = [Counter() for _ in langs]
    for lang, words in segments:
        seen[number[lang]].update(words)
    lexicon: dict[str, int] = {}
    for i, c in enumerate(seen):
        for w, n in c.items():
            if n >= 5:
                lexicon[w] = lexicon.get(w, 0) | 1 << i
    model = Crf(langs, np.zeros((BUCKETS, k), np.float32), lexicon, np.zeros((k, k), np.float32), np.zeros((k, k), np.float32), np.zeros(k, np.float32))
    vocab = list({w for _, words in segments for w in words})
    row = {w: i for i, w in enumerate(vocab)}
    f_word, f_bucket = features(vocab)
    f_start = np.searchsorted(f_word, np.arange(len(vocab) + 1))
    hits = model.lexicon_hits(vocab)
    coded = [(number[lang], np.array([row[w] for w in words], np.int64)) for lang, words in segments]
    params = [model.weights, model.lexicon_weights, model.transitions, model.start]
    squares = [np.full_like(p, 1e-3) for p in params]
    for _ in range(epochs):
        shuffled = [coded[i] for i in rng.permutation(len(coded))]
        strung, i = [], 0
        while i < len(shuffled):
            n = int(rng.integers(1, 4))
            strung.append(shuffled[i : i + n])
            i += n
        for b in range(0, len(strung), 48):
            _step(strung[b : b + 48], f_bucket, f_start, hits, params, squares)
    return model


def _step(batch, f_bucket, f_start, hits, params, squares):
    weights, lexicon_weights, transitions, start = params
    k = len(start)
    words = np.concatenate([w for s in batch for _, w in s])
    gold = np.concatenate([np.full(len(w), y) for s in batch for y, w in s])
    lengths = np.array([sum(len(w) for _, w in s) for s in batch])
    # features of each position
    n = f_start[words + 1] - f_start[words]
    owner = np.repeat(np.arange(len(words)), n)
    bucket = f_bucket[np.repeat(f_start[words] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
    scores = np.add.reduceat(weights[bucket], np.cumsum(n) - n, axis=0) + hits[words] @ lexicon_weights
    # padded forward-backward, which also gives the expected transitions
    most, rows = int(lengths.max()), len(lengths)
    heads = np.cumsum(lengths) - lengths
    mask = np.arange(most)[None] < lengths[:, None]
    e = np.ones((rows, most, k))
    e[mask] = np.exp(scores - scores.max(axis=1, keepdims=True))
    t, first = np.exp(transitions.astype(np.float64)), np.exp(start.astype(np.float64))
    alpha, beta = np.empty_like(e), np.ones_like(e)
    alpha[:, 0] = first * e[:, 0]
    alpha[:, 0] /= alpha[:, 0].sum(axis=1, keepdims=True)
    for s in range(1, most):
        x = (alpha[:, s - 1] @ t) * e[:, s]
        alpha[:, s] = np.where(mask[:, s, None], x / x.sum(axis=1, keepdims=True), alpha[:, s - 1])
    pairs = np.zeros((k, k))
    for s in range(most - 2, -1, -1):
        x = (beta[:, s + 1] * e[:, s + 1]) @ t.T
        on = mask[:, s + 1, None]
        beta[:, s] = np.where(on, x / x.sum(axis=1, keepdims=True), 1.0)
        p = alpha[:, s, :, None] * t * (beta[:, s + 1] * e[:, s + 1])[:, None, :]
        p = np.where(on[..., None], p / p.sum(axis=(1, 2), keepdims=True), 0)
        pairs += p.sum(axis=0)
    gamma = alpha * beta
    gamma = (gamma / gamma.sum(axis=2, keepdims=True))[mask]
    delta = -gamma
    delta[np.arange(len(gold)), gold] += 1
    same = np.ones(len(gold) - 1, bool)
    same[heads[1:] - 1] = False
    gold_pairs = np.zeros((k, k))
    np.add.at(gold_pairs, (gold[:-1][same], gold[1:][same]), 1)
    grad_w = np.zeros_like(weights)
    touched, inverse = np.unique(bucket, return_inverse=True)
    for j in range(k):
        grad_w[touched, j] = np.bincount(inverse, delta[owner, j], len(touched))
    grads = [grad_w, hits[words].T @ delta, gold_pairs - pairs, delta[heads].sum(axis=0)]
    for p, g, q in zip(params, grads, squares, strict=True):
        g = g / rows
        q += g * g
        p += (0.2 * g / np.sqrt(q)).astype(np.float32)


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = ROWS) -> Crf | None:
    """A model of docs' texts and non-null languages, from at most rows whole documents of a language, by a hash of id and text.

    Ids play no other part: they may be null or repeat. What comes to the driver is rows documents of each language."""
    named = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.xxhash64(F.lit("train"), F.col(id_col).cast("string"), F.col(text_col)).alias("draw"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    # the limit by group is applied before the shuffle as well, so no task gets more than rows from each task
    place = F.row_number().over(Window.partitionBy("lang").orderBy("draw"))
    chosen = named.withColumn("place", place).where(F.col("place") <= rows).select("lang", "place", "text")
    pieces = []
    for r in sorted(chosen.collect(), key=lambda r: (r["lang"], r["place"])):
        w = [x for x in words_of(r["text"]) if any(map(str.isalpha, x))]
        pieces += [(r["lang"], w[i : i + SEGMENT_WORDS]) for i in range(0, len(w), SEGMENT_WORDS)]
    return train(pieces)


def predict(docs: DataFrame, model: Crf | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch):
        for part in small_slices(batch, 2 << 20):
            own = shared.value
            langs, scores = own.label(texts(part)) if own else (["und"] * part.num_rows, [0.0] * part.num_rows)
            yield pa.record_batch([part.column("doc_id"), pa.array(langs), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return map_batches(pick(docs, id_col, text_col), run, "doc_id long, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Crf | None, margin: float = 1 / 15, text_col: str = "text") -> DataFrame:
    """docs without those that have no letter, or whose words share no language: a mean marginal that is not margin of the
    way from chance, which is 1 / k for k languages, to certainty."""
    least = 1 / len(model.langs) + margin * (1 - 1 / len(model.langs)) if model else 0.0
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch):
        keep = []
        for part in small_slices(batch, 2 << 20, text_col):
            langs, scores = shared.value.label(texts(part, text_col)) if shared.value else (["und"] * part.num_rows, [0.0] * part.num_rows)
            keep += [lang != "und" and s >= least for lang, s in zip(langs, scores, strict=True)]
        yield batch.filter(pa.array(keep))
        release()

    return docs.mapInArrow(lambda bs: (x for b in bs if b.num_rows for x in run(b)), docs.schema)


def held_out() :
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: doc_id, held_out, lang_pred, score."""
    from verdigris.llm.common import read

    docs = read(spark, sf_dir, "documents")
    model = learn(docs.where(~held_out()))
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
