"""Quality by perplexity under an interpolated modified Kneser-Ney model of characters, trained on trusted text.

1. The character n-grams of the highest order in trusted documents are counted in their batches; the counts are summed by
   n-gram, in shards. Other documents give no n-grams: the model grows with the trusted text alone.
2. The n-grams of each lower order follow from those above: an n-gram's count is its number of different left
   neighbours. Three discounts for each order come from the counts of counts.
3. Sharded joins of n-grams with contexts and with the next lower order give every seen n-gram its interpolated
   probability and every context the weight that it leaves to the lower order, which is what an unseen n-gram backs off by.
4. A pass over all documents sums the logarithms over each whole text. The model goes to the executors as hashes and values if
   its exact number of rows is at most ``near_rows``. A larger one is cut by the two characters before the last into parts of
   that size, and every part has a pass that adds what its n-grams are worth; of a document only a number is shuffled.
5. One trusted document in ``FOLDS``, by a hash of its id, is left out of the counts: in its own model a text looks
   better than a new one. Of a language with two or more trusted documents at least one is left out. A language's
   threshold is the ``quantile`` of its own left-out documents' perplexities, however few, exact to a thousandth of a
   natural logarithm. Only a language that has no such document takes the quantile of all languages.

Trusted are the documents that labels call good and not toxic, in all their rows. Counts, statistics and thresholds
cover all data. Texts begin with ``order - 1`` NUL characters. An empty or null text has no perplexity and is not
kept; without any trusted text every character is equally likely and every other document is kept. A null language
is a language. Every row is scored by itself.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verdigris.llm.common import discard, map_batches, materialize, read, release, small_slices, texts

ORDER, QUANTILE, FOLDS, NEAR_ROWS, NEAR_IDS = 5, 0.99, 5, 4_000_000, 8_000_000
#: Bytes of text that are looked at together, and distinct n-grams that a task sums up before it passes them on.
SLICE, HELD = 4 << 20, 1_000_000
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def code_points(batch: list[str], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts' code points with order - 1 zeros before each; the places where n-grams end; the texts' lengths."""
    lengths = np.array([len(t) for t in batch], np.int64)
    pad = "\0" * (order - 1)
    flat = np.frombuffer((pad + pad.join(batch)).encode("utf-32-le"), np.uint32)
    inside = np.ones(len(flat), bool)
    begins = np.cumsum(lengths + order - 1) - (lengths + order - 1)
    for i in range(order - 1):
        inside[begins + i] = False
    return flat, np.flatnonzero(inside), lengths


def gram_hashes(flat: np.ndarray, ends: np.ndarray, order: int) -> np.ndarray:
    h = np.zeros(len(flat), np.uint64)
    for i in range(order):
        h[order - 1 :] = h[order - 1 :] * FACTOR + flat[i : len(flat) - order + 1 + i]
    h = h[ends]
    return h ^ (h >> np.uint64(32))


def distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, distinct hashes, a place of each)."""
    codes, unique = pd.factorize(h)
    place = np.empty(len(unique), np.int64)
    place[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
    return codes, unique, place


def gram_counts(docs: DataFrame, order: int) -> DataFrame:
    """(g, n): every n-gram of docs (text), and its count."""

    def merged(held: list[tuple]):
        """One row for each n-gram of what was held."""
        codes, unique, place = distinct(np.concatenate([h for h, _, _ in held]))
        n = np.bincount(codes, np.concatenate([n for _, n, _ in held]), len(unique)).astype(np.int64)
        whole = np.concatenate([c for _, _, c in held])[place].tobytes().decode("utf-32-le")
        return pa.record_batch([pa.array([whole[i : i + order] for i in range(0, len(whole), order)]), pa.array(n)], ["g", "n"])

    def run(batches):
        held: list[tuple] = []
        for batch in batches:
            for part in small_slices(batch, SLICE):
                flat, ends, _ = code_points(texts(part), order)
                if not len(ends):
                    continue
                codes, unique, place = distinct(gram_hashes(flat, ends, order))
                at = ends[place]
                held.append((unique, np.bincount(codes, minlength=len(unique)), np.stack([flat[at - order + 1 + i] for i in range(order)], axis=1)))
                if sum(len(h) for h, _, _ in held) > HELD:
                    yield merged(held)
                    held = []
        if held:
            yield merged(held)
        release()

    return docs.select("text").mapInArrow(run, "g string, n long").groupBy("g").agg(F.sum("n").alias("n"))


def discounts(n1: int, n2: int, n3: int, n4: int) -> list[float]:
    """What counts of 1, 2, and 3 or more lose; a half where the counts of counts cannot tell."""
    if not n1 or not n2:
        return [0.5, 0.5, 0.5]
    y = n1 / (n1 + 2 * n2)
    out = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 0.5]
    return [min(max(d, 0.01), i + 0.99) for i, d in enumerate(out)]


def model_rows(counts: DataFrame, order: int) -> tuple[DataFrame, float]:
    """(k, kind, g, v) of the model of counts (g, n): the logarithm of the probability of every seen n-gram of order k (kind 0), and
    of the weight that a context of length k leaves (kind 1). Also the logarithm of an unseen character's probability."""
    grams = {order: counts}
    for k in range(order - 1, 0, -1):
        grams[k] = materialize(grams[k + 1].groupBy(F.substring("g", 2, k).alias("g")).agg(F.count("*").alias("n")), "gram-counts")
    tallies = [g.agg(F.lit(k).alias("k"), *[F.count_if(F.col("n") == i).alias(f"n{i}") for i in (1, 2, 3, 4)], F.count("*").alias("all"), F.sum("n").alias("total")) for k, g in grams.items()]
    of_order = {r["k"]: r for r in _union(tallies).collect()}
    out, p, unseen = [], None, 0.0
    for k in range(1, order + 1):
        r = of_order[k]
        d = discounts(r["n1"], r["n2"], r["n3"], r["n4"])
        own = grams[k].withColumn("c", F.substring("g", 1, k - 1) if k > 1 else F.lit(""))
        seen = [F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2), F.count_if(F.col("n") >= 3)]
        context = own.groupBy("c").agg(F.sum("n").alias("total"), sum((F.lit(x) * s for x, s in zip(d, seen, strict=True)), F.lit(0.0)).alias("lost"))
        context = materialize(context.select("c", "total", (F.col("lost") / F.col("total")).alias("b")), "contexts")
        off = F.when(F.col("n") >= 3, d[2]).when(F.col("n") == 2, d[1]).otherwise(d[0])
        own = own.join(context, "c").select("g", F.substring("g", 2, k - 1).alias("s") if k > 1 else F.lit("").alias("s"), ((F.col("n") - off) / F.col("total")).alias("a"), "b")
        if k == 1:
            lost = context.first()["b"]  # of the one empty context
            unseen = math.log(lost / (r["all"] + 1)) if lost else -math.inf
            p = own.select("g", (F.col("a") + F.col("b") / float(r["all"] + 1)).alias("p"))
        else:
            p = own.join(p.select(F.col("g").alias("s"), F.col("p").alias("lower")), "s").select("g", (F.col("a") + F.col("b") * F.col("lower")).alias("p"))
            out.append(context.select(F.lit(k - 1).alias("k"), F.lit(1).alias("kind"), F.col("c").alias("g"), F.ln("b").alias("v")))
        p = materialize(p, "gram-probabilities")
        out.append(p.select(F.lit(k).alias("k"), F.lit(0).alias("kind"), "g", F.ln("p").alias("v")))
    return _union(out), unseen


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def hashed_rows(rows: DataFrame) -> DataFrame:
    """(k, kind, h, v, middle) of rows (k, kind, g, v): the n-gram's hash, and that of the two characters by which the model is cut; -1 for
    rows too short to have them, which belong to every part."""

    def run(batch):
        grams, k, kind = batch.column("g").to_pylist(), batch.column("k").to_numpy(), batch.column("kind").to_numpy()
        h, middle = np.zeros(len(grams), np.uint64), np.full(len(grams), -1, np.int64)
        for n in np.unique(k):
            on = np.flatnonzero(k == n)
            flat = np.frombuffer("".join(grams[i] for i in on.tolist()).encode("utf-32-le"), np.uint32).reshape(len(on), n)
            h[on] = row_hashes(flat)
            for what, last in ((0, n - 1), (1, n)):
                if last >= 2:
                    some = kind[on] == what
                    middle[on[some]] = middles(flat[some][:, last - 2 : last])
        yield pa.record_batch([pa.array(k.astype(np.int8)), pa.array(kind.astype(np.int8)), pa.array(h.view(np.int64)), batch.column("v"), pa.array(middle)], ["k", "kind", "h", "v", "middle"])

    return map_batches(rows, run, "k byte, kind byte, h long, v double, middle long")


def row_hashes(chars: np.ndarray) -> np.ndarray:
    """The hash of each row of code points."""
    h = np.zeros(len(chars), np.uint64)
    for i in range(chars.shape[1]):
        h = h * FACTOR + chars[:, i]
    return h ^ (h >> np.uint64(32))


def middles(pair: np.ndarray) -> np.ndarray:
    return (row_hashes(pair) * FACTOR >> np.uint64(8)).astype(np.int64)


class Model:
    """Rows of hashed_rows as sorted arrays, or of them part number part of parts."""

    def __init__(self, rows: pa.Table, order: int, unseen: float, part: int = 0, parts: int = 1):
        self.order, self.unseen, self.part, self.parts = order, unseen, part, parts
        self.tables = {}
        k, kind, h, v = (rows[c].to_numpy() for c in ("k", "kind", "h", "v"))
        for n in range(1, order + 1):
            for what in (0, 1):
                on = np.flatnonzero((k == n) & (kind == what))
                at = on[np.argsort(h[on].view(np.uint64), kind="stable")]
                self.tables[n, what] = h[at].view(np.uint64), v[at]

    def look_up(self, n: int, what: int, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether it is there, its value) of each row of chars."""
        hashes, values = self.tables[n, what]
        if not len(hashes):
            return np.zeros(len(chars), bool), np.zeros(len(chars))
        h = row_hashes(chars)
        at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
        return hashes[at] == h, values[at]

    def log_probability(self, chars: np.ndarray) -> np.ndarray:
        """Of each row of chars (order code points): what is seen, else what its context leaves times the next lower order."""
        out, left = np.zeros(len(chars)), np.arange(len(chars))
        if self.parts > 1:
            left = np.flatnonzero(middles(chars[:, -3:-1]) % self.parts == self.part)
        for n in range(self.order, 0, -1):
            there, v = self.look_up(n, 0, chars[left, self.order - n :])
            out[left[there]] += v[there]
            left = left[~there]
            if n > 1:
                there, v = self.look_up(n - 1, 1, chars[left, self.order - n : -1])
                out[left[there]] += v[there]
        out[left] += self.unseen
        return out

    def sums(self, batch: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(the sum of logarithms, the length) of each text."""
        flat, ends, lengths = code_points(batch, self.order)
        out = np.zeros(len(lengths))
        if len(ends):
            codes, unique, place = distinct(gram_hashes(flat, ends, self.order))
            at = ends[place]
            each = self.log_probability(np.stack([flat[at - self.order + 1 + i] for i in range(self.order)], axis=1))[codes]
            some = lengths > 0
            out[some] = np.add.reduceat(each, (np.cumsum(lengths) - lengths)[some])
        return out, lengths


def score(docs: DataFrame, rows: DataFrame | None, unseen: float, order: int, near_rows: int) -> DataFrame:
    """docs (doc_id, lang, text, ...) with logp, the sum over the whole text, and chars, its length, instead of text. rows are hashed_rows."""
    n = rows.count() if rows is not None else 0
    parts = max(1, -(-n // max(near_rows, 1))) if order >= 3 else 1
    passes = []
    for part in range(parts):
        own = rows.where((F.col("middle") < 0) | (F.pmod("middle", F.lit(parts)) == part)).drop("middle").toArrow() if n else pa.table({"k": pa.array([], pa.int32()), "kind": pa.array([], pa.int32()), "h": pa.array([], pa.int64()), "v": pa.array([], pa.float64())})
        shared = docs.sparkSession.sparkContext.broadcast(Model(own, order, unseen, part, parts))
        # equal rows have equal sums, so they may share a key
        keyed = docs if parts == 1 else docs.select("text", F.xxhash64("text").alias("row1"), F.xxhash64("text", F.lit(1)).alias("row2"))

        def run(batch, shared=shared):
            for piece in small_slices(batch, SLICE):
                sums, lengths = shared.value.sums(texts(piece))
                kept = [c for c in piece.schema.names if c != "text"]
                yield pa.record_batch([*(piece.column(c) for c in kept), pa.array(sums), pa.array(lengths)], [*kept, "logp", "chars"])

        kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keyed.schema if f.name != "text")
        scored = map_batches(keyed, run, f"{kept}, logp double, chars long")
        if parts == 1:
            return scored
        passes.append(materialize(scored.groupBy("row1", "row2").agg(F.min("logp").alias("logp"), F.min("chars").alias("chars")), "partial-sums"))
        shared.unpersist()
    whole = _union(passes).groupBy("row1", "row2").agg(F.sum("logp").alias("logp"), F.min("chars").alias("chars"))
    keyed = docs.withColumns({"row1": F.xxhash64("text"), "row2": F.xxhash64("text", F.lit(1))}).drop("text")
    return keyed.join(whole, ["row1", "row2"]).drop("row1", "row2")


def trusted_ids(labels: DataFrame, id_col: str = "doc_id", quality_col: str = "quality", toxic_col: str = "toxic") -> DataFrame:
    good = F.coalesce((F.col(quality_col) == 1) & (F.coalesce(F.col(toxic_col), F.lit(0)) == 0), F.lit(False))
    return labels.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(good).alias("good")).where("good and id is not null").select("id")


def classify(docs: DataFrame, labels: DataFrame, order: int = ORDER, quantile: float = QUANTILE, near_rows: int = NEAR_ROWS, near_ids: int = NEAR_IDS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, lang, n_chars, perplexity, threshold, trusted, keep) of every row."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    ids = materialize(trusted_ids(labels), "trusted")
    side = F.broadcast(ids) if ids.count() <= near_ids else ids  # 8 bytes a row
    flagged = own.join(side, F.col("doc_id") == F.col("id"), "left").withColumn("trusted", F.col("id").isNotNull()).drop("id")
    drawn, fold = F.xxhash64(F.lit("fold"), "doc_id"), F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(FOLDS))
    # by language, the document next to be left out: decides where the hash leaves out none
    first = flagged.where("trusted and text <> ''").groupBy("lang").agg(F.min(F.struct(fold.alias("fold"), drawn.alias("drawn"))).alias("first"), F.min(drawn).alias("low"), F.max(drawn).alias("high"))
    first = materialize(first.where("low < high and first.fold > 0").select(F.col("lang").alias("first_lang"), F.col("first.drawn").alias("first")), "left-out")
    flagged = flagged.join(F.broadcast(first), F.col("lang").eqNullSafe(F.col("first_lang")), "left")
    flagged = flagged.withColumn("left_out", F.col("trusted") & ((fold == 0) | F.coalesce(F.col("first") == drawn, F.lit(False)))).drop("first_lang", "first")
    counts = materialize(gram_counts(flagged.where("trusted and not left_out"), order), "gram-counts")
    rows, unseen = None, 0.0  # without any trusted text every character is equally likely
    if not counts.isEmpty():
        rows, unseen = model_rows(counts, order)
        rows = materialize(hashed_rows(rows), "model")
    scored = score(flagged, rows, unseen, order, near_rows)
    scored = materialize(scored.select("doc_id", "lang", "trusted", "left_out", "chars", F.when(F.col("chars") > 0, F.exp(-F.col("logp") / F.col("chars"))).alias("perplexity")), "perplexities")
    discard(counts, rows, ids, first)
    bins = scored.where("left_out and chars > 0").groupBy("lang", F.ceil(F.ln("perplexity") * 1000).alias("bin")).agg(F.count("*").alias("n"))
    of_all = bins.groupBy("bin").agg(F.sum("n").alias("n")).select(F.lit(1).alias("one"), "bin", "n")
    by_lang = _quantile(bins.withColumn("lang", F.coalesce("lang", F.lit(""))), "lang", quantile).select(F.col("lang").alias("l"), F.col("cut").alias("own"))
    rest = _quantile(of_all, "one", quantile).select(F.col("cut").alias("any"))
    out = scored.join(by_lang, F.coalesce(scored["lang"], F.lit("")) == by_lang["l"], "left").drop("l")
    cut = rest.first()  # one number
    over_all = F.lit(cut["any"] if cut else math.inf)
    out = out.withColumn("threshold", F.coalesce("own", over_all))
    return out.select("doc_id", "lang", F.col("chars").alias("n_chars"), "perplexity", "threshold", "trusted", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(False)).alias("keep"))


def _quantile(bins: DataFrame, by: str, quantile: float) -> DataFrame:
    """The smallest bin's upper end that at least this share of each group is at or below; bins are few thousands."""
    w = Window.partitionBy(by)
    run = bins.withColumns({"upto": F.sum("n").over(w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)), "total": F.sum("n").over(w)})
    return run.where(F.col("upto") >= F.ceil(F.col("total") * quantile)).groupBy(by).agg(F.exp(F.min("bin") / 1000.0).alias("cut"), F.max("total").alias("total"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: doc_id, lang, n_chars, perplexity, threshold, trusted, keep."""
    return classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
