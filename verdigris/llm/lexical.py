"""Ranked lexical search by Fagin's threshold algorithm, over an index that is dealt out by documents.

A term is a maximal run of letters, digits and characters beyond ASCII, with A-Z lower-cased. A document's score for an
item sums, over the item's distinct terms, w * impact: w = floor(1000 ln((2N + 2) / (2 df + 1))), impact = 10^9 tf div (1000 tf +
20 m), m = 50 + (50 n N) div L, with N the documents that hold a term, L all their terms, n one document's terms.

1. N and L come from one pass that only counts.
2. One map turns every batch of documents into segments of about ``SEGMENT`` bytes of text. A segment holds, for its own documents, a
   list for each term sorted by impact, and the forward index: each document's terms with their impacts. Postings are never
   shuffled, so a term that all documents hold is one list in each segment and no group anywhere. Segments lie in row groups of about
   ``GROUP`` bytes, so that a task holds few of them at a time however large its split is.
3. df is a sum over the segments' dictionaries, joined with the terms of a block of items.
4. Items go out in blocks of at most ``BLOCK`` bytes of terms, whose broadcast is thereby bounded. In each segment an item's lists are read round-robin
   from the top. A document that is seen the first time is scored in full through the forward index. No unseen document can score above the
   threshold, the sum of the impacts where the lists now stand; the walk stops when that falls strictly below the k-th
   best score so far (of the task's earlier segments as well), so documents that tie with the k-th are all met.
5. Each task passes on k rows an item at most; these are cut to k within ``DEALT`` groups by document first, then within the item.

Results are exact. Null and blank documents hold no term and are never found; neither is a document whose score is 0. An item that is
null or holds no known term has no rows. Repeated documents are found each, in order of doc_id, a null doc_id after all others; repeated
items are ranked each. A document's text is counted in pieces, whatever its length. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verdigris.llm.common import discard, map_batches, materialize, read, release, small_slices

SEGMENT, BLOCK, DEALT, PIECE, CELLS, GROUP = 2 << 20, 32 << 20, 64, 4 << 20, 8 << 20, 16 << 20
#: Products and sums up to this are exact in double precision.
EXACT = 2.0**53
PATTERN = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of UTF-8 text to bytes of terms with single blanks between: what is no term is a blank.
TERM_BYTES = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).translate(bytes.maketrans(UPPER.encode(), LOWER.encode()))
INDEX = "ids array<long>, terms array<binary>, dfs array<int>, ends binary, fwd_terms binary, fwd_impacts binary, list_docs binary, list_impacts binary"
FOUND = "query int, item_id long, doc_id long, score long"
LARGEST = np.iinfo(np.int64).max


def pieces(words: bytes) -> Iterator[bytes]:
    """Terms in pieces of about PIECE bytes, so that a very long text is no list of all its terms."""
    at = 0
    while at < len(words):
        end = words.find(b" ", at + PIECE)
        end = len(words) if end < 0 else end
        yield words[at:end]
        at = end


def count_terms(text: bytes) -> Counter:
    """tf of every term of a whole UTF-8 text."""
    out = Counter()
    for words in pieces(text.translate(TERM_BYTES)):
        out.update(words.split())
    return out


def lengths(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """How many texts of a batch hold a term, and how many terms they hold."""
    n = [sum(len(p.split()) for p in pieces(t.translate(TERM_BYTES))) for t in batch.column("text").to_pylist() if t]
    yield pa.record_batch([pa.array([sum(x > 0 for x in n)]), pa.array([sum(n)])], ["docs", "terms"])


def impacts(tf: np.ndarray, length: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """10^9 tf div (1000 tf + 20 m) for terms of documents with so many terms."""
    if len(length) and 50 * int(length.max()) * n_docs > LARGEST:
        m = np.array([50 + 50 * int(n) * n_docs // n_terms for n in length], np.int64)
    else:
        m = 50 + 50 * length * n_docs // max(1, n_terms)
    return 10**9 * tf // (1000 * tf + 20 * m)


def pack(x: np.ndarray) -> bytes:
    """Numbers from 0 on in two or four bytes each, after a byte that says which."""
    width = 2 if x.max(initial=0) < 1 << 16 else 4
    return bytes([width]) + x.astype(f"<u{width}").tobytes()


def unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64)


def segment(ids: list, counts: list[Counter], n_docs: int, n_terms: int) -> pa.RecordBatch:
    """A row of INDEX for documents in order of their ids, each with at least one term."""
    sizes = np.array([len(c) for c in counts], np.int64)
    coded = pa.array([t for c in counts for t in c], pa.binary()).dictionary_encode()
    terms, code = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
    tf = np.fromiter((n for c in counts for n in c.values()), np.int64, int(sizes.sum()))
    doc = np.repeat(np.arange(len(ids)), sizes)
    impact = impacts(tf, np.repeat(np.array([c.total() for c in counts], np.int64), sizes), n_docs, n_terms)
    forward = np.argsort(doc * len(terms) + code)
    listed = np.argsort((code << 20) - impact, kind="stable")  # impacts are below 10^6; of equal ones the smaller document is first
    arrays = [pa.array(ids, pa.int64()), terms, pa.array(np.bincount(code, minlength=len(terms)).astype(np.int32))]
    one = [pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a) for a in arrays]
    blobs = [pa.array([pack(x)], pa.binary()) for x in (np.cumsum(sizes), code[forward], impact[forward], doc[listed], impact[listed])]
    return pa.record_batch([*one, *blobs], [c.split()[0] for c in INDEX.split(", ")])


class Segment:
    """One row of the index, as a search needs it."""

    def __init__(self, batch: pa.RecordBatch, row: int):
        get = lambda c: batch.column(c)[row]
        ends, self.code, self.impact, self.list_docs, self.list_impacts = (unpack(get(c).as_py()) for c in ("ends", "fwd_terms", "fwd_impacts", "list_docs", "list_impacts"))
        self.terms, self.start = get("terms").values, np.r_[0, np.cumsum(get("dfs").values.to_numpy())]
        ids = get("ids").values
        self.no_id = np.asarray(pc.is_null(ids).to_numpy(zero_copy_only=False))
        self.ids = pc.fill_null(ids, LARGEST).to_numpy()
        self.n = len(ends)
        self.keys = np.repeat(np.arange(self.n), np.diff(np.r_[0, ends])) * len(self.terms) + self.code
        self.rows = self.column = None

    def scores(self, docs: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Whole scores by the forward index; docs and terms ascend."""
        if self.rows is not None and 1e6 * weights.sum() < EXACT:  # impacts are below 10^6
            return (self.rows[docs[:, None], self.column[terms]].astype(np.float64) @ weights).astype(np.int64)
        out, most = np.zeros(len(docs), np.int64), max(1, CELLS // len(terms))
        for a in range(0, len(docs), most):
            wanted = (docs[a : a + most, None] * len(self.terms) + terms[None, :]).ravel()
            at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
            out[a : a + most] = (np.where(self.keys[at] == wanted, self.impact[at], 0).reshape(-1, len(terms)) * weights).sum(axis=1)
        return out

    def open(self, terms: np.ndarray) -> bool:
        """Lays out the forward index for these terms as a row of impacts for each document, if that takes at most CELLS cells."""
        self.rows = None
        if len(terms) * self.n > CELLS:
            return False
        self.column = np.full(len(self.terms), -1)
        self.column[terms] = np.arange(len(terms))
        use = np.flatnonzero(self.column[self.code] >= 0)
        self.rows = np.zeros((self.n, len(terms)), np.float32)
        self.rows[self.keys[use] // len(self.terms), self.column[self.code[use]]] = self.impact[use]
        return True

    def walk(self, terms: np.ndarray, weights: np.ndarray, floor: int, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Documents that can be among the k best and reach floor, their scores, and how many were scored."""
        places, ends = self.start[terms], self.start[terms + 1]
        seen, best, score, scored, step = np.zeros(self.n, bool), np.zeros(0, np.int64), np.zeros(0, np.int64), 0, 16
        while len(live := np.flatnonzero(places < ends)) and (weights[live] * self.list_impacts[places[live]]).sum() >= floor:
            size = np.minimum(ends[live] - places[live], step)
            at = np.repeat(places[live] - np.cumsum(size) + size, size) + np.arange(size.sum())
            docs = np.unique(self.list_docs[at])
            docs = docs[~seen[docs]]
            seen[docs] = True
            scored += len(docs)
            new = self.scores(docs, terms, weights)
            best, score = np.r_[best, docs[new >= floor]], np.r_[score, new[new >= floor]]
            if len(best) > k:  # places are in order of ids, so ties go to the smaller id
                first = np.lexsort((best, -score))[:k]
                best, score = best[first], score[first]
            if len(best) == k:
                floor = max(floor, int(score.min()))
            places[live] += size
            step *= 2
        return best, score, scored


class Items:
    """A block of items as the executors get it: distinct terms that some document holds, their weights, and each item's terms."""

    def __init__(self, ids: list, terms: list[list[bytes]], weights: dict[bytes, int]):
        self.ids = ids
        self.terms = sorted(weights)
        place = {t: i for i, t in enumerate(self.terms)}
        self.weights = np.array([weights[t] for t in self.terms], np.int64)
        self.of = [np.array(sorted({place[t] for t in ts if t in place}), np.int64) for ts in terms]

    def search(self, batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
        """The k best documents of every item in the task's segments."""
        top = [np.zeros((3, 0), np.int64)] * len(self.ids)  # score, whether the id is null, id
        floor = [1] * len(self.ids)
        block = pa.array(self.terms, pa.binary())
        for batch in batches:
            for row in range(batch.num_rows):
                part = Segment(batch, row)
                here = pc.fill_null(pc.index_in(block, value_set=part.terms), -1).to_numpy().astype(np.int64)
                own = [t[here[t] >= 0] for t in self.of]
                self._search(part, [(i, np.sort(here[t]), self.weights[t[np.argsort(here[t])]]) for i, t in enumerate(own) if len(t)], top, floor, k)
            release()
        sizes = np.array([t.shape[1] for t in top], np.int64)
        if sizes.any():
            query, (score, no_id, ids) = np.repeat(np.arange(len(top)), sizes), np.concatenate(top, axis=1)
            yield pa.record_batch([pa.array(query.astype(np.int32)), pa.array([self.ids[q] for q in query], pa.int64()), pa.array(ids, pa.int64(), mask=no_id.astype(bool)), pa.array(score)], ["query", "item_id", "doc_id", "score"])

    def _search(self, part: Segment, items: list, top: list, floor: list, k: int) -> None:
        """Items (number, terms, weights) in one segment, in halves while their terms take too many cells."""
        if len(items) > 1 and not part.open(np.unique(np.concatenate([t for _, t, _ in items]))):
            self._search(part, items[: len(items) // 2], top, floor, k)
            self._search(part, items[len(items) // 2 :], top, floor, k)
            return
        if len(items) == 1:
            part.open(items[0][1])
        for i, terms, weights in items:
            docs, score, _ = part.walk(terms, weights, floor[i], k)
            if len(docs):
                both = np.c_[top[i], np.stack([score, part.no_id[docs].astype(np.int64), part.ids[docs]])]
                top[i] = both[:, np.lexsort((both[2], both[1], -both[0]))[:k]]
                if top[i].shape[1] == k:
                    floor[i] = int(top[i][0, -1])


class LexicalIndex:
    """The index of all documents; terms (term, df)."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", segment_bytes: int = SEGMENT):
        own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        own = own.select("doc_id", F.col("text").cast("binary").alias("text"))
        counted = map_batches(own.select("text"), lengths, "docs long, terms long").agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("terms"), F.lit(0))).first()
        n_docs, n_terms = self.n_docs, self.n_terms = int(counted[0]), int(counted[1])

        def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in small_slices(batch, segment_bytes):
                    rows = [(i, c) for i, t in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True) if t and (c := count_terms(t))]
                    if rows:
                        rows.sort(key=lambda r: (r[0] is None, r[0] or 0))
                        yield segment([i for i, _ in rows], [c for _, c in rows], n_docs, n_terms)
                release()

        self.segments = materialize(own.mapInArrow(build, INDEX), "segments", GROUP)
        self.terms = self.segments.select(F.explode(F.arrays_zip("terms", "dfs")).alias("t")).groupBy(F.col("t.terms").alias("term")).agg(F.sum("t.dfs").alias("df"))

    def weight(self, df: int) -> int:
        return math.floor(1000 * math.log((2 * self.n_docs + 2) / (2 * df + 1)))

    def search(self, items: DataFrame, k: int = 50, id_col: str = "item_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
        """(item_id, rank, doc_id, score): each item's k best documents with a score above 0."""
        own = items.select(F.col(id_col).cast("long").alias("item_id"), F.array_distinct(F.regexp_extract_all(F.translate(F.col(text_col).cast("string"), UPPER, LOWER), F.lit(PATTERN), F.lit(0))).alias("terms"))
        own = materialize(own.where("size(terms) > 0"), "items")
        size = own.agg(F.coalesce(F.sum(F.aggregate("terms", F.lit(0).cast("long"), lambda n, t: n + F.octet_length(t) + 16)), F.lit(0))).first()[0]
        blocks, out = max(1, -(-size // block)), None
        for b in range(blocks):
            some = own.where(F.pmod(F.xxhash64("item_id", "terms"), F.lit(blocks)) == b)
            found = self._search_block(some, k).withColumn("block", F.lit(b))
            found = found if blocks == 1 else materialize(found, "found")
            out = found if out is None else out.unionByName(found)
        best = lambda by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
        dealt = out.withColumn("deal", F.pmod(F.xxhash64("doc_id"), F.lit(DEALT))).withColumn("rank", best(["block", "query", "deal"])).where(F.col("rank") <= k)
        return dealt.withColumn("rank", best(["block", "query"])).where(F.col("rank") <= k).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")

    def _search_block(self, items: DataFrame, k: int) -> DataFrame:
        wanted = items.select(F.explode(F.col("terms").cast("array<binary>")).alias("term")).distinct()
        known = self.terms.join(wanted, "term").toArrow()
        weights = {t: self.weight(n) for t, n in zip(known["term"].to_pylist(), known["df"].to_pylist(), strict=True)}
        rows = items.toArrow()
        block = Items(rows["item_id"].to_pylist(), [[t.encode() for t in ts] for ts in rows["terms"].to_pylist()], weights)
        shared = items.sparkSession.sparkContext.broadcast(block)
        return self.segments.mapInArrow(lambda batches: shared.value.search(batches, k), FOUND)

    def close(self) -> None:
        """Deletes the index's files."""
        discard(self.segments)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: item_id, rank, doc_id, score; the 50 best documents of every benchmark item."""
    return LexicalIndex(read(spark, sf_dir, "documents")).search(read(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents
), e AS (SELECT doc_id, ts, len(ts)::BIGINT AS n FROM d WHERE len(ts) > 0),
s AS (SELECT count(*)::BIGINT AS nd, sum(n)::BIGINT AS nt FROM e),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
p AS (SELECT doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, n, unnest(ts) AS term FROM e) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, s GROUP BY term, nd),
i AS (SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nd) // nt))) AS x FROM p JOIN w USING (term), s),
f AS (SELECT item_id, doc_id, sum(x)::BIGINT AS score FROM q JOIN i USING (term) GROUP BY ALL HAVING sum(x) > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM f)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= 50
"""
