"""Reversible line dedup: exact reference-count tables, and sharded cuckoo filters of the frequent keys in front.

``LineIndex`` holds, for every line key, in how many documents it is, and one cuckoo filter for each shard of the keys that
reached ``min_docs`` (``filters``). Counts are levels: ``insert`` and ``delete`` append one of signed counts, so what is written
follows the change and not the corpus; after ``LEVELS`` of them they are merged. Only keys that cross the threshold enter or leave a
filter, and only their shards' filters are made anew, so deleting what was inserted restores the index. A document is counted
as well, by a digest of its set of keys: ``delete`` refuses documents that are not in the index.

``drop`` probes the filters while it scans the documents; only a line that a filter may hold is verified against
the exact table. The filters and the frequent keys go to the executors if their exact size is within
``broadcast_bytes``; if only the filters are, the verification is a join on the key that AQE can split. Beyond that, keys are
routed to their shard's filter, in groups of about ``ROUTED`` rows however hot a shard, and what passes is verified by that join.
Only documents with a verified line are joined with their texts.

Keys are compared by 128-bit hash. A key counts once in a document. Null and empty texts are one empty line. Keys
shorter than ``min_chars`` code points are never dropped. Every row is a document, whatever its id; ids may be null or repeat.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from verdigris.llm.common import discard, map_batches, materialize, small_slices, texts, unused
from verdigris.llm.cuckoo import CuckooFilter

#: The ASCII white space that is stripped from a key, [\x20\x09-\x0D].
STRIP = b" \t\n\x0b\x0c\r"
KEYS_PER_SHARD = 100_000
#: Bytes of text that a task takes up at a time; levels of counts at most; keys that meet a filter in one group.
PIECE, LEVELS, ROUTED = 8 << 20, 8, 500_000


def keys_of(text: str, min_chars: int = 1) -> list[bytes]:
    """A 16-byte key for each line; b"" for lines that are never dropped. bytes.lower() lowers A-Z only."""
    out = []
    for line in text.encode().lower().split(b"\n"):
        line = line.strip(STRIP)
        short = len(line) < min_chars if min_chars <= 1 else len(line.decode()) < min_chars
        out.append(b"" if short else xxhash.xxh3_128_digest(line))
    return out


def _halves(keys: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)


def count_keys(docs: DataFrame, text_col: str = "text", min_chars: int = 1, members: bool = False) -> DataFrame:
    """(k1, k2, doc, n): in how many of docs each key is; summed in each batch, then by map-side partial sums. With members, also how
    many documents have each set of keys, as rows with doc."""

    def count(batch):
        found: Counter[tuple[bytes, bool]] = Counter()
        for part in small_slices(batch, PIECE, text_col):
            for text in texts(part, text_col):
                own = {k for k in keys_of(text, min_chars) if k}
                found.update((k, False) for k in own)
                if members:
                    found[xxhash.xxh3_128_digest(b"".join(sorted(own))), True] += 1
        if found:
            k = _halves([k for k, _ in found])
            yield pa.record_batch([pa.array(k[:, 0].copy()), pa.array(k[:, 1].copy()), pa.array([d for _, d in found]), pa.array(list(found.values()), pa.int64())], ["k1", "k2", "doc", "n"])

    each = map_batches(docs.select(text_col), count, "k1 long, k2 long, doc boolean, n long")
    return each.groupBy("k1", "k2", "doc").agg(F.sum("n").alias("n"))


KEY = ["k1", "k2", "doc"]


@dataclass
class LineIndex:
    """levels (k1, k2, doc, n) of signed counts, filters (shard, filter) of the keys in at least min_docs documents."""

    levels: list[DataFrame]
    filters: DataFrame
    shards: int
    min_docs: int
    min_chars: int

    @classmethod
    def build(cls, docs: DataFrame, min_docs: int = 10, min_chars: int = 1, text_col: str = "text", members: bool = True) -> LineIndex:
        """The index of docs; without members it cannot tell what was inserted, and so not delete."""
        return cls._of(materialize(count_keys(docs, text_col, min_chars, members), "line-counts"), min_docs, min_chars)

    @classmethod
    def _of(cls, counts: DataFrame, min_docs: int, min_chars: int) -> LineIndex:
        shards = max(1, -(-counts.where((F.col("n") >= min_docs) & ~F.col("doc")).count() // KEYS_PER_SHARD))
        out = cls([counts], counts, shards, min_docs, min_chars)
        out.filters = materialize(out._sharded(out.frequent()).groupBy("shard").applyInPandas(_build, "shard long, filter binary"), "line-filters")
        return out

    @property
    def counts(self) -> DataFrame:
        """(k1, k2, doc, n) of all levels together."""
        if len(self.levels) == 1:
            return self.levels[0]
        return _union(self.levels).groupBy(*KEY).agg(F.sum("n").alias("n")).where("n > 0")

    def frequent(self) -> DataFrame:
        return self.counts.where((F.col("n") >= self.min_docs) & ~F.col("doc")).select("k1", "k2")

    def _sharded(self, keys: DataFrame) -> DataFrame:
        return keys.withColumn("shard", F.pmod(F.col("k1"), F.lit(self.shards)).cast("long"))

    def insert(self, docs: DataFrame, text_col: str = "text") -> LineIndex:
        return self._changed(docs, 1, text_col)

    def delete(self, docs: DataFrame, text_col: str = "text") -> LineIndex:
        """Takes out documents that were inserted before; ValueError if any was not."""
        return self._changed(docs, -1, text_col)

    def _changed(self, docs: DataFrame, sign: int, text_col: str) -> LineIndex:
        delta = materialize(count_keys(docs, text_col, self.min_chars, True).withColumn("n", F.col("n") * sign), "line-counts")
        touched = delta.select(*KEY, F.col("n").alias("d"))
        was = _union(self.levels).join(delta.select(*KEY), KEY, "left_semi").groupBy(*KEY).agg(F.sum("n").alias("was"))
        both = touched.join(was, KEY, "left").select(*KEY, F.coalesce("was", F.lit(0).cast("long")).alias("was"), "d")
        both = materialize(both.withColumn("n", F.col("was") + F.col("d")), "line-changes")
        if sign < 0 and not both.where("n < 0").isEmpty():
            raise ValueError("the index does not hold all of these documents")
        levels = [*self.levels, delta]
        if len(levels) > LEVELS:
            levels = [materialize(LineIndex(levels, self.filters, self.shards, self.min_docs, self.min_chars).counts, "line-counts")]
        out = LineIndex(levels, self.filters, self.shards, self.min_docs, self.min_chars)
        crossed = both.where(~F.col("doc") & ((F.col("n") >= self.min_docs) != (F.col("was") >= self.min_docs))).select("k1", "k2", (F.col("n") >= self.min_docs).alias("enters"))
        crossed = materialize(self._sharded(crossed), "line-crossings")

        def renew(key: tuple, filters: pd.DataFrame, moved: pd.DataFrame) -> pd.DataFrame:
            f = CuckooFilter.from_bytes(filters["filter"].iloc[0]) if len(filters) else CuckooFilter.sized(len(moved))
            k1, k2, enters = moved["k1"].to_numpy(), moved["k2"].to_numpy(), moved["enters"].to_numpy(bool)
            f.delete(k1[~enters], k2[~enters])
            fits = f.insert(k1[enters], k2[enters])
            return pd.DataFrame({"shard": [key[0]], "filter": [f.to_bytes() if fits else b""]})

        shards = crossed.select("shard").distinct()
        own = self.filters.join(shards, "shard", "left_semi")
        renewed = materialize(own.groupBy("shard").cogroup(crossed.groupBy("shard")).applyInPandas(renew, "shard long, filter binary"), "line-filters")
        full = renewed.where(F.length("filter") == 0).select("shard")  # outgrown: made anew, twice as large
        again = out._sharded(out.frequent()).join(full, "shard", "left_semi").groupBy("shard").applyInPandas(_build, "shard long, filter binary")
        rest = self.filters.join(shards, "shard", "left_anti")
        out.filters = materialize(rest.unionByName(renewed.where(F.length("filter") > 0)).unionByName(again), "line-filters")
        discard(renewed, both, crossed)
        return out

    def drop(self, docs: DataFrame, text_col: str = "text", broadcast_bytes: int = 64 << 20) -> DataFrame:
        """docs with the kept lines as text, joined by line feeds, and n_lines (before) and n_dropped, both long."""
        spark = docs.sparkSession
        docs = docs.drop("n_lines", "n_dropped")
        frequent = self.frequent()
        filter_bytes = self.filters.agg(F.coalesce(F.sum(F.length("filter")), F.lit(0))).first()[0]
        near = filter_bytes + 16 * frequent.count() <= broadcast_bytes
        min_chars = self.min_chars
        if filter_bytes <= broadcast_bytes:
            held = Filters(self.filters.collect(), self.shards)
            if near:
                keys = frequent.toArrow()  # 16 bytes a key; a Row of Python takes ten times as much
                held.exact = _sorted_keys(np.column_stack([keys["k1"].to_numpy(), keys["k2"].to_numpy()]))
            shared = spark.sparkContext.broadcast(held)
            if near:
                return map_batches(docs, lambda b: (_kept(p, text_col, shared.value, min_chars) for p in small_slices(b, PIECE, text_col)), _out_schema(docs))
        else:
            shared = None
        # a text is known by two hashes; equal texts have equal lines
        hashes = [F.xxhash64(F.col(text_col)), F.xxhash64(F.col(text_col), F.lit(1))]
        own = docs.select(hashes[0].alias("_t1"), hashes[1].alias("_t2"), F.col(text_col).alias("text"))
        asked = map_batches(own, lambda b: (x for p in small_slices(b, PIECE) for x in _asked(p, shared.value if shared else None, min_chars)), "_t1 long, _t2 long, k1 long, k2 long")
        if shared is None:
            asked = self._routed(asked)
        # AQE splits the partitions of a key that a large part of the documents holds
        t1, t2, held = (unused(docs, n) for n in ("_t1", "_t2", "_hot"))
        hot = asked.join(frequent, ["k1", "k2"]).groupBy(F.col("_t1").alias(t1), F.col("_t2").alias(t2)).agg(F.collect_set(F.struct("k1", "k2")).alias(held))
        joined = docs.withColumns({t1: hashes[0], t2: hashes[1]}).join(hot, [t1, t2], "left").drop(t1, t2)
        return map_batches(joined, lambda b: (_kept(p, text_col, None, min_chars, held) for p in small_slices(b, PIECE, text_col)), _out_schema(docs))

    def _routed(self, asked: DataFrame) -> DataFrame:
        """asked (_t1, _t2, k1, k2) as far as the keys' shards' filters may hold them. A shard's keys are dealt over as many groups as
        the exact number of keys in documents needs, each with a copy of the filter."""
        total = _union(self.levels).where(~F.col("doc")).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        salts = max(1, -(-total // (self.shards * ROUTED)))
        filters = self.filters.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        keys = self._sharded(asked).withColumn("salt", F.pmod(F.xxhash64("_t1", "k2"), F.lit(salts)).cast("int"))

        def probe(filters: pa.Table, keys: pa.Table) -> pa.Table:
            f = CuckooFilter.from_bytes(filters["filter"][0].as_py()) if filters.num_rows and keys.num_rows else None
            at = f.contains(np.ascontiguousarray(keys["k1"].to_numpy()), np.ascontiguousarray(keys["k2"].to_numpy())) if f else np.zeros(keys.num_rows, bool)
            return keys.select(["_t1", "_t2", "k1", "k2"]).filter(pa.array(at))

        return filters.groupBy("shard", "salt").cogroup(keys.groupBy("shard", "salt")).applyInArrow(probe, "_t1 long, _t2 long, k1 long, k2 long")


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


class Filters:
    """What drop() sends to executors: the filter of each shard and, if small enough, the exact keys."""

    def __init__(self, rows, shards: int):
        self.shards, self.exact = shards, None
        self.by_shard = {r["shard"]: CuckooFilter.from_bytes(bytes(r["filter"])) for r in rows}

    def may_hold(self, keys: np.ndarray) -> np.ndarray:
        out, shard = np.zeros(len(keys), bool), np.mod(keys[:, 0], self.shards)
        for s in np.unique(shard) if self.shards > 1 else [0]:
            if f := self.by_shard.get(int(s)):
                at = np.flatnonzero(shard == s)
                out[at] = f.contains(np.ascontiguousarray(keys[at, 0]), np.ascontiguousarray(keys[at, 1]))
        return out

    def holds(self, keys: np.ndarray) -> np.ndarray:
        """Filter first; the exact keys decide on what it lets through."""
        out = self.may_hold(keys)
        at = np.flatnonzero(out)
        if len(at):
            mine = _sorted_view(keys[at])
            where = np.searchsorted(self.exact, mine)
            out[at] = self.exact[np.minimum(where, len(self.exact) - 1)] == mine if len(self.exact) else False
        return out


_PAIR = np.dtype([("k1", np.int64), ("k2", np.int64)])


def _sorted_view(keys: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(keys).view(_PAIR).ravel()


def _sorted_keys(keys: np.ndarray) -> np.ndarray:
    return np.sort(_sorted_view(keys), order=["k1", "k2"])


def _build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"shard": [key[0]], "filter": [CuckooFilter.of(rows["k1"].to_numpy(), rows["k2"].to_numpy()).to_bytes()]})


def _asked(batch: pa.RecordBatch, filters: Filters | None, min_chars: int):
    keys = [[k for k in set(keys_of(t, min_chars)) if k] for t in texts(batch)]
    flat = _halves([k for ks in keys for k in ks])
    doc = np.repeat(np.arange(len(keys)), [len(ks) for ks in keys])
    if filters is not None and len(flat):
        at = filters.may_hold(flat)
        doc, flat = doc[at], flat[at]
    yield pa.record_batch([*(batch.column(c).take(pa.array(doc)) for c in ("_t1", "_t2")), pa.array(flat[:, 0].copy()), pa.array(flat[:, 1].copy())], ["_t1", "_t2", "k1", "k2"])


def _out_schema(docs: DataFrame) -> StructType:
    return StructType([*docs.schema, StructField("n_lines", LongType()), StructField("n_dropped", LongType())])


def _kept(batch: pa.RecordBatch, text_col: str, filters: Filters | None, min_chars: int, held: str = "") -> pa.RecordBatch:
    """The batch with kept text. Without filters, its column held lists the frequent keys of each row."""
    all_texts = texts(batch, text_col)
    keys = [keys_of(t, min_chars) for t in all_texts]
    counts = [len(k) for k in keys]
    flat = [k for ks in keys for k in ks]
    real = np.array([bool(k) for k in flat], bool)
    hot = np.zeros(len(flat), bool)
    if filters is not None:
        if real.any():
            hot[real] = filters.holds(_halves([k for k in flat if k]))
    else:
        rows = batch.column(held).to_pylist()
        sets = [{np.array([x["k1"], x["k2"]], np.int64).tobytes() for x in r or ()} for r in rows]
        hot[:] = [k in s for ks, s in zip(keys, sets, strict=True) for k in ks]
    out, dropped, at = [], [], 0
    for text, n in zip(all_texts, counts, strict=True):
        gone = hot[at : at + n]
        at += n
        dropped.append(int(gone.sum()))
        out.append("\n".join(line for line, g in zip(text.split("\n"), gone.tolist(), strict=True) if not g) if dropped[-1] else text)
    names = [n for n in batch.schema.names if n != held]
    columns = [pa.array(out, pa.string()) if n == text_col else batch.column(n) for n in names]
    return pa.record_batch([*columns, pa.array(counts, pa.int64()), pa.array(dropped, pa.int64())], [*names, "n_lines", "n_dropped"])


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, text_col: str = "text", broadcast_bytes: int = 64 << 20) -> DataFrame:
    """docs without the lines whose key is in at least min_docs of them; see LineIndex.drop for the columns."""
    return LineIndex.build(docs, min_docs, min_chars, text_col, members=False).drop(docs, text_col, broadcast_bytes)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: doc_id, n_lines, n_dropped, kept_sha256."""
    from verdigris.llm.common import pick, read

    out = dedup_lines(pick(read(spark, sf_dir, "documents")))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH lines AS (
  SELECT d.doc_id, u.i AS pos, u.line,
         translate(trim(u.line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM documents d, LATERAL (SELECT unnest(string_split(coalesce(d.text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(d.text, ''), chr(10)), 1) AS i) u
), hot AS (
  SELECT key FROM lines WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10
), marked AS (
  SELECT l.doc_id, l.pos, l.line, h.key IS NOT NULL AS gone FROM lines l LEFT JOIN hot h ON l.key = h.key
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
