"""Token ids as directly addressable codes.

An id is cut into chunks of ``CHUNK_BITS`` bits, low chunk first. Level k holds the k-th chunk of every id that has
one, and a bitmap that says whether a next chunk follows. A rank directory counts the bitmap's ones before every
``RANK_EVERY`` bits, so that token i's place at level k + 1 is a rank at level k: any token is read in a few steps
without decoding its neighbours.

A segment is one run of documents in ascending doc_id order (null ids first; ties by a hash of their ids):

    magic "VDAC", version u16, chunk bits u16, documents u32, tokens u64, levels u32
    doc ids i64[], null flags u8[], token ends u64[]
    for each level: count u64, chunks u8[], bitmap u64[], ranks u32[]
    crc32 of all before u32

Texts are encoded where they lie; only ids, two bytes each, are shuffled into order. Segments are stored as the binary column
of an uncompressed Parquet table, which Spark's committer writes and any store can hold: a lost executor's half-written
files never count. Each segment knows its partition and its first token there; the partitions' totals give the rest of
``start``. These columns are the directory by which ``token_at`` reads one segment's bytes only. A text of any length is
one document; a segment holds at least one. Null texts are empty, so such a document holds its end id alone.
"""

from __future__ import annotations

import json
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verdigris.llm.bpe_units import FastEncoder, read_spec
from verdigris.llm.common import pick, release, shared_path, shuffle_partitions, small_slices, texts

CHUNK_BITS, RANK_EVERY = 8, 512
SEGMENT_TOKENS = 1 << 21
HEAD = struct.Struct("<4sHHIQI")


def write_segment(doc_ids: list[int | None], ids: list[np.ndarray]) -> bytes:
    """The bytes of a segment of these documents' ids."""
    rest = np.concatenate(ids).astype(np.uint32) if ids else np.zeros(0, np.uint32)
    n, levels, body = len(rest), 0, []
    while levels == 0 or len(rest):
        more = (rest >> CHUNK_BITS) > 0
        body += [struct.pack("<Q", len(rest)), (rest & ((1 << CHUNK_BITS) - 1)).astype(np.uint8).tobytes()]
        bits = np.zeros(-(-len(rest) // RANK_EVERY) * RANK_EVERY, np.uint8)
        bits[: len(rest)] = more
        ones = np.cumsum(bits.reshape(-1, RANK_EVERY).sum(axis=1, dtype=np.uint32), dtype=np.uint32)
        body += [np.packbits(bits, bitorder="little").tobytes(), np.r_[np.uint32(0), ones].astype("<u4").tobytes()]
        rest = rest[more] >> CHUNK_BITS
        levels += 1
    ends = np.cumsum([len(x) for x in ids], dtype=np.uint64)
    head = HEAD.pack(b"VDAC", 1, CHUNK_BITS, len(doc_ids), n, levels)
    out = b"".join([head, np.array([d or 0 for d in doc_ids], "<i8").tobytes(), bytes(d is None for d in doc_ids), ends.astype("<u8").tobytes(), *body])
    return out + struct.pack("<I", zlib.crc32(out))


class Segment:
    """Reads a segment: documents, single tokens, or all ids."""

    def __init__(self, data: bytes, check: bool = True):
        if check and zlib.crc32(memoryview(data)[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError("the segment is damaged")
        magic, version, self.bits, n_docs, self.n, levels = HEAD.unpack_from(data)
        if magic != b"VDAC" or version != 1:
            raise ValueError("not a segment")
        at = HEAD.size

        def take(dtype: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, dtype, count, at)
            at += out.nbytes
            return out

        ids, null = take("<i8", n_docs), take("u1", n_docs)
        self.doc_ids = [None if z else int(d) for d, z in zip(ids, null, strict=True)]
        self.ends = take("<u8", n_docs).astype(np.int64)
        self.levels = []
        for _ in range(levels):
            count = int(take("<u8", 1)[0])
            runs = -(-count // RANK_EVERY)
            self.levels.append((take("u1", count), take("<u8", runs * RANK_EVERY // 64), take("<u4", runs + 1)))

    def token(self, i: int) -> int:
        """Token i by rank directories alone."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for k, (chunks, bitmap, ranks) in enumerate(self.levels):
            value |= int(chunks[i]) << (self.bits * k)
            word, bit = divmod(i, 64)
            if not int(bitmap[word]) >> bit & 1:
                break
            first = i // RANK_EVERY * (RANK_EVERY // 64)
            i = int(ranks[i // RANK_EVERY]) + int(np.bitwise_count(bitmap[first:word]).sum()) + (int(bitmap[word]) & ((1 << bit) - 1)).bit_count()
        return value

    def ids(self) -> np.ndarray:
        """All ids, level by level."""
        out = np.zeros(self.n, np.uint32)
        at = np.arange(self.n)
        for k, (chunks, bitmap, _) in enumerate(self.levels):
            out[at] |= chunks.astype(np.uint32) << np.uint32(self.bits * k)
            at = at[np.unpackbits(bitmap.view(np.uint8), bitorder="little")[: len(at)].view(bool)]
        return out

    def documents(self):
        """(doc_id, first token, ids) of each document."""
        ids, begin = self.ids(), 0
        for doc, end in zip(self.doc_ids, self.ends.tolist(), strict=True):
            yield doc, begin, ids[begin:end]
            begin = end


SEGMENTS = "part int, first long, tokens long, documents long, segment binary"


def encoded(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """(doc_id, ids binary) of docs (doc_id, text), in their order: ids of two bytes where all ids fit, else of four, with the end id."""
    spec = docs.sparkSession.sparkContext.broadcast(read_spec(tokenizer))

    def run(batches):
        encoder, width = FastEncoder(spec.value), "<u2" if max_id(spec.value, end_id) < 1 << 16 else "<u4"
        end = np.array([end_id], width)
        for batch in batches:
            for part in small_slices(batch, 8 << 20):
                ids = [np.concatenate([encoder.ids(t).astype(width), end]).tobytes() for t in texts(part)]
                yield pa.record_batch([part.column("doc_id"), pa.array(ids, pa.binary())], ["doc_id", "ids"])
                release()

    return docs.mapInArrow(run, "doc_id long, ids binary")


def max_id(spec: str, end_id: int) -> int:
    d = json.loads(spec)
    return max(end_id, *d["model"]["vocab"].values(), *(t["id"] for t in d["added_tokens"]))


def write_tokens(docs: DataFrame, tokenizer: str, path: str | None = None, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes docs' ids as a table of segments at path, or in the shared folder, and returns that table."""
    spark = docs.sparkSession
    width = "<u2" if max_id(read_spec(tokenizer), end_id) < 1 << 16 else "<u4"
    # texts are shuffled, compressed, and encoded where they are written, so that ids are on disk once. The tie is part of the range, so that
    # rows of one id, or of none, are dealt over many tasks
    own = pick(docs, id_col, text_col).withColumn("tie", F.xxhash64("text"))
    ordered = encoded(own.repartitionByRange(shuffle_partitions(spark), "doc_id", "tie").sortWithinPartitions("doc_id", "tie"), tokenizer, end_id)

    def run(batches):
        part, first = TaskContext.get().partitionId(), 0
        doc_ids, ids, held = [], [], 0

        def segment():
            return pa.record_batch([pa.array([part], pa.int32()), pa.array([first]), pa.array([held]), pa.array([len(ids)]), pa.array([write_segment(doc_ids, ids)], pa.binary())], ["part", "first", "tokens", "documents", "segment"])

        for batch in batches:
            for doc, data in zip(batch.column("doc_id").to_pylist(), batch.column("ids"), strict=True):
                own = np.frombuffer(data.as_buffer(), width)
                if held and held + len(own) > SEGMENT_TOKENS:
                    yield segment()
                    first, doc_ids, ids, held = first + held, [], [], 0
                doc_ids.append(doc)
                ids.append(own.copy())
                held += len(own)
        if ids:
            yield segment()

    table = ordered.mapInArrow(run, SEGMENTS)
    where = path or shared_path(spark, "token-segments")
    # nothing compressed, and a row group for every few segments: one segment is read without its neighbours
    table.write.mode("overwrite").options(**{"compression": "none", "parquet.enable.dictionary": "false", "parquet.block.size": str(4 * SEGMENT_TOKENS)}).parquet(where)
    return spark.read.schema(table.schema).parquet(where)


def parts(segments: DataFrame) -> DataFrame:
    """(p, before): the tokens of all partitions before each; a row for each partition of the writing job."""
    whole = segments.groupBy("part").agg(F.sum("tokens").alias("n"))
    return whole.select(F.col("part").alias("p"), F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))


def token_at(segments: DataFrame, position: int) -> int:
    """The token at a place of the whole corpus. The directory columns find its segment, whose bytes alone are read; in it
    the token's own chunks and ranks are looked at, and nothing is decoded."""
    p = parts(segments).where(F.col("before") <= position).orderBy(F.desc("p")).first() if position >= 0 else None
    at = position - p["before"] if p else -1
    found = segments.where((F.col("part") == p["p"]) & (F.col("first") <= at) & (F.col("first") + F.col("tokens") > at)).select("first", "segment").first() if p else None
    if found is None:
        raise IndexError(position)
    return Segment(found["segment"], check=False).token(at - found["first"])


def read_tokens(segments: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids binary) of every document, from the segments alone."""
    before = parts(segments)

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                docs = list(Segment(row["segment"]).documents())
                yield pa.record_batch([
                    pa.array([d for d, _, _ in docs], pa.int64()), pa.array([row["first"] + b for _, b, _ in docs], pa.int64()),
                    pa.array([len(x) for _, _, x in docs], pa.int64()), pa.array([x.astype("<u4").tobytes() for _, _, x in docs], pa.binary()),
                ], ["doc_id", "start", "n_tokens", "ids"])

    placed = segments.join(F.broadcast(before), segments["part"] == before["p"]).select((F.col("before") + F.col("first")).alias("first"), "segment")
    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: doc_id, start, n_tokens, ids_crc32."""
    import public_tokenizers

    from verdigris.llm.common import read

    out = read_tokens(write_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))
    return out.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
