"""BPE encoding and decoding through a table of distinct words.

1. Documents are cut into words (see ``bpe_units``) and packed into blocks of bounded text: each block keeps its
   distinct words, most frequent first, and every document's words as numbers into that list.
2. The distinct words are dealt out by hash into shards, where each is encoded once; what is shuffled is one packed
   list of words for each block and shard.
3. The ids are joined back by block and shard, laid out by position, and decoded through the table of id to piece,
   whose size is bounded by the vocabulary.

The number of shards follows the text's bytes, ``SHARD_BYTES`` to a shard, so that a task's words stay as many when the input
grows. Blocks must come out the same if a task is run again after an executor was lost: what is not read straight from files
is stored first, and every list carries its block's digest, so that lists of two different cuts are an error, never a result.

The id-to-piece join is one of positions: the table of pieces is an array with a place for each id of the vocabulary, which
every task holds, as in a broadcast join. A text of white space alone, however long, is one word.

A word that all documents hold is in one list for each block, not one for each occurrence. A text longer than a block
is a block of its own. Null texts are empty; special strings inside a text become their id, as the library does by
default; bytes that are no UTF-8 decode to U+FFFD. Rows with the same doc_id, null included, are encoded apart.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.llm.bpe_units import FastEncoder, Units, byte_symbols, read_spec
from verdigris.llm.common import pick, release, shuffle_partitions, small_slices, stored, texts

BLOCK_BYTES = 12 << 20
#: Bytes of text to a shard of the distinct-word table, and the fewest shards.
SHARD_BYTES, LEAST_SHARDS = 16 << 20, 16
#: A block's own row has shard -1; its other rows hold the words of one shard of the distinct-word table. place is
#: what a row is dealt out by: the block for the first kind, the shard for the second. digest is the block's.
BLOCK = "place long, block long, shard int, digest long, docs array<long>, sizes array<long>, numbers binary, shards binary, words binary"


def pack(numbers: np.ndarray) -> bytes:
    """Byte planes of 32-bit numbers, compressed: the upper planes are nearly all zero."""
    return zstandard.compress(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 3)


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def pack_strings(items: list[bytes]) -> bytes:
    return zstandard.compress(np.array([len(items), *map(len, items)], "<u4").tobytes() + b"".join(items), 3)


def unpack_strings(data: bytes) -> list[bytes]:
    data = zstandard.decompress(data)
    n = int(np.frombuffer(data, "<u4", 1)[0])
    ends = (4 * n + 4 + np.cumsum(np.frombuffer(data, "<u4", n, 4), dtype=np.int64)).tolist()
    return [data[a:b] for a, b in zip([4 * n + 4, *ends], ends, strict=False)]


def to_blocks(docs: DataFrame, spec, shards: int) -> DataFrame:
    """Blocks of documents (doc_id, text), as in BLOCK; a block's number holds its task's partition."""

    def run(batches):
        units, seq = Units(spec.value), TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in small_slices(batch, BLOCK_BYTES):
                yield from _block(part, units, seq, shards)
                seq += 1
                release()

    return docs.mapInArrow(run, BLOCK)


def _block(part: pa.RecordBatch, units: Units, block: int, shards: int):
    first: dict[str, int] = {}
    cut, sizes = [], []
    for text in texts(part):
        own = units.units(text)
        cut.append(np.fromiter((first.setdefault(w, len(first)) for w in own), np.uint32, len(own)))
        sizes.append(len(own))
    flat = np.concatenate(cut)
    order = np.argsort(-np.bincount(flat, minlength=len(first)), kind="stable")  # frequent words get small numbers
    number = np.empty(len(first), np.uint32)
    number[order] = np.arange(len(first), dtype=np.uint32)
    words = [w.encode() for w in first]
    words = [words[i] for i in order.tolist()]
    shard = np.fromiter((xxhash.xxh3_64_intdigest(w) % shards for w in words), np.uint32, len(words))
    numbers = pack(number[flat])
    digest = xxhash.xxh3_64_intdigest(b"\0".join(words) + numbers) >> 1
    rows = [(block, block, -1, digest, part.column("doc_id").to_pylist(), sizes, numbers, zstandard.compress(shard.tobytes(), 1), None)]
    rows += [(s, block, s, digest, None, None, None, None, pack_strings([words[i] for i in at.tolist()])) for s, at in by_shard(shard)]
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary())
    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["place", "block", "shard", "digest", "docs", "sizes", "numbers", "shards", "words"])


def by_shard(shard: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(shard, places of its words) of every shard that occurs."""
    order = np.argsort(shard, kind="stable")
    found, begin = np.unique(shard[order], return_index=True)
    return list(zip(found.tolist(), np.split(order, begin[1:]), strict=True)) if len(shard) else []


def encode_words(dealt: DataFrame, spec) -> DataFrame:
    """(place: the block, shard, digest, ids binary): the ids of the words of every block and shard, each distinct word encoded once."""

    def run(batches):
        encoder, now, known = FastEncoder(spec.value), None, {}
        for batch in batches:
            batch = batch.select(["block", "shard", "digest", "words"])
            for i in np.flatnonzero(batch.column("shard").to_numpy() >= 0).tolist():
                row = batch.slice(i, 1).to_pylist()[0]
                if row["shard"] != now:  # sorted by shard: a table of one shard at a time
                    now, known = row["shard"], {}
                words = unpack_strings(row["words"])
                for w in words:
                    if w not in known:
                        known[w] = encoder.ids(w.decode()).astype("<u4").tobytes()
                yield pa.record_batch([pa.array([row["block"]]), pa.array([now], pa.int32()), pa.array([row["digest"]]), pa.array([pack_strings([known[w] for w in words])], pa.binary())], ["place", "shard", "digest", "ids"])
        del known
        release()

    return dealt.sortWithinPartitions("shard").mapInArrow(run, "place long, shard int, digest long, ids binary")


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, which: np.ndarray) -> np.ndarray:
    """flat[starts[w] : starts[w] + lengths[w]] for every w of which, laid end to end."""
    n = lengths[which]
    at = np.repeat(starts[which] - np.r_[0, np.cumsum(n)[:-1]] if len(n) else n, n)
    return flat[at + np.arange(len(at))]


class Pieces:
    """The id-to-piece table as one byte array."""

    def __init__(self, spec: str):
        d = json.loads(spec)
        byte_of = {s: b for b, s in enumerate(byte_symbols())}
        table = {i: bytes(byte_of[c] for c in s) if all(c in byte_of for c in s) else s.encode() for s, i in d["model"]["vocab"].items()}
        table |= {t["id"]: t["content"].encode() for t in d["added_tokens"]}
        pieces = [table.get(i, b"") for i in range(1 + max(table))]
        self.lengths = np.array([len(p) for p in pieces], np.int64)
        self.starts = np.r_[0, np.cumsum(self.lengths)[:-1]]
        self.flat = np.frombuffer(b"".join(pieces), np.uint8)

    def decode(self, ids: np.ndarray) -> str:
        return gather(self.flat, self.starts, self.lengths, ids.astype(np.int64)).tobytes().decode("utf-8", "replace")


def encode_decode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids binary: little-endian unsigned 32-bit, decoded string) of every row."""
    spark = docs.sparkSession
    spec = spark.sparkContext.broadcast(read_spec(tokenizer))
    # One exchange for both kinds of rows: the plan reuses it, so what is dealt out is written once. Neither reader
    # filters or prunes it in Spark, which would make it two.
    own = stored(pick(docs, id_col, text_col), "bpe-input")
    total = own.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    dealt = to_blocks(own, spec, max(LEAST_SHARDS, -(-total // SHARD_BYTES))).repartition(shuffle_partitions(spark), "place")
    ids = encode_words(dealt, spec)

    def lay_out(words: pa.Table, block: pa.Table) -> pa.Table:
        release()  # what the block before this one took
        pieces, out = Pieces(spec.value), []
        for row in block.filter(pc.equal(block["shard"], -1)).to_pylist():
            shard = np.frombuffer(zstandard.decompress(row["shards"]), np.uint32)
            places, table = dict(by_shard(shard)), np.empty(len(shard), object)
            if sorted(words["shard"].to_pylist()) != sorted(places) or set(words["digest"].to_pylist()) - {row["digest"]}:
                raise RuntimeError("a block was cut anew between its lists of words and of numbers")
            for s, data in zip(words["shard"].to_pylist(), words["ids"].to_pylist(), strict=True):
                table[places[s]] = unpack_strings(data)
            lengths = np.array([len(x) // 4 for x in table], np.int64)
            flat, starts = np.frombuffer(b"".join(table.tolist()), "<u4"), np.cumsum(lengths) - lengths
            numbers, at = unpack(row["numbers"]).astype(np.int64), 0
            for doc, n in zip(row["docs"], row["sizes"], strict=True):
                own = gather(flat, starts, lengths, numbers[at : at + n])
                at += n
                out.append((doc, len(own), own.tobytes(), pieces.decode(own)))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 4, (pa.int64(), pa.int64(), pa.binary(), pa.string()), strict=True)], ["doc_id", "n_tokens", "ids", "decoded"])

    return ids.groupBy("place").cogroup(dealt.groupBy("place")).applyInArrow(lay_out, "doc_id long, n_tokens long, ids binary, decoded string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    import public_tokenizers

    from verdigris.llm.common import read

    out = encode_decode(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


