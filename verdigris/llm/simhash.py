"""SimHash near-duplicates by anchor-point covering.

The anchors are made of the codewords of three perfect codes side by side, two Golay codes of length 23 and a Hamming code of
length 15, over 61 of a fingerprint's 64 bits: 2^35 anchors, and every word is within 3, 3 and 1 bits of exactly one codeword
of each code. A fingerprint's home is the anchor within that covering radius; it is replicated to every anchor within radius plus
threshold, the threshold being shared by the codes: about 153 anchors at 2 bits. If two fingerprints differ in t bits or fewer,
each is replicated to the other's home, so comparing homes with replicas anchor by anchor misses nothing. With 10^9 different
fingerprints an anchor holds few by chance: some 4 10^9 comparisons in all.

Equal fingerprints are one row before replication, so exact copies cost nothing, and a fingerprint has at most
2,080 others within 2 bits, which bounds the links of a group of near copies. Homes and replicas meet in an
equi-join on the anchor, whose large keys AQE splits; components come from star rounds.

Words are runs of anything but ASCII white space, A-Z lower-cased; shingles count as often as they occur. A text
with fewer words than a shingle is one shingle; one without words has fingerprint zero, linked like any other. A
null doc_id takes part; a component's id is its smallest doc_id that is not null.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache
from itertools import combinations, product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.llm.common import discard, map_batches, materialize, pick, small_slices, texts, unused
from verdigris.llm.components import connected_components
from verdigris.llm.shingle_links import band_rows, bands, shingle_set, similar_links

#: Rows of at most 16 bytes that are broadcast at most.
NEAR_IDS = 8_000_000

def shingle_hashes(text: str, words: int, seed: int = 42) -> np.ndarray:
    w = text.encode().lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    shingles = map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False)) if len(w) >= words else [b" ".join(w)]
    return np.fromiter((xxhash.xxh64_intdigest(s, seed) for s in shingles), np.uint64)


def fingerprint(text: str, words: int, seed: int = 42) -> int:
    return majority(shingle_hashes(text, words, seed))


def majority(h: np.ndarray) -> int:
    """The fingerprint of shingle hashes."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 14):
        ones += np.unpackbits(h[i : i + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int, with_bands: bool = False) -> DataFrame:
    """(doc_id long, text_hash long, fp long: the fingerprint's bits, bands array<long>) for every row of docs (doc_id, text)."""

    def run(batch):
        for part in small_slices(batch, 8 << 20):
            hashed = [shingle_hashes(t, words) for t in texts(part)]
            fps = np.array([majority(h) for h in hashed], np.uint64).view(np.int64)
            own = [bands(h) for h in hashed] if with_bands else [None] * len(hashed)
            yield pa.record_batch([part.column("doc_id"), part.column("text_hash"), pa.array(fps), pa.array(own, pa.list_(pa.int64()))], ["doc_id", "text_hash", "fp", "bands"])

    return map_batches(docs.withColumn("text_hash", F.xxhash64("text")), run, "doc_id long, text_hash long, fp long, bands array<long>")


@dataclass(frozen=True)
class Code:
    """A perfect cyclic code over some of a fingerprint's bits: every word is within radius of exactly one codeword."""

    shift: int
    length: int
    info: int
    radius: int
    generator: int

    def remainder(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(np.int64).copy()
        for i in range(self.length - 1, self.length - self.info - 1, -1):
            x ^= np.where(x >> i & 1, self.generator << (i - (self.length - self.info)), 0)
        return x

    def word(self, fps: np.ndarray) -> np.ndarray:
        return ((fps.view(np.uint64) >> np.uint64(self.shift)) & np.uint64((1 << self.length) - 1)).astype(np.int64)

    def number(self, codeword: np.ndarray) -> np.ndarray:
        """A codeword is known by its upper bits."""
        return codeword >> (self.length - self.info)


#: The Golay code's generator polynomial x^11 + x^9 + x^7 + x^6 + x^5 + x + 1, and the Hamming code's x^4 + x + 1.
CODES = (Code(0, 23, 12, 3, 0b101011100011), Code(23, 23, 12, 3, 0b101011100011), Code(46, 15, 11, 1, 0b10011))


@cache
def errors(code: Code, excess: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The errors that lead to a codeword at most radius away (excess 0), or exactly radius + excess: all of them, ordered by the
    remainder of the word, and where each remainder's begin and how many it has."""
    by: list[list[int]] = [[] for _ in range(1 << (code.length - code.info))]
    single = [int(code.remainder(np.array([1 << i]))[0]) for i in range(code.length)]
    for weight in range(code.radius + 1) if excess == 0 else [code.radius + excess]:
        for bits in combinations(range(code.length), weight):
            error = left = 0
            for i in bits:
                error |= 1 << i
                left ^= single[i]
            by[left].append(error)
    counts = np.array([len(own) for own in by], np.int64)
    return np.array([e for own in by for e in own], np.int64), np.cumsum(counts) - counts, counts


class Covering:
    """Anchors of fingerprints, for links at up to bits differing bits (0 to 2)."""

    def __init__(self, bits: int):
        if not 0 <= bits <= 2:
            raise ValueError("bits is 0, 1 or 2")
        self.shares = [x for x in product(range(bits + 1), repeat=len(CODES)) if sum(x) <= bits]

    def anchors(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index into fps, anchor, whether it is the home) of every replica."""
        words = [c.word(fps) for c in CODES]
        lefts = [c.remainder(w) for c, w in zip(CODES, words, strict=True)]
        out = []
        for share in self.shares:  # how much of the threshold falls to each code
            which, anchor = np.arange(len(fps)), np.zeros(len(fps), np.int64)
            for code, word, left, excess in zip(CODES, words, lefts, share, strict=True):
                all_errors, starts, counts = errors(code, excess)
                each = counts[left[which]]
                place = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
                which, anchor = np.repeat(which, each), np.repeat(anchor, each)
                anchor = anchor << code.info | code.number(word[which] ^ all_errors[starts[left[which]] + place])
            out.append((which, anchor, np.full(len(which), not any(share))))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def near_links(fps: DataFrame, bits: int) -> DataFrame:
    """(a long, b long): all pairs of distinct fingerprints of fps (fp) within bits differing bits, once each."""

    def homes(batch):
        own = batch.column("fp").to_numpy()
        which, anchor, home = Covering(0).anchors(own)
        yield pa.record_batch([pa.array(anchor[home]), pa.array(own[which[home]])], ["anchor", "a"])

    def replicas(batch):
        own, covering = batch.column("fp").to_numpy(), Covering(bits)
        for begin in range(0, len(own), 2000):
            part = own[begin : begin + 2000]
            which, anchor, _ = covering.anchors(part)
            yield pa.record_batch([pa.array(anchor), pa.array(part[which])], ["anchor", "b"])

    left, right = map_batches(fps, homes, "anchor long, a long"), map_batches(fps, replicas, "anchor long, b long")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits
    # Spark takes the replicas for as many rows as the fingerprints they come from, and so would broadcast them
    return left.join(right.hint("merge"), "anchor").where((F.col("a") < F.col("b")) & near).select("a", "b")


def near_duplicates(docs: DataFrame, words: int = 5, bits: int = 2, similarity: float | None = None, id_col: str = "doc_id", text_col: str = "text", near_ids: int = NEAR_IDS) -> DataFrame:
    """(doc_id, text_hash, fp, component_id) of every row: documents whose fingerprints are linked share a component_id.

    With a similarity, documents are linked as well whose shingle sets are at least so similar (see shingle_links).
    Every different text is compared by its own set, as texts with one fingerprint can have quite different ones."""
    own = pick(docs, id_col, text_col)
    each = materialize(fingerprints(own, words, similarity is not None), "fingerprints")
    fps = materialize(each.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    links = materialize(near_links(fps.select("fp"), bits), "near-links")
    if similarity is not None:

        def shingles_of(nodes: DataFrame) -> DataFrame:
            chosen = materialize(nodes, "compared")
            side = F.broadcast(chosen) if chosen.count() <= near_ids else chosen

            def sets(batch):
                for part in small_slices(batch, 8 << 20):
                    yield pa.record_batch([part.column("node"), pa.array([shingle_set(shingle_hashes(t, words)) for t in texts(part)], pa.binary())], ["node", "shingles"])

            compared = own.join(side, F.xxhash64("text") == F.col("node")).select("node", "text")
            return map_batches(compared, sets, "node long, shingles binary").dropDuplicates(["node"])

        similar = similar_links(band_rows(each), shingles_of, similarity)
        # links of texts become links of their fingerprints, which gives the same components
        of = each.select("text_hash", "fp").distinct()
        for end in ("a", "b"):
            similar = similar.join(of.select(F.col("text_hash").alias(end), F.col("fp").alias(f"fp_{end}")), end)
        links = links.unionByName(similar.select(F.col("fp_a").alias("a"), F.col("fp_b").alias("b")))
    roots = connected_components(links)
    member = fps.join(roots, fps["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = member.groupBy("root").agg(F.min("least").alias("component_id"))
    component = materialize(member.join(least, "root").select("fp", "component_id", "root"), "fingerprint-components")
    discard(fps)
    return each.join(component, "fp").select("doc_id", "text_hash", "fp", "component_id", "root")


def keep_one(docs: DataFrame, words: int = 5, bits: int = 2, similarity: float | None = 0.8, id_col: str = "doc_id", text_col: str = "text", near_ids: int = NEAR_IDS) -> DataFrame:
    """docs without all but the smallest doc_id of each component; of rows with equal id and text one stays, and of linked texts under
    that one id, or all without an id, the one with the smallest hash.

    The ids that go are broadcast if there are at most near_ids (16 bytes each), so that texts are not shuffled."""
    found = materialize(near_duplicates(docs, words, bits, similarity, id_col, text_col, near_ids).select("doc_id", "text_hash", "component_id", "root"), "components")
    # a row is known by its id and its text's hash, so that rows with one id, or none, are told apart
    gone, digest = unused(docs, "_lost"), unused(docs, "_hash")
    # different texts of a group under its smallest id: the one with the smallest hash stays
    own = found.where("doc_id <=> component_id").select("root", "doc_id", "text_hash").distinct()
    others = own.join(own.groupBy("root").agg(F.min("text_hash").alias("stays")), "root").where("text_hash > stays")
    lost = found.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id", "text_hash").unionByName(others.select("doc_id", "text_hash"))
    lost = materialize(lost.select(F.col("doc_id").alias(gone), F.col("text_hash").alias(digest)).distinct(), "lost")
    twice = materialize(found.groupBy("doc_id", "text_hash").count().where("count > 1").select(F.col("doc_id").alias(gone), F.col("text_hash").alias(digest)), "repeated")
    discard(found)

    def near(ids: DataFrame) -> DataFrame:
        return F.broadcast(ids) if ids.count() <= near_ids else ids

    same = F.col(id_col).cast("long").eqNullSafe(F.col(gone)) & (F.xxhash64(F.col(text_col).cast("string")) == F.col(digest))
    kept = docs.join(near(lost), same, "left_anti")
    if twice.isEmpty():
        return kept
    return kept.join(near(twice), same, "left_anti").unionByName(kept.join(near(twice), same, "left_semi").dropDuplicates([id_col, text_col]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: doc_id, fingerprint, component_id, by 3-word shingles and at most 2 bits."""
    from verdigris.llm.common import read

    out = near_duplicates(read(spark, sf_dir, "documents"), words=3, bits=2)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
