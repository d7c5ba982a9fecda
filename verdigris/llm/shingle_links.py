"""Links between documents whose sets of word shingles have a Jaccard similarity of at least a threshold.

SimHash fingerprints of such documents differ in far more bits than anchors can cover, so near-dedup at 0.8 takes its
candidates here. The hashes that fingerprints are made of are cut into ``BINS`` by their upper bits; each bin's
smallest is a one-permutation min-hash. ``ROWS`` neighbouring bins are a band, and documents with an equal band share a
bucket: at a similarity of 0.8 two documents share none of the 16 with a probability of 0.0002.

A bucket's leader is the member with the largest buckets in all; every member is compared with it, exactly, by its whole
set, which is one row for each member. Buckets of which the components that this gives still hold several are then
settled whole: their intersections are a product of 0/1 matrices, and only links that join components come out. Such
a bucket is cut into cells of at most twice ``CELL`` members, every two chunks of it meeting in one cell, so no task holds
a large bucket and no pair of members is a row. No link that a bucket holds is lost to the components.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.llm.common import discard, map_batches, materialize, release
from verdigris.llm.components import connected_components

BINS, ROWS, CELL = 64, 4, 512
SPREAD = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def bands(hashes: np.ndarray) -> np.ndarray:
    """The bands of a text's shingle hashes; none for a text without words. An empty bin borrows from the next full one."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    u = np.unique(hashes)
    full, first = np.unique(u >> np.uint64(64 - BINS.bit_length() + 1), return_index=True)
    full = full.astype(np.int64)
    at = np.searchsorted(full, np.arange(BINS)) % len(full)
    away = (full[at] - np.arange(BINS)) % BINS
    values = mixed(u[first][at] + away.astype(np.uint64) * SPREAD).reshape(-1, ROWS)
    out = np.arange(BINS // ROWS, dtype=np.uint64) * SPREAD
    for j in range(ROWS):
        out = mixed(out + values[:, j] * SPREAD)
    return out.view(np.int64)


def shingle_set(hashes: np.ndarray) -> bytes:
    return np.unique(hashes).tobytes()


def jaccard(a: bytes, b: bytes) -> float:
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / max(1, len(x) + len(y) - both)


def verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """(a, b) of the pairs (a, b) whose sets (node, shingles) are similar enough."""

    def run(batch):
        a, b = batch.column("a"), batch.column("b")
        keep = [jaccard(x, y) >= least for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True)]
        yield pa.record_batch([a.filter(pa.array(keep)), b.filter(pa.array(keep))], ["a", "b"])

    joined = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    return map_batches(joined.select("a", "b", "x", "y"), run, "a long, b long")


def similar_links(members: DataFrame, shingles_of, least: float) -> DataFrame:
    """(a long, b long): links between nodes of members (key long, node long, distinct rows).

    shingles_of gives (node, shingles binary) for a table (node) of those that are compared."""
    shared = members.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    own = materialize(members.join(shared, "key"), "buckets")
    score = own.groupBy("node").agg(F.sum("size").alias("score"))
    sets = materialize(shingles_of(score.select("node")), "shingle-sets")
    best = own.join(score, "node").groupBy("key").agg(F.max_by("node", F.struct("score", "node")).alias("leader"))
    led = materialize(own.join(best, "key").select("key", "node", "leader"), "led")
    pairs = led.where("node <> leader").select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct()
    near = materialize(verified(pairs, sets, least), "leader-links")
    roots = connected_components(near).withColumnRenamed("node", "member")
    placed = materialize(own.join(roots, F.col("node") == F.col("member"), "left").select("key", "node", "size", F.coalesce("root", "node").alias("comp")), "placed")
    unsettled = placed.where("size > 2").groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("key")
    links = materialize(near.unionByName(settled(placed.join(unsettled, "key"), sets, least)), "shingle-links")
    discard(own, sets, led, near, placed)
    return links


def settled(rows: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """(a, b): links that join components inside the buckets of rows (key, node, size, comp)."""
    chunks = F.ceil(F.col("size") / CELL).cast("int")
    own = F.pmod(F.xxhash64("node"), chunks).cast("int")
    cells = rows.select("key", "node", "comp", own.alias("c"), F.explode(F.sequence(F.lit(0), chunks - 1)).alias("x"))
    cells = cells.select("key", "node", "comp", F.least("c", "x").alias("low"), F.greatest("c", "x").alias("high"))
    cells = cells.hint("merge").join(sets, "node")  # Spark does not see that they are more rows than the members, and could broadcast them

    def settle(t: pa.Table) -> pa.Table:
        release()
        a, b = joining_links(t["node"].to_numpy(), t["comp"].to_numpy(), t["shingles"].to_pylist(), least)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return cells.select("key", "low", "high", "node", "comp", "shingles").groupBy("key", "low", "high").applyInArrow(settle, "a long, b long")


def joining_links(nodes: np.ndarray, comps: np.ndarray, packed: list[bytes], least: float) -> tuple[list[int], list[int]]:
    """Links between nodes whose sets are similar enough, as many as it takes to join their components."""
    sets = [np.frombuffer(x, np.uint64) for x in packed]
    sizes = np.array([len(x) for x in sets], np.int64)
    values, which = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    shared = np.bincount(which, minlength=len(values)) > 1
    number = np.cumsum(shared) - 1
    row, column = row[shared[which]], number[which[shared[which]]]
    both = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for begin in range(0, int(shared.sum()), 2048):
        lo, hi = np.searchsorted(column, [begin, begin + 2048])
        x = np.zeros((len(sets), 2048), np.float32)
        x[row[lo:hi], column[lo:hi] - begin] = 1
        both += x @ x.T
    near = both >= least * (sizes[:, None] + sizes - both) - 1e-3  # whole numbers, so the slack admits no other pair
    label = np.unique(comps, return_inverse=True)[1]
    a, b = [], []
    for i in range(len(sets)):
        for j in np.flatnonzero(near[i] & (label != label[i])).tolist():
            if label[j] != label[i]:
                label[label == label[j]] = label[i]
                a.append(int(nodes[i]))
                b.append(int(nodes[j]))
    return a, b


def band_rows(hashed: DataFrame) -> DataFrame:
    """(key, node) of documents (text_hash, bands), once for each different text."""
    return hashed.select(F.explode("bands").alias("key"), F.col("text_hash").alias("node")).distinct()


