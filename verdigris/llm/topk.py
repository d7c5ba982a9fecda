"""Exact top-k inner products by a pivot-distance index.

Vectors are scaled to integers, floor(scale * x), and given one more coordinate, sqrt(M^2 - |x|^2) with M the largest
norm, so that all have norm M and the largest inner product with a query is the smallest Euclidean distance. Each
vector is keyed by its nearest pivot and the distance to it. A pivot's vectors, sorted by that distance, are cut into
annuli of at most ``ANNULUS`` rows; copies and hot cells so spread over as many rows of the index as they need. An annulus
also knows its largest norm, and the range of its distances to ``REFERENCES`` further pivots.

A search takes the queries in blocks of at most ``QUERY_BLOCK``, whose broadcast size is thereby bounded:

1. every annulus near a query's own key gives a first bound, the k-th best score seen, for that query;
2. all annuli are scanned where they lie, each task expanding outwards from a query's distance; by the triangle inequality no
   vector that is between lo and hi away from a pivot p is nearer to query q than max(d(q,p) - hi, lo - d(q,p), 0). The
   largest of these over an annulus's own pivot and the further ones, and the product of norms, bound its scores. An annulus that
   this rules out for a query is skipped; the others are scored by one exact matrix product, and raise the bound.

Blocks are rounds over the whole index, each as wide as the cluster and without a shuffle of vectors: what a round sends out is a
block of queries, what it returns are k rows a query and task. ``share`` tells which part of all pairs was scored in the last search.
Without clusters there is nothing to rule out: independent directions in 64 dimensions are all nearly as far from any pivot.

Pivots are fitted on at most ``SAMPLE`` vectors chosen by a hash of their id, by farthest-first choice; they affect
speed only, never results. Every row is indexed.

A vector that is null, or holds a null, NaN or infinite component, takes no part. Shorter vectors count as padded
with zeros. Scores beyond 64 bits are held at the largest long. Of rows with one vec_id each is a candidate of its
own; a query excludes all rows of its own id. Fewer than k candidates give fewer rows. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verdigris.llm.common import discard, materialize, read

SCALE, SAMPLE, PIVOTS, REFERENCES, ANNULUS, QUERY_BLOCK = 64, 20_000, 128, 16, 2048, 20_000
#: Products up to this are exact in double precision.
EXACT = 2.0**53


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of doubles, padded with zeros to dim."""
    lengths = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if (lengths == dim).all():
        return values.reshape(-1, dim)
    out = np.zeros((len(lengths), dim))
    at = np.repeat(np.arange(len(lengths)), lengths)
    out[at, np.arange(len(at)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values
    return out


def inner(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products: doubles where they cannot round, else longs made by unbounded integers."""
    if q.shape[1] == 0 or not len(q) or not len(x):
        return np.zeros((len(q), len(x)))
    if np.abs(q).max() * np.abs(x).max() * q.shape[1] < EXACT:
        return q @ x.T
    whole = np.array([[int(v) for v in row] for row in q], object) @ np.array([[int(v) for v in row] for row in x], object).T
    return np.clip(whole, -(2**63), 2**63 - 1).astype(np.int64)


class Pivots:
    """Fitted pivots in the space with one more coordinate."""

    def __init__(self, sample: np.ndarray, largest: float, count: int):
        self.largest = largest
        points, seen = self.lift(sample), []
        if len(points):
            gap = np.full(len(points), np.inf)
            at = 0
            while len(seen) < min(count, len(points)):
                seen.append(at)
                gap = np.minimum(gap, np.linalg.norm(points - points[at], axis=1))
                at = int(gap.argmax())
                if gap[at] == 0:
                    break
        self.at = points[seen] if seen else np.zeros((1, sample.shape[1] + 1))

    def lift(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.largest - np.einsum("ij,ij->i", x, x), 0))
        return np.column_stack([x, rest])

    def distances(self, x: np.ndarray, as_query: bool = False) -> np.ndarray:
        """Of every row to every pivot. A query's last coordinate is zero, so that it adds nothing to a product."""
        y = np.column_stack([x, np.zeros(len(x))]) if as_query else self.lift(x)
        return np.sqrt(np.maximum(np.einsum("ij,ij->i", y, y)[:, None] + np.einsum("ij,ij->i", self.at, self.at) - 2 * y @ self.at.T, 0))


INDEX = "pivot int, lo double, hi double, norm double, los array<double>, his array<double>, ids array<long>, vectors binary"


class PivotIndex:
    """annuli, as in INDEX, with what a search must know of them."""

    def __init__(self, vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, pivots: int = PIVOTS, annulus: int = ANNULUS):
        values = F.col(vector_col).cast("array<double>")
        valid = vectors.select(F.col(id_col).cast("long").alias("vec_id"), values.alias("v")).where(f"v is not null and not exists(v, x -> x is null or isnan(x) or abs(x * {float(scale)!r}D) = double('infinity'))")
        self.valid = valid.select("vec_id", F.transform("v", lambda x: _floor(x, scale)).alias("v"))
        self.spark = vectors.sparkSession
        facts = self.valid.agg(F.coalesce(F.max(F.size("v")), F.lit(0)), F.coalesce(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)), F.lit(0.0)), F.count("*")).first()
        self.dim, self.largest, self.count = int(facts[0]), float(facts[1]), int(facts[2])
        share = SAMPLE / max(1, self.count)
        sample = self.valid.where(F.pmod(F.xxhash64(F.lit("pivot"), "vec_id"), F.lit(1 << 30)) < F.lit(int(min(1.0, share) * (1 << 30)))).select("v").limit(SAMPLE).toArrow()
        rows = matrix(sample["v"].combine_chunks(), self.dim) if sample.num_rows else np.zeros((0, self.dim))
        self.pivots = Pivots(rows, self.largest, pivots)
        self.annulus, self.share = annulus, None
        self.annuli = materialize(self._build(), "annuli")

    def _build(self) -> DataFrame:
        dim, shared, annulus = self.dim, self.spark.sparkContext.broadcast(self.pivots), self.annulus

        def key(batches):
            for batch in batches:
                for b in range(0, batch.num_rows, 4096):
                    part = batch.slice(b, 4096)
                    d = shared.value.distances(matrix(pa.concat_arrays([part.column("v")]), dim))
                    nearest = d.argmin(axis=1)
                    yield pa.record_batch([part.column("vec_id"), part.column("v"), pa.array(nearest.astype(np.int32)), pa.array(d[np.arange(len(d)), nearest])], ["vec_id", "v", "pivot", "distance"])

        keyed = self.valid.mapInArrow(key, "vec_id long, v array<double>, pivot int, distance double")

        def cut(batches):
            for batch in batches:
                pivot = batch.column("pivot").to_numpy()
                border = np.flatnonzero(np.r_[True, pivot[1:] != pivot[:-1]]) if len(pivot) else []
                for a, b in zip(border, [*border[1:], len(pivot)], strict=True):
                    for c in range(a, b, annulus):
                        part = batch.slice(c, min(annulus, b - c))
                        d = part.column("distance").to_numpy()
                        x = matrix(pa.concat_arrays([part.column("v")]), dim)
                        far = shared.value.distances(x)[:, :REFERENCES]
                        yield pa.record_batch([
                            pa.array([int(pivot[c])], pa.int32()), pa.array([float(d.min())]), pa.array([float(d.max())]), pa.array([float(np.sqrt(np.einsum("ij,ij->i", x, x).max()))]),
                            pa.array([far.min(axis=0).tolist()], pa.list_(pa.float64())), pa.array([far.max(axis=0).tolist()], pa.list_(pa.float64())), pa.array([part.column("vec_id").to_pylist()], pa.list_(pa.int64())), pa.array([x.tobytes()], pa.binary()),
                        ], ["pivot", "lo", "hi", "norm", "los", "his", "ids", "vectors"])

        # ranges of (pivot, distance, id): a pivot with a third of all rows is dealt over many tasks
        parts = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), 1)
        return keyed.repartitionByRange(parts, "pivot", "distance", "vec_id").sortWithinPartitions("pivot", "distance").mapInArrow(cut, INDEX)

    def search(self, wanted: DataFrame, k: int = 20, block: int = QUERY_BLOCK) -> DataFrame:
        """(query_id, rank, vec_id, score): the k best for every indexed vector whose id is in wanted (vec_id)."""
        queries = materialize(self.valid.join(wanted.select(F.col("vec_id").cast("long")).distinct(), "vec_id", "left_semi"), "queries")
        n = queries.count()
        blocks = -(-n // block)
        out = []
        for i in range(blocks):
            own = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == i)
            rows = own.select("vec_id", "v").toArrow()  # about block rows: the hash deals them out evenly
            out.append(materialize(self._search_block(rows, k), "top-k"))
        if not out:
            return self.spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
        best = out[0]
        for more in out[1:]:
            best = best.unionByName(more)
        scored = best.where("copy < 0").agg(F.sum("score")).first()[0]
        self.share = (scored or 0) / max(1, n * self.count)
        best = best.where("copy >= 0")
        w = Window.partitionBy("query_id", "copy").orderBy(F.desc("score"), "vec_id")
        ranked = best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        discard(queries)
        return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

    def _search_block(self, rows: pa.Table, k: int) -> DataFrame:
        q = matrix(rows["v"].combine_chunks(), self.dim)
        ids = np.array(rows["vec_id"].to_pylist(), np.int64)
        # rows with one id are queries apart
        copy = np.zeros(len(ids), np.int64)
        order = np.argsort(ids, kind="stable")
        same = np.r_[False, ids[order][1:] == ids[order][:-1]]
        for j in np.flatnonzero(same):
            copy[order[j]] = copy[order[j - 1]] + 1
        dim, sc = self.dim, self.spark.sparkContext
        block = QueryBlock(ids, q, self.pivots)
        shared = sc.broadcast(block)
        near = self.annuli.mapInArrow(lambda b: shared.value.near(b, dim, k), "query int, score long")
        floors = np.full(len(ids), np.iinfo(np.int64).min)
        w = Window.partitionBy("query").orderBy(F.desc("score"))
        kth = near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") == k).select("query", "score").toArrow()
        floors[kth["query"].to_numpy()] = kth["score"].to_numpy()
        bounds = sc.broadcast((floors, copy))
        return self.annuli.mapInArrow(lambda b: shared.value.best(b, dim, k, *bounds.value), "query_id long, copy long, vec_id long, score long")


def _floor(x, scale: int):
    y = x * F.lit(float(scale))
    return F.rint(y) - F.when(F.rint(y) > y, 1.0).otherwise(0.0)


class QueryBlock:
    """A block of queries and their distances to the pivots, as the executors get it."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, pivots: Pivots):
        self.ids, self.q = ids, q
        self.norm = np.sqrt(np.einsum("ij,ij->i", q, q))
        self.reach = self.norm**2 + pivots.largest
        self.slack = 1e-5 * np.sqrt(pivots.largest + 1)  # more than distances are off by rounding
        self.to_pivots = pivots.distances(q, as_query=True)
        own = pivots.distances(q)
        self.home = own.argmin(axis=1)
        self.key = own[np.arange(len(ids)), self.home]

    def near(self, batches, dim: int, k: int):
        """The k best scores of each query in the annulus that holds its own key."""
        for batch in batches:
            for i in range(batch.num_rows):
                pivot, lo, hi = (batch.column(c)[i].as_py() for c in ("pivot", "lo", "hi"))
                use = np.flatnonzero((self.home == pivot) & (self.key >= lo - self.slack) & (self.key <= hi + self.slack))
                if not len(use):
                    continue
                x_ids, x = _annulus(batch, i, dim)
                for part in np.array_split(use, -(-len(use) // 2048)):
                    score = inner(self.q[part], x)
                    at, where = np.nonzero(x_ids[None, :] != self.ids[part][:, None])
                    n = np.bincount(at, minlength=len(part))
                    order = np.lexsort((-score[at, where], at))
                    first = (np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)) < k
                    at, where = at[order][first], where[order][first]
                    yield pa.record_batch([pa.array(part[at].astype(np.int32)), pa.array(score[at, where].astype(np.int64))], ["query", "score"])

    def best(self, batches, dim: int, k: int, floors: np.ndarray, copy: np.ndarray):
        """What can be among the k best of each query; floors are scores that k candidates reach. One more row, with copy -1,
        has the number of pairs that were scored as its score."""
        n, floor, scored = len(self.ids), floors.copy(), 0
        top = [np.zeros((0, 2), np.int64)] * n
        for batch in batches:
            pivot, lo, hi, norm = (batch.column(c).to_numpy() for c in ("pivot", "lo", "hi", "norm"))
            los, his = (np.array(batch.column(c).to_pylist()).reshape(batch.num_rows, -1) for c in ("los", "his"))
            vectors = [_annulus(batch, i, dim) for i in range(batch.num_rows)]
            for begin in range(0, n, 4096):
                who = np.arange(begin, min(n, begin + 4096))
                d = self.to_pivots[who][:, pivot]
                gap = np.maximum(d - hi, lo - d)
                for r in range(los.shape[1]):
                    d = self.to_pivots[who][:, r : r + 1]
                    gap = np.maximum(gap, np.maximum(d - his[:, r], los[:, r] - d))
                gap = np.maximum(gap - self.slack, 0)
                # |q|^2 + M^2 - 2qx is a squared distance, at least gap^2
                upper = np.minimum((self.reach[who, None] - gap * gap) / 2, self.norm[who, None] * norm) + 1e-9 * self.reach[who, None] + 1e-3
                order = np.argsort(-upper, axis=1, kind="stable")
                for r in range(batch.num_rows):  # outwards; the bounds of what is left only fall
                    alive = np.flatnonzero(upper[np.arange(len(who)), order[:, r]] >= floor[who])
                    if not len(alive):
                        break
                    nearest = order[alive, r]
                    by = np.argsort(nearest, kind="stable")
                    for own in np.split(by, np.flatnonzero(np.diff(nearest[by])) + 1):
                        self._meet(who[alive[own]], *vectors[nearest[own[0]]], top, floor, k)
                        scored += len(own) * len(vectors[nearest[own[0]]][0])
        yield pa.record_batch([pa.array([None], pa.int64()), pa.array([-1]), pa.array([None], pa.int64()), pa.array([scored])], ["query_id", "copy", "vec_id", "score"])
        sizes = np.array([len(t) for t in top], np.int64)
        if sizes.any():
            rows, at = np.concatenate(top), np.repeat(np.arange(n), sizes)
            yield pa.record_batch([pa.array(self.ids[at]), pa.array(copy[at]), pa.array(rows[:, 1].copy()), pa.array(rows[:, 0].copy())], ["query_id", "copy", "vec_id", "score"])

    def _meet(self, part: np.ndarray, x_ids: np.ndarray, x: np.ndarray, top: list, floor: np.ndarray, k: int) -> None:
        score = inner(self.q[part], x)
        hit = (score >= floor[part][:, None]) & (x_ids[None, :] != self.ids[part][:, None])
        for j in np.flatnonzero(hit.any(axis=1)).tolist():
            at, where = part[j], np.flatnonzero(hit[j])
            have = np.concatenate([top[at], np.column_stack([score[j, where].astype(np.int64), x_ids[where]])])
            if len(have) > k:
                have = have[np.lexsort((have[:, 1], -have[:, 0]))[:k]]
            top[at] = have
            if len(have) == k:
                floor[at] = max(floor[at], have[:, 0].min())


def _annulus(batch: pa.RecordBatch, i: int, dim: int) -> tuple[np.ndarray, np.ndarray]:
    ids = batch.column("ids")[i].values.to_numpy()
    return ids, np.frombuffer(batch.column("vectors")[i].as_py(), np.float64).reshape(len(ids), dim)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: query_id, rank, vec_id, score; queries are the rows whose vec_id is divisible by 20."""
    vectors = read(spark, sf_dir, "embeddings")
    return PivotIndex(vectors).search(vectors.where("vec_id % 20 = 0").select("vec_id"))


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, x.vec_id, list_inner_product(q.e, x.e)::BIGINT AS score
  FROM v q JOIN v x ON q.vec_id <> x.vec_id WHERE q.vec_id % 20 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20
"""
