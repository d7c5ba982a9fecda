"""Embedding whitening by a tall-skinny QR: principal directions without a covariance matrix.

Every component c of a vector becomes the whole number x = floor(64 c) + 1000000. Directions are fitted on the fit list, each distinct x vector
once, and applied to all rows.

1. The fit list is one distinct, written to the shared folder; its length n and the sums S are exact: whole numbers are summed within
   tasks and then as decimals by dimension.
2. Rows are centred with these sums, (n x - S) / n, one rounding each. A task folds its rows into one triangular factor R, chunk by chunk.
3. R factors, one of d x d doubles for a task, are merged ``FAN`` at a time by a QR of the stack, level by level, each level a table,
   so that a lost executor repeats one merge.
4. The singular values s and right vectors of the last R are those of all centred rows: variances are s^2 / n, and the right vectors scaled by
   1 / sqrt(variance) whiten. Squaring the data, which would cost half of all digits, never happens.
5. The whitened fit list goes through the same QR tree; its R, 16 x 16, gives the distance of the whitened covariance from the identity.

A vector that is null, or holds a null, NaN or infinite entry, has no rows; nor has one with an entry whose 64-fold exceeds ``LIMIT``, which is no
exact whole number. Shorter vectors count as padded with zeros (an empty one is all zeros). Rows of one vec_id, or of none, are rows apart and
keep their ids. A direction without variance (all rows equal, or fewer rows than dimensions) has a null whitened value;
explained is null where nothing varies. A deviation beyond 64 bits is held at the largest long. An empty table gives no rows. Extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.llm.common import discard, materialize, read

SCALE, SHIFT, COMPONENTS, FAN, LIMIT = 64, 1_000_000, 16, 16, 2.0**52
#: Rows that a task folds into its factor at once.
CHUNK = 2048
#: A direction whose singular value is below this part of the largest has no variance but rounding.
FLAT = 1e-12
LARGEST = np.iinfo(np.int64).max


def whole(vectors: DataFrame, id_col: str, vector_col: str, scale: int, shift: int) -> DataFrame:
    """(vec_id, x array<long>) of every vector that takes part."""
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    v = v.where(f"v is not null and not exists(v, c -> c is null or isnan(c) or abs(c * {float(scale)!r}D) > {LIMIT!r}D)")
    return v.select("vec_id", F.transform("v", lambda c: F.floor(c * F.lit(float(scale))).cast("long") + F.lit(shift)).alias("x"))


def longs(column: pa.Array, dim: int, pad: int) -> np.ndarray:
    """Rows of whole numbers, padded to dim."""
    sizes = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy()
    if (sizes == dim).all():
        return values.reshape(-1, dim)
    out = np.full((len(sizes), dim), pad, np.int64)
    at = np.repeat(np.arange(len(sizes)), sizes)
    out[at, np.arange(len(at)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S, exactly: longs, or unbounded integers where longs could overflow."""
    most = max(int(np.abs(x).max(initial=0)) * n, max(map(abs, sums), default=0))
    if most < LARGEST // 2:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def deviation(y: np.ndarray) -> np.ndarray:
    """Sums of squares of whole rows, held at the largest long."""
    if y.dtype != object and int(np.abs(y).max(initial=0)) ** 2 * max(1, y.shape[1]) <= LARGEST:
        return (y * y).sum(axis=1)
    return np.array([min(LARGEST, sum(int(v) ** 2 for v in row)) for row in y], np.int64)


def fold(r: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The triangular factor of r's rows and more."""
    return np.linalg.qr(np.vstack([r, rows]), mode="r")


def tsqr(rows: DataFrame, dim: int, values: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """R, at most dim x dim, of all rows: one factor for each task, merged in a tree."""

    def leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, dim))
        for batch in batches:
            for a in range(0, batch.num_rows, CHUNK):
                r = fold(r, values(batch.slice(a, CHUNK)))
        yield pa.record_batch([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([r.tobytes()])], ["part", "r"])

    def merge(table: pa.Table) -> pa.Table:
        r = np.zeros((0, dim))
        for part, blob in sorted(zip(table["part"].to_pylist(), table["r"].to_pylist(), strict=True)):
            r = fold(r, np.frombuffer(blob).reshape(-1, dim))
        return pa.table({"part": [part // FAN], "r": [r.tobytes()]})

    level = materialize(rows.mapInArrow(leaf, "part long, r binary"), "factors")
    while level.count() > 1:
        above = materialize(level.groupBy(F.floor(F.col("part") / FAN)).applyInArrow(merge, "part long, r binary"), "factors")
        discard(level)
        level = above
    last = level.first()
    discard(level)
    return np.frombuffer(last.r).reshape(-1, dim) if last else np.zeros((0, dim))


class Whitening:
    """Fitted on a table of vectors: n, dim, sums (exact), directions (dim x components, unit columns), variances, explained and
    identity_error, the largest absolute entry of the whitened fit list's covariance less the identity."""

    def __init__(self, vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT):
        self.rows = whole(vectors, id_col, vector_col, scale, shift)
        self.spark, self.shift = vectors.sparkSession, shift
        self.dim = int(self.rows.agg(F.coalesce(F.max(F.size("x")), F.lit(0))).first()[0])
        padded = F.concat("x", F.array_repeat(F.lit(shift).cast("long"), F.lit(self.dim) - F.size("x")))
        fit = materialize(self.rows.select(padded.alias("x")).distinct(), "fit-list")
        self.n = fit.count()
        self.sums = self._sums(fit)
        dim, n, sums, pad = self.dim, self.n, self.sums, shift
        r = tsqr(fit, dim, lambda b: centred(longs(b.column("x"), dim, pad), n, sums).astype(np.float64) / n) if n and dim else np.zeros((0, dim))
        _, s, right = np.linalg.svd(r, full_matrices=False) if r.size else (None, np.zeros(0), np.zeros((0, dim)))
        s, right = np.r_[s, np.zeros(dim - len(s))], np.vstack([right, np.zeros((dim - len(right), dim))])
        self.components = min(components, dim)
        total = float((s * s).sum())
        self.varies = (s > FLAT * s.max(initial=0)) & (s > 0)
        self.variances = (s * s / max(1, n))[: self.components]
        self.explained = (s * s / total if total else np.full(dim, np.nan))[: self.components]
        self.directions = right[: self.components].T.copy()
        self.varies = self.varies[: self.components]
        self.identity_error = self._identity_error(fit)
        discard(fit)

    def _sums(self, fit: DataFrame) -> list[int]:
        dim, pad = self.dim, self.shift

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = [0] * dim
            for batch in batches:
                x = longs(batch.column("x"), dim, pad)
                part = x.sum(axis=0) if int(np.abs(x).max(initial=0)) * len(x) <= LARGEST else x.astype(object).sum(axis=0)
                total = [a + int(b) for a, b in zip(total, part, strict=True)]
            yield pa.record_batch([pa.array([[str(t) for t in total]], pa.list_(pa.string()))], ["s"])

        rows = fit.mapInArrow(add, "s array<string>").select(F.posexplode("s").alias("pos", "s")).groupBy("pos").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
        out = [0] * dim
        for row in rows:  # one for each dimension
            out[row.pos] = int(row.s)
        return out

    def _project(self, y: np.ndarray) -> np.ndarray:
        """Whitened values of centred whole rows, along directions that vary."""
        return y.astype(np.float64) / max(1, self.n) @ (self.directions[:, self.varies] / np.sqrt(self.variances[self.varies]))

    def _identity_error(self, fit: DataFrame) -> float | None:
        width = int(self.varies.sum())
        if not width:
            return None
        own = self._portable()
        r = tsqr(fit, width, lambda b: own._project(centred(longs(b.column("x"), own.dim, own.shift), own.n, own.sums)))
        return float(np.abs(r.T @ r / self.n - np.eye(width)).max())

    def _portable(self) -> Whitening:
        """Without what lives on the driver alone."""
        own = object.__new__(Whitening)
        own.__dict__ = {k: v for k, v in self.__dict__.items() if k not in ("rows", "spark")}
        return own

    def transform(self) -> DataFrame:
        """(vec_id, component, n, deviation, whitened, explained, identity_error) of every row that takes part."""
        shared = self.spark.sparkContext.broadcast(self._portable())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = shared.value
            c = own.components
            for batch in batches:
                for a in range(0, batch.num_rows, CHUNK):
                    part = batch.slice(a, CHUNK)
                    y = centred(longs(part.column("x"), own.dim, own.shift), own.n, own.sums)
                    white = np.full((len(y), c), np.nan)
                    white[:, own.varies] = own._project(y)
                    each = np.repeat(np.arange(len(y)), c)
                    component = np.tile(np.arange(1, c + 1, dtype=np.int32), len(y))
                    explained = np.tile(own.explained, len(y))
                    yield pa.record_batch([
                        part.column("vec_id").take(pa.array(each)), pa.array(component), pa.array(np.full(len(each), own.n)), pa.array(deviation(y)[each]),
                        pa.array(white.ravel(), pa.float64(), from_pandas=True), pa.array(explained, pa.float64(), from_pandas=True), pa.array([own.identity_error] * len(each), pa.float64()),
                    ], ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

        return self.rows.mapInArrow(run, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: vec_id, component, n, deviation, whitened, explained, identity_error."""
    return Whitening(read(spark, sf_dir, "embeddings")).transform()
