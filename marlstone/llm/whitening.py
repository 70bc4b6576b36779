"""Whitening of embeddings: Welford updates, the parallel update formula, a symmetric QR eigen-solve.

Entries become integers x = floor(64 c) + 1000000, and the fit list has each distinct vector of them once.
1. Every task runs through its part of the fit list and updates count, mean and sum of products by a rank-one term a vector;
   sums of x are kept exactly beside them.
2. The tasks' moments are merged by the parallel update formula, FAN at a time, until there is one of each vector length.
3. One task a length reduces the covariance to tridiagonal form by Householder reflections and diagonalises that by implicit
   QR steps with Wilkinson shifts.
4. A second run through the fit list takes the covariance of the whitened vectors in the same way, for identity_error.
5. Rows are centred exactly, projected on up to COMPONENTS eigenvectors and divided by the roots of the eigenvalues.

What tasks and driver hold grows with the square of a vector's length and with the number of different lengths, not with rows.

Defined results: rows whose vector is null, empty, or holds null or non-finite entries or such of 2^56 or more, which no long
holds, are left out; vectors of each length have a fit list of their own; equal rows give equal results, one set a row; rows of
null vec_id are rows like others. Where a component has no variance (an eigenvalue under 1e-12 of their sum), whitened is null,
and identity_error leaves it out; explained is null where all vectors are one. deviation is null where it exceeds 64 bits. An
empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from decimal import Decimal
from math import hypot, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from marlstone.llm.common import bound_batches, fields, table, written

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 16
#: Moments that one merge takes together.
FAN = 8
#: Share of all variance below which a component has none.
NONE = 1e-12

MOMENTS = fields("size int, source int, n long, sums decimal[], mean double[], products double[]")


class Moments:
    """Count, exact sums, mean and centred products of vectors seen so far."""

    def __init__(self, size: int) -> None:
        self.n, self.sums = 0, [0] * size
        self.mean, self.products = np.zeros(size), np.zeros((size, size))

    def add(self, rows: np.ndarray) -> None:
        """Rank-one updates, a row at a time."""
        for row in rows:
            self.n += 1
            away = row - self.mean
            self.mean += away / self.n
            self.products += np.multiply.outer(away, away * ((self.n - 1) / self.n))

    def merge(self, other: Moments) -> Moments:
        """The parallel update formula."""
        n = self.n + other.n
        if n:
            away = other.mean - self.mean
            self.products += other.products + np.multiply.outer(away, away * (self.n * other.n / n))
            self.mean += away * (other.n / n)
        self.n, self.sums = n, [a + b for a, b in zip(self.sums, other.sums, strict=True)]
        return self

    def row(self, size: int, source: int) -> dict:
        """A row of the schema MOMENTS."""
        return {"size": size, "source": source, "n": self.n, "sums": [Decimal(s) for s in self.sums], "mean": self.mean.tolist(), "products": self.products.ravel().tolist()}

    @staticmethod
    def of(row) -> Moments:
        m = Moments(0)
        m.n, m.sums, m.mean = int(row.n), [int(s) for s in row.sums], np.array(row.mean, float)
        m.products = np.array(row.products, float).reshape(len(m.mean), len(m.mean))
        return m


def exact_sums(x: np.ndarray) -> list[int]:
    """Column sums of 64-bit integers, by halves that cannot overflow."""
    high, low = (x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0)
    return [(int(h) << 32) + int(w) for h, w in zip(high, low, strict=True)]


def _tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, subdiagonal and the rows of an orthogonal matrix that takes the symmetric `a` to them."""
    a, n = a.copy(), len(a)
    turned = np.eye(n)
    for k in range(n - 2):
        v = a[k + 1 :, k].copy()
        length = np.sqrt(v @ v)
        if length == 0 or not v[1:].any():
            continue
        v[0] += length if v[0] >= 0 else -length
        v /= np.sqrt(v @ v)
        rest = a[k + 1 :, k + 1 :]
        p = rest @ v
        w = p - v * (v @ p)
        rest -= 2 * (np.multiply.outer(v, w) + np.multiply.outer(w, v))
        side = a[k + 1 :, k] - 2 * v * (v @ a[k + 1 :, k])
        a[k + 1 :, k] = a[k, k + 1 :] = side
        below = turned[k + 1 :]
        below -= 2 * np.multiply.outer(v, v @ below)
    return np.diag(a).copy(), np.diag(a, -1).copy(), turned


def symmetric_qr(a: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a symmetric matrix, falling, and unit eigenvectors as rows."""
    d, e, vectors = _tridiagonal(np.asarray(a, float))
    high = len(d) - 1
    steps = 0
    while high > 0:
        small = np.abs(e[:high]) <= np.finfo(float).eps * (np.abs(d[:high]) + np.abs(d[1 : high + 1]))
        e[:high][small] = 0.0
        if e[high - 1] == 0:
            high -= 1
            steps = 0
            continue
        low = high - 1
        while low > 0 and e[low - 1] != 0:
            low -= 1
        steps += 1
        if steps > sweeps:
            raise ArithmeticError("the QR steps did not settle")
        half = (d[high - 1] - d[high]) / 2
        shift = d[high] - e[high - 1] ** 2 / (half + (1 if half >= 0 else -1) * hypot(half, e[high - 1]))
        x, z = d[low] - shift, e[low]
        for k in range(low, high):  # a bulge is chased down the block
            r = hypot(x, z)
            c, s = (x / r, z / r) if r else (1.0, 0.0)
            if k > low:
                e[k - 1] = r
            p, q, off = d[k], d[k + 1], e[k]
            d[k] = c * c * p + 2 * c * s * off + s * s * q
            d[k + 1] = s * s * p - 2 * c * s * off + c * c * q
            e[k] = c * s * (q - p) + (c * c - s * s) * off
            if k + 1 < high:
                x, z = e[k], s * e[k + 1]
                e[k + 1] *= c
            vectors[k], vectors[k + 1] = c * vectors[k] + s * vectors[k + 1], c * vectors[k + 1] - s * vectors[k]
    order = np.argsort(-d, kind="stable")
    return d[order], vectors[order]


def integers(vectors: DataFrame) -> DataFrame:
    """(vec_id, size, x) of the rows that count."""
    values = F.col("embedding").cast("array<double>")
    fits = F.forall(values, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float(1 << 56)))
    rows = vectors.where(F.coalesce((F.size(values) > 0) & fits, F.lit(False)))
    return rows.select("vec_id", F.size("embedding").alias("size"), F.transform(values, lambda c: F.floor(c * SCALE) + OFFSET).alias("x"))


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
    """(length, rows, x as a matrix) for each vector length of a batch."""
    size = batch.column("size").to_numpy()
    for own in np.unique(size).tolist():
        part = batch.filter(pa.array(size == own))
        yield own, part, part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, own)


def _moments(fit: DataFrame, models: dict[int, Model] | None = None) -> DataFrame:
    """Moments of each task and vector length: of x less OFFSET, or of the whitened vectors."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Moments] = {}
        for batch in batches:
            for own, _, x in _blocks(batch):
                rows = (x - OFFSET).astype(float) if models is None else models[own].whitened(x)
                m = held.setdefault(own, Moments(rows.shape[1]))
                m.add(rows)
                if models is None:
                    m.sums = [a + b for a, b in zip(m.sums, exact_sums(x), strict=True)]
        source = TaskContext.get().partitionId()
        if held:
            yield pa.RecordBatch.from_pylist([m.row(own, source) for own, m in held.items()], schema=schema)

    schema = to_arrow_schema(MOMENTS)
    return fit.mapInArrow(run, MOMENTS)


def merged(moments: DataFrame) -> DataFrame:
    """One row a vector length: rows of neighbouring sources are merged, FAN at a time."""

    def together(frame: pd.DataFrame) -> pd.DataFrame:
        rows = list(frame.sort_values("source").itertuples())
        total = Moments.of(rows[0])
        for r in rows[1:]:
            total.merge(Moments.of(r))
        return pd.DataFrame([total.row(int(rows[0].size), int(rows[0].source) // FAN)])

    last = moments.agg(F.max("source")).first()[0] or 0
    while last > 0:
        moments = moments.groupBy("size", F.floor(F.col("source") / FAN).alias("_next")).applyInPandas(together, MOMENTS)
        last //= FAN
    return moments


class Model:
    """Centre and components of the vectors of one length."""

    def __init__(self, row) -> None:
        self.n, self.sums = row.n, [int(s) for s in row.sums]
        self.share = np.array(row.share, float)
        self.live = np.array(row.live, bool)
        root = np.sqrt(np.where(self.live, row.variances, 1.0))
        self.axes = np.array(row.axes, float).reshape(len(root), -1) / root[:, None]

    def away(self, x: np.ndarray) -> np.ndarray:
        """n x - S, exactly: as 64-bit integers where those hold it, else as Python's."""
        rest = [s - self.n * OFFSET for s in self.sums]
        most = max(abs(int(x.max(initial=0)) - OFFSET), abs(int(x.min(initial=0)) - OFFSET))
        if self.n * most + max(map(abs, rest)) < 1 << 62:
            return self.n * (x - OFFSET) - np.array(rest, np.int64)
        return self.n * (x.astype(object) - OFFSET) - np.array(rest, object)

    def projected(self, away: np.ndarray) -> np.ndarray:
        return (away / self.n).astype(float) @ self.axes.T

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """The components that have variance."""
        return self.projected(self.away(x))[:, self.live]


MODEL = fields("size int, n long, sums decimal[], variances double[], share double[], live boolean[], axes double[]")


def components(moments: DataFrame, most: int = COMPONENTS) -> DataFrame:
    """A row of MODEL for each row of moments."""

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples():
                m = Moments.of(r)
                values, axes = symmetric_qr(m.products / m.n)
                total = float(np.trace(m.products / m.n))
                top = values[:most]
                share = (top / total).tolist() if total > 0 else [None] * len(top)
                live = (top > NONE * total) if total > 0 else np.zeros(len(top), bool)
                yield pd.DataFrame([{"size": r.size, "n": m.n, "sums": list(r.sums), "variances": top.tolist(), "share": share, "live": live.tolist(), "axes": axes[:most].ravel().tolist()}])

    return moments.mapInPandas(solve, MODEL)


WHITE = fields("component int, n long, deviation long, whitened double, explained double, identity_error double")


def whiten(vectors: DataFrame, most: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error of every row that counts."""
    rows = integers(vectors)
    fit = written(rows.select("size", "x").distinct(), "fit-list")
    models = {r["size"]: Model(r) for r in components(merged(written(_moments(fit), "moments")), most).collect()}  # 17 vectors a length
    errors = {}
    for r in merged(written(_moments(fit, models), "white-moments")).collect():  # 16 x 16 a length
        m = Moments.of(r)
        if len(m.mean):
            errors[r["size"]] = float(np.abs(m.products / m.n - np.eye(len(m.mean))).max())
    full = T.StructType([rows.schema["vec_id"], *WHITE])
    schema = to_arrow_schema(full)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, part, x in _blocks(batch):
                model = models[own]
                away = model.away(x)
                k = len(model.live)
                spread = np.abs(away).max(initial=0)
                if int(spread) ** 2 * own < 1 << 63:
                    deviation = pa.array((away.astype(np.int64) ** 2).sum(1))
                else:
                    deviation = pa.array([v if v < 1 << 63 else None for v in (sum(int(c) ** 2 for c in row) for row in away)], pa.int64())
                at = np.repeat(np.arange(len(x)), k)
                white = model.projected(away)
                none = np.broadcast_to(~model.live, white.shape).ravel()
                columns = [part.column("vec_id").take(pa.array(at)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(at), model.n))]
                columns += [deviation.take(pa.array(at)), pa.array(white.ravel(), mask=none), pa.array(np.tile(model.share, len(x)), from_pandas=True), pa.array([errors.get(own)] * len(at), pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return rows.mapInArrow(run, full)


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return whiten(table(spark, sf_dir, "embeddings"))
