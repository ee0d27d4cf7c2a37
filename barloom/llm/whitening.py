"""Whitening of embeddings by the principal components of their covariance, found by spectral divide and conquer.

The polar factor of the covariance less a shift (QDWH: dynamically weighted Halley steps with QR) has eigenvalue 1 above the shift and -1
below, so it gives the projector of each side; the covariance is then parted into the two invariant subspaces, and so on until each
holds one component. Only sums over the rows are made on Spark, exactly, as integers; the dims x dims matrix they give reaches the driver,
and components x dims numbers go to every task.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import batch

COMPONENTS = 8
SCALE, OFFSET = 1024, 100_000
LIMIT = 2**30  # entries beyond it count as it, so that sums of squares stay exact
EPS = float(np.finfo(np.float64).eps)
ROWS = 4096  # vectors handled together


# -- spectral divide and conquer ------------------------------------------------------------------------------------
def polar(a: np.ndarray, steps: int = 30) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix: its eigenvectors, with the signs of its eigenvalues."""
    n = len(a)
    x = a / np.linalg.norm(a)
    low = EPS / np.sqrt(n)  # a lower bound of the singular values, as far as they are told from zero
    for _ in range(steps):
        l2 = low * low
        d = np.cbrt(4 * (1 - l2) / (l2 * l2))
        root = np.sqrt(1 + d)
        wa = root + np.sqrt(8 - 4 * d + 8 * (2 - l2) / (l2 * root)) / 2
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        q, _ = np.linalg.qr(np.concatenate([np.sqrt(wc) * x, np.eye(n)]))
        new = wb / wc * x + (wa - wb / wc) / np.sqrt(wc) * (q[:n] @ q[n:].T)
        new = (new + new.T) / 2
        low = min(1.0, low * (wa + wb * l2) / (1 + wc * l2))
        if np.linalg.norm(new - x) < np.cbrt(EPS) and abs(low - 1) < 10 * EPS:
            return new
        x = new
    return x


def parted(a: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of two invariant subspaces, that of larger eigenvalues first; None if no shift parts `a`.

    The mean of the eigenvalues lies between them. If one of them equals it the projector fails, and other shifts are tried; of
    all tried the one that leaves least between the two sides is taken.
    """
    n, size = len(a), np.linalg.norm(a)
    mean, diagonal = np.trace(a) / n, np.diag(a)
    spread = np.linalg.norm(a - mean * np.eye(n)) / np.sqrt(n)
    best, least = None, np.inf
    random = np.random.default_rng(1).standard_normal((n, n))
    for shift in (mean, np.median(diagonal), *(mean + k * spread / 8 for k in (1, -1, 3, -3, 5, -5))):
        projector = (polar(a - shift * np.eye(n)) + np.eye(n)) / 2
        rank = round(float(np.trace(projector)))
        if not 0 < rank < n:
            continue
        q, _ = np.linalg.qr(projector @ random[:, :rank], mode="complete")
        q, _ = np.linalg.qr(projector @ q[:, :rank], mode="complete")
        left = np.linalg.norm(q[:, rank:].T @ a @ q[:, :rank])
        if left < least:
            best, least = (q[:, :rank], q[:, rank:]), left
        if left <= 8 * EPS * size:
            break
    return best


def leading(a: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The `count` largest eigenvalues of a symmetric matrix, falling, and their unit eigenvectors as columns."""
    size = np.linalg.norm(a)
    values, vectors = [], []
    waiting = [np.eye(len(a))]  # bases still to be parted, those of the smallest eigenvalues first
    while waiting and len(values) < count:
        basis = waiting.pop()
        own = basis.T @ a @ basis
        own = (own + own.T) / 2
        sides = None
        if len(own) > 1 and np.linalg.norm(own - np.trace(own) / len(own) * np.eye(len(own))) > EPS * size:
            sides = parted(own)
        if sides:
            waiting += [basis @ sides[1], basis @ sides[0]]
        else:
            order = np.argsort(-np.diag(own), kind="stable")
            values += np.diag(own)[order].tolist()
            vectors += list(basis.T[order])
    values, vectors = np.array(values), np.array(vectors).reshape(-1, len(a)).T
    # Neighbours that differ by rounding alone may come in either order.
    order = np.argsort(-values, kind="stable")[:count]
    vectors = vectors[:, order] / np.linalg.norm(vectors[:, order], axis=0)
    top = np.abs(vectors).argmax(0)
    return values[order], vectors * np.where(vectors[top, np.arange(len(order))] < 0, -1.0, 1.0)


# -- sums over the rows ---------------------------------------------------------------------------------------------
def vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, v (doubles) of the rows whose vector and all its entries are there and finite."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(F.col("v").isNotNull() & fine)


def _blocks(batches: Iterable[pa.RecordBatch], dims: int) -> Iterable[tuple[pa.RecordBatch, np.ndarray]]:
    """Parts of the batches and x = floor(1024 * entry) + 100000 of their vectors, as a matrix."""
    for b in batches:
        for at in range(0, b.num_rows, ROWS):
            part = b.slice(at, ROWS)
            entries = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, dims)
            yield part, np.clip(np.floor(SCALE * entries) + OFFSET, -LIMIT, LIMIT).astype(np.int64)


def products(c: np.ndarray) -> np.ndarray:
    """The exact sum of the outer products of the rows of integers up to 2^31."""
    most = int(np.abs(c).max(initial=0)) ** 2 * len(c)
    if most < 2**53:
        f = c.astype(np.float64)
        return (f.T @ f).astype(np.int64)
    return c.T @ c if most < 2**63 else products(c[: len(c) // 2]) + products(c[len(c) // 2 :])


def _added(rows: DataFrame, column: str, kind: str) -> list:
    """The arrays in `column` added up place by place on Spark."""
    cells = rows.select(F.posexplode(column).alias("k", "value")).groupBy("k").agg(F.sum(F.col("value").cast(kind)).alias("value"))
    return [r.value for r in cells.orderBy("k").collect()]


@dataclass(frozen=True)
class Whitening:
    n: int
    dims: int
    centre: np.ndarray  # whole numbers near the means of x
    rest: np.ndarray  # exact sums of x - centre, as Python integers
    values: np.ndarray
    components: np.ndarray  # dims x components
    trace: float

    def apply(self, x: np.ndarray) -> np.ndarray:
        away = (x - self.centre).astype(np.float64) - (self.rest / self.n).astype(np.float64)
        return away @ (self.components / np.sqrt(self.values))

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n * x - S)^2 of each row, exact; None beyond a long."""
        c = x - self.centre
        rest = [int(r) for r in self.rest]
        widest = self.n * int(np.abs(c).max(initial=0)) + max(map(abs, rest), default=0)
        if widest * widest * self.dims < 2**63:
            away = self.n * c - np.array(rest, np.int64)
            return (away * away).sum(axis=1).tolist()
        sums = [sum((self.n * v - r) ** 2 for v, r in zip(row, rest, strict=True)) for row in c.tolist()]
        return [s if s < 2**63 else None for s in sums]


def fit(given: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of rows as of `vectors`; None without rows.

    Vectors of another length than the commonest (of those the smallest) are left out. Components with an eigenvalue that
    is zero but for rounding have no whitened value and are left out.
    """
    sizes = given.groupBy(F.size("v").alias("dims")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dims").limit(1).collect()
    if not sizes or not sizes[0].dims:
        return None
    dims, n = sizes[0].dims, sizes[0].n
    rows = given.where(F.size("v") == dims)
    schema = pa.schema([("sums", pa.list_(pa.int64()))])

    def sums(batches):
        total, count = np.zeros(dims, np.int64), 0
        for _, x in _blocks(batches, dims):
            total, count = total + x.sum(axis=0), count + len(x)
            if count > 2**31:
                yield batch(schema, [total.tolist()])
                total, count = np.zeros(dims, np.int64), 0
        yield batch(schema, [total.tolist()])

    totals = [int(v) for v in _added(rows.mapInArrow(sums, "sums array<long>"), "sums", "decimal(38,0)")]
    # Whole numbers are taken off before multiplying, so the products are exact; what is left of the mean is taken off after.
    whole = [(2 * t + n) // (2 * n) for t in totals]
    centre, rest = np.array(whole, np.int64), np.array([t - n * w for t, w in zip(totals, whole, strict=True)], object)

    def grams(batches):
        total, bound = np.zeros((dims, dims), np.int64), 0
        for _, x in _blocks(batches, dims):
            c = x - centre
            for part in np.array_split(c, 1 if int(np.abs(c).max()) ** 2 * len(c) < 2**62 else len(c)):
                most = int(np.abs(part).max()) ** 2 * len(part)
                if bound + most >= 2**63:
                    yield batch(schema, [total.ravel().tolist()])
                    total, bound = np.zeros((dims, dims), np.int64), 0
                total, bound = total + products(part), bound + most
        yield batch(schema, [total.ravel().tolist()])

    gram = np.array([int(v) for v in _added(rows.mapInArrow(grams, "sums array<long>"), "sums", "decimal(38,0)")], object).reshape(dims, dims)
    covariance = ((n * gram - np.outer(rest, rest)) / (n * n)).astype(np.float64)
    trace = float(np.trace(covariance))
    if trace <= 0:
        return Whitening(n, dims, centre, rest, np.zeros(0), np.zeros((dims, 0)), trace)
    values, found = leading(covariance, min(components, dims))
    positive = values > dims * EPS * values[0]
    return Whitening(n, dims, centre, rest, values[positive], found[:, positive], trace)


def identity_error(rows: DataFrame, w: Whitening) -> float:
    """Largest absolute entry of the covariance of the whitened rows less the identity, over all rows."""
    k = len(w.values)
    schema = pa.schema([("sums", pa.list_(pa.float64()))])

    def sums(batches):
        total = np.zeros((k + 1, k))
        for _, x in _blocks(batches, w.dims):
            y = w.apply(x)
            total += np.concatenate([y.T @ y, y.sum(axis=0)[None]])
        yield batch(schema, [total.ravel().tolist()])

    total = np.array(_added(rows.mapInArrow(sums, "sums array<double>"), "sums", "double")).reshape(k + 1, k) / w.n
    return float(np.abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k)).max())


def whitened(given: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The first components of every row, whitened: vec_id, component (from 1), n, deviation, whitened, explained, identity_error.

    Each entry c becomes x = floor(1024 * c) + 100000 (held within 2^30 of zero). n is the number of rows, deviation the sum of (n * x - S)^2
    over the dimensions with S their sums (null beyond a long), whitened x less its mean projected on the component and divided by
    the root of its eigenvalue, explained that eigenvalue's share of the trace, identity_error one number for all rows.

    Rows whose vector is null or empty, or has null or non-finite entries, or another length than the commonest, give no row; components without
    variance give none, so equal vectors alone or an empty table give no rows. A null vec_id stays null; repeated rows count as often as
    they stand and give repeated rows. No other column is read.
    """
    rows = vectors(given, id_col, vector_col)
    spark = given.sparkSession
    out = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    w = fit(rows, components)
    if w is None or not len(w.values):
        return spark.createDataFrame([], out)
    rows = rows.where(F.size("v") == w.dims)
    k, error, share = len(w.values), identity_error(rows, w), w.values / w.trace
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
    schema = pa.schema(list(zip([c.split()[0] for c in out.split(", ")], kinds, strict=True)))

    def run(batches):
        for b, x in _blocks(batches, w.dims):
            each = np.repeat(np.arange(len(x)), k)
            yield batch(schema, b.column(0).take(pa.array(each)), np.tile(np.arange(1, k + 1, dtype=np.int32), len(x)), np.full(len(each), w.n),
                        pa.array(w.deviations(x), pa.int64()).take(pa.array(each)), w.apply(x).ravel(), np.tile(share, len(x)), np.full(len(each), error))

    return rows.mapInArrow(run, out)
