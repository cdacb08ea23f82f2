"""Whitening of embeddings by FEAST contour integration.

Spark adds up the moments of all vectors; what comes to the driver is one dimensions x dimensions matrix,
whatever the number of rows. There the leading eigenpairs of the covariance are found by contour
integration: the spectrum is cut into intervals that hold a few eigenvalues each by inertia counts (signs
of the pivots of the shifted tridiagonal form), and for each interval

    Q = sum over nodes z of a quadrature on the circle through its ends of w * (z I - V)^-1 Y

is close to the projection of a random block ``Y`` on the interval's eigenvectors. Rayleigh-Ritz on ``Q``
gives eigenpairs; the block is filtered again until the residuals are at rounding level. The pairs found in
an interval must be as many as the inertia says, or the block grows and the interval is done again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, written
from .registry import query

COMPONENTS = 8
SCALE, SHIFT = 1024, 100_000
LARGEST = 2 ** 60
NODES = 8  # on the upper half of the circle
A_GROUP = 4  # eigenvalues an interval is meant to hold
ROUNDS = 30
LEAST_SHARE = 1e-13  # smaller shares of the variance are rounding


# ---------------------------------------------------------------- eigenpairs

def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and lower diagonal of an orthogonally similar tridiagonal matrix, by reflections."""
    a = a.copy()
    n = len(a)
    for k in range(n - 2):
        v = a[k + 1:, k].copy()
        size = np.linalg.norm(v)
        if size == 0:
            continue
        v[0] += np.copysign(size, v[0])
        v /= np.linalg.norm(v)
        p = a[k + 1:, k + 1:] @ v
        p -= v * (v @ p)
        a[k + 1:, k + 1:] -= 2 * (np.outer(v, p) + np.outer(p, v))
        a[k + 1:, k] -= 2 * v * (v @ a[k + 1:, k])
    return np.diag(a).copy(), np.diag(a, -1).copy()


def count_above(diagonal: np.ndarray, beside: np.ndarray, at: float) -> int:
    """Eigenvalues above ``at``: positive pivots of the shifted tridiagonal matrix (inertia)."""
    n, pivot = 0, 1.0
    tiny = np.finfo(float).tiny / np.finfo(float).eps
    squares = np.append(0.0, beside * beside).tolist()
    for d, s in zip(diagonal.tolist(), squares):
        pivot = d - at - s / pivot
        if abs(pivot) < tiny:
            pivot = -tiny
        n += pivot > 0
    return n


def edge(diagonal: np.ndarray, beside: np.ndarray, a: float, b: float, n: int) -> float:
    """Where the number of eigenvalues above falls to ``n`` on the way from ``a`` to ``b``."""
    for _ in range(60):
        mid = (a + b) / 2
        a, b = (mid, b) if count_above(diagonal, beside, mid) > n else (a, mid)
    return b


def intervals(diagonal: np.ndarray, beside: np.ndarray, wanted: int, group: int = A_GROUP) -> list[tuple[float, float, int]]:
    """Intervals (low, high, eigenvalues inside) that cover the ``wanted`` largest eigenvalues, from the top.

    Ends lie in gaps of the spectrum where bisection finds one; a cluster closer than rounding stays whole.
    """
    wide = np.abs(np.append(beside, 0)) + np.abs(np.append(0, beside))
    low, high = float((diagonal - wide).min()), float((diagonal + wide).max())
    room = max(high - low, abs(high), np.finfo(float).tiny)
    top, out, above = high + 1e-3 * room, [], 0
    while above < wanted:
        goal = min(above + group, len(diagonal))
        a, b = low - 1e-3 * room, top  # more than `above` eigenvalues above a, `above` above b
        best = (a, count_above(diagonal, beside, a))
        for _ in range(200):
            mid = (a + b) / 2
            if not a < mid < b or b - a < 4e-15 * room:  # a cluster of more than the group
                best = (a - 1e-11 * room, count_above(diagonal, beside, a - 1e-11 * room))
                break
            n = count_above(diagonal, beside, mid)
            if above < n <= best[1]:
                best = (mid, n)
            if n > goal:
                a = mid
            elif n == above:
                b = mid
            else:
                break
        cut, n = best
        if n < len(diagonal):  # to the middle of the gap it lies in
            below = edge(diagonal, beside, low - 1e-3 * room, cut, n)
            over = edge(diagonal, beside, cut, top, n - 1)
            cut = (below + over) / 2 if below < (below + over) / 2 < over else cut
        out.append((cut, top, n - above))
        top, above = cut, n
    return out


def feast(v: np.ndarray, low: float, high: float, held: int, extra: int, rng: np.random.Generator, nodes: int = NODES) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues in (low, high] and their eigenvectors by filtered subspace iteration."""
    n = len(v)
    angles, weights = np.polynomial.legendre.leggauss(nodes)
    angles = np.pi / 2 * (angles + 1)  # upper half of the circle; the lower half is its conjugate
    middle, radius = (low + high) / 2, (high - low) / 2
    y = rng.standard_normal((n, min(n, held + extra)))
    size = np.linalg.norm(v, ord=np.inf) or 1.0
    values, vectors = np.empty(0), np.empty((n, 0))
    last = np.inf
    for _ in range(ROUNDS):
        q = np.zeros_like(y)
        for t, w in zip(angles, weights):
            z = middle + radius * np.exp(1j * t)
            q += w / 2 * np.real(radius * np.exp(1j * t) * np.linalg.solve(z * np.eye(n) - v, y.astype(complex)))
        basis, _ = np.linalg.qr(q)
        ritz, turn = np.linalg.eigh(basis.T @ v @ basis)
        y = basis @ turn
        hit = (ritz > low) & (ritz <= high)
        values, vectors = ritz[hit], y[:, hit]
        worst = np.linalg.norm(v @ vectors - vectors * values, axis=0).max(initial=0.0)
        if len(values) == held and (worst <= 4e-16 * size or worst >= last / 2 and worst <= 1e-13 * size):
            break
        last = worst
    return values, vectors


def top_eigenpairs(v: np.ndarray, wanted: int = COMPONENTS, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues, falling, and unit eigenvectors as columns; fewer if there are fewer."""
    rng = np.random.default_rng(seed)
    wanted = min(wanted, len(v))
    if not wanted or not np.any(v):
        return np.zeros(wanted), np.eye(len(v))[:, :wanted]
    scale = np.abs(v).max()
    scaled = v / scale
    vectors = []
    diagonal, beside = tridiagonal(scaled)
    for low, high, held in intervals(diagonal, beside, wanted):
        for extra in (4, 8, 16, len(v)):
            e, x = feast(scaled, low, high, held, extra, rng)
            if len(e) == held:
                break
        else:
            raise ArithmeticError(f"{len(e)} of {held} eigenvalues found between {low * scale} and {high * scale}")
        vectors.append(x)
    # one Rayleigh-Ritz step over all intervals: vectors of close neighbours become orthogonal
    x, _ = np.linalg.qr(np.concatenate(vectors, axis=1))
    e, turn = np.linalg.eigh(x.T @ scaled @ x)
    return e[::-1][:wanted] * scale, (x @ turn)[:, ::-1][:, :wanted]


# ---------------------------------------------------------------- moments

def whole_rows(vectors: DataFrame) -> DataFrame:
    """vec_id and the scaled vector of every row whose vector is not empty and has only finite entries."""
    def scale(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("embedding")
            size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            values = lists.flatten().to_numpy(zero_copy_only=False).astype(float)  # null entries become NaN
            owner = np.repeat(np.arange(len(size)), size)
            kept = (size > 0) & (np.bincount(owner[~np.isfinite(values)], minlength=len(size)) == 0)
            x = np.clip(np.floor(values[kept[owner]] * SCALE), -LARGEST, LARGEST).astype(np.int64) + SHIFT
            ends = np.append(0, np.cumsum(size[kept])).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").filter(pa.array(kept)), pa.ListArray.from_arrays(pa.array(ends), pa.array(x))], ["vec_id", "x"])

    return (vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
            .mapInArrow(scale, "vec_id long, x array<long>"))


def matrix(batch: pa.RecordBatch, column: str) -> np.ndarray:
    """The vectors of a batch as rows; all have the same length."""
    values = batch.column(column)
    return values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1)


def sums(rows: DataFrame, column: str, dims: int) -> tuple[int, list]:
    """Number of rows and sum per dimension, as exact integers for integer columns; added up per task first."""
    exact = rows.schema[column].dataType.elementType.typeName() == "long"

    def add(batches):
        n, total = 0, np.zeros(dims, object if exact else float)
        for batch in batches:
            m = matrix(batch, column)
            if len(m):
                n += len(m)
                total += m.sum(axis=0) if np.abs(m).max() < 2 ** 48 else m.astype(object).sum(axis=0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([[str(int(t)) if exact else repr(float(t)) for t in total]], pa.list_(pa.string()))], ["n", "total"])

    kind = "decimal(38,0)" if exact else "double"
    parts = rows.select(column).mapInArrow(add, "n long, total array<string>")
    per = (parts.select("n", F.posexplode("total")).groupBy("pos").agg(F.sum("n").alias("n"), F.sum(F.col("col").cast(kind)).alias("total"))
           .collect())  # one row per dimension
    out = [0] * dims
    for r in per:
        out[r["pos"]] = int(r["total"]) if exact else r["total"]
    return (per[0]["n"] if per else 0), out


def scatter(rows: DataFrame, column: str, centre: np.ndarray) -> np.ndarray:
    """Sum over rows of the outer product of (row - centre); one row per matrix row comes to the driver."""
    dims = len(centre)

    def add(batches):
        total = np.zeros((dims, dims))
        seen = False
        for batch in batches:
            m = matrix(batch, column)
            if len(m):
                y = (m - centre).astype(float)
                total += y.T @ y
                seen = True
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], ["i", "row"])

    parts = rows.select(column).mapInArrow(add, "i int, row array<double>")
    added = (parts.select("i", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"))
             .groupBy("i").agg(F.array_sort(F.collect_list(F.struct("j", "v"))).alias("row")))
    out = np.zeros((dims, dims))
    for r in added.collect():
        out[r["i"]] = [c["v"] for c in r["row"]]
    return (out + out.T) / 2


def covariance(rows: DataFrame, column: str, n: int, total: list) -> np.ndarray:
    """Covariance with divisor n. Integers are centred at the whole number next to the mean, so that products are
    exact until their sum passes 2^53, and the rest of the mean, at most a half, is taken off afterwards."""
    if isinstance(total[0], int):
        centre = np.array([(2 * t + n) // (2 * n) for t in total], np.int64)
        rest = np.array([(t - n * int(c)) / n for t, c in zip(total, centre)])
    else:
        centre, rest = np.array(total) / n, np.zeros(len(total))
    return scatter(rows, column, centre) / n - np.outer(rest, rest)


# ---------------------------------------------------------------- whitening

def deviations(m: np.ndarray, n: int, total: list) -> list:
    """Sum over dimensions of (n x - S)^2 for each row, exact; None where it does not fit a long."""
    centre = np.array([t // n for t in total], np.int64)
    most = int(np.abs(m - centre).max(initial=0)) + 1
    if (most * n) ** 2 * len(total) < 2 ** 63:
        d = (m - centre) * n - np.array([t - n * int(c) for t, c in zip(total, centre)], np.int64)
        return (d * d).sum(axis=1).tolist()
    out = (sum((n * x - t) ** 2 for x, t in zip(row, total)) for row in m.tolist())
    return [d if d < 2 ** 63 else None for d in out]


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row per vector and component.

    ``vectors`` has vec_id and embedding. Rows whose vector is null, empty or has null or non-finite entries
    are dropped, and so are those whose length is not the most common one (of ties the larger). Rows that
    repeat a vec_id each count and each come out; a null vec_id stays null. Components without variance (fewer
    vectors or dimensions than components, constant vectors) give no rows, and so does an empty table. Scaled
    entries beyond 2^60 count as 2^60. A deviation beyond a long is null. Other columns are ignored.
    """
    spark = vectors.sparkSession
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = written(whole_rows(vectors), "vectors")
    common = rows.groupBy(F.size("x").alias("dims")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dims")).first()
    if common is None:
        return spark.createDataFrame([], schema)
    dims = common["dims"]
    rows = rows.filter(F.size("x") == dims)
    n, total = sums(rows, "x", dims)
    v = covariance(rows, "x", n, total)
    trace = float(np.trace(v))
    values, axes = top_eigenpairs(v, components)
    kept = int((values > LEAST_SHARE * trace).sum()) if trace > 0 else 0
    if not kept:
        return spark.createDataFrame([], schema)
    values, axes = values[:kept], axes[:, :kept]
    centre = [t // n for t in total]
    rest = np.array([(t - n * c) / n for t, c in zip(total, centre)])
    projection = axes / np.sqrt(values)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = np.array(centre, np.int64)
        for batch in batches:
            m = matrix(batch, "x")
            w = ((m - whole) - rest) @ projection
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(deviations(m, n, total), pa.int64()),
                 pa.ListArray.from_arrays(pa.array(np.arange(0, w.size + 1, kept), pa.int32()), pa.array(w.reshape(-1)))],
                ["vec_id", "deviation", "w"])

    white = written(rows.mapInArrow(project, "vec_id long, deviation long, w array<double>"), "whitened")
    error = float(np.abs(covariance(white, "w", *sums(white, "w", kept)) - np.eye(kept)).max())
    share = F.array(*(F.lit(float(e / trace)) for e in values))
    return (white.select("vec_id", "deviation", F.posexplode("w").alias("_at", "whitened"))
            .select("vec_id", (F.col("_at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
                    F.get(share, F.col("_at")).alias("explained"), F.lit(error).alias("identity_error")))


@query()
def op11_feast_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(read(spark, sf_dir, "embeddings"))
