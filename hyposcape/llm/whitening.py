"""Whitening of embeddings: eigenvectors of an exact distributed covariance, refined from single precision by matrix products.

Integers. An entry c becomes x = floor(256 c). The fit list holds every distinct x vector once (one shuffle of the packed vectors,
duplicates are dropped before it). Per-dimension sums S are exact. For the covariance the list is centred on the integers next to its
means, the products are summed exactly as integers (16-bit limbs, blocks of rows whose BLAS sums stay below 2**53), and the rest of the mean is
taken off as a fraction: V is known exactly and does not depend on partitions or reruns. A task returns d^2 numbers, whatever its rows.

Eigenvectors. ``numpy`` solves V in float32. Ogita-Aishima steps then correct all vectors at once, with matrix products only: with
R = I - X'X and S = X'VX the eigenvalues are S_ii / (1 - R_ii) and X moves by X E, E_ij = (S_ij + l_j R_ij) / (l_j - l_i); convergence
is quadratic. First in double, then (up to EXTENDED dimensions, as these products do not use BLAS) in extended precision. Where eigenvalues lie closer than the error of S, E is not defined; such
a cluster gets E = R / 2, which only keeps it orthogonal, and its basis is found by a sub-solve of the cluster's own small matrix, shifted by its centre so that
the differences are not lost. Equal eigenvalues stay one cluster; any orthonormal basis of it is right.

Defined cases: null and empty vectors and those with null or non-finite entries get no row, nor do vectors of another length than the
most frequent one (ties: the longer). Repeated rows and ids each get their rows; a null vec_id is kept. x is held at +-2**30. Fewer than
four dimensions give fewer components. An eigenvalue that is zero up to rounding (a constant or dependent dimension, one distinct
vector) gives a null ``whitened`` and does not enter ``identity_error``; ``explained`` is null if no dimension varies. ``deviation`` beyond 64
bits is null. ``identity_error`` is null if no component varies. An empty table gives an empty result. Extra columns are unread.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, vectors
from .vectors import floored

SCALE, LIMIT, COMPONENTS = 256, 1 << 30, 4
LIMB = 16
EXTENDED = 512
SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


@dataclass(frozen=True)
class Whitening:
    """Fitted state: bounded by the dimension, never by the rows."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray  # eigenvalues, falling
    axes: np.ndarray  # (dimension, components), double
    trace: float


def fit_list(rows: DataFrame, dim: int) -> DataFrame:
    """(x binary): every distinct floored vector once, as packed int32."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, v in vectors.matrices(batch, dim):
                raw = floored(v, SCALE, LIMIT).astype("<i4").tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([raw[i : i + 4 * dim] for i in range(0, len(raw), 4 * dim)], pa.binary())], names=["x"])

    return rows.select("embedding").mapInArrow(pack, "x binary").distinct()


def unpacked(batch: pa.RecordBatch, dim: int, rows: int = vectors.ROWS) -> Iterator[np.ndarray]:
    for s in range(0, batch.num_rows, rows):
        yield np.frombuffer(b"".join(batch.column(0).slice(s, rows).to_pylist()), "<i4").reshape(-1, dim).astype(np.int64)


def sums_of(distinct: DataFrame, dim: int) -> tuple[int, list[int]]:
    """(number of vectors, exact sums of the dimensions)."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(dim + 1, np.int64)
        for batch in batches:
            for x in unpacked(batch, dim):
                total[:dim] += x.sum(0)
                total[dim] += len(x)
        yield vectors.slot_batch(np.arange(dim + 1), total)

    found = vectors.sums_by_slot(distinct.mapInArrow(add, "slot long, total long"))
    return found.get(dim, 0), [found.get(k, 0) for k in range(dim)]


def gram_sums(y: np.ndarray) -> list[np.ndarray]:
    """Exact Y'Y of integers below 2**32 as three limb matrices: low x low, the mixed products, high x high."""
    low = ((y + (1 << (LIMB - 1))) & ((1 << LIMB) - 1)) - (1 << (LIMB - 1))
    high = (y - low) >> LIMB
    a, b = low.astype(np.float64), high.astype(np.float64)
    zero = np.zeros((y.shape[1],) * 2, np.int64)
    if not high.any():
        return [(a.T @ a).astype(np.int64), zero, zero]
    mixed = a.T @ b
    return [(a.T @ a).astype(np.int64), mixed.astype(np.int64) + mixed.T.astype(np.int64), (b.T @ b).astype(np.int64)]


def covariance(distinct: DataFrame, dim: int, n: int, sums: list[int]) -> list[list[int]]:
    """Numerators of V over n^2, exact integers (upper triangle mirrored)."""
    centre = np.array([s // n for s in sums], np.int64)
    upper = np.triu_indices(dim)
    wide = len(upper[0])

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3, wide), np.int64)
        for batch in batches:
            for x in unpacked(batch, dim):  # ROWS * 2**33 < 2**53
                for k, g in enumerate(gram_sums(x - centre)):
                    total[k] += g[upper]
        yield vectors.slot_batch(np.arange(3 * wide), total.ravel())

    found = vectors.sums_by_slot(distinct.mapInArrow(products, "slot long, total long"))
    rest = [s - n * int(c) for s, c in zip(sums, centre, strict=True)]
    out = [[0] * dim for _ in range(dim)]
    for at, (i, j) in enumerate(zip(*(u.tolist() for u in upper), strict=True)):
        gram = sum(found.get(k * wide + at, 0) << (LIMB * k) for k in range(3))
        out[i][j] = out[j][i] = n * gram - rest[i] * rest[j]
    return out


def extended(numerators: list[list[int]], n: int) -> np.ndarray:
    """V = numerators / n^2 in extended precision: leading 64 bits of each quotient."""
    square = n * n

    def quotient(a: int) -> np.longdouble:
        shift = max(0, 66 + square.bit_length() - abs(a).bit_length())
        q, sign = (abs(a) << shift) // square, -1 if a < 0 else 1
        high, low = q >> 32, q & 0xFFFFFFFF
        return sign * np.ldexp(np.longdouble(high) * np.longdouble(4294967296.0) + np.longdouble(low), -shift)

    return np.array([[quotient(a) for a in row] for row in numerators], np.longdouble)


def norm(a: np.ndarray) -> float:
    """Upper bound of the spectral norm of a symmetric matrix."""
    return float(np.abs(a).sum(1).max()) if len(a) else 0.0


def clusters_of(values: np.ndarray, gap: float) -> list[np.ndarray]:
    """Runs of at least two eigenvalues whose neighbours lie within ``gap``."""
    order = np.argsort(values)
    cut = np.flatnonzero(np.diff(values[order]) > gap) + 1
    return [c for c in np.split(order, cut) if len(c) > 1]


def sub_solve(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """An orthonormal basis of the span of x that makes x'ax diagonal: a small solve, shifted by its centre and scaled."""
    gram = x.T @ x
    x = x @ (1.5 * np.eye(len(gram), dtype=x.dtype) - gram / 2)  # one step to orthonormal columns
    inner = x.T @ (a @ x)
    inner = inner - np.eye(len(inner), dtype=x.dtype) * (np.trace(inner) / len(inner))
    size = np.abs(inner).max()
    if size == 0:
        return x
    turn = np.linalg.eigh((inner / size).astype(np.float64))[1].astype(x.dtype)
    return x @ turn


def refine(a: np.ndarray, x: np.ndarray, steps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, eigenvectors) of symmetric a in the precision of its type, from approximate vectors x, by matrix products."""
    kind, eps = a.dtype.type, float(np.finfo(a.dtype).eps)
    x, eye, size = x.astype(kind), np.eye(len(a), dtype=kind), norm(a)
    last, turned = np.inf, set()
    for _ in range(steps):
        r = eye - x.T @ x
        s = x.T @ (a @ x)
        values = np.diag(s) / (1 - np.diag(r))
        off = s - np.diag(values)
        error = 2 * (norm(off) + size * norm(r))
        apart = values[None, :] - values[:, None]
        near = np.abs(apart) <= max(error, 4 * eps * size)
        np.fill_diagonal(near, True)
        turn = (s + s.T) / 2 + (values[None, :] + values[:, None]) / 2 * r
        e = r / 2 + np.where(near, 0, turn / np.where(near, 1, apart))  # the second part is antisymmetric to the last bit
        x = x + x @ e
        change = float(np.abs(e).max())
        if change <= 2 * len(a) * eps or (change >= last / 2 and change < np.sqrt(eps)):
            groups = clusters_of(values, max(error, 4 * eps * size))
            todo = [g for g in groups if tuple(sorted(g.tolist())) not in turned]
            if not todo:
                break
            for g in todo:
                turned.add(tuple(sorted(g.tolist())))
                x[:, g] = sub_solve(a, x[:, g])
            last = np.inf
            continue
        if error < size:  # clusters that the current error cannot part are solved on their own
            for g in clusters_of(values, max(error, 4 * eps * size)):
                if len(g) < len(a):
                    x[:, g] = sub_solve(a, x[:, g])
        last = change
    x = x @ (1.5 * eye - x.T @ x / 2)
    s = np.einsum("ij,ij->j", x, a @ x) / np.einsum("ij,ij->j", x, x)
    order = np.argsort(-s, kind="stable")
    return s[order], x[:, order]


def eigen(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors of a symmetric matrix in extended precision."""
    size = np.abs(v).max()
    if not size > 0:
        return np.zeros(len(v)), np.eye(len(v))
    scaled = v / size
    start = np.linalg.eigh(scaled.astype(np.float32))[1]
    _, x = refine(scaled.astype(np.float64), start)
    values, x = refine(scaled if len(v) <= EXTENDED else scaled.astype(np.float64), x)
    x = x / np.sqrt((x * x).sum(0))
    return values * size, x


def fit(rows: DataFrame, dim: int, components: int = COMPONENTS) -> tuple[Whitening, DataFrame]:
    """Fitted axes and the fit list they come from (a scratch table)."""
    distinct = common.scratch(fit_list(rows, dim), "fit-list")
    n, sums = sums_of(distinct, dim)
    numerators = covariance(distinct, dim, n, sums)
    values, axes = eigen(extended(numerators, n))
    k = min(components, dim)
    trace = float(sum(numerators[i][i] for i in range(dim))) / float(n * n)
    return Whitening(n, tuple(sums), values[:k].astype(np.float64), axes[:, :k].astype(np.float64), trace), distinct


def projector(model: Whitening):
    """int64 rows -> whitened values (rows, components); components without variance are NaN."""
    centre = np.array([s // model.n for s in model.sums], np.int64)
    rest = np.array([(s - model.n * int(c)) / model.n for s, c in zip(model.sums, centre, strict=True)])
    varies = model.values > len(centre) * 2.0**-50 * max(model.trace, 0.0)
    scale = np.where(varies, 1 / np.sqrt(np.where(varies, model.values, 1.0)), np.nan)

    def project(x: np.ndarray) -> np.ndarray:
        return (((x - centre) - rest) @ model.axes) * scale

    return project, varies


def deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> pa.Array:
    """Sum over dimensions of (n x - S)^2, exact; null beyond 64 bits."""
    largest = n * (int(np.abs(x).max()) if x.size else 0) + max(map(abs, sums))
    if len(sums) * largest * largest < 1 << 63:
        y = n * x - np.array(sums, np.int64)
        return pa.array((y * y).sum(1))
    exact = (sum((n * v - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x.tolist())
    return pa.array([d if d < 1 << 63 else None for d in exact], pa.int64())


def identity_error(distinct: DataFrame, model: Whitening) -> float | None:
    """Largest entry of the covariance of the whitened fit list minus the identity; centred sums merged by Spark."""
    project, varies = projector(model)
    used, dim = np.flatnonzero(varies), len(model.sums)
    if not len(used):
        return None
    names = [f"w{k}" for k in range(len(used))]

    def whiten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in unpacked(batch, dim):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in np.ascontiguousarray(project(x)[:, used].T)], names=names)

    table = distinct.mapInArrow(whiten, ", ".join(f"{c} double" for c in names))
    pairs = [(i, j) for i in range(len(names)) for j in range(i + 1)]
    row = table.agg(*[F.covar_pop(names[i], names[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return float(max(abs(row[f"c{i}_{j}"] - (i == j)) for i, j in pairs))


def whitened(table: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, embedding, ...) -> one row per usable vector and component, see the module's text."""
    rows = common.add_id_check(table, ["vec_id", "embedding"])
    dim = vectors.dimension(rows)
    if not dim:
        return rows.sparkSession.createDataFrame([], SCHEMA)
    model, distinct = fit(rows, dim, components)
    error = identity_error(distinct, model)
    common.delete(distinct)
    project, _ = projector(model)
    explained = [float(e) / model.trace if model.trace > 0 else None for e in model.values]
    k = len(explained)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, v in vectors.matrices(batch, dim):
                x = floored(v, SCALE, LIMIT)
                w = project(x).ravel()
                times = pa.array(np.repeat(np.arange(len(x)), k))
                ids = batch.column("vec_id").cast(pa.int64()).take(pa.array(at)).take(times)
                columns = [ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(w), model.n))]
                columns += [deviations(x, model.n, model.sums).take(times), pa.array(w, mask=np.isnan(w)), pa.array(explained * len(x), pa.float64())]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([error] * len(w), pa.float64())], names=[f.split()[0] for f in SCHEMA.split(", ")])

    return rows.mapInArrow(score, SCHEMA)
