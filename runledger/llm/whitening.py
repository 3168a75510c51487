"""Whitening of embeddings on their principal components, found by spectral divide and conquer.

Entries become whole numbers ``floor(scale * c) + shift``. Two passes over all rows give the
exact sums and the centred covariance; polar decompositions of the shifted covariance give
spectral projectors, which split invariant subspaces down to single components (``qdwh``). The
projection, a matrix of dimension times components, is broadcast, and a third pass measures
the covariance of the whitened rows. Every pass covers all rows; the driver holds matrices of
the vectors' dimension only.

Defined results: rows whose vector is null or holds a null or non-finite entry take no part;
zero vectors, repeated ids and null ids do. Vectors of different lengths are separate spaces,
each with its own fit. An entry that leaves the range of ±2^62 after scaling stays at its end.
A deviation beyond the range of long is null. A component without variance (equal rows, fewer
rows than dimensions) has a null ``whitened`` and an ``explained`` of 0, or null if the space
has no variance at all; ``identity_error`` is over the components with variance, null without
any. Equal eigenvalues share a subspace, in which any orthonormal basis may come out; it is the
same for all rows. An empty vector has no components, an empty table gives no rows. Input
columns other than the id and the vector do not appear in the result.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .moments import matrix_sums
from .qdwh import EPS, eigen

COMPONENTS = 8
SCALE, SHIFT = 1024, 100_000
RANGE = float(1 << 62)
DIGIT = (1 << 22) - 1


@dataclass
class Space:
    """The fit of the vectors of one length."""
    n: int
    sums: list[int]           # exact sums of each dimension
    mean: np.ndarray
    vectors: np.ndarray       # unit columns, largest eigenvalue first
    values: np.ndarray
    trace: float
    projection: np.ndarray    # columns over their standard deviation; 0 without variance
    centre: np.ndarray        # mean of the projected rows, a rounding residue
    identity_error: float | None = None


def usable(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``(vec_id long, v array<double>)`` of the rows that take part; repeated ids all stay."""
    v = F.col("v")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
            .filter(v.isNotNull() & ~bad))


def _spaces(batch: pa.RecordBatch, scale: int, shift: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(length, row positions, whole-number vectors)`` for each vector length of a batch."""
    column = batch.column(batch.schema.get_field_index("v"))
    flat = column.flatten().to_numpy(zero_copy_only=False)
    ends = np.cumsum(np.diff(column.offsets.to_numpy()))
    sizes = np.diff(ends, prepend=0)
    with np.errstate(over="ignore"):
        whole = np.clip(np.floor(flat * scale), -RANGE, RANGE - 1024).astype(np.int64) + shift
    for d in np.unique(sizes):
        at = np.flatnonzero(sizes == d)
        if d:
            yield int(d), at, whole[(ends[at] - d)[:, None] + np.arange(d)]


def _digits(x: np.ndarray) -> np.ndarray:
    """Column sums of a batch in digits of 22 bits, and the row count; sums of 2^31 such batches
    stay exact in doubles."""
    low = x & (1 << 26) - 1
    low, high = low.sum(axis=0), (x - low >> 26).sum(axis=0)
    return np.stack([low & DIGIT, low >> 22, high & DIGIT, high >> 22 & DIGIT, high >> 44,
                     np.full(x.shape[1], len(x))]).astype(np.float64)


def _number(digits: list[float]) -> int:
    low, low2, high, high2, high3 = (int(v) for v in digits)
    return low + (low2 << 22) + (high + (high2 << 22) + (high3 << 44) << 26)


def fit(rows: DataFrame, components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT) -> dict[int, Space]:
    """``{vector length: Space}`` from all of ``usable`` rows."""
    means, exact = {}, {}
    for d, total in matrix_sums(rows, lambda b: ((d, _digits(x)) for d, _, x in _spaces(b, scale, shift))).items():
        n = int(total[-1, 0])
        exact[d] = [_number(digits) for digits in total[:-1].T]
        means[d] = (n, np.array([s / n for s in exact[d]]))

    def scatter(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
        for d, _, x in _spaces(batch, scale, shift):
            centred = x - means[d][1]
            yield d, np.vstack([centred.T @ centred, centred.sum(axis=0)])

    spaces = {}
    for d, total in matrix_sums(rows, scatter).items():
        n, mean = means[d]
        rest = total[d] / n
        covariance = total[:d] / n - np.outer(rest, rest)
        values, vectors = eigen(covariance)
        trace = float(np.trace(covariance))
        varied = values > 64 * EPS * d * max(trace, 0.0)
        projection = np.where(varied, vectors / np.sqrt(np.where(varied, values, 1.0)), 0.0)[:, :components]
        spaces[d] = Space(n, exact[d], mean, vectors, np.where(varied, values, 0.0), trace, projection,
                          rest @ projection)
    _measure(rows, spaces, scale, shift)
    return spaces


def _measure(rows: DataFrame, spaces: dict[int, Space], scale: int, shift: int) -> None:
    """Set each space's ``identity_error`` from the covariance of its whitened rows."""
    parts = {d: (s.mean, s.projection, s.centre) for d, s in spaces.items()}

    def covariance(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
        for d, _, x in _spaces(batch, scale, shift):
            mean, projection, centre = parts[d]
            w = (x - mean) @ projection - centre
            yield d, w.T @ w

    for d, total in matrix_sums(rows, covariance).items():
        kept = np.flatnonzero(spaces[d].projection.any(axis=0))
        if len(kept):
            found = total[np.ix_(kept, kept)] / spaces[d].n
            spaces[d].identity_error = float(np.abs(found - np.eye(len(kept))).max())


def _deviation(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Per row the exact sum of ``(n * x - S)^2``; null beyond the range of long."""
    top = max(n * int(np.abs(x).max()), max(abs(s) for s in sums)) * 2
    if 2 * x.shape[1] * top * top < 1 << 63:
        off = n * x - np.array(sums, np.int64)
        return (off * off).sum(axis=1).tolist()
    if top < 1 << 62:
        off = n * x - np.array(sums, np.int64)
        reach = isqrt((1 << 62) // x.shape[1])
        fits = (np.abs(off) <= reach).all(axis=1)
        near = np.where(fits[:, None], off, 0)
        total: list = (near * near).sum(axis=1).tolist()
        rest, lines = np.flatnonzero(~fits), off
    else:
        total, rest, lines = [None] * len(x), np.arange(len(x)), None
    for i in rest.tolist():
        line = lines[i].tolist() if lines is not None else [n * c - s for c, s in zip(x[i].tolist(), sums)]
        square = sum(c * c for c in line)
        total[i] = square if square < 1 << 63 else None
    return total


_OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def transform(rows: DataFrame, spaces: dict[int, Space], scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """One row for each ``usable`` row and component."""
    shared = rows.sparkSession.sparkContext.broadcast({
        d: (s.n, s.sums, s.mean, s.projection, s.centre, s.values[:s.projection.shape[1]], s.trace, s.identity_error)
        for d, s in spaces.items()})                                   # a few matrices of the vectors' dimension
    schema = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()),
                        ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("vec_id"))
            for d, at, x in _spaces(batch, scale, shift):
                n, sums, mean, projection, centre, values, trace, error = shared.value[d]
                k = projection.shape[1]
                white = (x - mean) @ projection - centre
                flat = np.repeat(np.arange(len(at)), k)
                share = pa.array([v / trace if trace > 0 else None for v in values] * len(at), pa.float64())
                none = np.tile(values <= 0, len(at))
                yield pa.RecordBatch.from_arrays([
                    ids.take(pa.array(at[flat])), pa.array(np.tile(np.arange(1, k + 1), len(at)), pa.int32()),
                    pa.array(np.full(len(flat), n)), pa.array(_deviation(x, n, sums), pa.int64()).take(pa.array(flat)),
                    pa.array(white.ravel(), pa.float64(), mask=none), share,
                    pa.array([error] * len(flat), pa.float64())], schema=schema)
    return rows.mapInArrow(run, _OUT)


def whiten(rows: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Fit on all rows and whiten all rows: ``(vec_id, component, n, deviation, whitened, explained,
    identity_error)``."""
    good = usable(rows, id_col, vec_col)
    return transform(good, fit(good, components))
