"""Whitening of embeddings: covariance in double-double, merged over tasks, and its eigenvectors.

Entries become integers (``SCALE`` times the entry, rounded down), so sums are
exact. The covariance is that of the distinct vectors, each centred before it is
multiplied. A block of centred vectors is cut into slices of so few bits that
the products of two slices add up without rounding, whatever the order; these
sums are carried as pairs of doubles, high and low part, from task to task in
rounds of merging. The matrix is solved by tridiagonal reduction and divide and
conquer, and the eigenvectors in use are corrected once by their residuals in
double-double.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

SCALE = 256
#: Vectors of a block, and bits of a slice of it: products of two slices have twice the bits, and their sum over a block as many more as its size has.
BLOCK, BITS = 1024, 21
SLICES = 3
#: Partial sums that a task merges at least.
FAN = 64
#: Integers beyond this are cut to it.
LIMIT = 1 << 62
#: Lengths of vectors that may occur; each has a model of its own.
LENGTHS = 1000

Pair = tuple[np.ndarray, np.ndarray]


def two_sum(a: np.ndarray, b: np.ndarray) -> Pair:
    """The rounded sum and its exact error."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def two_product(a: np.ndarray, b: np.ndarray) -> Pair:
    """The rounded product and its exact error, by halves of 26 bits."""

    def halves(x: np.ndarray) -> Pair:
        t = x * 134217729.0
        high = t - (t - x)
        return high, x - high

    p = a * b
    (ah, al), (bh, bl) = halves(np.asarray(a)), halves(np.asarray(b))
    return p, ((ah * bh - p) + ah * bl + al * bh) + al * bl


def added(a: Pair, b: Pair) -> Pair:
    """The sum of two double-double numbers."""
    high, error = two_sum(a[0], b[0])
    low, rest = two_sum(a[1], b[1])
    high, error = two_sum(high, error + low)
    return two_sum(high, error + rest)


def as_pair(value: Fraction) -> tuple[float, float]:
    high = float(value)
    return high, float(value - Fraction(high))


def integers(column: str, scale: int = SCALE) -> Column:
    """Each entry as an integer, or null where the vector is null or holds null, infinite or undefined entries."""
    entry = lambda c: F.floor(F.greatest(F.least(c.cast("double") * scale, F.lit(float(LIMIT))), F.lit(-float(LIMIT))))
    known = F.col(column).isNotNull() & F.forall(column, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return F.when(known, F.transform(column, entry))


def _vectors(frames: Iterator[pd.DataFrame]) -> Iterator[np.ndarray]:
    """Blocks of at most ``BLOCK`` vectors of one length, as integers."""
    for frame in frames:
        lengths = frame["x"].map(len)
        for _, own in frame["x"].groupby(lengths):
            for at in range(0, len(own), BLOCK):
                yield np.array(list(own.iloc[at : at + BLOCK]), dtype=np.int64).reshape(len(own.iloc[at : at + BLOCK]), -1)


def _totals(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each length and dimension the number of vectors and sums of the upper and lower 32 bits."""
    sums: dict[int, list] = {}
    for x in _vectors(frames):
        own = sums.setdefault(x.shape[1], [0, 0, 0])
        own[0] += len(x)
        own[1] = own[1] + (x >> 32).sum(axis=0)
        own[2] = own[2] + (x & 0xFFFFFFFF).sum(axis=0)
    for d, (n, high, low) in sums.items():
        yield pd.DataFrame({"d": d, "k": range(d), "n": n, "high": high, "low": low})


def centred(x: np.ndarray, mean: Pair) -> Pair:
    """Integers less the mean, as double-double."""
    high = x.astype(float)
    low = (x - high.astype(np.int64)).astype(float)
    s, error = two_sum(high, -mean[0])
    return two_sum(s, error + (low - mean[1]))


def outer_sum(high: np.ndarray, low: np.ndarray) -> Pair:
    """The sum of the outer products of the rows of a block, as double-double.

    Slices hold ``BITS`` bits each below the largest entry, so their products add
    up without rounding error; what is left below the slices is smaller by
    2^-63, so plain doubles are enough for its products.
    """
    n, d = high.shape
    out = np.zeros((d, d)), np.zeros((d, d))
    top = np.abs(high).max(initial=0.0)
    if top == 0:
        return out
    slices, grid = [], np.ldexp(1.0, int(np.frexp(top)[1]) - BITS)
    rest, error = high, low
    for _ in range(SLICES):
        part = np.rint(rest / grid) * grid
        rest, error = two_sum(rest - part, error)
        slices.append(part)
        grid = np.ldexp(grid, -BITS)
    rest = rest + error
    for i in range(SLICES):
        for j in range(i, SLICES):
            product = slices[i].T @ slices[j]
            out = added(out, (product if i == j else product + 0.0, np.zeros((d, d))))
            if i != j:
                out = added(out, (product.T, np.zeros((d, d))))
    small = rest.T @ (slices[0] + slices[1] + slices[2])
    return added(out, (small + small.T + rest.T @ rest, np.zeros((d, d))))


def _outer_of(means):
    """For each length the summed outer products of a task's centred vectors."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, Pair] = {}
        for x in _vectors(frames):
            own = outer_sum(*centred(x, means.value[x.shape[1]]))
            d = x.shape[1]
            sums[d] = added(sums[d], own) if d in sums else own
        for d, (high, low) in sums.items():
            yield pd.DataFrame({"d": [d], "high": [high.tobytes()], "low": [low.tobytes()]})

    return run


def _merge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    sums: dict[int, Pair] = {}
    for frame in frames:
        for d, high, low in zip(frame["d"], frame["high"], frame["low"], strict=True):
            own = np.frombuffer(high), np.frombuffer(low)
            sums[d] = added(sums[d], own) if d in sums else own
    for d, (high, low) in sums.items():
        yield pd.DataFrame({"d": [d], "high": [high.tobytes()], "low": [low.tobytes()]})


def _merged(parts: DataFrame) -> dict[int, Pair]:
    """One pair of matrices for each length: rounds in which a task merges ``FAN`` partial sums, so neither one task nor the driver gets all."""
    spark, held = parts.sparkSession, None
    while True:
        parts, path = common.written(parts, "covariance")
        if held:
            common.remove(spark, held)
        held, n = path, parts.count()
        if n <= max(FAN, 4 * parts.select("d").distinct().count()):
            break
        parts = parts.repartition(-(-n // FAN)).mapInPandas(_merge, "d int, high binary, low binary")
    found: dict[int, Pair] = {}
    for r in parts.toLocalIterator():  # one matrix after the other
        own = tuple(np.frombuffer(r[c]).reshape(r["d"], r["d"]) for c in ("high", "low"))
        found[r["d"]] = added(found[r["d"]], own) if r["d"] in found else own
    common.remove(spark, held)
    return found


def eigen(matrix: Pair, components: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as columns), largest first, of a symmetric double-double matrix.

    Tridiagonal divide and conquer gives all pairs of the rounded matrix; those
    in use are corrected along the other eigenvectors by residuals in
    double-double. Values that are nothing but rounding errors are 0.
    """
    values, vectors = np.linalg.eigh(matrix[0])
    values, vectors = values[::-1].copy(), vectors[:, ::-1].copy()
    top = np.abs(values).max(initial=0.0)
    noise = len(values) * np.finfo(float).eps * top
    out = vectors.copy()
    for k in range(min(components, len(values))):
        v = vectors[:, k]
        product, error = two_product(matrix[0], v[None, :])
        total: Pair = np.zeros(len(v)), np.zeros(len(v))
        for j in range(len(v)):
            total = added(total, (product[:, j], error[:, j] + matrix[1][:, j] * v[j]))
        scaled = two_product(np.full(len(v), values[k]), v)
        residual = added(total, (-scaled[0], -scaled[1]))[0]
        along = vectors.T @ residual
        gaps = values[k] - values
        moves = np.divide(along, gaps, out=np.zeros_like(along), where=np.abs(gaps) > noise)
        moves[k] = 0.0
        v = v + vectors @ moves
        out[:, k] = v / np.linalg.norm(v)
        values[k] += along[k]
    values[np.abs(values) <= noise] = 0.0
    return np.maximum(values[:components], 0.0), out[:, :components]


class Whitener:
    """The model of vectors of one length: n, exact sums, mean, trace, eigenvalues and the matrix that whitens."""

    def __init__(self, n: int, sums: list[int], covariance: Pair, components: int):
        self.n, self.sums = n, sums
        self.mean = tuple(np.array(p) for p in zip(*[as_pair(Fraction(s, n)) for s in sums], strict=True)) if sums else (np.zeros(0), np.zeros(0))
        self.trace = float(np.trace(covariance[0]) + np.trace(covariance[1]))
        self.values, vectors = eigen(covariance, components)
        self.project = np.divide(vectors, np.sqrt(self.values), out=np.full_like(vectors, np.nan), where=self.values > 0)
        self.explained = self.values / self.trace if self.trace > 0 else np.zeros(len(self.values))
        self.error: float | None = None

    def whitened(self, x: np.ndarray) -> np.ndarray:
        high, low = centred(x, self.mean)
        return high @ self.project + low @ self.project

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """The squared distance from the mean, times n squared: exact, or None where a long can't hold it."""
        sums, most = np.array([float(s) for s in self.sums]), float(np.abs(x).max(initial=0))
        if x.shape[1] * (self.n * most + np.abs(sums).max(initial=0.0)) ** 2 < 2.0**62:
            return ((self.n * x - np.array(self.sums, dtype=np.int64)) ** 2).sum(axis=1).tolist()
        exact = [sum((self.n * int(v) - s) ** 2 for v, s in zip(row, self.sums, strict=True)) for row in x]
        return [v if v < 1 << 63 else None for v in exact]


def _error_parts(shared):
    """Summed outer products of the whitened vectors of a task."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for x in _vectors(frames):
            w = shared.value[x.shape[1]].whitened(x)
            sums[x.shape[1]] = sums.get(x.shape[1], 0.0) + w.T @ w
        for d, own in sums.items():
            yield pd.DataFrame({"d": d, "k": range(own.size), "v": own.ravel()})

    return run


def _cells(shared):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame = frame.reset_index(drop=True)
            lengths = frame["x"].map(len)
            for d, own in frame.groupby(lengths):
                model = shared.value.get(d)
                k = len(model.values) if model else 0
                if not k:
                    continue
                x = np.array(list(own["x"]), dtype=np.int64)
                yield pd.DataFrame({
                    "id": own["id"].repeat(k), "component": np.tile(np.arange(1, k + 1), len(own)), "n": model.n, "deviation": pd.array(model.deviations(x), dtype="Int64").repeat(k),
                    "whitened": model.whitened(x).ravel(), "explained": np.tile(model.explained, len(own)), "identity_error": np.nan if model.error is None else model.error,
                })

    return run


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 4, scale: int = SCALE) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): the first components of every usable vector.

    Vectors that are null or hold null, infinite or undefined entries are left
    out, as are empty ones, which have no component. Rows that repeat, and null
    ids, are returned as they are; equal vectors count once in the fit. Vectors
    of several lengths are fitted apart (at most ``LENGTHS`` lengths). Where the
    fit has no variance along a component, ``whitened`` is null and ``explained``
    0; ``identity_error`` is taken over the other components, null if there are
    none. A deviation that a long can't hold is null. Shorter vectors than
    ``components`` have as many components as entries. Other columns don't
    matter. No rows, no rows.
    """
    spark = rows.sparkSession
    known = rows.select(F.col(id_col).alias("id"), integers(vector_col, scale).alias("x")).where("size(x) > 0")
    fit, fit_at = common.written(known.select("x").distinct(), "distinct")
    totals = fit.mapInPandas(_totals, "d int, k int, n long, high long, low long")
    exact = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    sums: dict[int, list] = {}
    lengths = totals.select("d").distinct().limit(LENGTHS + 1).count()
    if lengths > LENGTHS:
        raise ValueError(f"vectors of more than {LENGTHS} lengths")
    for r in totals.groupBy("d", "k").agg(F.sum("n").alias("n"), exact("high"), exact("low")).orderBy("d", "k").collect():  # one row for each dimension
        sums.setdefault(r["d"], []).append((r["n"], (int(r["high"]) << 32) + int(r["low"])))
    means = {d: tuple(np.array(p) for p in zip(*[as_pair(Fraction(s, n)) for n, s in own], strict=True)) for d, own in sums.items()}
    products = _merged(fit.mapInPandas(_outer_of(spark.sparkContext.broadcast(means)), "d int, high binary, low binary")) if sums else {}
    models = {}
    for d, (high, low) in products.items():
        n = sums[d][0][0]
        cell = two_product(high / n, np.full_like(high, n))
        covariance = two_sum(high / n, (added((high, low), (-cell[0], -cell[1]))[0]) / n)
        models[d] = Whitener(n, [s for _, s in sums[d]], covariance, components)
    shared = spark.sparkContext.broadcast(models)
    errors: dict[int, list] = {}
    for r in fit.mapInPandas(_error_parts(shared), "d int, k int, v double").groupBy("d", "k").agg(F.sum("v").alias("v")).orderBy("d", "k").collect():  # components squared for each length
        errors.setdefault(r["d"], []).append(r["v"])
    for d, own in errors.items():
        k = len(models[d].values)
        off = np.abs(np.array(own, dtype=float).reshape(k, k) / models[d].n - np.eye(k))
        models[d].error = float(np.nanmax(off)) if np.isfinite(off).any() else None
    common.remove(spark, fit_at)
    out = known.mapInPandas(_cells(spark.sparkContext.broadcast(models)), "id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    cell = lambda c: F.when(~F.isnan(c), F.col(c)).alias(c)
    return out.select(F.col("id").alias(id_col), "component", "n", "deviation", cell("whitened"), "explained", cell("identity_error"))
