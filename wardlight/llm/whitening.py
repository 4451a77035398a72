"""Whitening of integer vectors by polarisation.

Entries become whole numbers, x = floor(256 * c), and the fit list is each
distinct vector once. With n vectors and the sums S of their dimensions, the
centred values y = n * x - S are whole numbers as well. Only squares are summed:
of every y_i, and of y_i + y_j for every pair of dimensions. Their differences
give all cross products, since (y_i + y_j)^2 - y_i^2 - y_j^2 = 2 y_i y_j, without
any rounding; the covariance is assembled from them for a symmetric
eigendecomposition of the size of one dimension by another.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlight.llm.graph import Shelf

# Units per 1.0 of an entry; x counts them.
UNITS = 256
# Components that a result has by default.
COMPONENTS = 4
# Rows whose pair sums are squared together.
ROWS = 2048
# An eigenvalue below this share of the largest one, times the dimension, is no spread but rounding.
FLAT = 1e-13

_WIDE = pa.decimal128(38, 0)
# Sums of squares are carried as two numbers, the lower one of so many bits.
_LOW_BITS = 100


def whole_entries(vector: Column, units: int = UNITS) -> Column:
    """The vector in whole units; null where an entry is null, not finite or beyond a long."""
    limit = float(1 << 62) / units
    able = F.forall(vector, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < limit))
    return F.when(able, F.transform(vector, lambda c: F.floor(c.cast("double") * units)))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
    return flat.reshape(len(column), -1)


def _exact(sums) -> pa.Array:
    return pa.array([Decimal(int(s)) for s in sums], _WIDE)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums, exact: 64-bit numbers where pair sums of them fit, else Python's own."""
    highest = max(int(np.abs(x).max(initial=0)) * n, max(map(abs, sums), default=0))
    if highest < 1 << 60:
        return x * np.int64(n) - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def square_sums(z: np.ndarray) -> list[int]:
    """Exact sums of squares down the columns, at most ROWS rows.

    64-bit numbers are cut into a signed upper and an unsigned lower part of 26 bits where their squares do not fit.
    """
    if z.dtype == object:
        return (z * z).sum(axis=0).tolist() if len(z) else [0] * z.shape[1]
    top = int(np.abs(z).max(initial=0))
    if top * top * len(z) < 1 << 63:
        return np.einsum("ij,ij->j", z, z).tolist()
    if top >= 1 << 52:
        return square_sums(z.astype(object))
    high, low = z >> 26, z & ((1 << 26) - 1)
    parts = [np.einsum("ij,ij->j", a, b).tolist() for a, b in ((high, high), (high, low), (low, low))]
    return [(hh << 52) + (hl << 27) + ll for hh, hl, ll in zip(*parts)]


def row_squares(y: np.ndarray) -> list[int]:
    """Exact sums of squares along the rows."""
    turned = np.ascontiguousarray(y.T)
    parts = [square_sums(turned[begin:begin + ROWS]) for begin in range(0, len(turned), ROWS)]
    return [sum(q) for q in zip(*parts)]


@dataclass(frozen=True)
class Whitening:
    """What a fit list says: its size, sums per dimension, eigenvalues by falling size and their unit vectors."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray  # one column per component
    trace: float

    @classmethod
    def of(cls, n: int, sums: list[int], squares: dict[tuple[int, int], int]) -> Whitening:
        """From exact sums of squares: (i, i) of dimension i, (i, j) with i < j of the sum of both."""
        d = len(sums)
        covariance = np.zeros((d, d))
        for (i, j), q in squares.items():
            # whole numbers divide with one rounding
            twice = 2 * q if i == j else q - squares[i, i] - squares[j, j]
            covariance[i, j] = covariance[j, i] = twice / (2 * n**3)
        values, vectors = np.linalg.eigh(covariance)
        values, vectors = values[::-1], vectors[:, ::-1]
        # the largest entry of a component is positive, so that a fit gives the same signs each time
        if d:
            signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(d)])
            vectors = vectors * np.where(signs == 0, 1, signs)
        return cls(n, sums, values, vectors, float(sum(squares[i, i] for i in range(d)) / n**3) if d else 0.0)

    def components(self, wanted: int) -> int:
        return min(wanted, len(self.sums))

    def scales(self, wanted: int) -> np.ndarray:
        """1 / sqrt(eigenvalue) of the first components; NaN where there is no spread."""
        values = self.values[:self.components(wanted)]
        floor = FLAT * len(self.sums) * max(float(self.values.max(initial=0)), 0)
        return np.where(values > floor, 1 / np.sqrt(np.where(values > floor, values, 1)), np.nan)

    def project(self, y: np.ndarray, wanted: int) -> np.ndarray:
        """Whitened coordinates of centred rows."""
        k = self.components(wanted)
        return (y / self.n).astype(np.float64) @ self.vectors[:, :k] * self.scales(wanted)


def _sum_up(fit: DataFrame) -> tuple[int, list[int]]:
    """Number of vectors and exact sums of the commonest length (the longer one if two are as common)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, sizes = batch.column(0), batch.column(0).value_lengths().to_numpy(zero_copy_only=False)
            for size in np.unique(sizes):
                x = _matrix(column.filter(pa.array(sizes == size)))
                sums = (x >> 31).sum(axis=0).tolist(), (x & ((1 << 31) - 1)).sum(axis=0).tolist()
                yield pa.RecordBatch.from_arrays([
                    pa.array([int(size)] * int(size), pa.int32()), pa.array(range(int(size)), pa.int32()),
                    pa.array([len(x)] * int(size), pa.int64()), _exact((h << 31) + low for h, low in zip(*sums)),
                ], ["size", "at", "n", "total"])

    length = fit.filter(F.size("x") > 0).groupBy(F.size("x").alias("size")).count().orderBy(
        F.col("count").desc(), F.col("size").desc()).first()
    if length is None:
        return 0, []
    rows = fit.filter(F.size("x") == length["size"]).select("x").mapInArrow(run, "size int, at int, n long, total decimal(38,0)")
    found = rows.groupBy("at").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()
    sums = {r["at"]: int(r["total"]) for r in found}
    return length["count"], [sums[i] for i in range(length["size"])]


def _pair_squares(fit: DataFrame, n: int, sums: list[int]) -> dict[tuple[int, int], int]:
    """Exact sums of squares of every dimension (i, i) and of every sum of two (i, j)."""
    d = len(sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros(d - i, object) for i in range(d)]
        for batch in batches:
            whole = centred(_matrix(batch.column(0)), n, sums)
            for begin in range(0, len(whole), ROWS):
                y = whole[begin:begin + ROWS]
                for i in range(d):
                    z = y[:, i:i + 1] + y[:, i:]
                    z[:, 0] = y[:, i]
                    total[i] = total[i] + np.array(square_sums(z), object)
        first = np.repeat(np.arange(d), np.arange(d, 0, -1))
        second = np.concatenate([np.arange(i, d) for i in range(d)])
        parts = [divmod(int(q), 1 << _LOW_BITS) for q in np.concatenate(total)]
        yield pa.RecordBatch.from_arrays([
            pa.array(first, pa.int32()), pa.array(second, pa.int32()), _exact(h for h, _ in parts), _exact(low for _, low in parts),
        ], ["i", "j", "high", "low"])

    own = fit.filter(F.size("x") == d).select("x").mapInArrow(run, "i int, j int, high decimal(38,0), low decimal(38,0)")
    found = own.groupBy("i", "j").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).collect()
    return {(r["i"], r["j"]): (int(r["high"]) << _LOW_BITS) + int(r["low"]) for r in found}


def _identity_error(fit: DataFrame, model: Whitening, wanted: int) -> float | None:
    """Largest absolute entry of the covariance of the whitened fit list minus the identity.

    Components without spread have no whitened values and are left out.
    """
    k = model.components(wanted)
    good = np.flatnonzero(~np.isnan(model.scales(wanted)))
    if not len(good):
        return None
    d = len(model.sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        products = np.zeros((k, k))
        for batch in batches:
            w = model.project(centred(_matrix(batch.column(0)), model.n, model.sums), wanted)
            products += w.T @ w
        i, j = np.divmod(np.arange(k * k), max(k, 1))
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(products.ravel())], ["i", "j", "p"])

    rows = fit.filter(F.size("x") == d).select("x").mapInArrow(run, "i int, j int, p double")
    found = np.full((k, k), np.nan)
    for r in rows.groupBy("i", "j").agg(F.sum("p").alias("p")).collect():
        found[r["i"], r["j"]] = r["p"] / model.n
    return float(np.abs(found - np.eye(k))[np.ix_(good, good)].max())


def fitted(rows: DataFrame, components: int = COMPONENTS) -> tuple[Whitening, float | None]:
    """The whitening of the distinct vectors of column ``x`` and its identity error.

    Copies are dropped before the shuffle, so a vector may be a third of all
    rows. What reaches the driver is bounded by the dimension d: d sums, and
    d * (d + 1) / 2 sums of squares.
    """
    shelf = Shelf()
    fit = shelf.settled(rows.filter("x IS NOT NULL").select("x").distinct())
    n, sums = _sum_up(fit)
    squares = _pair_squares(fit, n, sums) if n else {}
    model = Whitening.of(n, sums, squares)
    error = _identity_error(fit, model, components) if n else None
    shelf.clear(rows.sparkSession)
    return model, error


def whiten(
    vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding", units: int = UNITS
) -> DataFrame:
    """vec_id, component, n, deviation (decimal(38,0)), whitened, explained, identity_error for
    every row with a whole vector and every component from 1 to ``components``.

    A row is left out if its vector is null, holds a null, an infinity, a NaN
    or an entry whose whole number is beyond a long, or has another length than
    most distinct vectors (the longer one of two lengths that are as common).
    Repeated rows stay and count once in the fit; null ids stay; an empty table
    gives an empty result; other columns are not read. ``whitened`` is null for
    a component along which the fit list does not spread, and so are
    ``explained`` without any spread and ``identity_error`` without any
    component that spreads; a deviation of more than 38 digits is null. Fewer dimensions than ``components`` give fewer.
    Equal eigenvalues leave the choice of their vectors open; one fit has one.
    """
    rows = vectors.select(F.col(id_col).alias("vec_id"), whole_entries(F.col(vector_col), units).alias("x"))
    model, error = fitted(rows, components)
    d, k = len(model.sums), model.components(components)
    explained = [float(e / model.trace) if model.trace > 0 else None for e in model.values[:k]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            y = centred(_matrix(batch.column(1)), model.n, model.sums)
            whitened = model.project(y, components).ravel()
            deviation = [Decimal(q) if q < 10**38 else None for q in row_squares(y)]
            take = np.repeat(np.arange(len(batch)), k)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(take)), pa.array(np.tile(np.arange(1, k + 1), len(batch)), pa.int32()),
                pa.array(np.full(len(take), model.n), pa.int64()), pa.array(deviation, _WIDE).take(pa.array(take)),
                pa.array(whitened, mask=np.isnan(whitened)), pa.array(explained * len(batch), pa.float64()),
                pa.array([error] * len(take), pa.float64()),
            ], ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    id_type = vectors.schema[id_col].dataType.simpleString()
    return rows.filter((F.size("x") == d) & F.col("x").isNotNull() & F.lit(d > 0)).mapInArrow(
        run, f"vec_id {id_type}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
