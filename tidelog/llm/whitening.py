"""Whitening of embeddings: principal components with unit variance, from a distributed singular value decomposition.

Entries are put on an integer grid, x = floor(64 c) + 1000000, so that means and deviations are exact. The fit list has
each different vector once; it is written to the shared folder and read by every pass:

1. exact sums S of each dimension, added up per batch and then by Spark as decimals;
2. the centred rows x - S/n (the integer part is subtracted exactly) go to MLlib's RowMatrix.computeSVD, which adds up
   the Gramian in a tree and decomposes it on the driver: d x d numbers, whatever the number of rows. Eigenvalues of
   the covariance are the squared singular values over n;
3. the total variance comes from the exact deviations instead, so the explained part can be checked against it;
4. the whitened fit list's own covariance is compared with the identity.

Defined results: vectors that are null or hold a null, NaN or infinity are left out; a vector shorter than the longest
counts as padded with zeros; entries beyond 2^55 count as 2^55; rows that repeat are whitened each but fit once; equal
eigenvalues are numbered in the order in which the decomposition gives them, the same for all rows; directions with
less than 1e-12 of the largest variance have no component, so an empty table, or one whose vectors are all equal, gives
no rows; a null vec_id is kept; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import discard, materialize

GRID = 64
OFFSET = 1_000_000
LARGEST = 1 << 61
COMPONENTS = 16
#: The least singular value that has a component, as part of the largest.
LEAST_SINGULAR = 1e-6
#: Decimals of 38 digits hold any sum in two parts.
PART = 10**18
DECIMAL = pa.decimal128(38, 0)


@dataclass(frozen=True)
class Whitening:
    """S = n * quotient + remainder, by dimension; axes has a column a component, already over sqrt(eigenvalue)."""

    n: int
    quotient: np.ndarray
    remainder: np.ndarray
    axes: np.ndarray
    eigenvalues: np.ndarray
    total_variance: float
    identity_error: float

    @property
    def width(self) -> int:
        return len(self.quotient)


def usable(vector: Column) -> Column:
    """True for a vector without null, NaN or infinity."""
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return vector.isNotNull() & ~F.exists(vector, bad)


def grid_rows(rows: DataFrame, width: int) -> DataFrame:
    """(vec_id, x) of the usable rows."""
    at = lambda c: F.least(F.greatest(F.floor(c.cast("double") * GRID), F.lit(-LARGEST)), F.lit(LARGEST)) + F.lit(OFFSET)
    filled = F.concat(F.transform("embedding", at), F.array_repeat(F.lit(OFFSET).cast("bigint"), F.lit(width) - F.size("embedding")))
    return rows.where(usable(F.col("embedding"))).select(F.col("vec_id").cast("bigint"), filled.alias("x"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, width)


def _exact(values: np.ndarray, bound: int) -> np.ndarray:
    """The same integers, of unlimited size where a sum could pass the bound of 64 bits."""
    return values if bound < 1 << 62 else values.astype(object)


def _split(total: int) -> tuple[int, int]:
    return total // PART, total % PART


def exact_sums(x: DataFrame, width: int) -> list[int]:
    """The sum of each dimension."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = _matrix(batch.column(0), width)
            if len(m):
                sums = _exact(m, int(np.abs(m).max()) * len(m)).sum(axis=0).tolist()
                yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array(sums, DECIMAL)], ["pos", "part"])

    found = x.select("x").mapInArrow(add, "pos int, part decimal(38,0)").groupBy("pos").agg(F.sum("part").alias("total")).collect()
    return [int(row.total) for row in sorted(found, key=lambda row: row.pos)]


def _deviations(y: np.ndarray, n: int, remainder: np.ndarray) -> tuple[list[int], list[int]]:
    """For each row the sums over dimensions of y^2 and of y * remainder, exactly."""
    most = int(np.abs(y).max(initial=0))
    exact = _exact(y, most * max(most, n) * y.shape[1])
    return (exact * exact).sum(axis=1).tolist(), (exact * remainder.astype(exact.dtype)).sum(axis=1).tolist()


def _square_sum(x: DataFrame, quotient: np.ndarray, remainder: np.ndarray, n: int) -> int:
    """The sum of (x - quotient)^2 over all rows and dimensions."""
    width = len(quotient)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            high, low = _split(sum(_deviations(_matrix(batch.column(0), width) - quotient, n, remainder)[0]))
            yield pa.RecordBatch.from_arrays([pa.array([high], DECIMAL), pa.array([low], DECIMAL)], ["high", "low"])

    high, low = x.select("x").mapInArrow(add, "high decimal(38,0), low decimal(38,0)").agg(F.sum("high"), F.sum("low")).first()
    return int(high) * PART + int(low)


def _mapped(x: DataFrame, width: int, change: Callable[[np.ndarray], np.ndarray]) -> RowMatrix:
    """The rows of x after change, as MLlib's matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = np.ascontiguousarray(change(_matrix(batch.column(0), width)))
            lists = pa.ListArray.from_arrays(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1], m.ravel())
            yield pa.RecordBatch.from_arrays([lists], ["v"])

    vectors = x.select("x").mapInArrow(run, "v array<double>").select(array_to_vector("v").alias("v"))
    return RowMatrix(MLUtils.convertVectorColumnsFromML(vectors, "v"))


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of the vectors of rows; None if they have no variance."""
    width = rows.where(usable(F.col("embedding"))).agg(F.max(F.size("embedding"))).first()[0] or 0
    if not width:
        return None
    x = materialize(grid_rows(rows, width).select("x").distinct())
    n = x.count()
    parts = [divmod(total, n) for total in exact_sums(x, width)]
    quotient, remainder = (np.array([p[k] for p in parts], np.int64) for k in range(2))
    shift = remainder / n
    squares = n * n * _square_sum(x, quotient, remainder, n) - n * sum(int(r) ** 2 for r in remainder)
    if not squares:
        discard(x)
        return None
    found = _mapped(x, width, lambda m: (m - quotient) - shift).computeSVD(width, False, LEAST_SINGULAR)
    values = np.asarray(found.s.toArray())[:components] ** 2 / n
    axes = found.V.toArray()[:, : len(values)] / np.sqrt(values)
    gramian = _mapped(x, width, lambda m: ((m - quotient) - shift) @ axes).computeGramianMatrix().toArray()
    error = float(np.abs(gramian / n - np.eye(len(values))).max())
    discard(x)
    return Whitening(n, quotient, remainder, axes, values, squares / n**3, error)


def whiten(rows: DataFrame, model: Whitening | None) -> DataFrame:
    """vec_id, component, n, deviation (a decimal, null beyond 38 digits), whitened, explained and identity_error."""
    if model is None:
        return rows.sparkSession.createDataFrame([], "vec_id bigint, component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double")
    width, n, quotient, remainder, axes = model.width, model.n, model.quotient, model.remainder, model.axes
    constant, shift = sum(int(r) ** 2 for r in remainder), remainder / n

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = _matrix(batch.column(1), width) - quotient
            deviations = [n * n * a - 2 * n * b + constant for a, b in zip(*_deviations(y, n, remainder), strict=True)]
            w = (y - shift) @ axes
            lists = pa.ListArray.from_arrays(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1], w.ravel())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([d if d < 10**38 else None for d in deviations], DECIMAL), lists], ["vec_id", "deviation", "w"])

    projected = grid_rows(rows, width).mapInArrow(project, "vec_id bigint, deviation decimal(38,0), w array<double>")
    explained = F.array(*(F.lit(float(e)) for e in model.eigenvalues / model.total_variance))
    each = projected.select("vec_id", "deviation", F.posexplode("w").alias("place", "whitened"))
    return each.select(
        "vec_id",
        (F.col("place") + 1).alias("component"),
        F.lit(n).cast("bigint").alias("n"),
        "deviation",
        "whitened",
        F.get(explained, F.col("place")).alias("explained"),
        F.lit(model.identity_error).alias("identity_error"),
    )
