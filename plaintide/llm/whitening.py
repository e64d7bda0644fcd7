"""Embeddings projected on the main axes of their spread and scaled to unit variance.

Sums and products are integers added up by Spark; the covariance, whose size depends on the dimension only, is
solved interval by interval in Spark tasks, each by contour integration.
"""

from __future__ import annotations

from decimal import Decimal
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plaintide.llm import feast
from plaintide.llm.arrow import type_of

# Components that are given, the grid of the entries and the shift that makes them positive.
COMPONENTS, GRID, SHIFT = 32, 64, 1_000_000
#: Entries whose grid number is larger can't be added up exactly.
LARGEST = 1 << 31
#: Vectors handled at once.
ROWS = 4096


def grid_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """_id and _x (array<bigint>, floor(64 * entry) + 1000000) of the usable vectors.

    Left out are vectors that are null or empty, hold null or non-finite entries or ones beyond 2**31 / 64, or
    differ in length from most of the others (of equally frequent lengths the longer one counts).
    """
    entries = F.col("_v")
    finite = F.forall(entries, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float(LARGEST) / GRID)))
    typed = vectors.select(F.col(id_col).alias("_id"), F.col(vector_col).cast("array<double>").alias("_v"))
    usable = typed.filter(entries.isNotNull() & (F.size("_v") > 0) & finite)
    lengths = usable.groupBy(F.size("_v").alias("_d")).agg(F.count("*").alias("_n"))
    # One row.
    usual = lengths.orderBy(F.desc("_n"), F.desc("_d")).limit(1).select("_d")
    numbers = F.transform(entries, lambda c: F.floor(c * GRID) + SHIFT)
    return usable.join(F.broadcast(usual), F.size("_v") == F.col("_d")).select("_id", numbers.alias("_x"))


def _matrices(batches, column: str):
    """The vectors of a column of arrays as matrices of about ROWS rows, with the slices they came from."""
    for batch in batches:
        for a in range(0, len(batch), ROWS):
            rows = batch.slice(a, ROWS)
            values = rows.column(column)
            yield rows, values.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)


def _summed(parts: DataFrame) -> dict[int, int]:
    """Sums by place as Python integers."""
    return {r.place: int(r.total) for r in parts.groupBy("place").agg(F.sum("value").alias("total")).collect()}


def _sums(batches, work):
    """(place, value) rows of the integer vectors that `work` gives for each matrix, added up per task."""
    total = None
    for _, x in _matrices(batches, "_x"):
        part = work(x)
        total = part if total is None else total + part
    if total is not None:
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(total)), pa.int32()), pa.array([Decimal(int(v)) for v in total], pa.decimal128(38, 0))],
            names=["place", "value"])


def column_sums(grid: DataFrame) -> tuple[int, list[int]]:
    """Number of vectors and the sum of each entry, exactly."""
    def work(x):
        return np.array([len(x), *x.sum(axis=0).tolist()], object)

    found = _summed(grid.select("_x").mapInArrow(lambda b: _sums(b, work), "place int, value decimal(38,0)"))
    return found.get(0, 0), [found[i] for i in range(1, len(found))]


def products(y: np.ndarray) -> np.ndarray:
    """The upper triangle of y.T @ y, exactly: in doubles while they can hold it, in Python integers otherwise."""
    upper = np.triu_indices(y.shape[1])
    top = int(np.abs(y).max(initial=0))
    if top * top * len(y) < 1 << 53:
        y = y.astype(np.float64)
        return (y.T @ y)[upper].astype(np.int64).astype(object)
    y = y.astype(object)
    return (y.T @ y)[upper]


def covariance(grid: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """Covariance (divisor n) of the vectors: centred by the nearest integers to the means, then by the rest.

    Products of the centred integers are added up exactly, so each entry is rounded once.
    """
    d = len(sums)
    centre = [(2 * s + n) // (2 * n) for s in sums]
    shift = np.array(centre, np.int64)
    found = _summed(grid.select("_x").mapInArrow(lambda b: _sums(b, lambda x: products(x - shift)),
                                                 "place int, value decimal(38,0)"))
    left = [s - n * c for s, c in zip(sums, centre)]
    rows, columns = np.triu_indices(d)
    result = np.zeros((d, d))
    for place, (i, j) in enumerate(zip(rows.tolist(), columns.tolist())):
        result[i, j] = result[j, i] = float(Fraction(n * found[place] - left[i] * left[j], n * n))
    return result


def components(spark: SparkSession, matrix: np.ndarray, most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The `most` largest eigenvalues, falling, and their unit eigenvectors as columns.

    Inertia counts cut the range of eigenvalues into intervals with a known number each; every interval is solved
    in a Spark task of its own and has to give that number.
    """
    found, norm = feast.intervals(matrix, most)
    if not found:
        return np.empty(0), np.empty((len(matrix), 0))
    shared = spark.sparkContext.broadcast(matrix)
    frame = spark.createDataFrame([(i, *row) for i, row in enumerate(found)], "i int, low double, high double, inside int")

    def solve(batches):
        for rows in batches:
            for row in rows.itertuples():
                values, vectors = feast.eigenpairs(shared.value, row.low, row.high, row.inside, norm, row.i + 1)
                yield pd.DataFrame({"value": values, "vector": list(vectors.T)})

    # One row per eigenvalue, at most the dimension.
    solved = frame.repartition(len(found), "i").mapInPandas(solve, "value double, vector array<double>").collect()
    expected = sum(inside for _, _, inside in found)
    if len(solved) != expected:
        raise ArithmeticError(f"{len(solved)} eigenvalues found, {expected} counted")
    vectors = np.array([r.vector for r in sorted(solved, key=lambda r: -r.value)]).T
    values, vectors = feast.polished(matrix, vectors)
    return values[:most], vectors[:, :most]


class Whitening:
    """A fitted projection: n, sums, eigenvalues, explained shares, and the columns that whiten."""

    def __init__(self, n: int, sums: list[int], values: np.ndarray, vectors: np.ndarray, trace: float):
        self.n, self.sums = n, sums
        self.values, self.vectors = values, vectors
        self.explained = values / trace if trace else values
        self.centre = np.array([(2 * s + n) // (2 * n) for s in sums] if n else [], np.int64)
        #: What the rounded means leave of the sums, and of the means.
        self.left = [s - n * c for s, c in zip(sums, self.centre.tolist())]
        self.rest = np.array([float(Fraction(x, n)) for x in self.left] if n else [], np.float64)
        self.columns = vectors / np.sqrt(values)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.centre) - self.rest) @ self.columns

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum over the entries of (n * x - S) squared, exactly; null beyond the range of a long."""
        y = x - self.centre
        top = self.n * int(np.abs(y).max(initial=0)) + max(map(abs, self.left), default=0)
        if top * top * y.shape[1] < 1 << 63:
            far = self.n * y - np.array(self.left, np.int64)
            return (far * far).sum(axis=1).tolist()
        far = self.n * y.astype(object) - np.array(self.left, object)
        return [int(v) if v < 1 << 63 else None for v in (far * far).sum(axis=1)]


def fit_whitening(grid: DataFrame, most: int = COMPONENTS) -> Whitening:
    n, sums = column_sums(grid)
    if not n:
        return Whitening(0, [], np.empty(0), np.empty((0, 0)), 0.0)
    matrix = covariance(grid, n, sums)
    values, vectors = components(grid.sparkSession, matrix, most)
    return Whitening(n, sums, values, vectors, float(np.trace(matrix)))


def identity_error(grid: DataFrame, fitted: Whitening) -> float:
    """Largest absolute entry of the covariance of the whitened vectors minus the identity, from the vectors."""
    k = len(fitted.values)
    if not k:
        return 0.0

    def work(batches):
        total = np.zeros(k + k * k)
        for _, x in _matrices(batches, "_x"):
            z = fitted.whitened(x)
            # The means are zero but for rounding; what is left of them is taken off below.
            total += np.concatenate((z.sum(axis=0), (z.T @ z).ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], names=["place", "value"])

    parts = grid.select("_x").mapInArrow(work, "place int, value double").groupBy("place").agg(F.sum("value").alias("v"))
    found = np.zeros(k + k * k)
    for row in parts.collect():
        found[row.place] = row.v
    mean = found[:k] / fitted.n
    return float(np.abs(found[k:].reshape(k, k) / fitted.n - np.outer(mean, mean) - np.eye(k)).max())


def whitened_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                     most: int = COMPONENTS) -> DataFrame:
    """One row per usable vector (see grid_vectors): id, n, deviation, whitened, explained (arrays), identity_error.

    whitened holds the coordinates on up to `most` components, by falling eigenvalue; eigenvalues that rounding
    can't tell from zero have none, so equal vectors alone give no component and an empty array. Equal eigenvalues
    have some orthonormal set of axes. Ids may be null or repeat: every row counts and is answered by itself. An
    empty table, or one without usable vectors, gives no rows. Vectors never move: three passes add up sums,
    products and the check, a fourth gives the result; what reaches the driver depends on the dimension only.
    """
    grid = grid_vectors(vectors, id_col, vector_col)
    fitted = fit_whitening(grid, most)
    error = identity_error(grid, fitted)
    schema = f"{id_col} {type_of(vectors, id_col)}, deviation bigint, whitened array<double>"

    def run(batches):
        for rows, x in _matrices(batches, "_x"):
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array(fitted.deviation(x), pa.int64()),
                 pa.array(list(fitted.whitened(x)), pa.list_(pa.float64()))],
                names=[id_col, "deviation", "whitened"])

    explained = F.array(*[F.lit(float(v)) for v in fitted.explained]).cast("array<double>")
    return grid.mapInArrow(run, schema).select(
        id_col, F.lit(fitted.n).cast("bigint").alias("n"), "deviation", "whitened", explained.alias("explained"),
        F.lit(error).alias("identity_error"))


def whitened_components(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                        most: int = COMPONENTS) -> DataFrame:
    """whitened_vectors with a row per vector and component (from 1): id, component, n, deviation, whitened, ..."""
    found = whitened_vectors(vectors, id_col, vector_col, most)
    every = F.posexplode(F.arrays_zip("whitened", "explained")).alias("_i", "_c")
    return found.select(id_col, "n", "deviation", "identity_error", every).select(
        id_col, (F.col("_i") + 1).cast("int").alias("component"), "n", "deviation",
        F.col("_c.whitened").alias("whitened"), F.col("_c.explained").alias("explained"), "identity_error")
