"""Whitening of vectors by shifted Cholesky QR: Gram matrices come from the executors, rows never leave them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import sliced
from .vectors import steps, usable

BASE = 1_000_000
MOST_COMPONENTS = 32
# Entries beyond this count as this, so that x is a whole number in doubles too.
MOST_STEPS = 2**52
# Directions narrower than this share of the widest one have no variance that doubles can tell from zero.
NARROW = 1e-10
UNIT = np.finfo(np.float64).eps / 2


@dataclass(frozen=True)
class Whitening:
    """n vectors of `width` entries with sums of x; components by falling variance (columns), their variances, the trace."""

    n: int
    width: int
    sums: list[int]
    components: np.ndarray
    variances: np.ndarray
    trace: float


def exact(bound: int, values: np.ndarray) -> np.ndarray:
    """The values as Python integers where results up to `bound` would not fit 64 bits."""
    return values if bound < 2**62 else values.astype(object)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S, exactly: S is split into whole means and remainders, so that the numbers stay as small as the spread."""
    quotient, rest = (np.array(v, object) for v in zip(*(divmod(s, n) for s in sums), strict=True))
    moved = x - quotient.astype(np.int64)
    return n * exact(n * (int(np.abs(moved).max(initial=0)) + 1), moved) - exact(n, rest.astype(np.int64))


def centred(column: pa.Array, width: int, n: int, sums: list[int]) -> np.ndarray:
    return deviations(steps(column, width, MOST_STEPS) + BASE, n, sums).astype(np.float64) / n


def solved(rows: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """Q of Q R = rows by forward substitution, all rows at a time."""
    out = np.empty_like(rows)
    for j in range(rows.shape[1]):
        out[:, j] = (rows[:, j] - out[:, :j] @ upper[:j, j]) / upper[j, j]
    return out


def gram(rows: DataFrame, width: int, make: Callable[[pa.Array], np.ndarray], size: int) -> np.ndarray:
    """Sum of M'M over all rows of M = make(vectors), `size` columns: one upper triangle from each task, added up in Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in sliced(batches, 8192, 4_000_000):
            m = make(batch.column(0))
            total += m.T @ m
        upper = np.triu_indices(size)
        yield pa.RecordBatch.from_arrays([pa.array((upper[0] * size + upper[1]).astype(np.int32)), pa.array(total[upper])], names=["cell", "value"])

    cells = rows.select("vector").mapInArrow(run, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).toPandas()
    out = np.zeros((size, size))
    at = cells.cell.to_numpy()
    out[at // size, at % size] = out[at % size, at // size] = cells.value.to_numpy()
    return out


def upper_factor(matrix: np.ndarray, shift: float) -> np.ndarray:
    """R with R'R = matrix + shift; the shift grows tenfold where it does not make the matrix positive definite."""
    least = len(matrix) * UNIT * max(np.trace(matrix), np.finfo(np.float64).tiny)
    while True:
        try:
            return np.linalg.cholesky(matrix + shift * np.eye(len(matrix))).T
        except np.linalg.LinAlgError:
            shift = max(10 * shift, least)


def fit(rows: DataFrame, width: int) -> Whitening:
    """Three Gram passes over the centred rows (key, vector): R of a shifted Cholesky, of Q = rows / R, and the root of the last
    Q's Gram matrix, which is defined for dependent columns too. The factors' product has the rows' singular values.
    """

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, sums = 0, [0] * width
        for batch in sliced(batches, 8192, 4_000_000):
            x = steps(batch.column(0), width, MOST_STEPS) + BASE
            count += len(x)
            part = exact(len(x) * int(np.abs(x).max(initial=0)), x).sum(0)
            sums = [s + int(v) for s, v in zip(sums, part, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, width), pa.int32()), pa.array([Decimal(v) for v in (count, *sums)], pa.decimal128(38, 0))], names=["dim", "sum"])

    found = {r.dim: int(r.sum) for r in rows.select("vector").mapInArrow(added, "dim int, sum decimal(38,0)").groupBy("dim").agg(F.sum("sum").cast("decimal(38,0)").alias("sum")).collect()}
    n, sums = found.get(-1, 0), [found.get(j, 0) for j in range(width)]
    if not n or not width:
        return Whitening(n, width, sums, np.zeros((width, 0)), np.zeros(0), 0.0)
    first = gram(rows, width, lambda c: centred(c, width, n, sums), width)
    if not first.any():
        return Whitening(n, width, sums, np.zeros((width, 0)), np.zeros(0), 0.0)
    one = upper_factor(first, 11 * (n * width + width * (width + 1)) * UNIT * float(np.linalg.eigvalsh(first)[-1]))
    two = upper_factor(gram(rows, width, lambda c: solved(centred(c, width, n, sums), one), width), 0.0)
    last = gram(rows, width, lambda c: solved(solved(centred(c, width, n, sums), one), two), width)
    values, vectors = np.linalg.eigh(last)
    root = np.sqrt(np.maximum(values, 0))[:, None] * vectors.T
    _, spread, turned = np.linalg.svd(root @ two @ one)
    wide = spread > NARROW * spread[0]
    return Whitening(n, width, sums, turned[wide].T, spread[wide] ** 2 / n, float((spread**2).sum() / n))


def projected(column: pa.Array, model: Whitening, most: int) -> np.ndarray:
    return centred(column, model.width, model.n, model.sums) @ (model.components[:, :most] / np.sqrt(model.variances[:most]))


def whiten(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", most: int = MOST_COMPONENTS) -> DataFrame:
    """Whitened coordinates of the vectors of `rows`, a row for each vector and component.

    x = floor(64 c) + 1000000 for each entry c. The fit is over all usable vectors, centred exactly before multiplying.
    Components are numbered from 1 by falling variance; at most `most`, and only those with variance (a spread above
    NARROW of the widest). Returns the key's column, component (int), n (long), deviation (long, the exact sum of
    (n x - S)^2; null beyond 64 bits), whitened, explained and identity_error (double; the last is one value for all).

    Vectors that are null or have null, NaN or infinite entries, and those not of the most common length, are left out.
    Entries of 2^52 steps and more count as that. Null keys are carried like others, repeated rows count each time, other
    columns are not read. No vectors, one vector, equal vectors only or vectors without entries give no rows.
    """
    kind = rows.select(F.col(f"`{key}`")).schema[0].dataType.simpleString()
    schema = f"`{key}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows, width = usable(rows, key, vector)
    model = fit(rows, width)
    k = min(most, len(model.variances))
    if not k:
        return rows.sparkSession.createDataFrame([], schema)
    unit = gram(rows, width, lambda c: projected(c, model, k), k) / model.n
    error = float(np.abs(unit - np.eye(k)).max())
    explained = model.variances[:k] / model.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 4096, 2_000_000):
            moved = deviations(steps(batch.column(1), width, MOST_STEPS) + BASE, model.n, model.sums)
            squares = exact(width * int(np.abs(moved).max(initial=0)) ** 2, moved)
            sums = [v if v < 2**63 else None for v in (squares * squares).sum(1).tolist()]
            size = batch.num_rows * k
            columns = [
                batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), batch.num_rows)), pa.array(np.full(size, model.n)),
                pa.array(sums, pa.int64()).take(pa.array(np.repeat(np.arange(batch.num_rows), k))), pa.array(projected(batch.column(1), model, k).ravel()),
                pa.array(np.tile(explained, batch.num_rows)), pa.array(np.full(size, error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, schema)


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings, up to 32 components; cases as in whiten()."""
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
