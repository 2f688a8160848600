"""Whitening of embeddings by shifted Cholesky QR.

The rows X, centred, are orthogonalised in three passes over the data. Each pass sums the Gram matrix of X solved by
all factors so far (triangular solves within the tasks), and its Cholesky factor is the next one. The first factor is
taken of the Gram matrix shifted by a little, so that it exists however badly the columns are conditioned; the other
two make up for the shift and bring the rows to orthogonality at machine precision. The singular values and right
vectors of R, the product of the factors, are those of X: covariance eigenvalues are their squares over n. The Gram
matrix of X alone would have squared the condition number.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

SCALE, OFFSET = 64, 1_000_000
LARGEST = float(1 << 45)  # of a component; beyond, whole numbers would not stay exact when centred
BLOCK_ROWS = 4096
PASSES = 3


@dataclass(frozen=True)
class Whitening:
    """For vectors of one length: how many, their sums, eigenvalues (falling), trace, components as columns."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    trace: float
    vectors: np.ndarray

    @property
    def solid(self) -> np.ndarray:
        """Which components have a variance above what rounding leaves of none."""
        return self.values > float(self.values[0]) * (len(self.sums) * 2.0**-46) ** 2


def whole_numbers(embeddings: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id and x, floor(64 c) + 1000000 of each component c as long, of the rows that take part.

    Vectors that are null or hold a null, NaN, infinite or huge (over 2**45) component take no part. Ids may be null
    or repeated; every row counts.
    """
    rows = embeddings.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("c"))
    sound = F.forall("c", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) <= F.lit(LARGEST)))
    x = F.transform("c", lambda c: F.floor(c * SCALE).cast("long") + OFFSET)
    return rows.where(F.col("c").isNotNull()).where(sound).select("vec_id", x.alias("x"))


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and matrix of the vectors of each length in a batch, in bounded blocks."""
    column = batch.column("x")
    sizes = np.diff(np.asarray(column.offsets))
    flat, first = np.asarray(column.values), np.asarray(column.offsets)[:-1]
    for size in np.unique(sizes[sizes > 0]):
        rows = np.flatnonzero(sizes == size)
        for a in range(0, len(rows), BLOCK_ROWS):
            part = rows[a : a + BLOCK_ROWS]
            yield part, flat[first[part][:, None] + np.arange(size)]


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x less the mean, in doubles: the whole part of the mean is taken away exactly, then its fraction."""
    whole = sums // n
    return (x - whole).astype(np.float64) - (sums - whole * n) / n


def summed(rows: DataFrame, of_block: Callable[[np.ndarray], np.ndarray], kind: type = np.float64) -> dict[int, np.ndarray]:
    """For each length of vectors the sum over all blocks of the matrix that ``of_block`` makes of a block.

    Tasks add up their own blocks. Their sums go, line by line, to tasks that add them up as they come in, so that
    what reaches the driver is one matrix, whatever the number of rows and tasks.
    """
    spark = rows.sparkSession

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, x in _blocks(batch):
                part = of_block(x)
                held[x.shape[1]] = held[x.shape[1]] + part if x.shape[1] in held else part
        yield from lines({(size, i): line for size, m in held.items() for i, line in enumerate(m)})

    def lines(held: dict[tuple[int, int], np.ndarray]) -> Iterator[pa.RecordBatch]:
        keys = list(held)
        for a in range(0, len(keys), 256):
            some = keys[a : a + 256]
            columns = [pa.array([k[i] for k in some], pa.int32()) for i in (0, 1)]
            yield pa.record_batch([*columns, pa.array([held[k].tobytes() for k in some], pa.binary())], names=["size", "line", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for size, line, raw in zip(*(batch.column(c).to_pylist() for c in ("size", "line", "sums"))):
                part, key = np.frombuffer(raw, kind), (size, line)
                held[key] = held[key] + part if key in held else part
        yield from lines(held)

    schema = "size int, line int, sums binary"
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = rows.select("x").mapInArrow(own, schema).repartition(width, "size", "line").mapInArrow(add, schema)
    out: dict[int, dict[int, np.ndarray]] = {}
    for r in parts.collect():
        out.setdefault(r["size"], {})[r["line"]] = np.frombuffer(bytes(r["sums"]), kind)
    return {size: np.array([m[i] for i in range(len(m))]) for size, m in out.items()}


def fit(rows: DataFrame) -> dict[int, Whitening]:
    """A whitening for each length of vectors (usually one), from ``rows`` (x: array of long)."""
    spark = rows.sparkSession
    sums = summed(rows, lambda x: np.vstack([x.sum(axis=0), np.full(x.shape[1], len(x))]), np.int64)
    means = {size: (int(s[1, 0]), s[0]) for size, s in sums.items()}
    factors: dict[int, list[np.ndarray]] = {size: [] for size in means}
    for step in range(PASSES):
        held = spark.sparkContext.broadcast((means, factors))

        def gram(x: np.ndarray) -> np.ndarray:
            means, factors = held.value
            q = solved(centred(x, *means[x.shape[1]]), factors[x.shape[1]])
            return q.T @ q

        for size, g in summed(rows, gram).items():
            factors[size] = [*factors[size], cholesky_upper(g, means[size][0], shifted=step == 0)]
    out = {}
    for size, (n, s) in means.items():
        first, *later = factors[size]
        _, singular, right = np.linalg.svd(reduce(lambda r, factor: factor @ r, later, first))
        values = singular**2 / n
        out[size] = Whitening(n, s, values, float(values.sum()), right.T)
    return out


def solved(x: np.ndarray, factors: list[np.ndarray]) -> np.ndarray:
    """x R^-1 for one upper factor R after the other; a transposed factor is lower triangular."""
    for r in factors:
        x = solve_lower(r.T, x.T).T
    return x


def cholesky_upper(gram: np.ndarray, n: int, shifted: bool) -> np.ndarray:
    """R with R' R = gram, shifted by 11 (n d + d (d + 1)) u |gram| first if asked, or where rounding demands it."""
    size = len(gram)
    unit_ = 2.0**-53
    norm = max(float(np.linalg.norm(gram, 2)), 1e-300)
    # n d u is what rounding may add up to in one long sum; sums of blocks of sums stay below that of a block
    shift = 11 * (min(n, BLOCK_ROWS) * size + size * (size + 1)) * unit_ * norm
    added = shift if shifted else 0.0
    while True:
        try:
            return np.linalg.cholesky(gram + added * np.eye(size)).T
        except np.linalg.LinAlgError:
            added = max(2 * added, shift)


def solve_lower(lower: np.ndarray, right: np.ndarray, block: int = 32) -> np.ndarray:
    """The solution of lower @ y = right, by blocks from the top."""
    y = np.array(right, np.float64)
    for a in range(0, len(lower), block):
        b = min(a + block, len(lower))
        if a:
            y[a:b] -= lower[a:b, :a] @ y[:a]
        for i in range(a, b):
            y[i] = (y[i] - lower[i, a:i] @ y[a:i]) / lower[i, i]
    return y


def projected(x: np.ndarray, model: Whitening, components: int) -> np.ndarray:
    """Whitened values of the first components; NaN where a component has no variance."""
    k = min(components, x.shape[1])
    scale = np.sqrt(np.where(model.solid[:k], model.values[:k], np.nan))
    return centred(x, model.n, model.sums) @ model.vectors[:, :k] / scale


def identity_errors(rows: DataFrame, models: dict[int, Whitening], components: int) -> dict[int, float]:
    """Largest absolute entry of the whitened rows' covariance less the identity, over components with a variance."""
    held = rows.sparkSession.sparkContext.broadcast(models)

    def moments(x: np.ndarray) -> np.ndarray:
        w = projected(x, held.value[x.shape[1]], components)
        return np.vstack([w.T @ w, w.sum(axis=0)])

    out = {}
    for size, m in summed(rows, moments).items():
        mean = m[-1] / models[size].n
        error = m[:-1] / models[size].n - np.outer(mean, mean) - np.eye(len(mean))
        out[size] = float(np.nanmax(np.abs(error), initial=0.0))
    return out


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """Sum over the dimensions of (n x - S)^2 of each row, exact; None where it does not fit 64 bits."""
    rough = (centred(x, n, sums) ** 2).sum(axis=1) * float(n) ** 2
    if rough.max(initial=0) < 2.0**62 and float(np.abs(x).max(initial=0)) * n < 2.0**62:
        away = x * n - sums
        return (away * away).sum(axis=1).tolist()
    exact = [sum((n * v - s) ** 2 for v, s in zip(row, sums.tolist())) for row in x.tolist()]
    return [d if d < 1 << 63 else None for d in exact]


def whiten(embeddings: DataFrame, components: int = 32) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained and identity_error of each row and component.

    Rows as ``whole_numbers`` gives them; vectors of different lengths are different lists, each with its own fit.
    There are as many components as dimensions, at most ``components``. One without variance (all rows equal in that
    direction, one row alone) has ``whitened`` null, and ``explained`` null if nothing varies at all. ``deviation`` is
    null where it does not fit 64 bits. Empty vectors have no components; an empty table gives an empty result.
    """
    rows = whole_numbers(embeddings)
    models = fit(rows)
    errors = identity_errors(rows, models, components)
    held = rows.sparkSession.sparkContext.broadcast((models, errors))

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models, errors = held.value
        for batch in batches:
            for at, x in _blocks(batch):
                size = x.shape[1]
                model, k = models[size], min(components, size)
                whitened = projected(x, model, components).ravel()
                share = model.values[:k] / model.trace if model.trace > 0 else np.full(k, np.nan)
                every = lambda values, kind: pa.array(np.tile(values, len(at)), kind, from_pandas=True)
                deviation = pa.array(deviations(x, model.n, model.sums), pa.int64())
                each = pa.array(np.repeat(np.arange(len(at)), k))
                yield pa.record_batch(
                    [batch.column("vec_id").take(pa.array(at)).take(each), every(np.arange(1, k + 1), pa.int32()), pa.array(np.full(len(at) * k, model.n), pa.int64()),
                     deviation.take(each), pa.array(whitened, pa.float64(), from_pandas=True), every(share, pa.float64()), pa.array(np.full(len(at) * k, errors[size]), pa.float64())],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    return rows.mapInArrow(written, schema)
