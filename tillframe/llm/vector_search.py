"""Exact top-k by inner product, pruned with segment statistics at several resolutions.

A vector is cut into 1, 4, 16, ... segments, down to segments of two components and of one. With a segment's mean m and
deviation s over its w components, |q - x|^2 is at least the sum of w ((m_q - m_x)^2 + (s_q - s_x)^2), so the inner
product is at most the sum of w (m_q m_x + s_q s_x). The bounds are taken coarse to fine, each for what the ones before
have left; what none of them rules out against a query's k-th best score so far is scored exactly, in whole numbers.

Candidates are dealt by hash of their place into blocks, queries into groups, both of bounded size; a copy of each
query group meets each candidate block in one task, and each query's best of every block are ranked again. This is a
search of a stated query set against all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tillframe.session import materialize

BLOCK_VALUES = 1 << 21  # components in a block of candidates or a group of queries
QUERY_STEP, CANDIDATE_STEP, FIRST_STEP = 128, 8192, 64
PAIRS_AT_ONCE = 1 << 15
DENSE = 0.05  # where more pairs than this are left, a bound is taken for all pairs in one product
NO_ID = np.iinfo(np.int64).max


def quantized(embeddings: DataFrame) -> DataFrame:
    """vec_id, vector (floor(256 x) of each component, as long) and dim, without rows that take no part.

    Vectors that are null or hold a null, NaN or infinite component take no part. Every other row does, repeated ones
    each for itself and those without an id too.
    """
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256).cast("long"))
    rows = embeddings.where(F.col("embedding").isNotNull()).where(sound)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("vector")).withColumn("dim", F.size("vector"))


def resolutions(dim: int) -> list[int]:
    """Widths of the segments, coarse to fine: a quarter each time, then two, then one."""
    widths, width = [], max(dim, 1)
    while width > 2:
        widths.append(width)
        width = -(-width // 4)
    return [*widths, 2, 1] if dim > 1 else [1]


def features(vectors: np.ndarray, width: int) -> np.ndarray:
    """Root of the width times mean and deviation of each segment; the rest of a division is filled with zeros.

    Segments of one component have no deviation.
    """
    n, dim = vectors.shape
    if width == 1:
        return vectors.astype(np.float64)
    segments = -(-dim // width)
    padded = np.zeros((n, width * segments))
    padded[:, :dim] = vectors
    cut = padded.reshape(n, segments, width)
    return np.hstack([cut.mean(axis=2), cut.std(axis=2)]) * np.sqrt(width)


def _pairwise(left: np.ndarray, right: np.ndarray, q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Scalar product of row q of left and row x of right, for each pair, some at a time."""
    out = np.empty(len(q), left.dtype)
    for a in range(0, len(q), PAIRS_AT_ONCE):
        b = a + PAIRS_AT_ONCE
        out[a:b] = np.einsum("ij,ij->i", left[q[a:b]], right[x[a:b]])
    return out


def _steps(n: int) -> Iterator[tuple[int, int]]:
    """Ranges of candidates, short ones first: once a query has k, candidates that only equal the k-th are ruled out."""
    first, step = 0, FIRST_STEP
    while first < n:
        yield first, min(first + step, n)
        first, step = first + step, min(2 * step, CANDIDATE_STEP)


def best_of_block(
    queries: np.ndarray, query_places: np.ndarray, vectors: np.ndarray, ids: np.ndarray, places: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query row, candidate row, score) of each query's k best among the candidates, and how many were scored exactly.

    Ties go to the smaller id, then to the smaller place. The candidate in a query's own place is left out.
    """
    order = np.lexsort((places, ids))
    vectors, places = vectors[order], places[order]
    q_all, x_all = queries.astype(np.float64), vectors.astype(np.float64)
    largest = np.abs(q_all).max(initial=0) * np.abs(x_all).max(initial=0) * max(q_all.shape[1], 1)
    if largest >= 2**53:  # beyond that, doubles are not exact
        q_exact, x_exact = queries.astype(np.int64), vectors.astype(np.int64)
    else:
        q_exact, x_exact = q_all, x_all
    slack = 1e-9 * largest + 1e-3
    widths = resolutions(q_all.shape[1])
    q_levels = [features(q_all, w) for w in widths]
    x_levels = [features(x_all, w) for w in widths]
    found_q, found_x, found_s, scored = [], [], [], 0
    for a in range(0, len(queries), QUERY_STEP):
        b = min(a + QUERY_STEP, len(queries))
        floor = np.full(b - a, -np.inf)  # a score that is needed, to come in
        held = (np.zeros(0, np.int64),) * 3
        few = min(k + 1, len(vectors), CANDIDATE_STEP)
        if few > k:  # the most promising of some by the finest bound give a first floor
            near = np.argpartition(-(q_levels[-1][a:b] @ x_levels[-1][:CANDIDATE_STEP].T), few - 1, axis=1)[:, :few]
            q, x = np.repeat(np.arange(a, b), few), near.ravel()
            s = _pairwise(q_exact, x_exact, q, x).astype(np.float64)
            s = np.where(query_places[q] == places[x], -np.inf, s).reshape(b - a, few)
            scored += len(q)
            floor = -np.partition(-s, k - 1, axis=1)[:, k - 1]
        for c, d in _steps(len(vectors)):
            q = x = None
            for q_level, x_level in zip(q_levels, x_levels):
                if q is None:
                    q, x = np.nonzero(q_level[a:b] @ x_level[c:d].T + slack >= floor[:, None])
                    continue
                if len(q) > DENSE * (b - a) * (d - c):
                    bound = (q_level[a:b] @ x_level[c:d].T)[q, x]
                else:
                    bound = _pairwise(q_level[a:b], x_level[c:d], q, x)
                alive = bound + slack >= floor[q]
                q, x = q[alive], x[alive]
            s = _pairwise(q_exact, x_exact, q + a, x + c).astype(np.int64)
            scored += len(q)
            keep = (s >= floor[q]) & (query_places[q + a] != places[x + c])
            q, x, s = (np.concatenate(pair) for pair in zip(held, (q[keep], x[keep] + c, s[keep])))
            rank = np.lexsort((x, -s, q))  # candidates are in order of their id
            q, x, s = q[rank], x[rank], s[rank]
            place = np.arange(len(q)) - np.searchsorted(q, q)
            held = q, x, s = q[place < k], x[place < k], s[place < k]
            full = place[place < k] == k - 1
            floor[q[full]] = s[full] + 1.0 if largest < 2**52 else s[full]  # an equal score later has the larger id
        found_q.append(held[0] + a)
        found_x.append(held[1])
        found_s.append(held[2])
    q, x, s = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (found_q, found_x, found_s))
    return q, order[x], s, scored


def search(embeddings: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k rows with the highest inner product to each query.

    Queries are the rows whose vec_id is divisible by ``every``; candidates are all rows of the same length but the
    query's own, rows of the same id or vector included. Ties go to the smaller vec_id, a null one last; a query has
    fewer rows where there are fewer candidates. Scores have to fit 64 bits. An empty table gives an empty result, and no
    other columns matter.
    """
    spark = embeddings.sparkSession
    rows = materialize(quantized(embeddings).withColumn("place", F.monotonically_increasing_id()), "search-vectors")
    asked = F.pmod(F.col("vec_id"), F.lit(every)) == 0
    size = rows.agg(F.count("*").alias("n"), F.count_if(asked).alias("q"), F.coalesce(F.max("dim"), F.lit(1)).alias("dim")).first()
    most = max(64, BLOCK_VALUES // max(size["dim"], 1))
    spread = min(spark.sparkContext.defaultParallelism, -(-size["n"] // 2048))
    blocks = max(1, spread, -(-size["n"] // most))
    groups = max(1, -(-size["q"] // most))
    dealt = lambda n: F.pmod(F.xxhash64("place"), F.lit(n)).cast("int")
    others = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    candidates = rows.withColumn("block", dealt(blocks)).withColumn("part", others(groups))
    queries = rows.where(asked).withColumn("part", dealt(groups)).withColumn("block", others(blocks))

    def matrix(table: pa.Table) -> np.ndarray:
        flat = table.column("vector").combine_chunks().flatten()
        return np.asarray(flat).reshape(table.num_rows, -1) if table.num_rows else np.zeros((0, 0), np.int64)

    def met(left: pa.Table, right: pa.Table) -> pa.Table:
        q, x, s = (np.zeros(0, np.int64),) * 3
        places = [np.asarray(t.column("place").combine_chunks()) for t in (left, right)]
        if left.num_rows and right.num_rows:
            ids = np.asarray(right.column("vec_id").combine_chunks().fill_null(NO_ID))
            q, x, s, _ = best_of_block(matrix(left), places[0], matrix(right), ids, places[1], k)
        take = [left.column("vec_id").take(pa.array(q)), pa.array(places[0][q]), right.column("vec_id").take(pa.array(x)), pa.array(places[1][x])]
        return pa.table([*take, pa.array(s)], names=["query_id", "query_place", "vec_id", "place", "score"])

    keys = ["dim", "block", "part"]
    schema = "query_id long, query_place long, vec_id long, place long, score long"
    best = queries.groupBy(*keys).cogroup(candidates.groupBy(*keys)).applyInArrow(met, schema)
    order = Window.partitionBy("query_place").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "place")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
