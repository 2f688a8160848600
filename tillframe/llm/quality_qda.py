"""Document quality by regularised quadratic discriminant analysis.

Each whole text becomes a short vector of transformed statistics (logarithms of counts, arcsines of shares). Each
class gets a mean and a covariance shrunk towards the pooled one and a multiple of the identity; the score is the
posterior from the difference of the two Gaussian log densities, by Mahalanobis distances with cached inverse
Cholesky factors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tillframe.llm.arrays import code_points, letter_table, others, row_blocks, span_hashes, word_spans
from tillframe.llm.language_kernel import held_out
from tillframe.session import materialize

BLOCK_CHARS = 1_000_000
ADDERS = 16
FEATURES = (
    "chars", "words", "word_length", "word_spread", "upper", "digit", "symbol", "space", "unlettered", "symbol_end",
    "distinct", "repeated", "line_words", "lines_repeated", "capital_start", "longest_run",
)


@dataclass(frozen=True)
class QualityModel:
    """For label 0 and 1: mean, inverse Cholesky factor, log determinant, log prior; prior alone if a class is missing."""

    prior: float
    means: tuple[np.ndarray, ...] = ()
    whiten: tuple[np.ndarray, ...] = ()
    log_det: tuple[float, ...] = ()
    log_prior: tuple[float, ...] = ()


def statistics(texts: list[str]) -> np.ndarray:
    """One row of transformed statistics a text; an empty text has zeros throughout its counts."""
    n = len(texts)
    points, starts = code_points(texts)
    kinds = letter_table()[points]
    chars = np.diff(starts) - 1
    row_of = np.repeat(np.arange(n), np.diff(starts))

    def per_row(mask: np.ndarray) -> np.ndarray:
        return np.bincount(row_of[mask], minlength=n)

    def share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
        return np.arcsin(np.sqrt(np.clip(part / np.maximum(whole, 1), 0, 1)))

    lettered = (kinds == 1) | (kinds == 2)
    spaces = per_row(kinds == 4) - 1  # the separator is one
    first, last = word_spans(kinds != 4)
    row, length = row_of[first], last - first
    words = np.bincount(row, minlength=n)
    mean = np.bincount(row, length, n) / np.maximum(words, 1)
    spread = np.sqrt(np.maximum(np.bincount(row, length.astype(float) ** 2, n) / np.maximum(words, 1) - mean**2, 0))
    counted = np.concatenate(([0], np.cumsum(lettered)))
    bare = np.bincount(row[counted[last] == counted[first]], minlength=n)
    plain_end = np.isin(points[last - 1], np.array([ord(c) for c in ".,;:?"], np.uint32))
    odd_end = np.bincount(row[(kinds[last - 1] == 0) & ~plain_end], minlength=n)
    hashes = span_hashes(points, first, last)
    order = np.lexsort((hashes, row))
    h, r = hashes[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    distinct = np.bincount(r[new], minlength=n)
    again = np.zeros(len(hashes), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
    repeated = np.bincount(row[again], minlength=n)
    group = np.cumsum(~again)
    run = np.zeros(n)
    if len(group):
        np.maximum.at(run, row, np.bincount(group)[group])
    line_first, line_last = word_spans(points != 10)
    line_row = row_of[line_first]
    lines = np.bincount(line_row, minlength=n)
    line_hash = span_hashes(points, line_first, line_last)
    order = np.lexsort((line_hash, line_row))
    lh, lr = line_hash[order], line_row[order]
    old = np.zeros(len(lh), bool)
    old[1:] = (lh[1:] == lh[:-1]) & (lr[1:] == lr[:-1])
    return np.column_stack(
        [
            np.log1p(chars), np.log1p(words), np.log1p(mean), np.log1p(spread), share(per_row(kinds == 2), per_row(lettered)),
            share(per_row(kinds == 3), chars), share(per_row(kinds == 0), chars), share(spaces, chars), share(bare, words),
            share(odd_end, words), share(distinct, words), share(repeated, words), np.log1p(words / np.maximum(lines, 1)),
            share(np.bincount(lr[old], minlength=n), lines), share(np.bincount(row[kinds[first] == 2], minlength=n), words),
            np.log1p(run),
        ]
    )


def measure(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """Columns ``keep`` and ``x``, the statistics of each whole text (null counts as empty).

    A kept column named x gives way to it. An empty table gives an empty result.
    """
    keep = others(keep, "x")

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("__text").to_pylist()]
            rows = [statistics(texts[a:b]) for a, b in row_blocks(np.array([len(t) for t in texts]), BLOCK_CHARS)]
            x = np.vstack(rows) if rows else np.zeros((0, len(FEATURES)))
            flat = pa.array(x.ravel())
            lists = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * len(FEATURES), flat)
            yield pa.record_batch([*[batch.column(k) for k in keep], lists], names=[*keep, "x"])

    schema = docs.select(*keep).schema.add("x", T.ArrayType(T.DoubleType()))
    return docs.select(*keep, F.col(text).alias("__text")).mapInArrow(measured, schema)


def fit(rows: DataFrame, shrink: float = 0.1, floor: float = 1e-3) -> QualityModel:
    """Learn from a DataFrame (label int, x array<double>), by sums over each class.

    Tasks add up their own rows, a few further tasks add up those sums as they come in, and the driver gets two small
    rows of each of these, whatever the number of rows and tasks.
    """
    size = len(FEATURES)

    def batch_of(held: dict[int, list]) -> Iterator[pa.RecordBatch]:
        for label, (n, s, ss) in held.items():
            yield pa.record_batch([pa.array([label]), pa.array([n]), pa.array([s.tobytes()]), pa.array([ss.tobytes()])], names=["label", "n", "s", "ss"])

    def none() -> list:
        return [0, np.zeros(size), np.zeros((size, size))]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            labels = batch.column("label").to_numpy(zero_copy_only=False)
            x = np.asarray(batch.column("x").flatten()).reshape(-1, size)
            for label in np.unique(labels):
                part, old = x[labels == label], held.setdefault(int(label), none())
                old[0] += len(part)
                old[1] += part.sum(axis=0)
                old[2] += part.T @ part
        yield from batch_of(held)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for label, n, s, ss in zip(*(batch.column(c).to_pylist() for c in ("label", "n", "s", "ss"))):
                old = held.setdefault(label, none())
                old[0] += n
                old[1] += np.frombuffer(s)
                old[2] += np.frombuffer(ss).reshape(size, size)
        yield from batch_of(held)

    clean, schema = rows.where("label in (0, 1)"), "label long, n long, s binary, ss binary"
    parts = clean.mapInArrow(sums, schema).withColumn("adder", F.pmod(F.spark_partition_id(), F.lit(ADDERS))).repartition(ADDERS, "adder")
    n, s, ss = [0, 0], [np.zeros(size), np.zeros(size)], [np.zeros((size, size)), np.zeros((size, size))]
    for r in parts.drop("adder").mapInArrow(added, schema).collect():
        n[r["label"]] += r["n"]
        s[r["label"]] += np.frombuffer(r["s"])
        ss[r["label"]] += np.frombuffer(r["ss"]).reshape(size, size)
    prior = (n[1] + 1) / (n[0] + n[1] + 2)
    if min(n) < 2:
        return QualityModel(prior)
    means = [s[k] / n[k] for k in (0, 1)]
    scatter = [ss[k] - n[k] * np.outer(means[k], means[k]) for k in (0, 1)]
    pooled = (scatter[0] + scatter[1]) / (n[0] + n[1])
    whiten, log_det = [], []
    for k in (0, 1):
        own = scatter[k] / n[k]
        weight = min(1.0, shrink + size / n[k])  # fewer rows lean more on the pooled covariance
        shrunk = (1 - weight) * own + weight * pooled + floor * np.eye(size) * max(np.trace(pooled) / size, 1e-6)
        factor = np.linalg.cholesky(shrunk)
        whiten.append(np.linalg.inv(factor))
        log_det.append(2 * float(np.log(np.diag(factor)).sum()))
    return QualityModel(prior, tuple(means), tuple(whiten), tuple(log_det), (float(np.log(1 - prior)), float(np.log(prior))))


def score_vectors(x: np.ndarray, model: QualityModel) -> np.ndarray:
    """Posterior of label 1 for each row of statistics."""
    if not model.means:
        return np.full(len(x), model.prior)
    dense = []
    for k in (0, 1):
        away = (x - model.means[k]) @ model.whiten[k].T
        dense.append(model.log_prior[k] - 0.5 * ((away**2).sum(axis=1) + model.log_det[k]))
    return 1 / (1 + np.exp(np.clip(dense[0] - dense[1], -700, 700)))


def score(measured: DataFrame, model: QualityModel, keep: list[str]) -> DataFrame:
    """Columns ``keep`` and score (0 to 1) of a DataFrame that has ``x``; a kept column named score gives way to it."""
    keep = others(keep, "score")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column("x").flatten()).reshape(-1, len(FEATURES))
            yield pa.record_batch([*[batch.column(k) for k in keep], pa.array(score_vectors(x, model))], names=[*keep, "score"])

    return measured.select(*keep, "x").mapInArrow(scored, measured.select(*keep).schema.add("score", "double"))


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``.

    Labels of held-out rows (crc32 of the id, modulo 5, is 0) are not learned from, nor rows with a null id or label;
    a row that is labelled twice counts twice. With fewer than two rows of a label every score is the prior.
    """
    rows = docs.select("doc_id", "text", held_out(F.col("doc_id"), 5, 0).alias("held_out"))
    measured = materialize(measure(rows, ["doc_id", "held_out"]), "quality-statistics")
    known = labels.select("doc_id", F.col("quality").cast("int").alias("label"))
    model = fit(measured.where(~F.col("held_out")).join(known, "doc_id").select("label", "x"))
    return score(measured, model, ["doc_id", "held_out"]).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
