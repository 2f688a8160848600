"""Language identification with a string kernel.

Kernel of two texts: the number of character n-grams (n = 1 .. 3, a blended spectrum) present in both, divided by the
geometric mean of the numbers present in each. N-grams are hashed into 65,536 presence bits. A bounded sample of the
labelled rows gives landmarks; kernel values against them, whitened by the landmarks' own kernel matrix (Nystroem),
are the features of a ridge regression for each language against the rest. As the kernel is a scalar product of
presence vectors, landmarks and weights fold into one matrix, and a block of texts is scored by one matrix product.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tillframe.llm.arrays import code_points, letter_table, mixed, others, row_blocks
from tillframe.session import materialize

BITS = 16
LENGTHS = (1, 2, 3)
BLOCK_CHARS, BLOCK_ROWS = 400_000, 64


@dataclass(frozen=True)
class LanguageModel:
    """langs in order; grams: the presence bits that landmarks have; weights: grams x langs; bias: by language."""

    langs: tuple[str, ...]
    grams: np.ndarray
    weights: np.ndarray
    bias: np.ndarray


def presence(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of presence bits, and whether each text has a letter. Case is folded; non-letters count as one gap."""
    points, starts = code_points(["\n" + t.lower() for t in texts])  # a gap on either side
    letters = letter_table()[points]
    symbols = np.where((letters == 1) | (letters == 2), points, 0).astype(np.uint64)
    row = np.repeat(np.arange(len(texts)), np.diff(starts))
    gap = symbols == 0
    keep = ~gap
    keep[:1] = True
    keep[1:] |= ~gap[:-1] | (row[1:] != row[:-1])
    symbols, row = symbols[keep], row[keep]
    bits = np.zeros(len(texts) << BITS, bool)
    lettered = np.zeros(len(texts), bool)
    lettered[row[symbols > 0]] = True
    code = np.zeros(len(symbols), np.uint64)
    for n in LENGTHS:
        part = symbols[n - 1 :]
        code = part + np.uint64(0x10FFFF + n) * code[: len(part)] if n > 1 else part.copy()
        same = row[n - 1 :] == row[: len(part)]
        hashed = (mixed(code + np.uint64(n << 40)) >> np.uint64(64 - BITS)).astype(np.int64)
        solid = same & ((part > 0) | (n > 1))
        bits[(row[n - 1 :][solid] << BITS) + hashed[solid]] = True
    return bits.reshape(len(texts), -1), lettered


def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").to_pylist()
        grams = []
        for first, last in row_blocks(np.array([len(t) for t in texts]), BLOCK_CHARS, BLOCK_ROWS):
            grams += [np.flatnonzero(r).astype(np.int32) for r in presence(texts[first:last])[0]]
        yield pa.record_batch([batch.column("lang"), batch.column("u"), pa.array(grams, pa.list_(pa.int32()))], names=["lang", "u", "grams"])


def _normalised(grams: list[np.ndarray], columns: np.ndarray) -> np.ndarray:
    """Presence rows over the given bits, each divided by the root of its number of bits."""
    out = np.zeros((len(grams), 1 << BITS), np.float32)
    for i, g in enumerate(grams):
        out[i, g] = 1 / np.sqrt(max(len(g), 1))
    return out[:, columns]


def fit(labelled: DataFrame, sample_per_lang: int = 1000, landmarks: int = 192, ridge: float = 1e-3) -> LanguageModel | None:
    """Learn from a DataFrame (lang, text, u), u uniform in [0, 1) by row; None where no row is labelled.

    About ``sample_per_lang`` rows of each language (all, if fewer) and ``landmarks`` landmarks in all, one a language
    at least, are used: the bound on what is fitted. The rows' presence bits are written once to the shared folder.
    """
    labelled = labelled.where("lang is not null and text is not null")
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    langs = tuple(sorted(counts))
    share = F.create_map(*[x for lang in langs for x in (F.lit(lang), F.lit(1.0 / counts[lang]))])[F.col("lang")]
    sample = labelled.withColumn("u", F.col("u") / share).where(F.col("u") < sample_per_lang)
    profiles = materialize(
        sample.mapInArrow(_profiles, "lang string, u double, grams array<int>").repartition(8, "u"), "language-sample"
    )
    each = max(1, landmarks // len(langs))
    chosen = [r for r in profiles.where(F.col("u") < 2 * each).collect()]
    by_lang = {lang: sorted((r for r in chosen if r["lang"] == lang), key=lambda r: r["u"])[:each] for lang in langs}
    marks = [np.array(r["grams"], np.int64) for lang in langs for r in by_lang[lang]]
    marks = marks or [np.array(r["grams"], np.int64) for r in profiles.orderBy("u").limit(each).collect()]
    columns = np.unique(np.concatenate([*marks, np.zeros(1, np.int64)]))
    points = _normalised(marks, columns)
    values, vectors = np.linalg.eigh((points @ points.T).astype(np.float64))
    solid = values > 1e-6 * max(values.max(), 1e-9)
    whiten = vectors[:, solid] / np.sqrt(values[solid])
    size = whiten.shape[1] + 1
    place = {lang: i for i, lang in enumerate(langs)}

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, target = np.zeros((size, size)), np.zeros((size, len(langs)))
        for batch in batches:
            grams, names = batch.column("grams"), batch.column("lang").to_pylist()
            for first in range(0, batch.num_rows, BLOCK_ROWS):
                rows = [np.asarray(g.values) for g in grams[first : first + BLOCK_ROWS]]
                kernel = _normalised(rows, columns) @ points.T
                features = np.hstack([kernel @ whiten, np.ones((len(rows), 1))])
                wanted = np.full((len(rows), len(langs)), -1.0)
                wanted[np.arange(len(rows)), [place[x] for x in names[first : first + BLOCK_ROWS]]] = 1
                gram += features.T @ features
                target += features.T @ wanted
        yield pa.record_batch([pa.array([gram.tobytes()]), pa.array([target.tobytes()])], names=["gram", "target"])

    parts = profiles.coalesce(8).mapInArrow(sums, "gram binary, target binary").collect()
    gram = sum(np.frombuffer(r["gram"]).reshape(size, size) for r in parts)
    target = sum(np.frombuffer(r["target"]).reshape(size, len(langs)) for r in parts)
    beta = np.linalg.solve(gram + ridge * max(gram[-1, -1], 1) * np.eye(size), target)
    weights = points.T @ (whiten @ beta[:-1])
    return LanguageModel(langs, columns, weights.astype(np.float32), beta[-1])


def predict(texts: list[str | None], model: LanguageModel | None) -> tuple[list[str], np.ndarray]:
    """Language and score of each text; ``und`` and 0 where the text is null or has no letter, or nothing was learned."""
    langs, scores = ["und"] * len(texts), np.zeros(len(texts))
    if model is None:
        return langs, scores
    texts = [t or "" for t in texts]
    for first, last in row_blocks(np.array([len(t) for t in texts]), BLOCK_CHARS, BLOCK_ROWS):
        bits, lettered = presence(texts[first:last])
        norm = np.sqrt(np.maximum(bits.sum(axis=1), 1))[:, None]
        values = bits[:, model.grams].astype(np.float32) @ model.weights / norm + model.bias
        best = values.argmax(axis=1)
        top = np.clip((1 + values[np.arange(len(best)), best]) / 2, 0, 1)
        for i in np.flatnonzero(lettered):
            langs[first + i], scores[first + i] = model.langs[best[i]], top[i]
    return langs, scores


def identify(docs: DataFrame, model: LanguageModel | None, keep: list[str], text: str = "text") -> DataFrame:
    """Columns ``keep`` of each row with lang_pred and score; whole texts, null and empty ones included.

    A kept column named like an output gives way to it. An empty table gives an empty result.
    """
    keep = others(keep, "lang_pred", "score")
    held = docs.sparkSession.sparkContext.broadcast(model)
    fields = docs.select(*keep).schema

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = predict(batch.column("__text").to_pylist(), held.value)
            arrays = [batch.column(k) for k in keep]
            yield pa.record_batch([*arrays, pa.array(langs, pa.string()), pa.array(scores)], names=[*keep, "lang_pred", "score"])

    out = fields.add("lang_pred", "string").add("score", "double")
    return docs.select(*keep, F.col(text).alias("__text")).mapInArrow(scored, out)


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """Whether crc32 of the id as text leaves the remainder ``part``; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))


def train_on_documents(docs: DataFrame, **settings) -> LanguageModel | None:
    """Learn from the rows of ``documents`` that are not held out (crc32 of the id, modulo 4, is not 2)."""
    rows = docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), 4, 2))
    place = F.xxhash64(F.lit("language sample"), "doc_id", F.monotonically_increasing_id())
    return fit(rows.select("lang", "text", (F.pmod(place, F.lit(1 << 40)) / float(1 << 40)).alias("u")), **settings)
