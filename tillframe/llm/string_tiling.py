"""Benchmark decontamination by greedy string tiling.

Words are compared by 64-bit hashes. Every run of five benchmark words is a seed; a document keeps only the stretches
that seeds may touch, found by a bit map of fixed size that is built from the whole benchmark. A join on the exact
seed hash then gives the pairs of document and item that share a seed, and each pair is tiled: the longest matches are
sought by running Karp-Rabin at a falling search length, marked without overlap in document and item, and the marked
share of the item's words is its coverage, in whatever order the document has the passages.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tillframe.llm.arrays import code_points, letter_table, mixed, row_blocks, span_hashes, word_spans
from tillframe.session import materialize

SEED_WORDS = 5
COVERAGE = 0.8
MAP_BITS = 1 << 25
BLOCK_CHARS = 1_000_000


def word_rows(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (runs of letters and digits, case folded) of all texts, and the text of each."""
    points, starts = code_points([t.lower() for t in texts])
    kinds = letter_table()[points]
    first, last = word_spans((kinds > 0) & (kinds < 4))
    return span_hashes(points, first, last), np.searchsorted(starts, first, side="right") - 1


def seeds(words: np.ndarray, n: int = SEED_WORDS) -> np.ndarray:
    """The hash of each run of n words."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + words[k : k + len(out)]
    return mixed(out)


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words, row = word_rows([t or "" for t in batch.column("text").to_pylist()])
        parts = np.split(words.view(np.int64), np.searchsorted(row, np.arange(1, batch.num_rows)))
        found = [np.unique(seeds(p.view(np.uint64))).view(np.int64) for p in parts]
        kind = pa.list_(pa.int64())
        yield pa.record_batch([batch.column("item_id"), pa.array(parts, kind), pa.array(found, kind)], names=["item_id", "item_words", "seeds"])


def _bit_map(items: DataFrame) -> np.ndarray:
    """The seeds' bits, MAP_BITS of them whatever the benchmark's size; built in the cluster, 4 KB a row.

    Spark's bit maps count buckets and bits from one.
    """
    places = items.select(F.explode("seeds").alias("seed")).select((F.pmod("seed", F.lit(MAP_BITS)) + 1).alias("bit"))
    rows = places.groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("map")
    )
    bits = np.zeros(MAP_BITS // 8 + 4096, np.uint8)
    for r in rows.collect():
        at = (r["bucket"] - 1) * 4096
        bits[at : at + len(r["map"])] = np.frombuffer(r["map"], np.uint8)
    return bits


def touched(words: np.ndarray, row: np.ndarray, n_rows: int, bits: np.ndarray) -> list[np.ndarray | None]:
    """For each text the words that seeds may touch, stretches apart by a zero; None where there are none."""
    out: list[np.ndarray | None] = [None] * n_rows
    found = seeds(words)
    if not len(found):
        return out
    place = (found.view(np.int64) % MAP_BITS).astype(np.int64)  # numpy's modulo is never negative, as pmod
    hit = (bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 > 0
    hit &= row[SEED_WORDS - 1 :] == row[: len(found)]
    if not hit.any():
        return out
    inside = np.zeros(len(words), bool)
    for k in range(SEED_WORDS):
        inside[k : k + len(hit)] |= hit
    first, last = word_spans(inside)
    for a, b in zip(first.tolist(), last.tolist()):
        for x in np.split(np.arange(a, b), np.flatnonzero(np.diff(row[a:b])) + 1):  # stretches of neighbouring texts
            i, piece = row[x[0]], np.append(words[x], np.uint64(0))
            out[i] = piece if out[i] is None else np.concatenate((out[i], piece))
    return out


def tiles(text: np.ndarray, item: np.ndarray, least: int = SEED_WORDS) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (place in text, place in item, length) of non-overlapping matches, longest first.

    Zeros in ``text`` match nothing. Running Karp-Rabin: at search length s, the hashes of s unmarked words of the
    text are looked up for each s unmarked words of the item and the matches are extended; a match of twice s restarts
    the search at its length, else s is halved once its matches are marked.
    """
    text, item = text.tolist(), item.tolist()
    free_text, free_item = [w != 0 for w in text], [True] * len(item)
    found, length = [], max(least, min(len(text), len(item)) // 2)
    while True:
        table = defaultdict(list)
        for k, h in _running(text, free_text, length):
            table[h].append(k)
        matches, longest = [], 0
        for j, h in _running(item, free_item, length):
            for k in table.get(h, ()):
                n = 0
                while k + n < len(text) and j + n < len(item) and free_text[k + n] and free_item[j + n] and text[k + n] == item[j + n]:
                    n += 1
                if n >= length:
                    matches.append((n, k, j))
                    longest = max(longest, n)
        if longest >= 2 * length:
            length = longest
            continue
        for n, k, j in sorted(matches, key=lambda m: (-m[0], m[1], m[2])):
            if all(free_text[k : k + n]) and all(free_item[j : j + n]):
                found.append((k, j, n))
                free_text[k : k + n] = free_item[j : j + n] = [False] * n
        if length == least:
            return found
        length = max(least, length // 2)


def _running(words: list[int], free: list[bool], n: int) -> Iterator[tuple[int, int]]:
    """Place and Karp-Rabin hash of each run of n free words."""
    prime, base = (1 << 61) - 1, 1_000_003
    top, h, run = pow(base, n, prime), 0, 0
    for k, w in enumerate(words):
        if not free[k]:
            h = run = 0
            continue
        h, run = (h * base + w) % prime, run + 1
        if run > n:
            h = (h - words[k - n] * top) % prime
        if run >= n:
            yield k - n + 1, h


def coverage(text: np.ndarray, item: np.ndarray) -> float:
    """The share of the item's words that tiles cover."""
    return sum(n for _, _, n in tiles(text, item)) / max(len(item), 1)


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = COVERAGE) -> DataFrame:
    """doc_id, text_hash, n_words, item_id, coverage and contaminated of every row of ``docs``.

    item_id is the item with the highest coverage (ties: the smallest id), null with coverage 0 where no seed is shared.
    Null and empty texts have no words and are clean; a benchmark row without id or text takes no part; an item of under five words has no seed and matches nothing;
    rows of the same id and text get the same result. text_hash is xxhash64 of the text.
    """
    spark = docs.sparkSession
    items = materialize(benchmark.where("text is not null and item_id is not null").select(F.col("item_id").cast("long"), "text").mapInArrow(_items, "item_id long, item_words array<long>, seeds array<long>"), "benchmark-items")
    held = spark.sparkContext.broadcast(_bit_map(items))

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            parts, counts = [], []
            for a, b in row_blocks(np.array([len(t) for t in texts]), BLOCK_CHARS):
                words, row = word_rows(texts[a:b])
                counts += np.bincount(row, minlength=b - a).tolist()
                parts += [p if p is None else p.view(np.int64) for p in touched(words, row, b - a, held.value)]
            yield pa.record_batch(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array(counts, pa.int64()), pa.array(parts, pa.list_(pa.int64()))],
                names=["doc_id", "text_hash", "n_words", "doc_words"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text")
    scanned = materialize(rows.mapInArrow(kept, "doc_id long, text_hash long, n_words long, doc_words array<long>"), "touched-words")
    # Rows of one id and text are tiled once; a text's stretches depend on its words alone.
    distinct = scanned.where("doc_words is not null").groupBy("text_hash", "n_words").agg(F.min("doc_words").alias("doc_words"))

    def doc_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(seeds(np.asarray(w.values).view(np.uint64))).view(np.int64) for w in batch.column("doc_words")]
            yield pa.record_batch([batch.column("text_hash"), batch.column("n_words"), pa.array(found, pa.list_(pa.int64()))], names=["text_hash", "n_words", "seeds"])

    stretches = materialize(distinct, "distinct-stretches")
    shared = stretches.mapInArrow(doc_seeds, "text_hash long, n_words long, seeds array<long>").select("text_hash", "n_words", F.explode("seeds").alias("seed"))
    pairs = shared.join(items.select("item_id", F.explode("seeds").alias("seed")), "seed").select("text_hash", "n_words", "item_id").distinct()
    joined = pairs.join(stretches, ["text_hash", "n_words"]).join(items.select("item_id", "item_words"), "item_id")

    def tiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs_, items_ = batch.column("doc_words"), batch.column("item_words")
            share = [coverage(np.asarray(d.values), np.asarray(i.values)) for d, i in zip(docs_, items_)]
            yield pa.record_batch([batch.column(c) for c in ("text_hash", "n_words", "item_id")] + [pa.array(share, pa.float64())], names=["text_hash", "n_words", "item_id", "coverage"])

    covered = joined.mapInArrow(tiled, "text_hash long, n_words long, item_id long, coverage double")
    best = covered.groupBy("text_hash", "n_words").agg(F.max(F.struct("coverage", (-F.col("item_id")).alias("back"))).alias("top"))
    best = materialize(best, "coverage")  # a join with a table can be split where a text is hot
    return scanned.drop("doc_words").join(best, ["text_hash", "n_words"], "left").select(
        "doc_id", "text_hash", "n_words", (-F.col("top.back")).alias("item_id"),
        F.coalesce("top.coverage", F.lit(0.0)).alias("coverage"),
        (F.coalesce("top.coverage", F.lit(0.0)) >= threshold).alias("contaminated"),
    )
