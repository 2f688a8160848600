"""Near-duplicates by SimHash fingerprints and multi-index hashing.

A 64-bit fingerprint is cut into segments, each with its own table of distinct fingerprints. If two fingerprints
differ in r bits or fewer, then in some segment they differ in no more bits than that segment's radius, where the
radii plus one add up to r + 1. So each fingerprint looks up, in every table, the small Hamming ball around its own
segment, and what it fetches is verified by the distance of the whole fingerprints. A pair is looked up from one side
only. Links join distinct fingerprints, so copies never make pairs; components of links give the groups.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tillframe.llm.arrays import row_blocks, utf8
from tillframe.llm.components import components
from tillframe.session import materialize

SHINGLE_WORDS = 3
MOST_BITS = 2
BLOCK_BYTES = 1_000_000


def shingle_hashes(text: bytes, n: int = SHINGLE_WORDS) -> list[int]:
    """XXH64 (seed 42) of each run of n words; of all words together, if they are fewer; none for no word.

    A to Z are lower-cased and words are parted by the six ASCII white-space bytes, as bytes.lower and bytes.split do.
    """
    words = text.lower().split()
    if len(words) <= n:
        runs = [b" ".join(words)] if words else []
    else:
        runs = map(b" ".join, zip(*(words[k:] for k in range(n))))
    digest = xxhash.xxh64_intdigest
    return [digest(r, 42) for r in runs]


def fingerprints(data: np.ndarray, offsets: np.ndarray, n: int = SHINGLE_WORDS) -> np.ndarray:
    """The fingerprint of each text: a bit is 1 if it is set in over half the shingle hashes."""
    out = np.zeros(len(offsets) - 1, np.uint64)
    weights = np.uint64(1) << np.arange(64, dtype=np.uint64)
    for a, b in row_blocks(np.diff(offsets), BLOCK_BYTES):
        raw = data[offsets[a] : offsets[b]].tobytes()
        cuts = (offsets[a : b + 1] - offsets[a]).tolist()
        hashes = [shingle_hashes(raw[i:j], n) for i, j in zip(cuts, cuts[1:])]
        counts = np.array([len(h) for h in hashes])
        filled = np.flatnonzero(counts)
        if not len(filled):
            continue
        joined = np.fromiter((x for h in hashes for x in h), np.uint64, int(counts.sum()))
        bits = np.unpackbits(joined.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        starts = np.concatenate(([0], np.cumsum(counts[filled])[:-1]))
        ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
        out[a + filled] = np.where(2 * ones > counts[filled][:, None], weights, np.uint64(0)).sum(axis=1, dtype=np.uint64)
    return out


def fingerprint_rows(docs: DataFrame, keep: list[str], n: int = SHINGLE_WORDS, text: str = "text") -> DataFrame:
    """Columns ``keep`` and the signed 64-bit fingerprint ``fp`` of each whole text (null counts as empty)."""

    def computed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = fingerprints(*utf8(batch.column("__text")), n).view(np.int64)
            yield pa.record_batch([*[batch.column(k) for k in keep], pa.array(fp)], names=[*keep, "fp"])

    return docs.select(*keep, F.col(text).alias("__text")).mapInArrow(computed, docs.select(*keep).schema.add("fp", "long"))


def segment_plan(most_bits: int, segments: int) -> list[tuple[int, int, int]]:
    """(lowest bit, width, radius) of each segment; the radii plus one add up to most_bits + 1."""
    sizes = [64 // segments + (i < 64 % segments) for i in range(segments)]
    shares = [(most_bits + 1) // segments + (i < (most_bits + 1) % segments) for i in range(segments)]
    return [(sum(sizes[:i]), sizes[i], shares[i] - 1) for i in range(segments) if shares[i]]


def near_pairs(prints: DataFrame, most_bits: int = MOST_BITS, segments: int = 2) -> DataFrame:
    """Links (a, b) between distinct fingerprints of a column ``fp`` that differ in ``most_bits`` bits or fewer."""
    tables, probes = None, None
    for i, (low, width, radius) in enumerate(segment_plan(most_bits, segments)):
        part = F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << width) - 1)) if width < 64 else F.col("fp")
        table = prints.select(F.lit(i).alias("segment"), part.alias("value"), F.col("fp").alias("b"))
        # Of two segments that differ, the one that has the highest differing bit looks up the other.
        flips = [sum(1 << k for k in bits) for r in range(1, radius + 1) for bits in combinations(range(width), r)]
        masks = F.array(*[F.lit(x).cast("long") for x in flips]) if flips else F.array().cast("array<bigint>")
        tops = F.filter(masks, lambda m: part.bitwiseAND(m) > (m - part.bitwiseAND(m)))
        ball = F.concat(F.array(F.lit(0).cast("long")), tops)
        probe = prints.select(F.lit(i).alias("segment"), part.alias("part"), F.col("fp").alias("a"), F.explode(ball).alias("mask"))
        probe = probe.select("segment", F.col("part").bitwiseXOR(F.col("mask")).alias("value"), "a", (F.col("mask") == 0).alias("same"))
        tables, probes = (table, probe) if tables is None else (tables.union(table), probes.union(probe))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= most_bits
    met = probes.join(tables, ["segment", "value"]).where(near & (F.col("a") != F.col("b")) & (~F.col("same") | (F.col("a") < F.col("b"))))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, most_bits: int = MOST_BITS, n: int = SHINGLE_WORDS, segments: int = 2) -> DataFrame:
    """doc_id, text_hash, fp, component_id and keep_hash of every row.

    component_id is the smallest doc_id reachable over links (null ids only stand for a group that has no other), and
    keep_hash the smallest text_hash (xxhash64 of the text) among that document's rows in the group: the copy to keep.
    Null and empty texts have fingerprint zero and are linked like any other.
    """
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    prints = materialize(fingerprint_rows(rows, ["doc_id", "text_hash"], n), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("first")
    distinct = materialize(prints.groupBy("fp").agg(first), "distinct-fingerprints")
    roots = components(near_pairs(distinct.select("fp"), most_bits, segments))
    grouped = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = grouped.groupBy("root").agg(F.min("first").alias("least"))
    of_print = grouped.select("fp", "root").join(least, "root").select(
        "fp", F.col("least.doc_id").alias("component_id"), F.col("least.text_hash").alias("keep_hash")
    )
    of_print = materialize(of_print, "components")  # a join with a table can be split where a fingerprint is hot
    return prints.join(of_print, "fp").select("doc_id", "text_hash", "fp", "component_id", "keep_hash")
