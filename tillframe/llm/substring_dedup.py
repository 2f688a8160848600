"""Removal of long repeated substrings over a whole corpus.

A byte goes if a string of a given length (400 bytes unless told otherwise) covers it that also starts anywhere else in
the corpus, the same text included.

1. *Runs.* Every window of that length has an anchor, the string of a few bytes in it (32 of 400) with the least hash.
   Neighbouring windows with the same anchor, and with the anchor in the same half of the window, are a run. All
   windows of a run share a core of half a window, whose place in a window depends on the window's content alone: equal
   windows, wherever they are, have equal cores. One row a run is written: the hash of its core and of all its bytes.
2. *Whole runs.* Runs with the same bytes are repeated as a whole. A core that occurs once is done with. What is left
   are runs whose core is repeated but whose bytes differ: the edges of copied passages.
3. *Edges.* They are read again, one copy of each, cut into finer runs (anchors in the same quarter, cores of three
   quarters), and brought together by core. In each group the core becomes one symbol between the bytes on both sides, and breadth-first backward
   extension on a Burrows-Wheeler transform, stopped at the length of a window, tells which windows are repeated
   (see interval_expansion).

A core shared by very many edges would make a group too large for one task; such groups are settled by the hash of
each single window instead, a count that spreads over all tasks. Copies of a text never come together: they are equal
whole runs, which are only counted. Cores, runs and windows are told apart by 128 bits of hash. Rows are known by
doc_id and the xxhash64 of the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tillframe.llm.arrays import mixed, powers, row_blocks, utf8
from tillframe.llm.interval_expansion import repeated_starts
from tillframe.session import materialize

LENGTH = 400
BLOCK_BYTES = 1_000_000
GROUP_EDGES = 4096
BATCH_SYMBOLS = 600_000
SALT_ROWS = 1 << 15
PLACE_BITS = 30


@dataclass(frozen=True)
class Windows:
    """The length of a window in bytes and what follows from it.

    ``anchor``: bytes of an anchor, 8 % of the window. ``reach``: places of an anchor in a window. ``coarse`` and
    ``fine``: how far anchors of one run may lie apart within their windows, a half and a quarter of the places.
    """

    length: int = LENGTH

    def __post_init__(self) -> None:
        if self.length < 8:
            raise ValueError("windows of under 8 bytes have no anchors worth the name")

    @property
    def anchor(self) -> int:
        return min(32, max(1, self.length * 2 // 25))

    @property
    def reach(self) -> int:
        return self.length - self.anchor + 1

    @property
    def coarse(self) -> int:
        return -(-self.reach // 2)

    @property
    def fine(self) -> int:
        return -(-self.reach // 4)

    def core(self, anchor: int, part: int, parts: int) -> tuple[int, int]:
        """Where the bytes shared by all windows of a part lie."""
        nearest, farthest = part * parts, min(part * parts + parts - 1, self.reach - 1)
        return anchor - nearest, anchor - farthest + self.length


def runs(data: np.ndarray, offsets: np.ndarray, shape: Windows, parts: int) -> tuple[np.ndarray, ...]:
    """Runs of windows in texts laid end to end: first window, last window, anchor and part, each an array.

    ``parts`` is the width of a part of the window: the anchor's place in the window, divided by it, is the part.
    """
    none = (np.zeros(0, np.int64),) * 4
    n, reach, length, size = len(data), shape.reach, shape.length, shape.anchor
    if n < length:
        return none
    up, down = powers(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTES[data] * up[:n], out=sums[1:])
    hashes = (sums[size:] - sums[:-size]) * down[: n - size + 1]
    hashes ^= hashes >> np.uint64(32)
    hashes *= np.uint64(0x94D049BB133111EB)
    place = np.uint64((1 << PLACE_BITS) - 1)
    hashes = (hashes & ~place) | np.arange(len(hashes), dtype=np.uint64)  # the first of equal ones is the least
    m = len(hashes)
    table = np.full(-(-m // reach) * reach, np.iinfo(np.uint64).max, np.uint64)
    table[:m] = hashes
    table = table.reshape(-1, reach)
    forward = np.minimum.accumulate(table, axis=1).ravel()
    backward = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    anchor = (np.minimum(backward[: m - reach + 1], forward[reach - 1 : m]) & place).astype(np.int64)
    change = np.zeros(n + 2, np.int32)
    long_ = np.diff(offsets) >= length
    change[offsets[:-1][long_]] += 1
    change[offsets[1:][long_] - length + 1] -= 1
    starts = np.flatnonzero(np.cumsum(change)[: len(anchor)] > 0)
    if not len(starts):
        return none
    anchor = anchor[starts]
    part = (anchor - starts) // parts
    new = np.concatenate(([True], (np.diff(anchor) != 0) | (np.diff(part) != 0) | (np.diff(starts) != 1)))
    heads = np.flatnonzero(new)
    tails = np.concatenate((heads[1:] - 1, [len(starts) - 1]))
    return starts[heads], starts[tails], anchor[heads], part[heads]


_BYTES = mixed(np.arange(1, 257, dtype=np.uint64))


def _halves(data: bytes, seed: int) -> tuple[int, int]:
    """128 bits of hash as two signed numbers."""
    both = xxhash.xxh3_128_intdigest(data, seed)
    return _signed(both >> 64), _signed(both & 0xFFFFFFFFFFFFFFFF)


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def run_rows(docs: DataFrame, shape: Windows) -> DataFrame:
    """key, key2 (hash of the core), bytes, bytes2 (hash of all bytes), doc_id, text_hash, first, windows of each run."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            ids, hashes = batch.column("doc_id"), batch.column("text_hash")
            for a, b in row_blocks(np.diff(offsets), BLOCK_BYTES):
                begin = offsets[a : b + 1] - offsets[a]
                raw = data[offsets[a] : offsets[b]]
                head, tail, anchor, part = runs(raw, begin, shape, shape.coarse)
                if not len(head):
                    continue
                view, digest = memoryview(raw.tobytes()), xxhash.xxh3_128_digest
                keys, wholes = [], []
                for h, t, x, p in zip(head.tolist(), tail.tolist(), anchor.tolist(), part.tolist()):
                    left, right = shape.core(x, p, shape.coarse)
                    keys.append(digest(view[left:right], p))
                    wholes.append(digest(view[h : t + shape.length]))
                halves = [np.frombuffer(b"".join(d), np.int64).reshape(-1, 2)[:, i] for d in (keys, wholes) for i in (0, 1)]
                row = np.searchsorted(begin, head, side="right") - 1
                take = pa.array(row + a)
                yield pa.record_batch(
                    [*[pa.array(np.ascontiguousarray(x)) for x in halves], ids.take(take), hashes.take(take), pa.array(head - begin[row]), pa.array((tail - head + 1).astype(np.int32))],
                    names=["key", "key2", "bytes", "bytes2", "doc_id", "text_hash", "first", "windows"],
                )

    return docs.mapInArrow(found, "key long, key2 long, bytes long, bytes2 long, doc_id long, text_hash long, first long, windows int")


def edge_rows(docs: DataFrame, wanted: DataFrame, shape: Windows) -> DataFrame:
    """The finer runs of the wanted runs of each text, with the bytes around their core.

    fine_key, fine_key2; settled (whether the run they are from is); doc_id, text_hash, first, windows; before and
    after: what its windows hold on both sides of the core. ``wanted`` has one list of runs a text.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            ids, hashes = batch.column("doc_id").to_pylist(), batch.column("text_hash").to_pylist()
            rows: list[tuple] = []
            for i, wanted_runs in enumerate(batch.column("runs").to_pylist()):
                raw = data[offsets[i] : offsets[i + 1]]
                for run in wanted_runs:
                    begin, windows = run["first"], run["windows"]
                    piece = raw[begin : begin + windows - 1 + shape.length]
                    view = piece.tobytes()
                    for h, t, x, p in zip(*(v.tolist() for v in runs(piece, np.array([0, len(piece)]), shape, shape.fine))):
                        left, right = shape.core(x, p, shape.fine)
                        rows.append((*_halves(view[left:right], p), run["settled"], ids[i], hashes[i], begin + h, t - h + 1, view[h:left], view[right : t + shape.length]))
                if len(rows) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _EDGE)], schema=_EDGE)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _EDGE)], schema=_EDGE)

    same = docs["doc_id"].eqNullSafe(wanted["doc_id"]) & (docs["text_hash"] == wanted["text_hash"])
    joined = docs.join(wanted, same).select(docs["doc_id"], docs["text_hash"], "text", "runs")
    return joined.mapInArrow(cut, _EDGE_SQL)


_EDGE = pa.schema(
    [("fine_key", pa.int64()), ("fine_key2", pa.int64()), ("settled", pa.bool_()), ("doc_id", pa.int64()), ("text_hash", pa.int64()),
     ("first", pa.int64()), ("windows", pa.int32()), ("before", pa.binary()), ("after", pa.binary())]
)
_EDGE_SQL = "fine_key long, fine_key2 long, settled boolean, doc_id long, text_hash long, first long, windows int, before binary, after binary"


def expand(groups: list[list[tuple[bytes, bytes, int]]]) -> list[list[np.ndarray]]:
    """For each edge (before, after, windows) of each group, which of its windows another edge of the group repeats."""
    pieces, symbol = [], 256
    for group in groups:
        symbol += 1
        for before, after, _ in group:
            piece = np.empty(len(before) + len(after) + 2, np.int64)
            piece[: len(before)] = np.frombuffer(before, np.uint8)
            piece[len(before) + 1 : -1] = np.frombuffer(after, np.uint8)
            piece[:-1] += 1
            piece[len(before)], piece[-1] = symbol, 0
            pieces.append(piece)
    symbols = np.concatenate(pieces)
    found: dict[int, np.ndarray] = {}
    # The length of a window in symbols is the same for all edges of a part: a window less its core, plus one.
    sizes = np.array([len(p) - 1 - w + 1 for p, (_, _, w) in zip(pieces, (e for g in groups for e in g))])
    for depth in np.unique(sizes).tolist():
        chosen = np.flatnonzero(sizes == depth)
        joined = symbols if len(chosen) == len(pieces) else np.concatenate([pieces[i] for i in chosen])
        marks = repeated_starts(joined, depth)
        at = np.concatenate(([0], np.cumsum([len(pieces[i]) for i in chosen])))
        for k, i in enumerate(chosen.tolist()):
            found[i] = marks[at[k] : at[k + 1]]
    out, i = [], 0
    for group in groups:
        out.append([found[i + k][:w] for k, (_, _, w) in enumerate(group)])
        i += len(group)
    return out


_SPAN = "doc_id long, text_hash long, start long, stop long"


def _span_batch(spans: list[tuple]) -> pa.RecordBatch:
    kinds = pa.schema([(c, pa.int64()) for c in ("doc_id", "text_hash", "start", "stop")])
    columns = zip(*spans) if spans else ([], [], [], [])
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=kinds)


def _expanded(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Spans of the unsettled edges that are repeated; rows come sorted by their core, so that groups are whole."""
    names = ("fine_key", "fine_key2", "doc_id", "text_hash", "first", "windows", "before", "after", "settled")
    rows = (row for b in batches for row in zip(*(b.column(c).to_pylist() for c in names)))
    groups: list[list[tuple]] = []
    held = 0

    def settle() -> pa.RecordBatch:
        usable = [g for g in groups if len(g) > 1 and not all(e[8] for e in g)]
        marks = expand([[(e[6], e[7], e[5]) for e in g] for g in usable]) if usable else []
        spans = []
        for group, found in zip(usable, marks):
            for edge, repeated in zip(group, found):
                if edge[8]:
                    continue
                steps = np.flatnonzero(np.diff(np.concatenate(([0], repeated.astype(np.int8), [0]))))
                spans += [(edge[2], edge[3], edge[4] + a, edge[4] + b - 1 + length) for a, b in zip(steps[::2].tolist(), steps[1::2].tolist())]
        return _span_batch(spans)

    last = None
    for row in rows:
        if groups and row[:2] == groups[-1][0][:2]:
            if row[2:6] != last:  # a row of the same id and text is no other place
                groups[-1].append(row)
                held += len(row[6]) + len(row[7])
        else:
            if held > BATCH_SYMBOLS or len(groups) > 100_000:
                yield settle()
                groups, held = [], 0
            groups.append([row])
            held += len(row[6]) + len(row[7])
        last = row[2:6]
    yield settle()


def _window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each single window of edges in very large groups: hash of the bytes around the core, and its place."""
    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("fine_key", "fine_key2", "doc_id", "text_hash", "first", "windows", "before", "after", "settled"))
        for key, key2, doc, text, first, windows, before, after, settled in zip(*columns):
            side = len(before) + len(after) - (windows - 1)
            both = before + after
            halves = zip(*(_halves(both[w : w + side], len(before) - w) for w in range(windows)))
            n = windows
            yield pa.record_batch(
                [pa.array([key] * n), pa.array([key2] * n), *[pa.array(h, pa.int64()) for h in halves], pa.array([doc] * n, pa.int64()), pa.array([text] * n), pa.array(range(first, first + n)), pa.array([settled] * n)],
                names=["fine_key", "fine_key2", "window", "window2", "doc_id", "text_hash", "first", "settled"],
            )


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, text_hash, start, stop (bytes) that are to go from each text; spans may overlap. docs: doc_id, text, text_hash."""
    shape = Windows(length)
    core, run, fine = ["key", "key2"], ["key", "key2", "bytes", "bytes2"], ["fine_key", "fine_key2"]
    rows = materialize(run_rows(docs, shape), "substring-runs")
    differ = (F.min("bytes") != F.max("bytes")) | (F.min("bytes2") != F.max("bytes2"))
    keys = rows.groupBy(*core).agg(F.count("*").alias("n"), differ.alias("differ")).where("n > 1")
    keys = keys.select(*core, "differ", F.ceil(F.col("n") / SALT_ROWS).alias("salts"))
    keys = materialize(keys, "substring-keys")  # a join with a table, not with an aggregate, can be split
    salt = F.pmod(F.xxhash64("doc_id", "first"), F.col("salts")).cast("int").alias("salt")
    again = rows.join(keys, core).select(*run, "differ", salt, "doc_id", "text_hash", "first", "windows")
    again = materialize(again, "substring-repeated")  # adaptive execution splits a core that is hot
    place = F.struct("doc_id", "text_hash", "first", "windows")
    runs_ = again.groupBy(*run, "differ").agg(F.count("*").alias("n"), F.min(place).alias("place"), F.collect_set("salt").alias("salts"))
    whole = materialize(runs_, "substring-whole")
    # A run meets its copies once for each salt that they have, so that many copies are dealt over many tasks.
    salted = whole.where("n > 1").select(*run, F.explode("salts").alias("salt"))
    copied = again.join(salted, [*run, "salt"]).select(
        "doc_id", "text_hash", F.col("first").alias("start"), (F.col("first") + F.col("windows") - 1 + length).alias("stop")
    )
    edge = F.struct("place.first", "place.windows", (F.col("n") > 1).alias("settled"))
    wanted = whole.where("differ").groupBy("place.doc_id", "place.text_hash").agg(F.collect_list(edge).alias("runs"))
    edges = materialize(edge_rows(docs, wanted, shape), "substring-edges")
    sizes = materialize(edges.groupBy(*fine).agg(F.count("*").alias("n")).where("n > 1"), "substring-sizes")
    grouped = edges.join(sizes, fine)
    small = grouped.where(F.col("n") <= GROUP_EDGES).drop("n")
    order = [*fine, "doc_id", "text_hash", "first"]
    expanded = small.repartition(*fine).sortWithinPartitions(*order).mapInArrow(lambda batches: _expanded(batches, length), _SPAN)
    single = grouped.where(F.col("n") > GROUP_EDGES).mapInArrow(
        _window_rows, "fine_key long, fine_key2 long, window long, window2 long, doc_id long, text_hash long, first long, settled boolean"
    )
    window = [*fine, "window", "window2"]
    places = F.struct("doc_id", "text_hash", "first")
    several = single.groupBy(*window).agg((F.min(places) != F.max(places)).alias("several")).where("several").drop("several")
    several = materialize(several, "substring-windows")
    windows = single.where("not settled").join(several, window).select(
        "doc_id", "text_hash", F.col("first").alias("start"), (F.col("first") + length).alias("stop")
    )
    return copied.unionByName(expanded).unionByName(windows)


def merged(spans: list[dict], n: int) -> list[tuple[int, int]]:
    """Spans joined where they touch or overlap, in order."""
    out: list[tuple[int, int]] = []
    for start, stop in sorted((s["start"], min(s["stop"], n)) for s in spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], stop))
        else:
            out.append((start, stop))
    return out


def remove_repeats(docs: DataFrame, keep: list[str], as_text: bool = False, length: int = LENGTH) -> DataFrame:
    """Columns ``keep`` of every row with n_bytes, n_removed, n_spans and ``kept``, the remaining bytes end to end.

    ``length`` is that of the strings, in bytes, whose repetition counts. ``as_text`` gives the rest as a string,
    without the bytes of characters that a cut has broken. A null text counts as empty. Rows of the same id and text
    are separate places, so that their texts repeat. A kept column named like an output gives way to it. An empty table
    gives an empty result.
    """
    keep = [k for k in keep if k not in ("n_bytes", "n_removed", "n_spans", "kept")]
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    spans = repeated_spans(texts, length).groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    spans = materialize(spans, "substring-spans")
    base = docs.withColumn("text_hash", F.xxhash64("text"))
    same = base["doc_id"].eqNullSafe(spans["doc_id"]) & (base["text_hash"] == spans["text_hash"])
    joined = base.join(spans, same, "left").select(*[base[k] for k in keep], base["text"].alias("__text"), spans["spans"].alias("__spans"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("__text"))
            raw = memoryview(data)
            out: list[tuple] = []
            for i, spans_ in enumerate(batch.column("__spans").to_pylist()):
                a, b = int(offsets[i]), int(offsets[i + 1])
                gone = merged(spans_ or [], b - a)
                edges = [0, *(x for s in gone for x in s), b - a]
                kept = b"".join(raw[a + x : a + y] for x, y in zip(edges[::2], edges[1::2]))
                out.append((b - a, b - a - len(kept), len(gone), kept.decode("utf-8", "ignore") if as_text else kept))
            columns = list(zip(*out)) if out else [[], [], [], []]
            arrays = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string() if as_text else pa.binary()))]
            yield pa.record_batch([*[batch.column(k) for k in keep], *arrays], names=[*keep, "n_bytes", "n_removed", "n_spans", "kept"])

    schema = docs.select(*keep).schema.add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add("kept", "string" if as_text else "binary")
    return joined.mapInArrow(cut, schema)
