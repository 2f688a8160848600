"""Small array helpers that the text operators share inside their tasks."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string or binary column end to end, and len + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, ends, data = column.buffers()
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(ends, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def row_blocks(sizes: np.ndarray, most: int, rows: int = 1 << 30) -> Iterator[tuple[int, int]]:
    """Row ranges whose sizes add up to at most ``most``; a larger single row is a range of its own."""
    first, held = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > first and (held + size > most or i - first >= rows):
            yield first, i
            first, held = i, 0
        held += size
    if len(sizes) > first:
        yield first, len(sizes)


def code_points(texts: list[str], separator: str = "\n") -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each followed by one separator, and the start of each text (len + 1)."""
    joined = separator.join([*texts, ""])
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=starts[1:])
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32), starts


@cache
def letter_table() -> np.ndarray:
    """For each code point: 1 for a letter, 2 for an upper-case letter, 3 for a digit, 4 for white space, else 0."""
    kinds = bytearray(0x110000)
    for point in range(0x110000):
        c = chr(point)
        if c.isalpha():
            kinds[point] = 2 if c.isupper() else 1
        elif c.isdecimal():
            kinds[point] = 3
        elif c.isspace():
            kinds[point] = 4
    return np.frombuffer(bytes(kinds), np.uint8)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(32)
    return h


class _Powers:
    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 .. n of the hash base and of its inverse, modulo 2**64."""
    if len(_Powers.up) <= n:
        size = 1 << (n + 1).bit_length()
        for name, base in (("up", BASE), ("down", BASE_INVERSE)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            setattr(_Powers, name, np.multiply.accumulate(table))
    return _Powers.up, _Powers.down


def span_hashes(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of symbols[start:end] for each span, the same for equal contents at any place."""
    up, down = powers(len(symbols))
    sums = np.zeros(len(symbols) + 1, np.uint64)
    np.cumsum(mixed(symbols.astype(np.uint64) + np.uint64(1)) * up[: len(symbols)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def others(keep: list[str], *output: str) -> list[str]:
    """The columns to keep that are not named like an output: an input column gives way to it."""
    return [k for k in keep if k not in output]


def word_spans(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edges = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
    return edges[::2], edges[1::2]
