"""Repeated substrings of a text in memory, from common prefixes that a Burrows-Wheeler transform yields.

Breadth-first backward extension: the interval of suffixes that begin with a string w is mapped, for each symbol c
before them, to the interval of c w. All strings of one length are extended together. The first interval that ends at
a border between two neighbouring suffixes tells their common prefix, so prefixes come in increasing value, and the
expansion stops at the length asked for: borders still open then have a common prefix of that length or more.
"""

from __future__ import annotations

import numpy as np


def suffix_order(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in order of their first ``depth`` symbols at least, by prefix doubling. Symbols are below 2**21."""
    n = len(symbols)
    padded = np.concatenate((symbols, np.zeros(2, symbols.dtype))).astype(np.uint64)
    key = (padded[:n] << np.uint64(42)) | (padded[1 : n + 1] << np.uint64(21)) | padded[2 : n + 2]
    known = 3
    while True:
        order = np.argsort(key)
        ordered = key[order]
        rank = np.zeros(n + 1, np.uint64)
        rank[order] = np.cumsum(np.concatenate(([True], ordered[1:] != ordered[:-1])))
        if known >= depth or int(rank[order[-1]]) == n:
            return order
        later = np.zeros(n, np.uint64)
        if known < n:
            later[: n - known] = rank[known:n]
        key = (rank[:n] << np.uint64(32)) | later
        known *= 2


def repeated_starts(symbols: np.ndarray, depth: int) -> np.ndarray:
    """For each place of ``symbols``, whether the ``depth`` symbols from there also start somewhere else.

    Symbol 0 ends a part: no match crosses it, and places nearer than ``depth`` to their part's end are undefined.
    """
    n = len(symbols)
    if n < 2:
        return np.zeros(n, bool)
    order = suffix_order(symbols, depth)
    before = symbols[order - 1]  # the transform; the first suffix is preceded by the last symbol, an end
    by_symbol = np.argsort(before, kind="stable")
    ahead = np.empty(n, np.int64)  # of each row, the row of the suffix one symbol longer
    ahead[by_symbol] = np.arange(n)
    grouped = before[by_symbol]
    same = np.concatenate(([False], grouped[1:] == grouped[:-1]))
    previous = np.full(n, -1, np.int64)  # the row before it with the same symbol
    previous[by_symbol[1:][same[1:]]] = by_symbol[:-1][same[1:]]
    following = np.full(n, n, np.int64)
    following[by_symbol[:-1][same[1:]]] = by_symbol[1:][same[1:]]

    open_ = np.ones(n + 1, bool)  # border i lies before row i
    open_[0] = open_[n] = False
    low, high = np.array([0]), np.array([n])
    for length in range(depth):
        size = high - low
        starts = np.concatenate(([0], np.cumsum(size)[:-1]))
        rows = np.arange(size.sum()) + np.repeat(low - starts, size)
        first = previous[rows] < np.repeat(low, size)
        last = following[rows] >= np.repeat(high, size)
        if length:  # only whole strings are extended over an end
            inner = before[rows] != 0
            first &= inner
            last &= inner
        low, high = np.sort(ahead[rows[first]]), np.sort(ahead[rows[last]]) + 1
        fresh = open_[high] | (high == n) & (length == 0)
        open_[high] = False
        low, high = low[fresh], high[fresh]
        if not len(low):
            break
    long_ = open_[:-1] | open_[1:]
    found = np.zeros(n, bool)
    found[order[long_]] = True
    return found
