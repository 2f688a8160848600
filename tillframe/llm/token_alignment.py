"""Alignment of the tokens of two tokenizers, by the byte ranges that they cover.

A is a tokenizers JSON file with byte-level pieces, B a sentencepiece model with byte fallback. Both see a text with a
space before it. The libraries' spans are the coarse cuts: A's in characters, turned into bytes, B's in bytes. Tokens
that share a character, or that the library gives an empty span, are placed by the lengths of their decoded bytes,
counted from the last coarse cut. Offsets where tokens of both end cut them into groups, and link the two tokens.

If no entry of either vocabulary has a space behind a character that is not white space, no token reaches over such a
place: texts are cut there, and each distinct part is aligned once for many texts. Else whole texts are aligned.

How often a pair of ids is linked in the whole corpus is summed in the cluster. Pairs that make up more than a fixed
part of all links are few by definition; they are looked up within the tasks, so that the join of the others has no
hot key.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tillframe.llm.arrays import row_blocks
from tillframe.session import materialize

BLOCK_CHARS = 1_000_000
JOINED_CHARS = 1 << 16  # of parts that go through the tokenizers together
KEPT_PARTS, KEPT_CHARS = 300_000, 1 << 23  # what a task remembers at most, beside the parts of a block
CUT = re.compile(r"(?<=\S) (?= *[^ ])")
CROSSES = re.compile(r"(?<=\S) ")
HOT_PART = 1 << 17  # a pair with more than one in so many links is hot: fewer than so many pairs are
SHIFT = 1 << 32
OUTPUT = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def byte_letters() -> dict[str, int]:
    """The byte of each letter of byte-level pieces: printable Latin-1 stands for itself, the rest follows from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def refined(coarse: np.ndarray, cut: np.ndarray, widths: np.ndarray) -> np.ndarray:
    """Byte ends of tokens: ``coarse`` where it is a ``cut``, elsewhere the last cut and the bytes of the tokens since."""
    total = np.cumsum(widths)
    last = np.maximum.accumulate(np.where(cut, np.arange(len(cut)), -1))
    known = last >= 0
    ends = total.copy()
    ends[known] += coarse[last[known]] - total[last[known]]
    return ends


class Pair:
    """Both tokenizers, and the bytes of their entries."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        letters = byte_letters()
        entries = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(entries.values()) + 1)
        for token, i in entries.items():
            known = all(c in letters for c in token)
            self.a_bytes[i] = bytes(letters[c] for c in token) if known else token.encode()
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        marks = ((self.a_bytes, "|"), (self.b_bytes, ";"))
        self.written = [tuple(np.array([f"{i}{mark}" for i in range(len(held))], object) for mark in (",", last)) for held, last in marks]
        self.parted = not any(CROSSES.search(raw.decode("utf-8", "replace")) for held in (self.a_bytes, self.b_bytes) for raw in held)
        self.a_widths, self.b_widths = (np.array([len(x) for x in held], np.int64) for held in (self.a_bytes, self.b_bytes))

    def tokens_a(self, spaced: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids and byte ends of the text's tokens; offsets of the library are in characters."""
        found = self.a.encode(spaced, add_special_tokens=False)
        ids = np.array(found.ids, np.int64)
        spans = np.fromiter(chain.from_iterable(found.offsets), np.int64, 2 * len(ids)).reshape(-1, 2)
        points = np.frombuffer(spaced.encode("utf-32-le"), np.uint32)
        at = np.concatenate(([0], np.cumsum(1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF).astype(np.int64))))
        cut = np.ones(len(ids), bool)
        cut[:-1] = spans[1:, 0] >= spans[:-1, 1]  # the next token does not begin within its last character
        return ids, refined(at[spans[:, 1]], cut, self.a_widths[ids])

    def tokens_b(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids and byte ends, counted with the space before the text; spans of the library are in bytes of the text."""
        pieces = self.b.encode(text, return_type="proto").pieces
        ids, end = np.array([x for p in pieces for x in (p.id, p.end)], np.int64).reshape(-1, 2).T
        return ids, refined(end + 1, np.diff(end, prepend=0) > 0, self.b_widths[ids])  # an empty span is no cut

    def align(self, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
        """Ids of A and B, and the places of the tokens of each at which a group ends; None for a text without tokens.

        That is a null or empty text, or one whose tokens' bytes are not those of the text behind a space.
        """
        if not text:
            return None
        spaced = " " + text
        a, a_ends = self.tokens_a(spaced)
        b, b_ends = self.tokens_b(text)
        raw = spaced.encode()
        if b"".join([self.a_bytes[i] for i in a.tolist()]) != raw or b"".join([self.b_bytes[i] for i in b.tolist()]) != raw:
            return None
        _, a_at, b_at = np.intersect1d(a_ends, b_ends, return_indices=True)
        return a, b, a_at, b_at


@dataclass(frozen=True)
class Aligned:
    """Numbers of tokens and groups of a text, the groups as ``a1,a2|b1;a3|b2,b3``, and its linked pairs with their times."""

    n_a: int
    n_b: int
    n_groups: int
    groups: str
    pairs: np.ndarray
    times: np.ndarray


def groups(both: Pair, a: np.ndarray, b: np.ndarray, a_at: np.ndarray, b_at: np.ndarray) -> str:
    """``a1,a2|b1;a3|b2,b3``: each id with what follows it, sorted by group, A before B."""
    ends = (np.zeros(len(a), bool), np.zeros(len(b), bool))
    ends[0][a_at], ends[1][b_at] = True, True
    parts = [np.where(end, closed[ids], open_[ids]) for ids, end, (open_, closed) in zip((a, b), ends, both.written)]
    group = [2 * (np.cumsum(end) - end) + side for side, end in enumerate(ends)]
    order = np.argsort(np.concatenate(group), kind="stable")
    return "".join(np.concatenate(parts)[order].tolist())[:-1]


class Texts:
    """Aligns texts by their distinct parts. A part's number is its place in lists of what is known of the parts.

    ``known`` has a line (tokens of A, tokens of B, groups) a part, -1 for one whose tokens' bytes are not its own.
    """

    def __init__(self, both: Pair):
        self.both = both
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.chars = 0
        self.groups: list[str] = []
        self.known = np.zeros((0, 3), np.int64)
        self.pairs, self.first = np.zeros(0, np.int64), np.zeros(1, np.int64)

    def learn(self, parts: list[str]) -> None:
        """Align new parts, many at a time as one text, which is cut between them again.

        A part that ends in white space, as the last one of a text may, can only be the last one there too.
        """
        lines: list[np.ndarray] = []
        pairs: list[np.ndarray] = []
        held, chars = [], 0
        for i, part in enumerate(parts, start=1):
            held.append(part)
            chars += len(part) + 1
            if chars >= JOINED_CHARS or part[-1].isspace() or i == len(parts):
                self._learn(held, lines, pairs)
                held, chars = [], 0
        self.known = np.vstack([self.known, *lines])
        self.pairs = np.concatenate([self.pairs, *pairs])
        counts = np.maximum(self.known[:, 2], 0)
        self.first = np.concatenate(([0], np.cumsum(counts)))

    def _learn(self, parts: list[str], lines: list[np.ndarray], pairs: list[np.ndarray]) -> None:
        found = self.both.align(" ".join(parts))
        if found is None:
            if len(parts) == 1:
                lines.append(np.full((1, 3), -1))
                self.groups.append("")
                return
            for half in (parts[: len(parts) // 2], parts[len(parts) // 2 :]):
                self._learn(half, lines, pairs)
            return
        a, b, a_at, b_at = found
        ends = np.cumsum([1 + len(p.encode()) for p in parts])
        group_ends = np.cumsum(self.both.a_widths[a])[a_at]
        last = np.searchsorted(group_ends, ends)  # the group that ends with each part
        if not np.array_equal(group_ends[np.minimum(last, len(group_ends) - 1)], ends):
            raise AssertionError("a token reached over a cut")
        steps = lambda x: np.diff(x, prepend=-1)
        lines.append(np.column_stack([steps(a_at[last]), steps(b_at[last]), steps(last)]))
        pairs.append(a[a_at] * SHIFT + b[b_at])
        single = groups(self.both, *found).split(";")
        begins = [0, *(last + 1).tolist()]
        self.groups += [single[i] if j - i == 1 else ";".join(single[i:j]) for i, j in zip(begins, begins[1:])]

    def align(self, texts: list[str | None]) -> list[Aligned | None]:
        """What each whole text gives; None as in ``Pair.align``."""
        if len(self.number) > KEPT_PARTS or self.chars > KEPT_CHARS:
            self.forget()
        split = [(CUT.split(t) if self.both.parted else [t]) if t else [] for t in texts]
        new: dict[str, int] = {}
        codes = []
        for parts in split:
            for part in parts:
                at = self.number.get(part)
                if at is None:
                    at = self.number[part] = len(self.number)
                    new[part] = at
                codes.append(at)
        if new:
            self.learn(list(new))
            self.chars += sum(map(len, new))
        sizes = np.array([len(parts) for parts in split], np.int64)
        code = np.array(codes, np.int64)
        text_of = np.repeat(np.arange(len(texts)), sizes)
        lines = self.known[code]
        sums = np.column_stack([np.bincount(text_of, lines[:, i], len(texts)) for i in range(3)]).astype(np.int64)
        failed = np.bincount(text_of[lines[:, 0] < 0], minlength=len(texts)) > 0
        many = np.maximum(lines[:, 2], 0)
        before = np.concatenate(([0], np.cumsum(many)[:-1])) if len(many) else many
        links = self.pairs[np.arange(int(many.sum())) + np.repeat(self.first[code] - before, many)]
        owner = np.repeat(text_of, many)
        order = np.lexsort((links, owner))
        links, owner = links[order], owner[order]
        heads = np.flatnonzero(np.concatenate(([True], (links[1:] != links[:-1]) | (owner[1:] != owner[:-1])))) if len(links) else np.zeros(0, np.int64)
        times = np.diff(np.append(heads, len(links)))
        bounds = np.searchsorted(owner[heads], np.arange(len(texts) + 1))
        out: list[Aligned | None] = []
        start = 0
        for i, size in enumerate(sizes.tolist()):
            mine = codes[start : start + size]
            start += size
            if not size or failed[i]:
                out.append(self._whole(texts[i]) if size > 1 else None)  # the whole text decides, not its parts
                continue
            at = slice(bounds[i], bounds[i + 1])
            out.append(Aligned(*sums[i].tolist(), ";".join([self.groups[c] for c in mine]), links[heads[at]], times[at]))
        return out

    def _whole(self, text: str) -> Aligned | None:
        found = self.both.align(text)
        if found is None:
            return None
        a, b, a_at, b_at = found
        return Aligned(len(a), len(b), len(a_at), groups(self.both, *found), *np.unique(a[a_at] * SHIFT + b[b_at], return_counts=True))


@lru_cache(maxsize=2)
def _texts(a_path: str, b_path: str) -> Texts:
    return Texts(Pair(a_path, b_path))


def aligned(docs: DataFrame, a_path: str, b_path: str, keep: list[str]) -> DataFrame:
    """Columns ``keep``, n_a, n_b, n_groups, n_links, groups_sha256, and the linked pairs (A id x 2**32 + B id) with
    their ``times`` in the text. The files must be at their paths on every executor."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _texts(a_path, b_path)
        kinds = [pa.int64()] * 4 + [pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32())]
        for batch in batches:
            texts = batch.column("__text").to_pylist()
            for i, j in row_blocks(np.array([len(t or "") for t in texts]), BLOCK_CHARS):
                rows = []
                for got in aligner.align(texts[i:j]):
                    if got is None:
                        rows.append((0, 0, 0, 0, "", (), ()))
                        continue
                    digest = hashlib.sha256(got.groups.encode()).hexdigest()
                    rows.append((got.n_a, got.n_b, got.n_groups, got.n_groups, digest, got.pairs, got.times))
                arrays = [pa.array(c, kind) for c, kind in zip(zip(*rows), kinds)]
                kept = [batch.column(k).slice(i, j - i) for k in keep]
                yield pa.record_batch([*kept, *arrays], names=[*keep, "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])

    schema = docs.select(*keep).schema
    for name in ("n_a", "n_b", "n_groups", "n_links"):
        schema = schema.add(name, "long")
    schema = schema.add("groups_sha256", "string").add("pairs", T.ArrayType(T.LongType())).add("times", T.ArrayType(T.IntegerType()))
    return docs.select(*keep, F.col("text").alias("__text")).mapInArrow(found, schema)


def pair_counts(rows: DataFrame) -> DataFrame:
    """pair, n (links in the corpus) and best: whether no other pair of the same B id has more."""
    single = rows.select(F.inline(F.arrays_zip("pairs", "times")))
    counts = materialize(single.groupBy(F.col("pairs").alias("pair")).agg(F.sum("times").alias("n")), "alignment-counts")
    of_b = F.pmod("pair", F.lit(SHIFT)).alias("b")
    top = counts.groupBy(of_b).agg(F.max("n").alias("most"))
    ranked = counts.select("pair", "n", of_b).join(top, "b")
    return materialize(ranked.select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "alignment-pairs")


@dataclass(frozen=True)
class HotPairs:
    """The pairs looked up within tasks, in order."""

    pair: np.ndarray
    n: np.ndarray
    best: np.ndarray


def hot_pairs(counts: DataFrame, part: int = HOT_PART) -> HotPairs:
    """Pairs with more than one link in ``part``; as they add up to at most all links, there are fewer than ``part``."""
    total = counts.agg(F.sum("n").alias("n")).first()["n"] or 0
    rows = sorted((r["pair"], r["n"], r["best"]) for r in counts.where(F.col("n") * part > total).collect())
    pair, n, best = zip(*rows) if rows else ((), (), ())
    return HotPairs(np.array(pair, np.int64), np.array(n, np.int64), np.array(best, bool))


def align(docs: DataFrame, a_path: str, b_path: str, keep: list[str], hot_part: int = HOT_PART) -> DataFrame:
    """Columns ``keep`` of every row with n_a, n_b (tokens), n_groups, n_links, n_best, count_sum and groups_sha256.

    n_best counts the links whose pair is, in the whole corpus, the most frequent of its B id (ties included);
    count_sum adds up the corpus counts of the links. Texts without tokens (see Pair.align) have zeros and an empty
    digest; repeated rows count each for itself. A kept column named like an output gives way to it. An empty table
    gives an empty result.
    """
    keep = [k for k in keep if k not in (*OUTPUT, "pairs", "times")]
    place = {k: f"k{i}" for i, k in enumerate(keep)}
    named = docs.select(*[F.col(k).alias(v) for k, v in place.items()], "text")
    found = aligned(named, a_path, b_path, list(place.values()))
    rows = materialize(found.withColumn("row", F.monotonically_increasing_id()), "alignment-rows")
    counts = pair_counts(rows)
    held = docs.sparkSession.sparkContext.broadcast(hot_pairs(counts, hot_part))

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What the hot pairs add to each row, and its other pairs."""
        hot = held.value
        for batch in batches:
            out = []
            for pairs, times in zip(batch.column("pairs"), batch.column("times")):
                pairs, times = (np.asarray(x.values.to_numpy(zero_copy_only=False), np.int64) for x in (pairs, times))
                at = np.searchsorted(hot.pair, pairs)
                known = at < len(hot.pair)
                known[known] = hot.pair[at[known]] == pairs[known]
                at, often = at[known], times[known]
                out.append((int(often[hot.best[at]].sum()), int((often * hot.n[at]).sum()), pairs[~known], times[~known]))
            columns = zip(*out) if out else [()] * 4
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()))
            yield pa.record_batch([batch.column("row"), *[pa.array(c, kind) for c, kind in zip(columns, kinds)]], names=["row", "best", "sum", "pairs", "times"])

    parts = rows.select("row", "pairs", "times").mapInArrow(looked_up, "row long, best long, sum long, pairs array<long>, times array<int>")
    parts = materialize(parts, "alignment-rest")
    rest = parts.where(F.size("pairs") > 0).select("row", F.inline(F.arrays_zip("pairs", "times"))).withColumnRenamed("pairs", "pair")
    rest = rest.join(counts, "pair").groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("best"), F.sum(F.col("times") * F.col("n")).alias("sum")
    )
    sums = parts.select("row", "best", "sum").union(rest.select("row", "best", "sum")).groupBy("row").agg(F.sum("best").alias("n_best"), F.sum("sum").alias("count_sum"))
    kept = [F.col(v).alias(k) for k, v in place.items()]
    return rows.drop("pairs", "times").join(sums, "row").select(*kept, *OUTPUT)
