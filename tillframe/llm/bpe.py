"""BPE encoding and decoding by speculation: propose tokens greedily, verify pairs, merge exactly where that fails.

A sequence of tokens is what exact merging gives if each token is what its own characters merge to, and no merge ever
crosses the border of two neighbours. So each distinct word is cut greedily into its longest tokens, all neighbouring
pairs of all new words are tested at once, and only words with a failing pair are merged step by step. A file of the
tokenizers library gives vocabulary, merges, split pattern and special tokens; nothing is trained.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F

from tillframe.llm.arrays import others

CACHED = 300_000  # words that a task remembers
NEVER = np.int64(1 << 40)
_NO_MERGE = (1 << 40, -1)
# White space as the split pattern means it: the Unicode property, without the four separators that Python adds.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


@cache
def _full(pattern: str) -> regex.Pattern:
    return regex.compile(pattern.replace("\\s", SPACE))


@cache
def _latin(pattern: str) -> re.Pattern:
    for name, kind in (("\\p{L}", "L"), ("\\p{N}", "N")):
        members = "".join(chr(c) for c in range(256) if unicodedata.category(chr(c))[0] == kind)
        pattern = pattern.replace(f"[{name}]", f"[{members}]").replace(name, members)
    return re.compile(pattern.replace("\\s", "\\t-\\r \\x85\\xa0"))


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte: itself where it has one, else the next from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


@dataclass
class Bpe:
    """A byte-level BPE with a mark at the end of words. Made by ``load``; plain data, so that it can be sent to tasks."""

    pattern: str
    tokens: list[str]
    ids: dict[str, int]
    end: str
    merges: dict[tuple[int, int], tuple[int, int]]  # pair -> rank, merged id
    special: dict[str, int]
    left: np.ndarray  # of each id, its last merge: left part, right part, rank; rank -1 for single characters
    right: np.ndarray
    rank: np.ndarray
    sound: bytearray  # by id: whether its characters merge to it
    longest: int
    greedy: dict[str, int]  # the sound tokens
    pair_keys: np.ndarray
    pair_ranks: np.ndarray
    ordered: bool  # each token's parts have lower ranks than it
    reach: dict[str, int] = field(default_factory=dict)  # longest sound token by its first two characters
    coded: dict[str | int, str] = field(default_factory=dict)
    plain: dict[str | int, str] = field(default_factory=dict)

    def merge(self, symbols: list[int]) -> list[int]:
        """Exact merging: always the pair of lowest rank, the leftmost of equal ones."""
        return self._merged(symbols)[0]

    def _merged(self, symbols: list[int]) -> tuple[list[int], tuple[int, int, int] | None]:
        merges, n = self.merges, len(symbols)
        if n <= 64:
            return self._merged_short(list(symbols))
        token, after, ahead = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m[0], i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (m := merges.get((symbols[i], symbols[i + 1])))]
        heapq.heapify(heap)
        last = None
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i] if token[i] == a else n
            if j >= n or token[j] != b:
                continue
            token[i], token[j] = merges[a, b][1], -1
            last = (a, b, rank)
            after[i] = after[j]
            if after[j] < n:
                ahead[after[j]] = i
                if m := merges.get((token[i], token[after[j]])):
                    heapq.heappush(heap, (m[0], i, token[i], token[after[j]]))
            if ahead[i] >= 0 and (m := merges.get((token[ahead[i]], token[i]))):
                heapq.heappush(heap, (m[0], ahead[i], token[ahead[i]], token[i]))
        return [t for t in token if t >= 0], last

    def _merged_short(self, token: list[int]) -> tuple[list[int], tuple[int, int, int] | None]:
        find, last = self.merges.get, None
        ahead = [find(pair, _NO_MERGE) for pair in zip(token, token[1:])]
        while ahead:
            best = min(ahead)
            if best == _NO_MERGE:
                break
            i = ahead.index(best)
            last = (token[i], token[i + 1], best[0])
            token[i : i + 2] = [best[1]]
            del ahead[i]
            if i:
                ahead[i - 1] = find((token[i - 1], token[i]), _NO_MERGE)
            if i < len(ahead):
                ahead[i] = find((token[i], token[i + 1]), _NO_MERGE)
        return token, last

    def symbols(self, word: str) -> list[int]:
        """Ids of the characters of a word in the byte alphabet, the last with the end mark."""
        return [self.ids[c] for c in word[:-1]] + [self.ids[word[-1] + self.end]]

    def propose(self, word: str) -> list[int]:
        """The longest token at each place; the last one has the end mark."""
        find, reach, end = self.greedy.get, self.reach.get, self.end
        out, i, n = [], 0, len(word)
        while True:
            if n - i <= self.longest and (t := find(word[i:] + end)) is not None:
                out.append(t)
                return out
            for j in range(min(n - 1, i + reach(word[i : i + 2], 1)), i, -1):
                if (t := find(word[i:j])) is not None:
                    break
            out.append(t)
            i = j

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of sound tokens, whether no merge crosses their border when they stand together.

        Merges inside both tokens are undone, the latest first. At each step the two pieces at the border stood side
        by side until the merge of lower rank took one of them; a merge of both before that breaks the pair.
        """
        good = np.ones(len(a), bool)
        live = np.arange(len(a))
        x, y = a.copy(), b.copy()
        taken_x, taken_y = np.full(len(a), NEVER), np.full(len(a), NEVER)
        while len(live):
            key = x.astype(np.int64) << 20 | y
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            crossing = np.where(self.pair_keys[at] == key, self.pair_ranks[at], NEVER)
            broken = (crossing < taken_x) & (crossing <= taken_y)
            good[live[broken]] = False
            rx, ry = self.rank[x], self.rank[y]
            on = ~broken & ((rx >= 0) | (ry >= 0))
            live, x, y, rx, ry, taken_x, taken_y = live[on], x[on], y[on], rx[on], ry[on], taken_x[on], taken_y[on]
            undo_x = rx > ry  # of two like merges the right one is the later
            taken_x, taken_y = np.where(undo_x, rx, taken_x), np.where(undo_x, taken_y, ry)
            x, y = np.where(undo_x, self.right[x], x), np.where(undo_x, y, self.left[y])
        return good

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Token ids of distinct words, which are in the byte alphabet."""
        if not self.ordered:
            return [self.merge(self.symbols(w)) for w in words]
        proposed = [self.propose(w) for w in words]
        sizes = np.array([len(p) for p in proposed], np.int64)
        flat = np.fromiter((t for p in proposed for t in p), np.int64, int(sizes.sum()))
        word = np.repeat(np.arange(len(words)), sizes)
        inner = word[1:] == word[:-1]
        failed = np.zeros(len(words), bool)
        failed[word[1:][inner][~self.compatible(flat[:-1][inner], flat[1:][inner])]] = True
        for i in np.flatnonzero(failed).tolist():
            proposed[i] = self.merge(self.symbols(words[i]))
        return proposed

    def pieces(self, text: str) -> list[str | int]:
        """The words of a text and the ids of its special tokens, in order."""
        out: list[str | int] = []
        for k, part in enumerate(self._special.split(text)):
            if k % 2:
                out.append(self.special[part])
            elif part:
                plain = unicodedata.normalize("NFC", part)
                plain = (plain.replace("Σ", "σ") if "Σ" in plain else plain).lower()  # lower case by character
                out += self._words(plain)
        return out

    @cached_property
    def _special(self) -> re.Pattern:
        names = sorted(self.special, key=len, reverse=True)
        return re.compile("(" + "|".join(map(re.escape, names)) + ")" if names else r"(?!)()")

    def _words(self, text: str) -> list[str]:
        """The words of a text; the classes are written out for Latin-1, where the built-in matcher is the faster."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return _full(self.pattern).findall(text)
        return _latin(self.pattern).findall(text)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_special"} | {"coded": {}, "plain": {}}

    def lookup(self, texts: list[str]) -> Iterator[tuple[str, str]]:
        """For each text: its ids as decimals joined by a space, and its decoded text."""
        if len(self.coded) > CACHED:
            self.coded.clear()
            self.plain.clear()
        coded, plain, names = self.coded, self.plain, self.tokens
        split = [self.pieces(t) for t in texts]
        new = list(set().union(*split).difference(coded))
        words = [p for p in new if isinstance(p, str)]
        in_bytes = "\n".join(words).encode("utf-8", "surrogatepass").decode("latin-1").translate(_ALPHABET).split(_ALPHABET[10])
        ids_of = dict(zip(words, self.encode_words(in_bytes))) if words else {}
        for w in new:
            ids = ids_of.get(w) or [w]
            coded[w] = " ".join(map(str, ids))
            plain[w] = " ".join([names[i] for i in ids])
        for pieces in split:
            yield " ".join(map(coded.__getitem__, pieces)), " ".join(map(plain.__getitem__, pieces))

    def encode(self, text: str) -> list[int]:
        """Token ids of a text."""
        return [int(i) for i in next(self.lookup([text]))[0].split()]

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by a space, as a file without a decoder says."""
        return " ".join([self.tokens[i] for i in ids])


_ALPHABET = {b: c for b, c in byte_alphabet().items()}


def load(source: str) -> Bpe:
    """Read the JSON of a tokenizers file: BPE, byte level, lower case, a mark at word ends, no decoder."""
    data = json.loads(source)
    model, end = data["model"], data["model"]["end_of_word_suffix"] or ""
    steps = [s["type"] for s in data["normalizer"]["normalizers"]]
    if model["type"] != "BPE" or steps != ["NFC", "Replace", "Lowercase"] or data["decoder"] is not None or not end:
        raise ValueError("not the kind of tokenizer file that this reads")
    pattern = data["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
    ids = model["vocab"]
    special = {t["content"]: t["id"] for t in data["added_tokens"]}
    size = max([*ids.values(), *special.values()]) + 1
    tokens = [""] * size
    for t, i in [*ids.items(), *special.items()]:
        tokens[i] = t
    merges: dict[tuple[int, int], tuple[int, int]] = {}
    for rank, pair in enumerate(model["merges"]):
        a, b = pair if isinstance(pair, list) else pair.split(" ")
        merges[ids[a], ids[b]] = (rank, ids[a + b])
    keys = np.array([a << 20 | b for a, b in merges], np.int64)
    ranks = np.array([m[0] for m in merges.values()], np.int64)
    order = np.argsort(keys)
    left, right, last = (np.full(size, -1, np.int64) for _ in range(3))
    sound, ordered = bytearray(size), True
    bpe = Bpe(pattern, tokens, ids, end, merges, special, left, right, last, sound, max(map(len, ids)), {}, keys[order], ranks[order], True)
    for t, i in ids.items():
        ended = t.endswith(end) and len(t) > len(end)
        chars = list(t[: -len(end)]) if ended else list(t)
        if ended:
            chars[-1] += end
        if any(c not in ids for c in chars):
            continue
        got, step = bpe._merged([ids[c] for c in chars])
        if got == [i]:
            sound[i] = 1
            bpe.greedy[t] = i
            if not ended:
                bpe.reach[t[:2]] = max(bpe.reach.get(t[:2], 1), len(t))
            if step:
                left[i], right[i], last[i] = step
    made = np.flatnonzero(last >= 0)
    bpe.ordered = bool((last[left[made]] < last[made]).all() and (last[right[made]] < last[made]).all())
    return bpe


def encode_documents(docs: DataFrame, path: str, keep: list[str], with_ids: bool = False, text: str = "text") -> DataFrame:
    """Columns ``keep`` of each row with n_tokens, ids_sha256 and decoded_sha256 (and token_ids) of its whole text.

    ``path`` is the tokenizer file, read where the query is made and sent to the tasks: a vocabulary, the same at any
    size of input. Null and empty texts have no tokens. A kept column named like an output gives way to it. An empty
    table gives an empty result.
    """
    keep = others(keep, "n_tokens", "ids_sha256", "decoded_sha256", *(["token_ids"] if with_ids else []))
    spark: SparkSession = docs.sparkSession
    with open(path, encoding="utf-8") as file:
        held = spark.sparkContext.broadcast(load(file.read()))
    schema = docs.select(*keep).schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    if with_ids:
        from pyspark.sql.types import ArrayType, IntegerType

        schema = schema.add("token_ids", ArrayType(IntegerType()))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = held.value
        for batch in batches:
            texts = batch.column("__text")
            counts, digests, decoded, ids = [], [], [], []
            for first in range(0, batch.num_rows, 200):
                for codes, plain in bpe.lookup([t or "" for t in texts[first : first + 200].to_pylist()]):
                    counts.append(codes.count(" ") + 1 if codes else 0)
                    digests.append(hashlib.sha256(codes.encode()).hexdigest())
                    decoded.append(hashlib.sha256(plain.encode()).hexdigest())
                    if with_ids:
                        ids.append(np.array(codes.split(), np.int32))
            arrays = [pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())]
            if with_ids:
                arrays.append(pa.array(ids, pa.list_(pa.int32())))
            yield pa.record_batch([*[batch.column(k) for k in keep], *arrays], names=schema.names)

    return docs.select(*keep, F.col(text).alias("__text")).mapInArrow(encoded, schema)
