"""Toxicity by nearest labelled examples under exact TF-IDF cosine.

*Terms* are runs of letters, their first 4 to 8 letters, and marks for terms that occur at least 2 or 4 times in a text.
A bounded sample of the labelled rows says which terms depend on the label (a G test, at a threshold at which fewer
than about one of the tried terms passes by chance) and by much (odds that double or halve); they make up the space. Document frequencies are counted
over all documents.

*Index.* Examples lie in blocks, similar ones together. For each term it holds the blocks where the term occurs, its
largest weight there, and its postings. A query adds up the largest weights into a bound for each block and scores
blocks in falling order of their bounds, until no bound reaches the k-th best cosine: the neighbours are exact.

*Votes* weigh a neighbour by the inverse of its distance and by how many labelled rows it stands for. Leave-one-out
votes of the examples, made monotone (pool adjacent violators), turn a vote into a calibrated score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tillframe.llm.language_kernel import held_out
from tillframe.session import materialize

BLOCK = 64
FIRST_WAVE = 4
PREFIXES = range(4, 9)
MARKS = (2, 4)
LEAST_ROWS = 4
LEAST_ODDS = 2.0
TASK_ROWS = 8192
NEAR = 0.01  # added to a distance, so that an equal text does not outvote all others
SLACK = 1e-9
LETTERS = re.compile(r"[^\W\d_]+")
EVIDENCE = "array<struct<example:long,cosine:double,label:int>>"


def terms_of(text: str | None) -> Counter:
    """Every term of a whole text with the number of times it occurs; a mark counts once."""
    found: Counter = Counter()
    for word, times in Counter(LETTERS.findall((text or "").lower())).items():
        found[word + "$"] += times
        for size in PREFIXES:
            if len(word) > size:
                found[word[:size]] += times
    for term, times in list(found.items()):
        for mark in MARKS:
            if times >= mark:
                found[f"{term}*{mark}"] = 1
    return found


class Space:
    """The chosen terms by number, and vectors of texts over them."""

    def __init__(self, terms: Sequence[str]):
        self.number = {term: i for i, term in enumerate(terms)}
        bare = {term.partition("*")[0] for term in self.number}
        self.heads = {term[: PREFIXES[0]] for term in bare if len(term) >= PREFIXES[0]}
        self.bare = bare

    def vector(self, text: str | None) -> tuple[list[int], list[int]]:
        """Term numbers in order and how often each occurs; what ``terms_of`` gives, restricted to the chosen terms."""
        counts: Counter = Counter()
        for word, times in Counter(LETTERS.findall((text or "").lower())).items():
            whole = word + "$"
            if whole in self.bare:
                counts[whole] += times
            if word[: PREFIXES[0]] in self.heads:
                for size in PREFIXES:
                    if len(word) > size and word[:size] in self.bare:
                        counts[word[:size]] += times
        found = []
        for term, times in counts.items():
            if term in self.number:
                found.append((self.number[term], times))
            for mark in MARKS:
                if times >= mark and f"{term}*{mark}" in self.number:
                    found.append((self.number[f"{term}*{mark}"], 1))
        found.sort()
        return [t for t, _ in found], [n for _, n in found]


def unit(terms: np.ndarray, times: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF weights of one text, of length 1 (no terms: none)."""
    weights = (1 + np.log(times)) * idf[terms]
    return weights / max(float(np.sqrt(weights @ weights)), 1e-300)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All numbers of start, start + 1, ... of each size, end to end."""
    before = np.concatenate(([0], np.cumsum(sizes)[:-1])) if len(sizes) else sizes
    return np.arange(int(sizes.sum())) + np.repeat(starts - before, sizes)


class BlockMaxIndex:
    """Inverted index over unit vectors, with the largest weight of each term in each block of examples."""

    def __init__(self, vectors: Sequence[tuple[np.ndarray, np.ndarray]], n_terms: int, block: int = BLOCK):
        """``vectors``: (term numbers in order, weights) of each example; similar ones should lie side by side."""
        self.size, self.block = len(vectors), block
        self.blocks = max(1, -(-len(vectors) // block))
        terms = np.concatenate([np.asarray(t, np.int64) for t, _ in vectors] or [np.zeros(0, np.int64)])
        weights = np.concatenate([np.asarray(w, np.float64) for _, w in vectors] or [np.zeros(0)])
        example = np.repeat(np.arange(len(vectors)), [len(t) for t, _ in vectors])
        order = np.lexsort((example, terms))
        terms, self.post_example, self.post_weight = terms[order], example[order], weights[order]
        place = terms * self.blocks + self.post_example // block
        heads = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1]))) if len(place) else np.zeros(0, np.int64)
        self.entry_block = place[heads] % self.blocks
        self.entry_max = np.maximum.reduceat(self.post_weight, heads) if len(heads) else np.zeros(0)
        self.post_start = np.concatenate((heads, [len(place)])).astype(np.int64)
        self.entry_start = np.searchsorted(terms[heads], np.arange(n_terms + 1))

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int, skip: int = -1) -> tuple[np.ndarray, np.ndarray, int]:
        """The k examples of highest cosine above zero and their cosines, ties to the first, and how many blocks were
        scored. ``skip`` is left out."""
        first = self.entry_start[terms]
        sizes = self.entry_start[terms + 1] - first
        entries, q = _ranges(first, sizes), np.repeat(weights, sizes)
        where = self.entry_block[entries]
        bounds = np.bincount(where, q * self.entry_max[entries], self.blocks)
        order = np.argsort(-bounds, kind="stable")
        order = order[bounds[order] > 0]
        best, cosines = np.zeros(0, np.int64), np.zeros(0)
        done, wave = 0, FIRST_WAVE
        while done < len(order) and (len(best) < k or bounds[order[done]] + SLACK >= cosines[-1]):
            mark = np.zeros(self.blocks, bool)
            mark[order[done : done + wave]] = True
            inside = mark[where]
            e, w = entries[inside], q[inside]
            lengths = self.post_start[e + 1] - self.post_start[e]
            p = _ranges(self.post_start[e], lengths)
            sums = np.bincount(self.post_example[p], np.repeat(w, lengths) * self.post_weight[p], self.size)
            if skip >= 0:
                sums[skip] = 0
            hit = np.flatnonzero(sums > (cosines[-1] - SLACK if len(best) == k else 0))
            best, cosines = np.concatenate((best, hit)), np.concatenate((cosines, np.minimum(sums[hit].round(12), 1)))
            top = np.lexsort((best, -cosines))[:k]
            best, cosines = best[top], cosines[top]
            done, wave = done + wave, 2 * wave
        return best, cosines, min(done, len(order))


def isotonic(votes: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Increasing votes and the label shares at them, never falling: equal votes first, then adjacent violators pooled.

    Each share leans on the overall one by the weight of a single row.
    """
    prior = float((labels * weights).sum() / weights.sum())
    pools: list[list[float]] = []  # weight, positive weight, sum of votes
    for vote in np.unique(votes):
        at = votes == vote
        pools.append([weights[at].sum(), (weights * labels)[at].sum(), vote * weights[at].sum()])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    total = weights.mean()
    shares = np.array([(p[1] + prior * total) / (p[0] + total) for p in pools])
    return np.array([p[2] / p[0] for p in pools]), np.maximum.accumulate(shares)


@dataclass(frozen=True)
class ToxicityModel:
    """Index of the examples, what they are, and the calibration. Without examples every score is ``prior``."""

    prior: float
    idf: np.ndarray | None = None
    index: BlockMaxIndex | None = None
    ids: np.ndarray | None = None
    labels: np.ndarray | None = None
    weights: np.ndarray | None = None
    k: int = 15
    votes: np.ndarray | None = None
    shares: np.ndarray | None = None
    alone: float = 0.0

    def vote(self, terms: np.ndarray, times: np.ndarray, skip: int = -1) -> tuple[float, np.ndarray, np.ndarray]:
        """Weighted share of label 1 among the neighbours (-1 without any), the neighbours and their cosines."""
        if not len(terms):
            return -1.0, np.zeros(0, np.int64), np.zeros(0)
        near, cosines, _ = self.index.search(terms, unit(terms, times, self.idf), self.k, skip)
        if not len(near):
            return -1.0, near, cosines
        weights = self.weights[near] / (NEAR + 1 - cosines)
        return float((weights * self.labels[near]).sum() / weights.sum()), near, cosines

    def score(self, vote: float) -> float:
        if self.votes is None or not len(self.votes):
            return self.alone if self.index is not None else self.prior
        return self.alone if vote < 0 else float(np.interp(vote, self.votes, self.shares))


def vectors(docs: DataFrame, space: Space, keep: list[str]) -> DataFrame:
    """Columns ``keep`` with terms and times of each whole text; a null text has none."""
    held = docs.sparkSession.sparkContext.broadcast(space)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [held.value.vector(t) for t in batch.column("__text").to_pylist()]
            lists = [pa.array([p[i] for p in pairs], pa.list_(pa.int32())) for i in (0, 1)]
            yield pa.record_batch([*[batch.column(k) for k in keep], *lists], names=[*keep, "terms", "times"])

    schema = docs.select(*keep).schema.add("terms", T.ArrayType(T.IntegerType())).add("times", T.ArrayType(T.IntegerType()))
    return docs.select(*keep, F.col("text").alias("__text")).mapInArrow(found, schema)


def choose_terms(examples: DataFrame, most: int) -> list[str]:
    """Terms of (text, label) rows that depend on the label, the strongest ``most`` at most, in order of strength.

    The G statistic of a term that does not depend on the label exceeds 2 ln(n) with a chance of under 1 in n; n is
    the number of terms that occur in four rows at least, which alone are tried. Of those that pass, the odds of label 1
    must be at least doubled or halved, so that words of long texts in general stay out.
    """

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
                terms = list(terms_of(text))
                yield pa.record_batch([pa.array(terms, pa.string()), pa.array([label] * len(terms), pa.int32())], names=["term", "label"])

    both = examples.agg(F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("t")).first()
    n, t = both["n"], both["t"]
    if not 0 < t < n:
        return []
    counts = examples.select("text", "label").mapInArrow(listed, "term string, label int").groupBy("term")
    counts = counts.agg(F.count("*").alias("n"), F.sum("label").alias("t")).where(F.col("n") >= LEAST_ROWS)
    counts = materialize(counts, "toxicity-terms")
    tried = counts.count()
    cell = lambda seen, share, rows: F.when(seen > 0, seen * F.log(seen / (rows * share))).otherwise(0.0)
    a, rows = F.col("t").cast("double"), F.col("n").cast("double")
    p = t / n
    g = 2 * (cell(a, p, rows) + cell(rows - a, 1 - p, rows) + cell(t - a, p, n - rows) + cell(n - rows - (t - a), 1 - p, n - rows))
    odds = (a + 0.5) * (n - rows - (t - a) + 0.5) / ((rows - a + 0.5) * (t - a + 0.5))
    strong = counts.withColumn("g", g).where(F.col("g") > 2 * log(max(tried, 2))).where(F.abs(F.log(odds)) >= log(LEAST_ODDS))
    return [r["term"] for r in strong.orderBy(F.desc("g"), "term").limit(most).select("term").collect()]


def sample_labels(labels: DataFrame, per_label: int) -> tuple[DataFrame, dict[int, float]]:
    """(doc_id, label) of about ``per_label`` rows of each label, chosen by a hash of the id, and the shares chosen.

    A doc_id counts once; if it is marked both ways, as 1. Other values than 0 and 1, and null ids, are left out.
    """
    clean = labels.where("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.max("label").alias("label"))
    sizes = {r["label"]: r["n"] for r in clean.groupBy("label").agg(F.count("*").alias("n")).collect()}
    shares = {k: min(1.0, per_label / n) for k, n in sizes.items()}
    u = F.pmod(F.xxhash64(F.lit("toxicity sample"), "doc_id"), F.lit(1 << 40)) / float(1 << 40)
    share = F.when(F.col("label") == 1, shares.get(1, 0.0)).otherwise(shares.get(0, 0.0))
    return clean.where(u < share), shares


def fit(measured: DataFrame, n: int, examples: DataFrame, shares: dict[int, float], n_terms: int, k: int = 15) -> ToxicityModel:
    """Learn from ``examples`` (doc_id, label, terms, times), which are bounded; ``measured`` is all ``n`` documents' vectors."""
    rows = sorted(examples.collect(), key=lambda r: (-max(r["times"], default=0), r["terms"], r["doc_id"]))
    rows.sort(key=lambda r: r["terms"][:3])  # those that share their strongest terms lie side by side
    labels = np.array([r["label"] for r in rows], np.int64)
    weights = np.array([1 / shares[r["label"]] for r in rows])
    prior = (float((labels * weights).sum()) + 1) / (float(weights.sum()) + 2)
    if not rows or labels.min() == labels.max():
        return ToxicityModel(prior)
    df = document_frequencies(measured, n_terms)
    idf = np.log((1 + n) / (1 + df)) + 1
    pairs = [(np.array(r["terms"], np.int64), np.array(r["times"], np.float64)) for r in rows]
    index = BlockMaxIndex([(t, unit(t, c, idf)) for t, c in pairs], n_terms)
    ids = np.array([r["doc_id"] for r in rows], np.int64)
    model = ToxicityModel(prior, idf, index, ids, labels, weights, k)
    spark = measured.sparkSession
    held = spark.sparkContext.broadcast((model, pairs))

    def left_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, pairs = held.value
        for batch in batches:
            at = batch.column("id").to_pylist()
            yield pa.record_batch([batch.column("id"), pa.array([model.vote(*pairs[i], skip=i)[0] for i in at], pa.float64())], names=["id", "vote"])

    votes = np.full(len(rows), -1.0)
    for r in spark.range(len(rows)).mapInArrow(left_out, "id long, vote double").collect():
        votes[r["id"]] = r["vote"]
    lone = votes < 0
    alone = (float((labels * weights)[lone].sum()) + prior * weights.mean()) / (float(weights[lone].sum()) + weights.mean())
    curve = isotonic(votes[~lone], labels[~lone], weights[~lone]) if not lone.all() else (None, None)
    return ToxicityModel(prior, idf, index, ids, labels, weights, k, *curve, alone)


def document_frequencies(measured: DataFrame, n_terms: int) -> np.ndarray:
    """In how many rows each term occurs. Tasks count their own rows and give a row for each term they have seen."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(n_terms, np.int64)
        for batch in batches:
            own += np.bincount(batch.column("terms").flatten().to_numpy(zero_copy_only=False), minlength=n_terms)
        seen = np.flatnonzero(own)
        yield pa.record_batch([pa.array(seen, pa.int32()), pa.array(own[seen])], names=["term", "n"])

    df = np.zeros(n_terms)
    for r in measured.select("terms").mapInArrow(counted, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        df[r["term"]] = r["n"]
    return df


def score(measured: DataFrame, model: ToxicityModel, keep: list[str], shown: int = 5) -> DataFrame:
    """Columns ``keep``, score and evidence: the nearest ``shown`` examples with their cosine and label."""
    held = measured.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        kind = pa.list_(pa.struct([("example", pa.int64()), ("cosine", pa.float64()), ("label", pa.int32())]))
        for batch in batches:
            scores, evidence = [], []
            for terms, times in zip(batch.column("terms").to_pylist(), batch.column("times").to_pylist()):
                vote, near, cosines = model.vote(np.array(terms, np.int64), np.array(times, np.float64)) if model.index else (-1.0, (), ())
                scores.append(model.score(vote))
                evidence.append([{"example": int(model.ids[i]), "cosine": float(c), "label": int(model.labels[i])} for i, c in zip(near[:shown], cosines)])
            yield pa.record_batch([*[batch.column(c) for c in keep], pa.array(scores, pa.float64()), pa.array(evidence, kind)], names=[*keep, "score", "evidence"])

    schema = measured.select(*keep).schema.add("score", "double").add("evidence", T._parse_datatype_string(EVIDENCE))
    return measured.select(*keep, "terms", "times").mapInArrow(scored, schema)


def score_documents(
    docs: DataFrame, labels: DataFrame, per_label: int = 4000, most_terms: int = 20_000, k: int = 15, threshold: float = 0.3
) -> DataFrame:
    """doc_id, held_out, score, predicted and evidence of every row of ``docs`` (doc_id, text), whatever else it holds.

    Labels (doc_id, toxic) of held-out rows (crc32 of the id, modulo 4, is 2) are not learned from. About ``per_label``
    labelled rows of each label and at most ``most_terms`` terms are: the bounds on what is fitted. Of rows with the
    same id the least text is the example; every row is scored. A text without a chosen term, null and empty ones too,
    has no neighbours and gets the share of label 1 among such examples. If no label, or only one, is known, every
    score is the (smoothed) share of label 1, and evidence is empty. An empty table gives an empty result.
    """
    rows = docs.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "text")
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("label"))
    chosen, shares = sample_labels(known.where(~held_out(F.col("doc_id"), 4, 2)), per_label)
    chosen = materialize(chosen, "toxicity-labels")
    texts = rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    examples = materialize(texts, "toxicity-examples")
    space = Space(choose_terms(examples, most_terms))
    measured = materialize(vectors(rows, space, ["doc_id", "held_out"]), "toxicity-vectors")
    n = measured.count()
    model = fit(measured, n, vectors(examples, space, ["doc_id", "label"]), shares, len(space.number), k)
    spread = measured.repartition(max(1, -(-n // TASK_ROWS)))  # vectors are small, so a split holds very many
    found = score(spread, model, ["doc_id", "held_out"])
    return found.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "evidence")
