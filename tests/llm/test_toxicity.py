import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tillframe.llm import queries, toxicity as tx


def test_terms_are_words_prefixes_and_marks():
    found = tx.terms_of("Idiotic IDIOTIC x1 x")
    assert found["idiotic$"] == 2 and found["idio"] == 2 and found["idioti"] == 2 and "idiotic" not in found
    assert found["idiotic$*2"] == 1 and "idiotic$*4" not in found and found["x$"] == 2
    assert tx.terms_of(None) == tx.terms_of("12 !") == {}


@given(st.text("abAB é1 ", max_size=80), st.sets(st.text("abé", min_size=4, max_size=6), max_size=10))
@settings(max_examples=100, deadline=None)
def test_vectors_are_the_terms_of_the_space(text, prefixes):
    terms = sorted(prefixes | {t + "*2" for t in prefixes} | {t + "$" for t in prefixes} | {"a$", "a$*4", "ab$"})
    numbers, times = tx.Space(terms).vector(text)
    assert {terms[i]: n for i, n in zip(numbers, times)} == {t: n for t, n in tx.terms_of(text).items() if t in terms}
    assert numbers == sorted(numbers)


@given(st.integers(0, 10_000), st.integers(1, 8), st.integers(1, 7))
@settings(max_examples=60, deadline=None)
def test_neighbours_equal_brute_force(seed, k, block):
    rng = np.random.default_rng(seed)
    dense = rng.integers(0, 3, (60, 12)) * (rng.random((60, 12)) < 0.4)
    dense[rng.integers(60, size=8)] = dense[0]  # repeated rows and ties
    idf = rng.random(12) + 0.5
    sparse = [(np.flatnonzero(r), tx.unit(np.flatnonzero(r), r[r > 0].astype(float), idf)) for r in dense]
    index = tx.BlockMaxIndex(sparse, 12, block)
    full = np.zeros((60, 12))
    for i, (t, w) in enumerate(sparse):
        full[i, t] = w
    for i in range(0, 60, 7):
        for skip in (-1, i):
            cosines = np.minimum((full @ full[i]).round(12), 1)
            if skip >= 0:
                cosines[skip] = 0
            wanted = [j for j in np.lexsort((np.arange(60), -cosines)) if cosines[j] > 0][:k]
            near, found, _ = index.search(*sparse[i], k, skip)
            assert np.allclose(found, cosines[wanted])
            assert near.tolist() == wanted or np.allclose(cosines[near], cosines[wanted])


def test_blocks_without_a_chance_are_not_scored():
    rows = [(np.array([i // 64]), np.array([1.0])) for i in range(64 * 50)]
    near, cosines, scored = tx.BlockMaxIndex(rows, 50).search(np.array([7]), np.array([1.0]), 5)
    assert near.tolist() == [448, 449, 450, 451, 452] and scored == 1
    mixed = [(np.array([0, 1 + i // 64]), np.array([0.1, np.sqrt(0.99)])) for i in range(64 * 50)]
    assert tx.BlockMaxIndex(mixed, 51).search(np.array([0, 9]), np.array([0.1, np.sqrt(0.99)]), 5)[2] <= tx.FIRST_WAVE


def test_calibration_is_monotone_and_near_the_shares():
    rng = np.random.default_rng(0)
    votes = rng.random(4000).round(2)
    labels = (rng.random(4000) < votes**2).astype(int)
    at, shares = tx.isotonic(votes, labels, np.ones(4000))
    assert (np.diff(at) > 0).all() and (np.diff(shares) >= 0).all()
    assert np.abs(np.interp([0.2, 0.5, 0.8], at, shares) - np.array([0.04, 0.25, 0.64])).max() < 0.08


def test_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    rows = queries.toxic(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("held_out").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert np.mean([r["predicted"] for r in rows if r["toxic"] == 1]) > 0.9
    assert np.mean([r["predicted"] for r in rows if r["toxic"] == 0]) < 0.02
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)


def test_held_out_labels_are_not_learned(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("toxic", F.when(tx.held_out(F.col("doc_id"), 4, 2), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    scores = [sorted((r["doc_id"], round(r["score"], 9)) for r in tx.score_documents(docs.repartition(n), part).collect()) for n, part in ((1, labels), (5, turned))]
    assert scores[0] == scores[1]


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(0, 1, 0.5), (1, 0, 0.5), (1, 0, 0.1), (4, None, 0.0), (6, 1, 1.0), (6, 0, 1.0), (5, 0, 0.0), (None, 1, 0.0), (99, 7, 0.0)], "doc_id long, toxic int, score double")
    found = tx.score_documents(odd_docs, labels)
    assert found.columns == ["doc_id", "held_out", "score", "predicted", "evidence"]
    assert sorted(map(str, (r["doc_id"] for r in found.collect()))) == sorted(map(str, (r["doc_id"] for r in odd_docs.collect())))
    assert tx.score_documents(no_docs, labels).count() == 0
    none = tx.score_documents(odd_docs, labels.limit(0)).collect()
    assert {(r["score"], len(r["evidence"])) for r in none} == {(0.5, 0)}


def test_equal_texts_and_empty_ones(spark):
    calm, angry = "the quiet river bends past the old mill", "you worthless fool you worthless fool"
    texts = [(i, (angry if i % 3 == 0 else calm) + f" {chr(97 + i % 26) * 3}") for i in range(120)] + [(1000, ""), (1001, None), (1002, angry.upper())]
    labels = [(i, int(i % 3 == 0)) for i in range(120)]
    found = {r["doc_id"]: r for r in tx.score_documents(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    assert found[1002]["predicted"] == 1 and found[1002]["evidence"][0]["label"] == 1
    assert found[1000]["score"] == found[1001]["score"] and found[1000]["evidence"] == []
    assert all(found[i]["predicted"] == (i % 3 == 0) for i in range(120))


@pytest.mark.parametrize("per_label", [5, 40])
def test_the_sample_is_bounded(spark, per_label):
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(2000)], "doc_id long, label int")
    chosen, shares = tx.sample_labels(labels, per_label)
    assert chosen.count() < 5 * per_label and shares == {0: per_label / 1500, 1: per_label / 500}
