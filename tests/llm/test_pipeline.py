import numpy as np

import corpus_pipeline as cp
from pyspark.sql import functions as F
from tests.llm.test_text_operators import brute_groups, brute_kept
from tillframe.llm import string_tiling

SMALL = "/root/testdata/sf0.001"


def stage_results(spark, docs, folder, tmp_path):
    for name, stage in cp.STAGES:
        before = docs
        stage(spark, docs, folder).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        yield name, before, docs


def test_stages_equal_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    items = [string_tiling.word_rows([r["text"]])[0] for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    for name, before, after in stage_results(spark, docs, SMALL, tmp_path):
        old, new = ({r["doc_id"]: r for r in x.collect()} for x in (before, after))
        if name == "language_id":
            assert new == {i: r for i, r in old.items() if any(c.isalpha() for c in r["text"] or "")}
        elif name == "simhash_near_dedup":
            assert set(new) == {i for i, _, c in brute_groups([(i, r["text"]) for i, r in old.items()]) if i == c}
        elif name == "suffix_array_dedup":
            kept = brute_kept([r["text"].encode() for r in old.values()], cp.PASSAGE_BYTES)
            assert {i: r["text"] for i, r in new.items()} == {i: k[3].decode("utf-8", "ignore") for i, k in zip(old, kept)}
            assert all(r["n_chars"] == len(r["text"]) for r in new.values() if r["text"] != old[r["doc_id"]]["text"])
        elif name == "benchmark_decontamination":
            words = {i: string_tiling.word_rows([r["text"]])[0] for i, r in old.items()}
            bad = {i for i, w in words.items() if max(string_tiling.coverage(w, x) for x in items) >= 0.8}
            assert set(new) == set(old) - bad
        else:
            assert set(new) == set(old) and all(len(r["token_ids"]) == r["n_tokens"] for r in new.values())
        if name != "bpe_encoding":
            assert after.columns == cp.COLUMNS


def test_odd_documents_pass(spark, odd_docs, no_docs, tmp_path):
    last = list(stage_results(spark, odd_docs.repartition(3), SMALL, tmp_path / "odd"))
    sizes = [b.count() for _, _, b in last]
    lettered = [r for r in odd_docs.collect() if any(c.isalpha() for c in r["text"] or "")]
    assert sizes[0] == len(lettered)
    assert sizes[1] == len({r["text"] for r in lettered})
    assert [b.count() for _, _, b in stage_results(spark, no_docs, SMALL, tmp_path / "none")] == [0] * 5


def test_run(spark):
    assert cp.run(spark, SMALL).count() > 100
    assert cp.ORACLE_SQL is None
