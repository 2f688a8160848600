"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

Language ID rejects documents without letters and those that every one-versus-rest classifier turns down; SimHash
keeps one document of each group; substring dedup cuts repeated passages out of the texts; decontamination drops
documents that hold a benchmark item; the last stage encodes what is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tillframe.llm import bpe, language_kernel, simhash_index, string_tiling, substring_dedup
from tillframe.llm.queries import tokenizer_path
from tillframe.session import work_path, working_tables

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
PASSAGE_BYTES = 250  # of a repeated passage that goes: those of over 50 words of the given prose have 260 at least
LEAST_LANGUAGE_SCORE = 0.2  # below, the best classifier's output is under -0.6 between -1 and 1


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: learned from the labelled rows that are not held out."""
    model = language_kernel.train_on_documents(docs.select("doc_id", "text", "lang"))
    found = language_kernel.identify(docs, model, COLUMNS)
    taught = model is not None  # with nothing learned there is no ground to reject a lettered text
    sure = (F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LANGUAGE_SCORE)
    lettered = F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False))
    return found.where(sure if taught else lettered).select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group: the smallest doc_id, of repeated rows one."""
    found = simhash_index.near_duplicates(docs.select("doc_id", "text"))
    kept = found.where(F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("text_hash") == F.col("keep_hash")))
    kept = kept.select(F.col("doc_id").alias("kept_id"), F.col("text_hash").alias("kept_hash")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.xxhash64("text") == F.col("kept_hash"))
    alone = docs.join(kept, same, "left_semi").withColumn("__hash", F.xxhash64("text"))
    return alone.dropDuplicates(["doc_id", "__hash"]).select(*COLUMNS)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without their repeated passages; a character that a cut has broken goes with it."""
    found = substring_dedup.remove_repeats(docs, COLUMNS, as_text=True, length=PASSAGE_BYTES)
    whole = F.col("n_removed") == 0
    chars = F.when(whole, F.col("n_chars")).otherwise(F.length("kept").cast("long"))
    return found.select("doc_id", F.when(whole, F.col("text")).otherwise(F.col("kept")).alias("text"), "lang", "source", chars.alias("n_chars"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = string_tiling.decontaminate(docs.select("doc_id", "text"), benchmark).where("contaminated")
    bad = found.select(F.col("doc_id").alias("bad_id"), F.col("text_hash").alias("bad_hash")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("bad_id")) & (F.xxhash64("text") == F.col("bad_hash"))
    return docs.join(bad, same, "left_anti").select(*COLUMNS)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, digests of ids and decoded text, and the token ids."""
    return bpe.encode_documents(docs, tokenizer_path(), ["doc_id", "lang", "source"], with_ids=True)


STAGES = [
    ("language_id", language_stage),
    ("simhash_near_dedup", near_duplicate_stage),
    ("suffix_array_dedup", substring_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("bpe_encoding", encoding_stage),
]

# A trained classifier and an iterative grouping are no SQL; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written to the shared folder and read again.

    The tables that a stage works with go once its result is written; the results stay.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = work_path(spark, f"pipeline-{name}")
        with working_tables(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
