"""The registered queries of this subpackage, and their SQL where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tillframe.llm import (
    bpe,
    chat_template,
    language_kernel,
    licences,
    quality_qda,
    shuffle_shards,
    simhash_index,
    string_tiling,
    substring_dedup,
    token_alignment,
    toxicity,
    vector_search,
    whitening,
)


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tokenizer_path() -> str:
    """The vocabulary that op7 and the pipeline encode with."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text", "lang")
    model = language_kernel.train_on_documents(docs)
    rows = docs.select("doc_id", language_kernel.held_out(F.col("doc_id"), 4, 2).alias("held_out"), "text")
    return language_kernel.identify(rows, model, ["doc_id", "held_out"])


def quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality_qda.score_documents(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = string_tiling.decontaminate(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))
    return found.drop("text_hash")


def chat(spark: SparkSession, folder: str) -> DataFrame:
    turns = _table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    return chat_template.digest_conversations(turns.union(chat_template.planted(spark)))


def simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash_index.near_duplicates(_table(spark, folder, "documents").select("doc_id", "text"))
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")


def substrings(spark: SparkSession, folder: str) -> DataFrame:
    found = substring_dedup.remove_repeats(_table(spark, folder, "documents").select("doc_id", "text"), ["doc_id"])
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def tokens(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encode_documents(_table(spark, folder, "documents"), tokenizer_path(), ["doc_id"])


def nearest(spark: SparkSession, folder: str) -> DataFrame:
    return vector_search.search(_table(spark, folder, "embeddings"))


def licence_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licences.scan(_table(spark, folder, "documents"), ["doc_id"])


def sharding(spark: SparkSession, folder: str) -> DataFrame:
    return shuffle_shards.shard_documents(_table(spark, folder, "documents"))


def toxic(spark: SparkSession, folder: str) -> DataFrame:
    found = toxicity.score_documents(_table(spark, folder, "documents"), _table(spark, folder, "labels"))
    nearest_ = F.try_element_at("evidence", F.lit(1))["cosine"]
    return found.select("doc_id", "held_out", "score", "predicted", F.size("evidence").alias("n_evidence"), nearest_.alias("nearest_cosine"))


def aligned_tokens(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    a, b = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return token_alignment.align(_table(spark, folder, "documents"), a, b, ["doc_id"])


def whitened(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(_table(spark, folder, "embeddings"))


def registry() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Query name -> callable(spark, folder of Parquet tables)."""
    return {
        "op1_language_id": language_id,
        "op2_quality": quality,
        "op3_decontamination": decontamination,
        "op4_chat_formatting": chat,
        "op5_simhash": simhash,
        "op6_substring_dedup": substrings,
        "op7_bpe": tokens,
        "op8_vector_search": nearest,
        "op9_licences": licence_scan,
        "op10_sharding": sharding,
        "op11_toxicity": toxic,
        "op12_token_alignment": aligned_tokens,
        "op13_whitening": whitened,
    }


# Exact integer inner products of every query with every row of its length.
NEAREST_SQL = """
with sound as (
  select row_number() over () place, vec_id, list_transform(embedding, lambda x: cast(floor(x::double * 256) as bigint)) v
  from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
  select q.vec_id query_id, q.place query_place, c.vec_id, c.place,
         cast(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) as bigint) score
  from sound q join sound c on len(q.v) = len(c.v) and q.place <> c.place
  where q.vec_id % 50 = 0
), ranked as (
  select query_id, row_number() over (partition by query_place order by score desc, vec_id nulls last, place) "rank", vec_id, score
  from scored
)
select query_id, cast("rank" as integer) "rank", vec_id, score from ranked where "rank" <= 5
"""


def twins() -> dict[str, str]:
    """Query name -> the same query for DuckDB."""
    return {"op8_vector_search": NEAREST_SQL, "op9_licences": licences.scan_sql()}
