"""Sharding by a two-pass external shuffle of whole records.

The first pass scatters records uniformly into buckets that fit in memory, by a seeded hash of their place; the second
shuffles each bucket by Fisher and Yates and writes it. As buckets follow each other in order of their number, the two
passes are one random permutation of all records. It is cut into shards where their counts are at most one apart (the
law ``rows``), so that a bucket goes to one shard, or to a few neighbours, in large files.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tillframe.session import work_path

BUCKET_ROWS = 200_000
BUCKET_BYTES = 64 << 20


def scatter(rows: DataFrame, buckets: int, seed: int) -> DataFrame:
    """``rows`` with a column ``__bucket``: a seeded hash of the row's place, so that equal rows part too."""
    return rows.withColumn("__bucket", F.pmod(F.xxhash64(F.lit(seed), F.monotonically_increasing_id()), F.lit(buckets)).cast("int"))


def fisher_yates(n: int, seed: int, bucket: int) -> np.ndarray:
    """A permutation of n rows by Fisher and Yates, the same for the same seed and bucket."""
    order = np.arange(n)
    np.random.Generator(np.random.PCG64([seed & (2**63 - 1), bucket])).shuffle(order)
    return order


def shard_starts(rows: int, shards: int) -> np.ndarray:
    """The first place of each shard in the permutation."""
    return np.array([k * rows // shards for k in range(shards)], np.int64)


def shuffled(rows: DataFrame, shards: int, seed: int, key: list[str], size: str) -> DataFrame:
    """``rows``, all columns, with shard and slot.

    key: columns that set the order of a bucket's rows before they are shuffled (rows equal in them change places
    freely); size: the column with a row's bytes. The number of buckets follows the rows and bytes, so that one bucket
    holds about BUCKET_ROWS rows or BUCKET_BYTES at most; the driver gets one count a bucket. ``rows`` is read three
    times and must give its rows in the same splits each time, as a scan of files does; else it is an error. An empty
    table gives an empty result; columns of the names shard and slot are replaced.
    """
    rows = rows.drop("shard", "slot")
    total = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("b")).first()
    buckets = max(1, -(-total["n"] // BUCKET_ROWS), -(-total["b"] // BUCKET_BYTES))
    held = scatter(rows, buckets, seed)
    counts = {r["__bucket"]: r["n"] for r in held.groupBy("__bucket").agg(F.count("*").alias("n")).collect()}
    starts = np.concatenate(([0], np.cumsum([counts.get(b, 0) for b in range(buckets)])))
    known = rows.sparkSession.sparkContext.broadcast((starts, shard_starts(total["n"], shards)))  # one number a bucket
    names = rows.columns
    schema = T.StructType([*rows.schema.fields, T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])

    def dealt(table: pa.Table) -> pa.Table:
        buckets, firsts = known.value
        bucket = table.column("__bucket")[0].as_py()
        if table.num_rows != buckets[bucket + 1] - buckets[bucket]:
            raise RuntimeError("the rows came in other splits than when they were counted; write them as a table first")
        table = table.select(names).sort_by([(k, "ascending") for k in key])
        table = table.take(pa.array(fisher_yates(table.num_rows, seed, bucket)))
        place = np.arange(table.num_rows) + buckets[bucket]
        shard = np.searchsorted(firsts, place, side="right") - 1
        return table.append_column("shard", pa.array(shard.astype(np.int32))).append_column("slot", pa.array(place - firsts[shard]))

    return held.groupBy("__bucket").applyInArrow(dealt, schema)


def write_shards(rows: DataFrame, path: str, shards: int, seed: int, key: list[str], size: str) -> None:
    """Write whole rows to ``path``, one folder a shard, each file in slot order."""
    dealt = shuffled(rows, shards, seed, key, size).sortWithinPartitions("shard", "slot")
    dealt.write.partitionBy("shard").parquet(path)


def shard_documents(docs: DataFrame, shards: int = 40, seed: int = 20240607) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (null under this law) of every document.

    The records (doc_id and text) are written to shards in the shared folder; what is told of them is read back from
    there. size is the UTF-8 bytes of the text plus 16, a null text having none; its crc32 is that of no bytes, 0.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    size = F.length(text).cast("long") + 16
    path = work_path(spark, "shards")
    rows = docs.select("doc_id", "text", size.alias("size"))
    write_shards(rows, path, shards, seed, ["doc_id", "size", "text"], "size")
    schema = T.StructType([*rows.schema.fields, T.StructField("slot", T.LongType()), T.StructField("shard", T.IntegerType())])
    return spark.read.schema(schema).parquet(path).select(
        "doc_id", size.alias("size"), F.crc32(text).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
