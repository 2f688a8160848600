"""Sorted integer codes for categorical columns, as tables that are fitted once and joined in."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillframe.session import materialize

# The encoded columns of a store observation.
CATEGORICAL = ("region", "store_chain", "beverage_type", "shelf_location")


@dataclass(frozen=True)
class LabelCodes:
    """A stored (label, code) table for each column, whose own size decides how it is joined."""

    tables: dict[str, DataFrame]


def fit_label_codes(df: DataFrame, columns: tuple[str, ...] = CATEGORICAL) -> LabelCodes:
    """Number the distinct labels of each column from 0 in sort order; a missing label comes last.

    ``df`` is read once a column, with that column only: pass a written table where joins stand behind it.
    """
    labels = [df.select(F.lit(c).alias("column_name"), F.col(f"`{c}`").alias("label")).distinct() for c in columns]
    ranked = _ranked(reduce(DataFrame.union, labels))
    return LabelCodes(
        {c: materialize(ranked.filter(F.col("column_name") == c).select("label", "code"), "label-codes") for c in columns}
    )


def label_encode(df: DataFrame, codes: LabelCodes) -> DataFrame:
    """Add ``<column>_encoded`` for each fitted column; a label unknown to ``codes`` raises.

    Spark broadcasts the codes of a column if their files are small, and shuffles both sides otherwise.
    """
    for column, table in codes.tables.items():
        label, code = f"_{column}_label", f"{column}_encoded"
        lookup = table.toDF(label, code)
        shown = F.coalesce(F.col(f"`{column}`"), F.lit("NULL"))
        unseen = F.raise_error(F.concat(F.lit(f"unseen label in {column}: "), shown)).cast("int")
        df = (
            df.join(lookup, F.col(f"`{column}`").eqNullSafe(F.col(f"`{label}`")), "left")
            .withColumn(code, F.when(F.col(f"`{code}`").isNull(), unseen).otherwise(F.col(f"`{code}`")))
            .drop(label)
        )
    return df


def _ranked(labels: DataFrame) -> DataFrame:
    """Ranks of distinct labels: the place in a sorted range, plus the labels in the ranges before it."""
    order = F.asc_nulls_last("label")
    ranges = labels.repartitionByRange("column_name", order).withColumn("part", F.spark_partition_id())
    placed = materialize(ranges, "labels")  # written, as a range has its number only here
    before = Window.partitionBy("column_name").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("column_name", "part").agg(F.count(F.lit(1)).alias("n"))
    starts = starts.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    place = F.row_number().over(Window.partitionBy("column_name", "part").orderBy(order)) - 1
    return placed.withColumn("place", place).join(starts, ["column_name", "part"]).select(
        "column_name", "label", (F.col("place") + F.col("start")).cast("int").alias("code")
    )
