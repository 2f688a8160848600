"""Cleaning order lines and deriving dates, margin and shipping time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillframe.schema import has_columns, present

# Fixed value: accepts one- and two-digit months and days.
DATE_PATTERN = "M/d/yyyy"


def valid_line() -> Column:
    """Sold, in a positive quantity, with a known profit."""
    return (F.col("sales") > 0) & (F.col("quantity") > 0) & F.col("profit").isNotNull()


def clean_filter(df: DataFrame) -> DataFrame:
    return df.filter(valid_line())


def parse_dates(df: DataFrame, columns: tuple[str, ...] = ("order_date", "ship_date")) -> DataFrame:
    """Text to dates; text that is no date becomes null and its row stays."""
    found = present(df, columns)
    return df.withColumns({c: F.try_to_date(c, DATE_PATTERN) for c in found})


def profit_margin(df: DataFrame) -> DataFrame:
    """Profit as a percentage of sales, per line."""
    return df.withColumn("profit_margin", F.round(F.try_divide(F.col("profit"), F.col("sales")) * 100, 2))


def date_parts(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "order_year": F.year("order_date"),
            "order_month": F.month("order_date"),
            "order_quarter": F.quarter("order_date"),
            "year_month": F.date_format("order_date", "yyyy-MM"),
        }
    )


def shipping_days(df: DataFrame) -> DataFrame:
    return df.withColumn("shipping_days", F.datediff("ship_date", "order_date"))


def fill_defaults(df: DataFrame) -> DataFrame:
    """Missing discounts and shipping costs count as zero."""
    return df.fillna({c: 0.0 for c in present(df, ("discount", "shipping_cost"))})


def cleaned_lines(df: DataFrame) -> DataFrame:
    """All cleaning steps in order.

    Steps whose input columns are absent are left out, so a caller may pass
    only the columns its report reads.
    """
    df = df.transform(clean_filter).transform(parse_dates).transform(profit_margin)
    if has_columns(df, "order_date"):
        df = df.transform(date_parts)
    if has_columns(df, "order_date", "ship_date"):
        df = df.transform(shipping_days)
    return df.transform(fill_defaults)


def cleaning_retention(raw: DataFrame) -> DataFrame:
    """Rows before and after the filter and the share kept, in one pass over the raw lines."""
    counts = raw.agg(
        F.count(F.lit(1)).alias("rows_before"),
        F.count_if(valid_line()).alias("rows_after"),
    )
    share = F.try_divide(F.col("rows_after"), F.col("rows_before")) * 100
    return counts.withColumn("retention_pct", F.round(share, 2))
