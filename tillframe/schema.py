"""Column names, types and CSV headings of the two input tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# CSV heading -> (column name, type) of an order line.
ORDER_LINE_COLUMNS: dict[str, tuple[str, T.DataType]] = {
    "Order ID": ("order_id", T.StringType()),
    "Order Date": ("order_date", T.StringType()),
    "Ship Date": ("ship_date", T.StringType()),
    "Ship Mode": ("ship_mode", T.StringType()),
    "Customer ID": ("customer_id", T.StringType()),
    "Customer Name": ("customer_name", T.StringType()),
    "Segment": ("segment", T.StringType()),
    "Country": ("country", T.StringType()),
    "Region": ("region", T.StringType()),
    "Market": ("market", T.StringType()),
    "Product ID": ("product_id", T.StringType()),
    "Product Name": ("product_name", T.StringType()),
    "Category": ("category", T.StringType()),
    "Sub-Category": ("sub_category", T.StringType()),
    "Sales": ("sales", T.DoubleType()),
    "Quantity": ("quantity", T.DoubleType()),
    "Discount": ("discount", T.DoubleType()),
    "Profit": ("profit", T.DoubleType()),
    "Shipping Cost": ("shipping_cost", T.DoubleType()),
    "Year": ("year", T.IntegerType()),
    "weeknum": ("weeknum", T.IntegerType()),
}

# Columns of a store observation.
OBSERVATION_SCHEMA = T.StructType(
    [
        T.StructField("obs_key", T.StringType()),
        T.StructField("region", T.StringType()),
        T.StructField("population_density", T.DoubleType()),
        T.StructField("median_income", T.DoubleType()),
        T.StructField("store_chain", T.StringType()),
        T.StructField("store_size", T.DoubleType()),
        T.StructField("weekly_foot_traffic", T.DoubleType()),
        T.StructField("beverage_type", T.StringType()),
        T.StructField("price", T.DoubleType()),
        T.StructField("promotion_intensity", T.DoubleType()),
        T.StructField("shelf_location", T.StringType()),
        T.StructField("competitor_count", T.IntegerType()),
        T.StructField("market_share", T.DoubleType()),
        T.StructField("monthly_sales", T.DoubleType()),
    ]
)

ORDER_LINE_SCHEMA = T.StructType([T.StructField(name, kind) for name, kind in ORDER_LINE_COLUMNS.values()])

HEADINGS = {name: heading for heading, (name, _) in ORDER_LINE_COLUMNS.items()}


def has_columns(df: DataFrame, *columns: str) -> bool:
    """Whether every column exists; the optional reports ask this while the plan is built."""
    return set(columns) <= set(df.columns)


def present(df: DataFrame, columns: Iterable[str]) -> list[str]:
    """Those of ``columns`` that ``df`` has, in the given order."""
    return [c for c in columns if c in df.columns]


def is_numeric(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, T.NumericType)
