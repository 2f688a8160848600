"""Sales reports by region, product, period, customer and shipping mode.

Ranked reports break ties on their group keys, so their order and their top
rows are repeatable. Reports on optional columns return None where the column
is absent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillframe.functions.measures import average, exact_avg, margin_pct, total, zero_filled_corr
from tillframe.schema import has_columns

# Measures several reports share; built on use, as a Column needs a session.
MEASURES = {
    "total_sales": lambda: total("sales"),
    "total_profit": lambda: total("profit"),
    "total_quantity": lambda: F.sum("quantity"),
    "avg_line_sales": lambda: average("sales"),
    "avg_profit": lambda: average("profit"),
    "avg_shipping_days": lambda: average("shipping_days"),
    "avg_margin_pct": lambda: average("profit_margin"),
    "avg_discount_pct": lambda: F.round(exact_avg("discount") * 100, 2),
    "margin_pct": margin_pct,
    "line_count": lambda: F.count("order_id"),
    "customer_count": lambda: F.count_distinct("customer_id"),
    "order_count": lambda: F.count_distinct("order_id"),
}

PRODUCT_KEYS = ("product_id", "product_name", "category")
CUSTOMER_KEYS = ("customer_id", "customer_name", "segment")


def region_performance(df: DataFrame) -> DataFrame:
    measures = ("total_sales", "total_profit", "customer_count", "order_count", "avg_line_sales", "margin_pct")
    return _rank(_summarize(df, ("region",), measures), ("region",), "total_sales")


def market_performance(df: DataFrame) -> DataFrame | None:
    if not has_columns(df, "market"):
        return None
    measures = ("total_sales", "total_profit", "customer_count")
    return _rank(_summarize(df, ("market",), measures), ("market",), "total_sales")


def top_countries(df: DataFrame, limit: int = 10) -> DataFrame:
    measures = ("total_sales", "total_profit", "customer_count")
    return _rank(_summarize(df, ("country",), measures), ("country",), "total_sales", limit)


def category_performance(df: DataFrame) -> DataFrame:
    keys = ("category", "sub_category")
    lines = F.count(F.lit(1)).alias("line_count")
    measures = ("total_sales", "total_profit", "avg_line_sales", "margin_pct", "avg_discount_pct")
    return _rank(_summarize(df, keys, measures, lines), keys, "total_sales")


def top_products(df: DataFrame, limit: int = 10) -> DataFrame:
    measures = ("total_sales", "total_quantity", "order_count", "avg_line_sales")
    return _rank(_summarize(df, PRODUCT_KEYS, measures), PRODUCT_KEYS, "total_sales", limit)


def top_profitable_products(df: DataFrame, limit: int = 10) -> DataFrame:
    products = _summarize(df, PRODUCT_KEYS, ("total_profit", "total_sales", "margin_pct"))
    return _rank(products.filter(F.col("total_profit") > 0), PRODUCT_KEYS, "total_profit", limit)


def yearly_sales(df: DataFrame) -> DataFrame:
    measures = ("total_sales", "total_profit", "customer_count", "order_count", "margin_pct")
    return _summarize(df, ("order_year",), measures).orderBy("order_year")


def monthly_sales(df: DataFrame) -> DataFrame:
    return _summarize(df, ("year_month",), ("total_sales", "total_profit", "order_count")).orderBy("year_month")


def quarterly_sales(df: DataFrame) -> DataFrame:
    keys = ("order_year", "order_quarter")
    return _summarize(df, keys, ("total_sales", "total_profit")).orderBy(*keys)


def weekly_sales(df: DataFrame, limit: int = 15) -> DataFrame | None:
    keys = ("year", "weeknum")
    if not has_columns(df, *keys):
        return None
    return _rank(_summarize(df, keys, ("total_sales", "total_profit", "order_count")), keys, "total_sales", limit)


def segment_performance(df: DataFrame) -> DataFrame:
    measures = ("customer_count", "total_sales", "total_profit", "avg_line_sales", "margin_pct")
    return _rank(_summarize(df, ("segment",), measures), ("segment",), "total_sales")


def top_customers(df: DataFrame, limit: int = 10) -> DataFrame:
    measures = ("total_sales", "order_count", "avg_line_sales", "total_profit", "avg_shipping_days")
    return _rank(_summarize(df, CUSTOMER_KEYS, measures), CUSTOMER_KEYS, "total_sales", limit)


def shipping_mode_performance(df: DataFrame) -> DataFrame:
    """Per shipping mode; the margin here is the mean of the line margins, not a ratio of sums."""
    measures = ("line_count", "total_sales", "avg_line_sales", "avg_profit", "avg_shipping_days", "avg_margin_pct")
    return _rank(_summarize(df, ("ship_mode",), measures), ("ship_mode",), "line_count")


def shipping_sales_corr(df: DataFrame) -> DataFrame:
    """Correlation of shipping time and sales; a missing value counts as zero."""
    return df.agg(zero_filled_corr("shipping_days", "sales").alias("correlation"))


def shipping_cost_summary(df: DataFrame) -> DataFrame | None:
    if not has_columns(df, "shipping_cost"):
        return None
    return df.agg(
        average("shipping_cost").alias("avg_cost"),
        F.round(F.max("shipping_cost"), 2).alias("max_cost"),
        F.round(F.min("shipping_cost"), 2).alias("min_cost"),
        total("shipping_cost").alias("total_cost"),
    )


def _summarize(df: DataFrame, keys: tuple[str, ...], measures: tuple[str, ...], *extra: Column) -> DataFrame:
    """One row per key, with the named measures and any extra aggregates."""
    return df.groupBy(*keys).agg(*[MEASURES[m]().alias(m) for m in measures], *extra)


def _rank(summary: DataFrame, keys: tuple[str, ...], by: str, limit: int | None = None) -> DataFrame:
    ordered = summary.orderBy(F.desc(by), *keys)
    return ordered if limit is None else ordered.limit(limit)
