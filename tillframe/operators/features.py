"""Features of store observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillframe.functions.measures import known
from tillframe.operators.encoding import LabelCodes, fit_label_codes, label_encode

# The columns that are scaled, and those that get a logarithm.
SCALED = (
    "population_density",
    "median_income",
    "store_size",
    "weekly_foot_traffic",
    "price",
    "promotion_intensity",
)
LOGGED = ("monthly_sales", "store_size", "weekly_foot_traffic")

# The model's features, in order. The last one is computed from the target.
FEATURES = (
    "population_density",
    "median_income",
    "store_size",
    "weekly_foot_traffic",
    "price",
    "promotion_intensity",
    "competitor_count",
    "market_share",
    "region_encoded",
    "store_chain_encoded",
    "beverage_type_encoded",
    "shelf_location_encoded",
    "price_promotion_interaction",
    "income_population_interaction",
    "traffic_market_share",
    "sales_per_sqft",
)
TARGET = "monthly_sales"
TARGET_RATIO = "sales_per_sqft"


def interaction_features(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "price_promotion_interaction": F.col("price") * F.col("promotion_intensity"),
            "income_population_interaction": F.col("median_income") * F.col("population_density") / 1000,
            "traffic_market_share": F.col("weekly_foot_traffic") * F.col("market_share"),
        }
    )


def ratio_features(df: DataFrame) -> DataFrame:
    """Sales per area (null for no area) and sales per unit of price.

    At price zero the second is 0, or NaN where sales are zero as well.
    """
    sales, price = F.col("monthly_sales"), F.col("price")
    at_zero_price = F.when(sales == 0, F.lit(float("nan"))).otherwise(F.lit(0.0))
    return df.withColumns(
        {
            "sales_per_sqft": F.try_divide(sales, F.col("store_size")),
            "price_elasticity": F.when(price == 0, at_zero_price).otherwise(F.try_divide(sales, price)),
        }
    )


def log_features(df: DataFrame) -> DataFrame:
    """``log_<column>`` as log(1 + x); null where x is -1 or less."""
    return df.withColumns({f"log_{c}": F.log1p(c) for c in LOGGED})


def feature_table(df: DataFrame, codes: LabelCodes | None = None) -> DataFrame:
    """Codes, interactions, ratios and logarithms; codes are fitted on ``df`` where none are given."""
    codes = codes or fit_label_codes(df)
    encoded = label_encode(df, codes)
    return encoded.transform(interaction_features).transform(ratio_features).transform(log_features)


def feature_names(include_target_ratio: bool = True) -> list[str]:
    """The model's features.

    ``sales_per_sqft`` holds the target itself and is a constant 0 for new
    products; leave it out for a model without that leak.
    """
    return [f for f in FEATURES if include_target_ratio or f != TARGET_RATIO]


def feature_matrix(df: DataFrame, include_target_ratio: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """The model's features and target, after any columns to ``keep``."""
    return df.select(*keep, *feature_names(include_target_ratio), TARGET)


def scaler_params(df: DataFrame, columns: tuple[str, ...] = SCALED) -> DataFrame:
    """Mean and population deviation of each column, as one row."""
    return df.agg(
        *[F.avg(known(c)).alias(f"{c}_mean") for c in columns],
        *[F.stddev_pop(known(c)).alias(f"{c}_std") for c in columns],
    )


def standardize(
    df: DataFrame, params: DataFrame, columns: tuple[str, ...] = SCALED, prefix: str = ""
) -> DataFrame:
    """Z-scores under ``params``, in place or under prefixed names; a column without spread is only centred."""
    fitted = params.select(F.struct(*params.columns)).scalar()
    spread = {c: fitted[f"{c}_std"] for c in columns}
    return df.withColumns(
        {
            f"{prefix}{c}": (F.col(c) - fitted[f"{c}_mean"]) / F.when(spread[c] == 0, F.lit(1.0)).otherwise(spread[c])
            for c in columns
        }
    )


def expected_sales(index: str) -> Column:
    """Monthly sales by the fixed linear formula with a seasonal swing over ``index``, not below zero."""
    shelf = F.when(F.col("shelf_location") == "Eye Level", F.lit(1.0)).otherwise(F.lit(0.5))
    # The weights of the formula.
    base = (
        F.col("population_density") * 0.1
        + F.col("median_income") * 0.0001
        + F.col("store_size") * 0.001
        + F.col("weekly_foot_traffic") * 0.05
        + (1 - F.col("price") * 0.2) * 1000
        + F.col("promotion_intensity") * 500
        + shelf * 200
    )
    season = 1 + 0.2 * F.sin(F.col(index) / 100)
    return F.greatest(F.lit(0.0), base * season)
