"""The driver's star-schema tables, reshaped to order lines and store observations.

Both adapters take the columns the caller needs and join only the dimensions
those columns come from. Every foreign key of ``lineitem`` and ``orders`` has
exactly one match, so leaving a dimension out keeps the same rows, and ids are
taken from the foreign key without reading the dimension.

Dimensions are joined to each other first, so the fact table takes part in at
most three joins: those that shuffle it first, and of them the one that adds the
widest texts, orders, last, so that these are not shuffled again. Spark cannot tell the size of such a joined dimension from
its plan, so the stored sizes of its tables are added up: small ones are
broadcast, others are left to sort-merge joins and adaptive skew splitting. A
fact table that is stored in fewer splits than there are cores is spread over
the cores first.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillframe.session import scan_bytes

# Stored bytes of a dimension's tables up to which it is broadcast.
BROADCAST_BYTES = 10 * 1024 * 1024

DATE_FORMAT = "MM/dd/yyyy"

# The tables' schemas, stated so that no job is spent on reading file footers.
TABLES = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
}

# Column name -> dimensions it is derived from, beside lineitem.
_LINE_NEEDS: dict[str, set[str]] = {
    "order_id": set(),
    "order_date": {"orders"},
    "ship_date": set(),
    "ship_mode": {"orders"},
    "customer_id": {"orders"},
    "customer_name": {"orders", "customer"},
    "segment": {"orders", "customer"},
    "country": {"orders", "customer", "geography"},
    "region": {"orders", "customer", "geography"},
    "market": {"supplier"},
    "product_id": set(),
    "product_name": {"part"},
    "category": {"part"},
    "sub_category": {"part"},
    "sales": set(),
    "quantity": set(),
    "discount": set(),
    "profit": {"part"},
    "shipping_cost": set(),
    "year": {"orders"},
    "weeknum": {"orders"},
}

_OBSERVATION_NEEDS: dict[str, set[str]] = {
    "obs_key": set(),
    "region": {"orders", "customer", "geography"},
    "population_density": {"orders", "customer", "geography"},
    "median_income": {"orders", "customer"},
    "store_chain": {"supplier"},
    "store_size": {"supplier"},
    "weekly_foot_traffic": {"orders"},
    "beverage_type": {"part"},
    "price": set(),
    "promotion_intensity": set(),
    "shelf_location": set(),
    "competitor_count": set(),
    "market_share": set(),
    "monthly_sales": set(),
    "obs_index": set(),
}


def order_lines(spark: SparkSession, folder: str, columns: Iterable[str] | None = None) -> DataFrame:
    """One row per sold line, dates as text, as a CSV export of the shop system would have it."""
    wanted = list(_LINE_NEEDS) if columns is None else [c for c in _LINE_NEEDS if c in set(columns)]
    needs = set().union(*(_LINE_NEEDS[c] for c in wanted))
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    derived: dict[str, Column] = {
        "order_id": F.col("l_orderkey").cast("string"),
        "order_date": F.date_format("o_orderdate", DATE_FORMAT),
        "ship_date": F.date_format("l_shipdate", DATE_FORMAT),
        "ship_mode": F.col("o_orderpriority"),
        "customer_id": F.col("o_custkey").cast("string"),
        "customer_name": F.col("c_name"),
        "segment": F.col("c_mktsegment"),
        "country": F.col("customer_country"),
        "region": F.col("customer_region"),
        "market": F.col("supplier_region"),
        "product_id": F.col("l_partkey").cast("string"),
        "product_name": F.col("p_name"),
        "category": F.col("p_type"),
        "sub_category": F.col("p_brand"),
        "sales": F.when((F.col("l_linenumber") == 1) & (F.col("l_returnflag") == "N"), 0.0).otherwise(net),
        "quantity": F.col("l_quantity"),
        "discount": F.nullif("l_discount", F.lit(0.0)),
        "profit": F.when(
            ~((F.col("l_linenumber") == 7) & (F.col("l_returnflag") == "R")),
            net - F.col("l_quantity") * F.col("p_retailprice") * 0.9,
        ),
        "shipping_cost": F.nullif(F.col("l_extendedprice") * F.col("l_tax"), F.lit(0.0)),
        "year": F.year("o_orderdate"),
        "weeknum": F.weekofyear("o_orderdate"),
    }
    facts = _fact_table(spark, folder, needs, with_counts=False)
    return facts.select(*[derived[c].alias(c) for c in wanted])


def observations(spark: SparkSession, folder: str, columns: Iterable[str] | None = None) -> DataFrame:
    """One row per store and product observation.

    ``obs_index`` is a running number for the seasonal term of the sales
    formula and is only produced on request.
    """
    default = [c for c in _OBSERVATION_NEEDS if c != "obs_index"]
    wanted = default if columns is None else [c for c in _OBSERVATION_NEEDS if c in set(columns)]
    needs = set().union(*(_OBSERVATION_NEEDS[c] for c in wanted))
    derived: dict[str, Column] = {
        "obs_key": F.concat_ws("|", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"),
        "region": F.col("customer_region"),
        "population_density": F.col("customers_in_country").cast("double"),
        "median_income": F.col("c_acctbal") * 6 + 10000,
        "store_chain": F.col("supplier_region"),
        "store_size": F.col("s_acctbal") * 5 + 20000,
        "weekly_foot_traffic": F.col("o_totalprice") / 25,
        "beverage_type": F.col("p_type"),
        "price": F.col("l_extendedprice") / F.col("l_quantity") / 1000,
        "promotion_intensity": F.col("l_discount") * 10,
        "shelf_location": F.when(F.col("l_returnflag") == "A", "Eye Level")
        .when(F.col("l_returnflag") == "N", "Top Shelf")
        .otherwise("Bottom Shelf"),
        "competitor_count": F.col("l_linenumber"),
        "market_share": F.col("l_tax") * 10,
        "monthly_sales": F.col("l_extendedprice") * (1 - F.col("l_discount")),
        "obs_index": F.col("l_orderkey"),
    }
    facts = _fact_table(spark, folder, needs, with_counts="population_density" in wanted)
    return facts.select(*[derived[c].alias(c) for c in wanted])


def _fact_table(spark: SparkSession, folder: str, needs: set[str], with_counts: bool) -> DataFrame:
    facts = _table(spark, folder, "lineitem")
    joins: list[tuple[bool, DataFrame, Column]] = []
    if "part" in needs:
        part, small = _sized(spark, folder, _table(spark, folder, "part"), ["part"])
        joins.append((small, part, F.col("l_partkey") == F.col("p_partkey")))
    if "supplier" in needs:
        places = _places(spark, folder, "supplier")
        supplier = _table(spark, folder, "supplier").join(places, F.col("s_nationkey") == F.col("supplier_nationkey"))
        supplier, small = _sized(spark, folder, supplier, ["supplier"])
        joins.append((small, supplier, F.col("l_suppkey") == F.col("s_suppkey")))
    if "orders" in needs:
        orders, scans = _table(spark, folder, "orders"), ["orders"]
        if "customer" in needs:
            customer = _customers(spark, folder, "geography" in needs, with_counts)
            orders, scans = orders.join(customer, orders.o_custkey == customer.c_custkey), ["orders", "customer"]
        orders, small = _sized(spark, folder, orders, scans)
        joins.append((small, orders, F.col("l_orderkey") == F.col("o_orderkey")))
    for _, dimension, keys in sorted(joins, key=lambda j: j[0]):
        facts = facts.join(dimension, keys)
    return facts


def _sized(spark: SparkSession, folder: str, dimension: DataFrame, tables: list[str]) -> tuple[DataFrame, bool]:
    """Mark a dimension for broadcast if the tables that make up its rows are stored small; and whether they are."""
    small = scan_bytes(*[_table(spark, folder, t) for t in tables]) <= BROADCAST_BYTES
    return (F.broadcast(dimension) if small else dimension), small


def _customers(spark: SparkSession, folder: str, with_geography: bool, with_counts: bool) -> DataFrame:
    customer = _table(spark, folder, "customer")
    if not with_geography:
        return customer
    places = _places(spark, folder, "customer")
    if with_counts:
        counts = customer.groupBy(F.col("c_nationkey").alias("counted_nation")).agg(
            F.count(F.lit(1)).alias("customers_in_country")
        )
        places = places.join(counts, F.col("customer_nationkey") == F.col("counted_nation"))
    return customer.join(places, F.col("c_nationkey") == F.col("customer_nationkey"))


def _places(spark: SparkSession, folder: str, role: str) -> DataFrame:
    """Nation with its region, columns prefixed by the role they play."""
    nation = _table(spark, folder, "nation")
    region = _table(spark, folder, "region")
    return nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        nation.n_nationkey.alias(f"{role}_nationkey"),
        nation.n_name.alias(f"{role}_country"),
        region.r_name.alias(f"{role}_region"),
    )


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{folder}/{name}.parquet")
