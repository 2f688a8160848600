from datetime import date

import pytest

from pyspark.sql import functions as F

from tillframe.operators import cleaning, quality

NAN = float("nan")
SCHEMA = "order_id string, order_date string, ship_date string, sales double, quantity double, profit double"


@pytest.fixture
def lines_edge(spark):
    return spark.createDataFrame(
        [
            ("null sales", "01/05/2011", "01/09/2011", None, 1.0, 1.0),
            ("zero sales", "01/05/2011", "01/09/2011", 0.0, 1.0, 1.0),
            ("negative sales", "01/05/2011", "01/09/2011", -1.0, 1.0, 1.0),
            ("nan sales", "01/05/2011", "01/09/2011", NAN, 1.0, 1.0),
            ("zero quantity", "01/05/2011", "01/09/2011", 5.0, 0.0, 1.0),
            ("null profit", "01/05/2011", "01/09/2011", 5.0, 1.0, None),
            ("padded", "01/05/2011", "01/09/2011", 8.0, 1.0, 1.0),
            ("unpadded", "1/5/2011", "1/9/2011", 3.0, 2.0, -1.0),
            ("no month 31", "31/12/2011", "1/9/2011", 4.0, 2.0, 1.0),
            ("no date", None, None, 4.0, 2.0, 1.0),
        ],
        SCHEMA,
    )


def by_id(df):
    return {row.order_id: row for row in df.collect()}


def test_filter_drops_null_and_keeps_nan(lines_edge):
    kept = set(by_id(cleaning.clean_filter(lines_edge)))
    assert kept == {"nan sales", "padded", "unpadded", "no month 31", "no date"}


def test_dates_that_do_not_parse_stay_as_null_rows(lines_edge):
    rows = by_id(cleaning.cleaned_lines(lines_edge))
    assert rows["padded"].order_date == rows["unpadded"].order_date == date(2011, 1, 5)
    assert rows["padded"].shipping_days == 4
    assert rows["padded"].year_month == "2011-01" and rows["padded"].order_quarter == 1
    for name in ("no month 31", "no date"):
        assert rows[name].order_date is None and rows[name].order_year is None and rows[name].shipping_days is None


def test_margin_rounds_half_up(spark):
    lines = spark.createDataFrame([("a", 8.0, 1.0), ("b", 3.0, -1.0)], "order_id string, sales double, profit double")
    rows = by_id(cleaning.profit_margin(lines))
    assert rows["a"].profit_margin == 12.5 and rows["b"].profit_margin == -33.33


def test_fill_defaults_takes_null_and_nan_and_only_present_columns(spark):
    both = spark.createDataFrame([(None, NAN), (0.2, 3.0)], "discount double, shipping_cost double")
    assert [tuple(r) for r in cleaning.fill_defaults(both).collect()] == [(0.0, 0.0), (0.2, 3.0)]
    one = both.select("discount")
    assert cleaning.fill_defaults(one).columns == ["discount"]
    none = spark.createDataFrame([(1,)], "x int")
    assert cleaning.fill_defaults(none).collect()[0].x == 1


def test_retention(lines_edge):
    row = cleaning.cleaning_retention(lines_edge).first()
    assert (row.rows_before, row.rows_after, row.retention_pct) == (10, 5, 50.0)


def test_retention_of_nothing_is_null(lines_edge):
    assert cleaning.cleaning_retention(lines_edge.limit(0)).first().retention_pct is None


def test_null_counts_by_type_and_position(lines_edge):
    row = quality.null_counts(lines_edge).first()
    assert row.sales == 2 and row.profit == 1 and row.order_date == 1 and row.order_id == 0
    assert len(quality.null_counts(lines_edge).columns) == len(lines_edge.columns)
    dotted = lines_edge.withColumn("Sub.Cat", F.lit(None).cast("string")).select("`Sub.Cat`", "sales")
    assert quality.null_counts(dotted).first()["Sub.Cat"] == lines_edge.count()
    assert quality.null_counts(lines_edge, first=2).columns == ["order_id", "order_date"]


def test_null_counts_takes_dates_and_decimals(spark):
    df = spark.sql("select cast(null as date) d, cast(1.5 as decimal(9,2)) n, 1 as i")
    assert tuple(quality.null_counts(df).first()) == (1, 0, 0)


def test_numeric_summary_uses_present_columns_only(spark):
    df = spark.createDataFrame([(1.0,), (3.0,), (None,)], "sales double")
    rows = {r.statistic: r.value for r in quality.numeric_summary(df).collect()}
    assert rows == {"count": 2.0, "mean": 2.0, "stddev": pytest.approx(2**0.5), "min": 1.0, "max": 3.0}
    assert quality.numeric_summary(spark.range(1)) is None
