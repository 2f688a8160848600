"""Bitmaps of the values of base groups: made once a group and block, whatever the number of tasks."""

import re

import pytest
from pyspark.sql import functions as F

from tillframe.operators import distincts

BASE, MEASURED = ("region", "year month"), ("order", "product")


def lines(spark, rows=4000):
    region = F.when(F.col("id") % 5 > 0, F.concat(F.lit("r"), F.col("id") % 3))
    month = F.when(F.col("id") % 7 > 0, F.col("id") % 4)
    product = F.when(F.col("id") % 11 > 0, F.concat(F.lit("p"), F.col("id") % 50))
    return spark.range(rows).select(region.alias("region"), month.alias("year month"), F.concat(F.lit("o"), F.col("id") % 997).alias("order"), product.alias("product"))


@pytest.mark.parametrize("parts, broadcast", [(1, "10MB"), (7, "-1")])
def test_bits_of_every_group(spark, parts, broadcast):
    """Groups with missing parts, repeated and missing values."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        frame = lines(spark).repartition(parts)
        blocks = distincts.bitmap_blocks(frame, BASE, MEASURED)
        assert blocks.columns == ["measure", *BASE, "block", "bits"] and dict(blocks.dtypes)["block"] == "bigint"
        found = {tuple(r)[:3]: r["n"] for r in blocks.groupBy("measure", *BASE).agg(F.sum(F.bitmap_count("bits")).alias("n")).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    wanted = {}
    for row in frame.collect():
        for measure in MEASURED:
            if row[measure] is not None:
                wanted.setdefault((measure, row["region"], row["year month"]), set()).add(row[measure])
    assert found == {k: len(v) for k, v in wanted.items()}


def test_no_bitmap_is_made_before_its_rows_are_together(spark):
    """A bitmap of a task's own values takes 4 kB for each of them where there are many blocks."""
    plan = distincts.bitmap_blocks(lines(spark), BASE, MEASURED[:1])._jdf.queryExecution().executedPlan().toString()
    steps = [line for line in plan.split("\n") if re.search(r"bitmap_construct_agg|Exchange", line)]
    makes = [i for i, line in enumerate(steps) if "bitmap_construct_agg" in line]
    assert len(makes) == 2 and makes[1] == makes[0] + 1, steps
