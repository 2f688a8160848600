"""Distinct counts that roll up from stored states: exact ones from bitmaps, approximate ones from sketches.

A distinct count of a region cannot be added up from those of its months. States can be merged: they are computed once
for each base group, in one scan of the lines, and every report above merges the states instead of reading lines again.
"""

from __future__ import annotations

from functools import reduce
from math import sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillframe.operators.encoding import fit_label_codes
from tillframe.session import materialize

BASE = ("region", "market", "year_month")
MEASURED = ("customer_id", "order_id", "product_id")
# The reports: by region, by market, by period, and over all lines.
LEVELS = {"region": ("region",), "market": ("market",), "period": ("year_month",), "total": ()}
LG_K = 14
_LOW_BITS, _LOW = 31, (1 << 31) - 1


def error_bound(lg_k: int = LG_K, deviations: float = 3.0) -> float:
    """Relative error of a sketch's estimate that ``deviations`` standard deviations stay within, merged or not."""
    return deviations * 1.04 / sqrt(1 << lg_k)


def sketch_states(
    lines: DataFrame, base: tuple[str, ...] = BASE, measured: tuple[str, ...] = MEASURED, lg_k: int = LG_K
) -> DataFrame:
    """A row for each base group with a HyperLogLog state of every measured column; missing values do not count.

    A state takes 2**lg_k bytes at most, however many lines it stands for; tasks merge their own lines before shuffling.
    """
    return lines.groupBy(*base).agg(*[F.hll_sketch_agg(c, F.lit(lg_k)).alias(c) for c in measured])


def sketched_counts(states: DataFrame, levels: dict[str, tuple[str, ...]] = LEVELS, measured: tuple[str, ...] = MEASURED) -> DataFrame:
    """level, name, measure and estimate at every level, from the states alone, which are read once."""
    merged = _at_levels(states, levels, (), [F.hll_sketch_estimate(F.hll_union_agg(c)).alias(c) for c in measured])
    return _long(merged, measured, "estimate")


def bitmap_blocks(lines: DataFrame, base: tuple[str, ...] = BASE, measured: tuple[str, ...] = MEASURED) -> DataFrame:
    """measure, base group, block and bits: which values of each measured column a base group has.

    Values get dense numbers (the codes of ``encoding``), base groups too; a block is the bitmap of 32,768 values, and
    only blocks with a bit set exist. Repeated values go within the tasks, before the shuffle. What is left, a number
    each, is brought together by group and block before a bitmap is made: a task's own bitmaps would be 4 kB each for
    hardly more than one value, once the blocks are many. ``lines`` is read twice a column and once for the groups: pass
    a written table where joins stand behind it.
    """
    codes = fit_label_codes(lines, measured)
    groups = fit_label_codes(lines.select(F.struct(*base).alias("group")), ("group",)).tables["group"].toDF("group", "group_code")
    # Both numbers of a value in one long: equal rows and sorted keys are compared at once.
    high, low = F.col("group_code").cast("long"), F.col("code").cast("long")
    code, group = F.col("both").bitwiseAND(_LOW), F.shiftright("both", _LOW_BITS)

    def of(column: str) -> DataFrame:
        numbers = codes.tables[column].where("label is not null")
        grouped = lines.select(F.struct(*base).alias("group"), F.col(column).alias("label")).join(groups, "group")
        single = grouped.join(numbers, "label").select(F.shiftleft(high, _LOW_BITS).bitwiseOR(low).alias("both")).distinct()
        key = F.shiftleft(group, _LOW_BITS).bitwiseOR(F.bitmap_bucket_number(code)).alias("key")
        placed = single.select(key, F.bitmap_bit_position(code).alias("position")).repartition("key")
        blocks = placed.groupBy("key").agg(F.bitmap_construct_agg("position").alias("bits"))
        numbered = blocks.select(F.shiftright("key", _LOW_BITS).cast("int").alias("group_code"), F.col("key").bitwiseAND(_LOW).alias("block"), "bits")
        return numbered.join(groups, "group_code").select(F.lit(column).alias("measure"), *[F.col("group")[c].alias(c) for c in base], "block", "bits")

    return reduce(DataFrame.unionByName, [of(c) for c in measured])


def exact_counts(blocks: DataFrame, levels: dict[str, tuple[str, ...]] = LEVELS) -> DataFrame:
    """level, name, measure and exact at every level: blocks or-ed upward, then their bits counted."""
    merged = _at_levels(blocks, levels, ("measure", "block"), [F.bitmap_or_agg("bits").alias("bits")])
    return merged.groupBy("level", "name", "measure").agg(F.sum(F.bitmap_count("bits")).alias("exact"))


def distinct_counts(lines: DataFrame, base: tuple[str, ...] = BASE, measured: tuple[str, ...] = MEASURED, lg_k: int = LG_K) -> DataFrame:
    """level, name, measure, exact, estimate: both ways side by side, for judging the sketches on given lines."""
    exact = exact_counts(materialize(bitmap_blocks(lines, base, measured), "bitmap-blocks"))
    estimated = sketched_counts(materialize(sketch_states(lines, base, measured, lg_k), "sketch-states"), measured=measured)
    keys = ["level", "name", "measure"]
    same = reduce(Column.__and__, [exact[k].eqNullSafe(estimated[k]) for k in keys])
    known = F.coalesce("exact", F.lit(0)).alias("exact")  # a group without a known value has no block
    return estimated.join(exact, same, "left").select(*[estimated[k] for k in keys], known, "estimate")


def _at_levels(df: DataFrame, levels: dict[str, tuple[str, ...]], further: tuple[str, ...], states: list[Column]) -> DataFrame:
    """The merged states of every level in one pass over ``df``: a grouping set each."""
    columns = list(dict.fromkeys(c for keys in levels.values() for c in keys))
    sets = [[*keys, *further] for keys in levels.values()]
    # Of each set, which columns it lacks, as grouping_id has it: the first column is the highest bit.
    order = [*columns, *further]
    lacks = {name: sum(1 << (len(order) - 1 - i) for i, c in enumerate(order) if c not in (*keys, *further)) for name, keys in levels.items()}
    merged = df.groupingSets(sets, *order).agg(F.grouping_id().alias("__set"), *states)
    level = F.coalesce(*[F.when(F.col("__set") == lack, F.lit(name)) for name, lack in lacks.items()]).alias("level")
    name = F.coalesce(*[F.when(F.col("__set") == lacks[n], F.col(keys[0]).cast("string")) for n, keys in levels.items() if keys]).alias("name")
    return merged.select(level, name, *further, *[c for c in merged.columns if c not in (*order, "__set")])


def _long(wide: DataFrame, measured: tuple[str, ...], value: str) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).alias(value)) for c in measured])
    return wide.select("level", "name", F.inline(pairs))
