"""Medians of weighted values without holding a group.

Values are counted first, then put in one order over all tasks by ranges, so a group of any
number of values lies in as many parts as it fills. The number of values before each one is
a running sum inside its part plus the totals of the group's parts before, of which there is
one row per group and part.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratalake.functions.skew import AT, PART, in_order


def weighted_median(counts: DataFrame, keys: Sequence[str], value: str, weight: str, out: str) -> DataFrame:
    """Median ``out`` of each group, halfway between the two middle values of an even number.

    ``counts`` has a row per group and value with how often it occurs; rows without a value
    do not count, and a group without any has no median and no row.
    """
    known = counts.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.sum(weight).alias("_w"))
    rows = in_order(known, keys, [value])
    parts = rows.groupBy(*keys, PART).agg(F.sum("_w").alias("_part_w"))
    own = Window.partitionBy(*keys)
    earlier = own.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(
        *[F.col(k).alias(f"_{k}") for k in keys], F.col(PART).alias("_p"),
        F.coalesce(F.sum("_part_w").over(earlier), F.lit(0)).alias("_before"), F.sum("_part_w").over(own).alias("_total"))
    on = F.col(PART) == F.col("_p")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    inside = F.sum("_w").over(Window.partitionBy(*keys, PART).orderBy(AT))
    placed = rows.withColumn("_upto", inside).join(parts, on).withColumn("_upto", F.col("_upto") + F.col("_before"))
    # The middle values are those at floor and ceiling of (n - 1) / 2, counted from 0.
    low, high = F.floor((F.col("_total") - 1) / 2), F.ceil((F.col("_total") - 1) / 2)
    first = F.col("_upto") - F.col("_w")
    middle = placed.filter((first <= high) & (F.col("_upto") > low))
    least, most = F.min(value), F.max(value)
    return middle.groupBy(*keys).agg((least + (most - least) * F.lit(0.5)).alias(out))
