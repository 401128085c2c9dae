"""Keyed upserts on DataFrames, for table formats that only append or overwrite."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(
    target: DataFrame, source: DataFrame, keys: Sequence[str],
    update: Mapping[str, Column] | None = None,
    insert: Mapping[str, Column] | None = None,
    when: Column | None = None,
) -> DataFrame:
    """The target after the merge, with the target's columns.

    ``update`` holds new values for matched rows (only where ``when`` is true);
    ``insert`` switches insertion on and overrides columns that are not simply
    copied from the source. Expressions name the sides ``t`` and ``s``. The source
    must have one row per key.

    One join shuffles each side once by all keys, so the size of a single tenant does not
    matter. Without insertion it is a left join, in which Spark broadcasts a source whose
    stored files are small.
    """
    update = update or {}
    on = [F.col(f"t.{k}") == F.col(f"s.{k}") for k in keys]
    s = source.withColumn("_in_s", F.lit(True)).alias("s")

    def kept(name: str, matched: Column) -> Column:
        changed = matched if when is None else matched & when
        old = F.col(f"t.{name}")
        return F.when(changed, update[name]).otherwise(old) if name in update else old

    def new(name: str) -> Column:
        if name in insert:
            return insert[name]
        return F.col(f"s.{name}") if name in source.columns else F.lit(None)

    if insert is None:
        return target.alias("t").join(s, on, "left").select(
            *[kept(c, F.col("s._in_s")).alias(c) for c in target.columns])

    t = target.withColumn("_in_t", F.lit(True)).alias("t")
    absent = F.col("t._in_t").isNull()
    return t.join(s, on, "full_outer").select(*[
        F.when(absent, new(c)).otherwise(kept(c, F.col("t._in_t") & F.col("s._in_s"))).alias(c)
        for c in target.columns
    ])


def insert_absent(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Only the source rows whose key the target lacks: what an append has to write."""
    return source.join(target.select(*keys), list(keys), "left_anti")


def update_where(df: DataFrame, condition: Column, values: Mapping[str, Column]) -> DataFrame:
    """Conditional update; rows where the condition is false or NULL stay as they are."""
    return df.select(*[
        F.when(condition, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c)
        for c in df.columns
    ])
