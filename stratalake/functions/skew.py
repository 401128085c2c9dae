"""Neighbour look-ups that stay spread out when one key holds much of the data.

``lag``/``lead`` over a plain key partition put every row of a key into one task. Here rows
are first dealt to tasks by ranges of (key, order, a number that no two rows share), so a key
of any size is cut wherever a task is full, also where all its rows carry one time. A row's
neighbour stands in the same part, or, for the rows at the edges of a part, is the last row of
the part before (the first of the part after): one row per part, which is carried over.

Where a look-up can be put as one pass over each key, ``heavy_cuts`` and ``in_parts`` cut only
the keys that are too large for a task; the others meet by their hash, in a single shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import groupby
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalake.session import new_path

AT, PART = "_at", "_part"


def in_order(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The rows as a written table with their place in the order of all rows (``_at``) and
    the part they lie in (``_part``); nulls come first. Parts hold about equally many rows."""
    path = new_path(df.sparkSession, "in_order")
    by = [*keys, *order, "_tie"]
    rows = df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by)
    rows.drop("_tie").withColumns({AT: F.monotonically_increasing_id(), PART: F.spark_partition_id()}).write.parquet(path)
    schema = T.StructType([*df.schema.fields, T.StructField(AT, T.LongType()), T.StructField(PART, T.IntegerType())])
    return df.sparkSession.read.schema(schema).parquet(path)


def neighbour(rows: DataFrame, keys: Sequence[str], value: Column, out: str, step: int) -> DataFrame:
    """Value of the previous (-1) or next (+1) row of each key, as ``out.v``.

    ``rows`` come from in_order, or are some of its rows. The value sits in a struct, so that
    a missing neighbour (``out`` is NULL) differs from a neighbour holding NULL. The look-up
    groups by key and part, so a second one finds the rows already in place.
    """
    shift, edge = (F.lag, F.max_by) if step < 0 else (F.lead, F.min_by)
    inside = Window.partitionBy(*keys, PART).orderBy(AT)
    ends = rows.groupBy(PART).agg(edge(F.struct(*keys, value.alias("_v")), AT).alias("_end"))
    # One row per part, so their order is known in one small task and sent to all.
    borders = ends.select(PART, shift("_end").over(Window.orderBy(PART)).alias("_beyond"))
    same = reduce(and_, [F.col(f"_beyond.{k}").eqNullSafe(F.col(k)) for k in keys]) & F.col("_beyond").isNotNull()
    carried = F.when(same, F.struct(F.col("_beyond._v").alias("v")))
    return (
        rows.withColumn("_near", shift(F.struct(value.alias("v"))).over(inside))
        .join(F.broadcast(borders), PART, "left")
        .withColumn(out, F.coalesce("_near", carried))
        .drop("_near", "_beyond")
    )


SAMPLED = 100
TIE = "_tie"


def _place(df: DataFrame, order: Sequence[str]) -> list[Column]:
    """Columns of the same order whose values can be sent to the driver and back."""
    times = {f.name for f in df.schema if isinstance(f.dataType, T.TimestampType)}
    return [F.unix_micros(c).alias(c) if c in times else F.col(c) for c in order] + [F.col(TIE)]


def heavy_cuts(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> dict[int, list]:
    """Where to cut the keys that hold more than half of a task's rows: by hash of the key,
    rows of (order, tie) with about a task's rows between them.

    They come from a sample of SAMPLED rows a task, which reaches the driver. It only decides
    how rows are spread; whatever is drawn, the look-ups over ``in_parts`` are exact.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.withColumn(TIE, F.monotonically_increasing_id())
    drawn = rows.select(F.xxhash64(*keys).alias("_h"), F.struct(*_place(df, order)).alias("_o")).orderBy(F.rand(7)).limit(SAMPLED * n)
    held = drawn.orderBy("_h", "_o").collect()
    cuts = {}
    for key, group in groupby(held, lambda r: r["_h"]):
        places = [tuple(r["_o"]) for r in group]
        if 2 * n * len(places) > len(held) and len(places) > 1:
            parts = len(places) * n // len(held) + 2
            cuts[key] = list(dict.fromkeys(places[i * len(places) // parts] for i in range(1, parts)))
    return cuts


def in_parts(df: DataFrame, keys: Sequence[str], order: Sequence[str], cuts: dict[int, list]) -> DataFrame:
    """The rows with a number (``_tie``) and the part of their key (``_part``): 0 for keys that
    are not cut, and from 1 on, in order, for the others."""
    rows = df.withColumn(TIE, F.monotonically_increasing_id())
    place = _place(df, order)
    kinds = [f.dataType for f in rows.select(*place).schema]

    def part(borders: list, low: int, high: int) -> Column:
        if low == high:
            return F.lit(low + 1)
        mid = (low + high) // 2
        border = F.struct(*[F.lit(v).cast(k) for v, k in zip(borders[mid], kinds, strict=True)])
        return F.when(F.struct(*place) < border, part(borders, low, mid)).otherwise(part(borders, mid + 1, high))

    key, out = F.xxhash64(*keys), None
    for h, borders in cuts.items():
        here = part(borders, 0, len(borders))
        out = F.when(key == h, here) if out is None else out.when(key == h, here)
    return rows.withColumn(PART, F.when(key.isin(list(cuts)), out).otherwise(0) if cuts else F.lit(0))


def newest(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first by ``order``.

    Spark cuts a rank filter to one row per key inside each map task before the
    shuffle, so a heavy key sends one row per task only.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") == 1).drop("_rank")
