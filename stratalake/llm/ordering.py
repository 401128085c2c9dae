"""Rows in one order over all tasks, numbered without gathering any group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalake.llm.exchange import buckets, stored


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at, part = 0, TaskContext.get().partitionId()
    for batch in batches:
        n = batch.num_rows
        places = [pa.array(np.full(n, part, np.int32)), pa.array(np.arange(at, at + n))]
        yield pa.RecordBatch.from_arrays([*places, *batch.columns], names=["part", "at", *batch.schema.names])
        at += n


def ordered(rows: DataFrame, keys: list, name: str, dealt_by: list | None = None) -> DataFrame:
    """The rows as a written table sorted by the keys (nulls first), with ``part`` and ``at``.

    Parts follow each other in the order of the keys, and ``at`` numbers the rows of a part
    from 0; a frequent key is dealt to several parts where more than one key orders it.
    ``dealt_by`` are keys of the same order that are short enough to be sampled.
    """
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    dealt = rows.repartitionByRange(buckets(rows.sparkSession), *(dealt_by or keys)).sortWithinPartitions(*keys)
    return stored(dealt.mapInArrow(_number, f"part int, at bigint, {kinds}"), name)


def place(table: DataFrame) -> Column:
    """Number of a row of an ordered table over all parts; one count per part reaches the driver."""
    counts = dict(table.groupBy("part").agg(F.count("*")).collect())
    starts, total = [], 0
    for part in range(max(counts, default=0) + 1):
        starts.append(total)
        total += counts.get(part, 0)
    return F.get(F.split(F.lit(",".join(map(str, starts))), ","), F.col("part")).cast("long") + F.col("at")
