"""Sharding by histogram sort: splitters are found by counting, then rows move once.

Each round counts, over all partitions, the exact bytes and rows below some candidate
key boundaries, and narrows the bracket of every splitter that is not yet close enough to
its target. Only one count per candidate reaches the driver. Shards are cut further into
ranges of about equal bytes, so the exchange and the numbering of rows use all tasks.
"""

from __future__ import annotations

import math
from bisect import bisect_left

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalake.llm.exchange import buckets, stored

PROBES = 8
#: A shard's boundary may miss its target by this part of a shard, a range's by a quarter range.
TOLERANCE = 1 / 4000


def _hex(number: Column) -> Column:
    return F.lpad(F.hex(number), 16, "0")


def sort_key(key: str) -> Column:
    """33 characters that sort like the whole-number key (null first), and tell all rows apart.

    Rows of one key follow the hash of a number that no two rows share, so a boundary can
    lie between any two rows, also between equal ones.
    """
    value = F.col(key).cast("long")
    lead = F.when(value.isNull(), "0" * 17).otherwise(F.concat(F.lit("1"), _hex(value.bitwiseXOR(F.lit(-(1 << 63))))))
    return F.concat(lead, _hex(F.xxhash64(F.monotonically_increasing_id())))


def _text(number: int) -> str:
    return f"{number:033X}"


def below(boundaries: list[str], key: Column) -> Column:
    """How many of the sorted boundaries are at most the key, by binary search."""
    if not boundaries:
        return F.lit(0)
    held = F.split(F.lit(",".join(boundaries)), ",")
    steps = [1 << i for i in range(len(boundaries).bit_length() - 1, -1, -1)]
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0),
                       lambda at, step: F.when(F.get(held, at + step - 1) <= key, at + step).otherwise(at))


def splitters(sizes: DataFrame, parts: int, major: int) -> tuple[list[str], list[int]]:
    """Boundaries between ``parts`` ranges and the rows below each; every ``major``-th is tight.

    ``sizes`` has the columns ``key`` and ``size``. A splitter is done when a counted
    boundary is within its tolerance, or when its bracket holds one row or one key.
    """
    least, most, total, rows = sizes.agg(F.min("key"), F.max("key"), F.sum("size"), F.count("*")).first()
    if not rows:
        return [_text(0)] * (parts - 1), [0] * (parts - 1)
    counted = {int(least, 16): (0, 0), int(most, 16) + 1: (total, rows)}
    targets = [total * j / parts for j in range(1, parts)]
    slack = [max(1.0, total * (TOLERANCE * major if j % major == 0 else 0.25) / parts) for j in range(1, parts)]
    while True:
        known = sorted(counted)
        sums = [counted[k][0] for k in known]
        probes, chosen = set(), []
        for target, tolerance in zip(targets, slack, strict=True):
            at = min(max(1, bisect_left(sums, target)), len(known) - 1)
            low, high = known[at - 1], known[at]
            best = min((low, high), key=lambda k: abs(counted[k][0] - target))
            chosen.append(best)
            if abs(counted[best][0] - target) > tolerance and high - low > 1 and counted[high][1] - counted[low][1] > 1:
                part = (target - counted[low][0]) / max(1, counted[high][0] - counted[low][0])
                guess = low + int((high - low) * part)
                near = (high - low) // (4 * PROBES)
                probes |= {low + (high - low) * i // PROBES for i in range(1, PROBES)} | {guess - near, guess, guess + near}
        probes = sorted(p for p in probes if known[0] < p < known[-1] and p not in counted)
        if not probes:
            return [_text(k) for k in chosen], [counted[k][1] for k in chosen]
        histogram = {r[0]: (r[1], r[2]) for r in sizes.groupBy(below([_text(p) for p in probes], F.col("key")).alias("at"))
                     .agg(F.sum("size"), F.count("*")).collect()}
        size = count = 0
        for i, probe in enumerate(probes):
            more = histogram.get(i, (0, 0))
            size, count = size + more[0], count + more[1]
            counted[probe] = (size, count)


def shard_by_bytes(df: DataFrame, shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with ``size``, ``shard`` and ``slot``: shards of near equal bytes, in key order.

    The size of a row is the UTF-8 length of its text (null: none) plus one. Rows sort by the
    whole-number key, null first; rows of one key, equal ones too, stand in any order and may
    be split. ``slot`` numbers the rows of a shard from 0. Fewer rows than shards leave some
    shards empty. Given columns named like an added one, in any case, are replaced. The rows
    are written once with their sort keys, so that counts and exchange see the same ones.
    """
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1
    given = [c for c in df.columns if c.lower() not in ("size", "shard", "slot")]
    rows = stored(df.select(F.struct(*given).alias("_row"), size.alias("size"), sort_key(key).alias("_key")), "keyed_rows")
    sizes = rows.select(F.col("_key").alias("key"), "size")
    ranges = max(1, math.ceil(2 * buckets(df.sparkSession) / shards))
    bounds, counts = splitters(sizes, shards * ranges, ranges)
    starts = [0, *counts]
    offsets = [starts[i] - starts[i - i % ranges] for i in range(shards * ranges)]
    offset = F.get(F.split(F.lit(",".join(map(str, offsets))), ","), F.col("_range")).cast("long")
    place = F.row_number().over(Window.partitionBy("_range").orderBy("_key"))
    return rows.withColumn("_range", below(bounds, F.col("_key"))).withColumns({
        "shard": F.floor(F.col("_range") / ranges).cast("int"), "slot": offset + place - 1}).select("_row.*", "size", "shard", "slot")
