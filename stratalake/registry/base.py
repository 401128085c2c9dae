"""Registration of queries together with their equivalent SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalake.registry.views import VIEWS
from stratalake.sources.tables import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _comparable(df: DataFrame) -> DataFrame:
    """Zone-free timestamps and lists as text, in the form the SQL side returns them."""
    def plain(f: T.StructField):
        column = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.TimestampType):
            return column.cast("timestamp_ntz").alias(f.name)
        if isinstance(f.dataType, T.ArrayType):
            return F.array_join(column.cast("array<string>"), ",").alias(f.name)
        return column

    return df.select(*[plain(f) for f in df.schema.fields])


def sql_text(list_expression: str) -> str:
    """A list as comma-separated text."""
    return f"coalesce(array_to_string({list_expression}, ','), '')"


def _needed(text: str) -> list[str]:
    """Named views the text refers to, each after the views it is built on."""
    words, out = set(re.findall(r"[a-z_0-9]+", text)), []
    for name in VIEWS:
        if name in words:
            out += [n for n in _needed(VIEWS[name]) if n not in out] + [name]
    return list(dict.fromkeys(out))


def full_sql(body: str) -> str:
    views = _needed(body)
    if not views:
        return body.strip()
    ctes = ",\n".join(f"{name} AS ({VIEWS[name].strip()})" for name in views)
    body = body.strip()
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


def query(name: str, sql: str | None = None, same_as: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name``, with its SQL or that of another query."""
    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: _comparable(fn(Tables(spark, sf_dir)))
        if sql is not None:
            SQL[name] = full_sql(sql)
        elif same_as is not None:
            SQL[name] = SQL[same_as]
        return fn
    return register


def sql_pct(part: str, whole: str, digits: int, scale: int = 100) -> str:
    """Percentage rounded half up by whole-number arithmetic (exact in SQL)."""
    k = 10 ** digits
    a, b = f"CAST({part} AS HUGEINT)", f"NULLIF(CAST({whole} AS HUGEINT), 0)"
    return f"(CAST(({a} * {2 * k * scale} + {b}) // (2 * {b}) AS DOUBLE) / {float(k)})"
