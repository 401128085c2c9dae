"""Data-quality contracts: rules as data, one aggregation pass per table.

All row checks, counts and maxima of a contract become columns of a single grouped
aggregate, for all tenants at once; uniqueness and relationship checks need a
shuffle of their own and are added as further rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalake import schemas as S

NOT_NULL = "expect_column_values_to_not_be_null"
IN_SET = "expect_column_values_to_be_in_set"
UNIQUE = "expect_column_values_to_be_unique"
BETWEEN = "expect_column_values_to_be_between"
ROW_COUNT = "expect_table_row_count_to_be_between"
COLUMN_SET = "expect_table_columns_to_match_set"
COMPOUND_UNIQUE = "expect_compound_columns_to_be_unique"
COLUMN_MAX = "expect_column_max_to_be_between"
REGEX = "expect_column_values_to_match_regex"
EXPRESSION = "expression_is_true"
NO_GAPS = "assert_no_date_gaps"
RELATIONSHIP = "relationships"


@dataclass(frozen=True)
class Rule:
    """One expectation. Exactly one of bad, value, unique or metadata is used."""

    expectation: str
    column: str | None
    severity: str
    bad: Column | None = None          # true on rows that break the rule; NULL passes
    value: Column | None = None        # aggregate to compare with the bounds
    low: Column | None = None
    high: Column | None = None
    unique: tuple[str, ...] = field(default=())
    metadata: tuple[str, ...] = field(default=())
    exact: bool = False
    live_only: bool = False            # skipped while backfilling history


def not_null(column: str, severity: str) -> Rule:
    return Rule(NOT_NULL, column, severity, bad=F.col(column).isNull())


def in_set(column: str, values: Sequence[str], severity: str) -> Rule:
    return Rule(IN_SET, column, severity, bad=~F.col(column).isin(list(values)))


def unique(column: str, severity: str) -> Rule:
    return Rule(UNIQUE, column, severity, unique=(column,))


def compound_unique(columns: Sequence[str], severity: str) -> Rule:
    return Rule(COMPOUND_UNIQUE, ",".join(columns), severity, unique=tuple(columns))


def between(column: str, low: Column | None, high: Column | None, severity: str,
            live_only: bool = False) -> Rule:
    outside = F.lit(False)
    if low is not None:
        outside = outside | (F.col(column) < low)
    if high is not None:
        outside = outside | (F.col(column) > high)
    return Rule(BETWEEN, column, severity, bad=outside, live_only=live_only)


def matches(column: str, pattern: str, severity: str) -> Rule:
    return Rule(REGEX, column, severity, bad=~F.col(column).rlike(pattern))


def holds(column: str, predicate: Column, severity: str) -> Rule:
    return Rule(EXPRESSION, column, severity, bad=~predicate)


def row_count(low: int, high: int | None, severity: str) -> Rule:
    top = None if high is None else F.lit(float(high))
    return Rule(ROW_COUNT, None, severity, value=F.count(F.lit(1)), low=F.lit(float(low)), high=top)


def column_max(column: str, low: Column, severity: str) -> Rule:
    """Freshness: the newest value, in seconds since 1970, must reach the bound."""
    def seconds(c: Column) -> Column:
        return F.unix_micros(c.cast("timestamp")) / F.lit(1e6)

    return Rule(COLUMN_MAX, column, severity, value=seconds(F.max(column)), low=seconds(low))


def columns_match(columns: Sequence[str], severity: str, exact: bool = False) -> Rule:
    return Rule(COLUMN_SET, None, severity, metadata=tuple(columns), exact=exact)


# --- Contracts --------------------------------------------------------------------------
def bounds(as_of: Column) -> dict[str, Column]:
    """Run-time parameters of the contracts, all relative to one moment."""
    return {
        "lookback_start": as_of - F.make_dt_interval(days=F.lit(90)),
        "tomorrow": as_of + F.make_dt_interval(days=F.lit(1)),
        "stale_before": as_of - F.make_dt_interval(hours=F.lit(26)),
        "today": F.date_trunc("day", as_of),
    }


def bronze_contract(as_of: Column, tenants: Sequence[str]) -> list[Rule]:
    b = bounds(as_of)
    return [
        not_null("tenant_id", "sev1"), not_null("event_id", "sev1"),
        not_null("event_timestamp", "sev1"),
        in_set("tenant_id", tenants, "sev1"),
        unique("event_id", "sev2"),
        between("event_timestamp", b["lookback_start"], b["tomorrow"], "sev2", live_only=True),
        row_count(1, None, "sev2"),
        columns_match(S.BRONZE_EVENTS.fieldNames(), "sev2"),
    ]


def silver_contract(as_of: Column, statuses: Sequence[str] = tuple(S.CONTRACT_STATUSES)):
    b = bounds(as_of)
    return [
        not_null("tenant_id", "sev1"), not_null("event_id", "sev1"),
        not_null("event_timestamp", "sev1"), not_null("status", "sev2"),
        in_set("status", statuses, "sev2"),
        column_max("last_updated_at", b["stale_before"], "sev1"),
        unique("event_id", "sev1"),
        between("event_timestamp", None, b["tomorrow"], "sev2"),
    ]


def gold_contract(as_of: Column) -> list[Rule]:
    return [
        not_null("event_date", "sev1"), not_null("event_count", "sev1"),
        between("event_count", F.lit(0), None, "sev1"),
        compound_unique(["event_date", "event_type", "status"], "sev1"),
        column_max("refreshed_at", bounds(as_of)["today"], "sev1"),
        row_count(1, None, "sev2"),
    ]


def kpi_model_tests() -> list[Rule]:
    return [
        not_null("event_date", "sev1"), not_null("event_count", "sev1"),
        holds("event_count", F.col("event_count") >= 0, "sev1"),
        holds("pct_of_day", F.col("pct_of_day").between(0, 100), "sev1"),
        compound_unique(["event_date", "event_type", "status"], "sev1"),
    ]


def cycle_model_tests() -> list[Rule]:
    return [
        not_null("reference_id", "sev1"), unique("reference_id", "sev1"),
        holds("cycle_days", F.col("cycle_days") >= 0, "sev1"),
        in_set("final_status", S.OUTCOMES, "sev1"),
    ]


def funnel_model_tests() -> list[Rule]:
    return [
        not_null("week_start", "sev1"), unique("week_start", "sev1"),
        holds("approval_rate_pct", F.col("approval_rate_pct").between(0, 100), "sev1"),
    ]


def silver_source_tests() -> list[Rule]:
    return [
        not_null("tenant_id", "sev1"), not_null("event_id", "sev1"), unique("event_id", "sev1"),
        not_null("event_timestamp", "sev1"), in_set("status", S.MODEL_STATUSES, "sev1"),
    ]


# --- Evaluation -------------------------------------------------------------------------
def _entry(rule: Rule, success: Column, observed: Column, expected: Column, bad: Column,
           share: Column) -> Column:
    return F.struct(
        F.lit(rule.expectation).alias("expectation_type"),
        F.lit(rule.column).cast("string").alias("column_name"),
        F.lit(rule.severity).alias("severity"),
        success.alias("success"),
        observed.cast("double").alias("observed_value"),
        expected.cast("double").alias("expected_value"),
        bad.cast("bigint").alias("unexpected_count"),
        share.cast("double").alias("unexpected_pct"),
    )


def _row_entry(rule: Rule, bad: Column, n: Column) -> Column:
    share = F.coalesce(bad * F.lit(100.0) / F.nullif(n, F.lit(0)), F.lit(0.0))
    return _entry(rule, bad == 0, bad, F.lit(0.0), bad, share)


def _value_entry(rule: Rule, value: Column) -> Column:
    low, high = rule.low, rule.high
    within = F.lit(True)
    if low is not None:
        within = within & (value >= low)
    if high is not None:
        within = within & (value <= high)
    nothing = F.lit(None)
    return _entry(rule, F.coalesce(within, F.lit(False)), value,
                  nothing if low is None else low, nothing, nothing)


def _metadata_entry(rule: Rule, columns: Sequence[str]) -> Column:
    wanted, found = set(rule.metadata), set(columns)
    wrong = len(wanted ^ found) if rule.exact else len(wanted - found)
    nothing = F.lit(None)
    return _entry(rule, F.lit(wrong == 0), F.lit(len(found)), F.lit(len(wanted)),
                  F.lit(wrong), nothing)


def _long(df: DataFrame, group: Sequence[str], entries: list[Column]) -> DataFrame:
    return df.select(*group, F.inline(F.array(*entries)))


def _uniqueness(df: DataFrame, rule: Rule, group: Sequence[str]) -> DataFrame:
    """Rows sharing a key. A single column ignores NULL; compound keys treat it as a value."""
    rows = df
    if len(rule.unique) == 1:
        rows = rows.filter(F.col(rule.unique[0]).isNotNull())
    per_key = rows.groupBy(*dict.fromkeys([*group, *rule.unique])).agg(
        F.count(F.lit(1)).alias("_n"))
    totals = per_key.groupBy(*group).agg(
        F.sum("_n").alias("n"),
        F.sum(F.when(F.col("_n") > 1, F.col("_n")).otherwise(0)).alias("bad"),
    )
    return _long(totals, group, [_row_entry(rule, F.col("bad"), F.col("n"))])


def evaluate(
    df: DataFrame, rules: Sequence[Rule], layer: str,
    group: Sequence[str] = ("tenant_id",), expected_groups: DataFrame | None = None,
    backfill: bool = False,
) -> DataFrame:
    """Contract result, one row per group and rule.

    Groups without any row are missing unless ``expected_groups`` names them; then
    their row count is 0 and fails the volume rule.
    """
    rules = [r for r in rules if not (backfill and r.live_only)]
    aggs = [F.count(F.lit(1)).alias("_n")]
    for i, rule in enumerate(rules):
        if rule.bad is not None:
            aggs.append(F.sum(F.when(rule.bad, 1).otherwise(0)).cast("bigint").alias(f"_v{i}"))
        elif rule.value is not None:
            aggs.append(rule.value.alias(f"_v{i}"))
    wide = df.groupBy(*group).agg(*aggs)
    if expected_groups is not None:
        zeros = {"_n": 0, **{
            f"_v{i}": 0 for i, r in enumerate(rules)
            if r.bad is not None or r.expectation == ROW_COUNT}}
        wide = expected_groups.select(*group).distinct().join(wide, list(group), "left")
        wide = wide.fillna(zeros)

    entries = []
    for i, rule in enumerate(rules):
        if rule.bad is not None:
            entries.append(_row_entry(rule, F.col(f"_v{i}"), F.col("_n")))
        elif rule.value is not None:
            entries.append(_value_entry(rule, F.col(f"_v{i}")))
        elif rule.metadata:
            entries.append(_metadata_entry(rule, df.columns))
    parts = [_long(wide, group, entries)] if entries else []
    parts += [_uniqueness(df, r, group) for r in rules if r.unique]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result.withColumn("layer", F.lit(layer))


def relationship(
    child: DataFrame, parent: DataFrame, keys: Sequence[str], column: str, layer: str,
    severity: str = "sev1",
) -> DataFrame:
    """Share of child rows whose key the parent lacks."""
    rule = Rule(RELATIONSHIP, column, severity)
    known = parent.select(*keys).distinct().withColumn("_known", F.lit(True))
    totals = child.select(*keys).join(known, list(keys), "left").groupBy("tenant_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.when(F.col("_known").isNull(), 1).otherwise(0)).cast("bigint").alias("bad"),
    )
    return _long(totals, ["tenant_id"], [_row_entry(rule, F.col("bad"), F.col("n"))]).withColumn(
        "layer", F.lit(layer))


def date_gaps(df: DataFrame, column: str, as_of, days: int = 7) -> DataFrame:
    """Dates without any row among the last ``days`` days, per tenant.

    Days present are collected per tenant as a set of at most ``days`` dates.
    """
    last = F.lit(as_of).cast("date")
    recent = F.when(F.col(column).between(F.date_sub(last, days - 1), last), F.col(column))
    present = df.groupBy("tenant_id").agg(F.collect_set(recent).alias("_days"))
    calendar = F.sequence(F.date_sub(last, days - 1), last)
    return present.select(
        "tenant_id", F.explode(F.array_except(calendar, F.col("_days"))).alias("missing_date"))


def no_date_gaps(df: DataFrame, column: str, as_of, layer: str, days: int = 7) -> DataFrame:
    rule = Rule(NO_GAPS, column, "sev1")
    last = F.lit(as_of).cast("date")
    recent = F.when(F.col(column).between(F.date_sub(last, days - 1), last), F.col(column))
    counted = df.groupBy("tenant_id").agg(
        (F.lit(days) - F.countDistinct(recent)).cast("bigint").alias("bad"))
    return _long(counted, ["tenant_id"], [_row_entry(rule, F.col("bad"), F.lit(days))]).withColumn(
        "layer", F.lit(layer))


def to_dq_results(evaluated: DataFrame, run_date: Column | None = None) -> DataFrame:
    """Rows in the layout of the stored result history."""
    rows = evaluated if run_date is None else evaluated.withColumn("run_date", run_date)
    return rows.select(*S.DQ_RESULTS.fieldNames())


def pass_rates(evaluated: DataFrame, *by: str) -> DataFrame:
    """Share of passed checks in percent."""
    n = F.count(F.lit(1))
    passed = F.sum(F.when(F.col("success"), 1).otherwise(0))
    return evaluated.groupBy(*by).agg(
        n.alias("checks"),
        F.round(passed * F.lit(100.0) / n, 2).alias("pass_rate_pct"),
        F.round((n - passed) * F.lit(100.0) / n, 2).alias("failure_rate_pct"),
    )
