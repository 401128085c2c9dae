"""Anomaly rules on planted histories."""

from datetime import date, timedelta

from pyspark.sql import functions as F

from stratalake import schemas as S
from stratalake.operators import anomaly as A
from stratalake.operators.quality import NOT_NULL, REGEX, ROW_COUNT

START = date(2024, 1, 1)


def history(spark, series):
    """Series: (tenant, expectation, column, layer) -> {day: value}."""
    rows = []
    for (tenant, kind, column, layer), days in series.items():
        for day, value in days.items():
            volume = kind == ROW_COUNT
            rows.append((tenant, START + timedelta(days=day), layer, kind, column, True,
                         float(value) if volume else None, 0.0, None,
                         None if volume else float(value)))
    return spark.createDataFrame(rows, S.DQ_RESULTS)


def hits(df, metric):
    return {((r.run_date - START).days, r.severity) for r in df.filter(
        F.col("metric") == metric).collect()}


def test_null_rate_rising_needs_seven_days_in_a_row(spark):
    rates = {d: d for d in range(0, 8)} | {8: 5, 9: 6}
    df = A.series_anomalies(history(spark, {("t", NOT_NULL, "k", "silver"): rates}))
    assert hits(df, "null_rate_rising") == {(7, "sev2")}


def test_a_missing_day_breaks_the_run(spark):
    rates = {d: d for d in range(0, 12) if d != 5}
    df = A.series_anomalies(history(spark, {("t", NOT_NULL, "k", "silver"): rates}))
    assert hits(df, "null_rate_rising") == set()


def test_volume_rules(spark):
    volume = {d: 100 for d in range(10)} | {10: 40, 11: 100}
    df = A.series_anomalies(history(spark, {("t", ROW_COUNT, None, "silver"): volume}))
    assert hits(df, "volume_vs_week") == {(10, "sev1")}
    assert hits(df, "volume_day_drop") == {(10, "sev1")}
    assert hits(df, "volume_week_change") == {(10, "sev2")}
    row = df.filter("metric = 'volume_vs_week'").first()
    assert (row.current_value, row.baseline_value, row.delta_pct) == (40.0, 100.0, -60.0)


def test_gold_uses_the_tighter_limit(spark):
    volume = {d: 100 for d in range(8)} | {8: 60}
    for layer, expected in (("silver", set()), ("gold", {(8, "sev1")})):
        df = A.series_anomalies(history(spark, {("t", ROW_COUNT, None, layer): volume}))
        assert hits(df, "volume_vs_week") == expected


def test_day_without_rows_counts_as_zero_and_zero_base_gives_no_change(spark):
    volume = {0: 100, 1: 100, 4: 100}
    figures = {(r.run_date - START).days: (r.value, r.delta_pct) for r in A.trend_figures(
        history(spark, {("t", ROW_COUNT, None, "silver"): volume})).collect()}
    assert figures[2] == (0.0, -100.0)
    assert figures[0] == (100.0, None)
    empty = {d: 0 for d in range(8)} | {8: 10}
    df = A.series_anomalies(history(spark, {("t", ROW_COUNT, None, "silver"): empty}))
    assert hits(df, "volume_vs_week") == set()


def test_trend_is_raised_after_two_more_weeks(spark):
    share = {d: d * 0.1 for d in range(40)}
    df = A.series_anomalies(history(spark, {("t", REGEX, "k", "silver"): share}))
    got = dict(hits(df, "unexpected_trend"))
    assert min(got) == 13
    assert got[27 - 1] == "sev3" and got[13 + 14] == "sev2"


def test_peer_divergence(spark):
    series = {(f"t{i}", NOT_NULL, "k", "silver"): {0: 1.0 + i * 0.1} for i in range(9)}
    series[("odd", NOT_NULL, "k", "silver")] = {0: 60.0}
    df = A.peer_anomalies(history(spark, series))
    assert [r.tenant_id for r in df.collect()] == ["odd"]


def test_routing_and_alert_rows(spark):
    rates = {0: 1, 1: 30, 2: 12}
    found = A.detect(history(spark, {("t", NOT_NULL, "event_id", "silver"): rates}))
    routed = A.route(found)
    by = {(r.metric, (r.run_date - START).days): r for r in routed.collect()}
    worst = by[("null_rate", 1)]
    assert (worst.to_alerts, worst.to_remediation, worst.channel) == (True, True, "#dq-t")
    assert worst.message.startswith(":rotating_light: SEV1 alert for t\n")
    assert "is 30.00, usually 1.00 (+2900.0%)" in worst.message
    assert by[("unexpected_share", 2)].message.startswith(":warning:")
    assert A.proposals(found).first().proposed_expectation == NOT_NULL
    assert A.alert_rows(found, F.current_timestamp()).columns == S.DQ_ALERTS.fieldNames()


def test_one_shuffle_feeds_all_series_rules(spark):
    df = A.series_anomalies(history(spark, {("t", NOT_NULL, "k", "silver"): {0: 1}}))
    assert df._jdf.queryExecution().executedPlan().toString().count("Exchange") <= 3


def test_only_sev1_also_goes_to_the_platform_channel(spark):
    rows = [("a", "silver", "rows", s, 1.0, None, None, "text") for s in ("sev1", "sev2", "sev3")]
    columns = "tenant_id string, layer string, metric string, severity string, current_value double, baseline_value double, delta_pct double, description string"
    got = A.deliveries(spark.createDataFrame(rows, columns)).collect()
    assert sorted((r.severity, r.channel) for r in got) == [("sev1", "#dq-a"), ("sev1", "#platform-alerts"), ("sev2", "#dq-a")]
    assert all(r.message for r in got)
