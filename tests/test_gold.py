"""Gold models on small frames with known answers."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from stratalake.plans import dashboards as D
from stratalake.plans import gold as G

COLUMNS = "tenant_id string, event_id string, event_type string, event_timestamp timestamp, " \
          "source_system string, status string, reference_id string"
ROWS = [
    ("t", "1", "submission", datetime(2024, 1, 1, 23, 50), "erp", "pending", "A"),
    ("t", "2", "review", datetime(2024, 1, 2, 0, 10), "erp", "approved", "A"),
    ("t", "3", "review", datetime(2024, 1, 5, 12, 0), "web", "escalated", "A"),
    ("t", "4", "submission", datetime(2024, 1, 2, 1, 0), "web", "pending", "B"),
    ("t", "5", "decision", datetime(2024, 1, 9, 1, 0), "web", "rejected", "B"),
    ("t", "6", "decision", datetime(2024, 1, 9, 2, 0), "web", "approved", None),
    ("t", "7", "submission", datetime(2024, 1, 9, 3, 0), "web", None, "C"),
    ("u", "8", "review", datetime(2023, 10, 1, 0, 0), "web", "completed", "A"),
]


@pytest.fixture(scope="module")
def silver(spark):
    return spark.createDataFrame(ROWS, COLUMNS)


def test_shares_of_a_day_add_up(silver):
    kpi = G.daily_kpi(silver, "2024-01-31")
    totals = kpi.groupBy("tenant_id", "event_date").agg(F.sum("pct_of_day").alias("s")).collect()
    assert totals and all(abs(r.s - 100) < 0.05 for r in totals)


def test_lookback_starts_at_midnight(silver):
    kept = {d: G.daily_kpi(silver, d).filter("tenant_id = 'u'").count()
            for d in ("2023-12-30", "2023-12-31")}
    assert kept == {"2023-12-30": 1, "2023-12-31": 0}


def test_cycle_days_count_calendar_days(silver):
    rows = {r.reference_id: r for r in G.cycle_time(silver).filter("tenant_id = 't'").collect()}
    assert set(rows) == {"A", "B"}  # C never finished, the nameless one has no cycle
    a, b = rows["A"], rows["B"]
    assert (a.cycle_days, a.cycle_hours, a.step_count, a.total_events) == (1, 24.0, 2, 3)
    assert (a.final_status, a.was_escalated) == ("approved", 1)
    assert (b.cycle_days, b.final_status) == (7, "rejected")


def test_short_form_keeps_rows_without_reference(silver):
    rows = {r.reference_id: r for r in G.cycle_time_terminal(silver)
            .filter("tenant_id = 't'").collect()}
    assert set(rows) == {"A", "B", None}
    assert rows["A"].cycle_days == 0


def test_funnel_counts_a_reference_once_per_status(silver):
    rows = {r.week_start: r for r in G.approval_funnel(silver, "2024-01-31").collect()}
    first = rows[date(2024, 1, 1)]
    assert (first.submitted, first.approved, first.escalated, first.total) == (2, 1, 1, 4)
    assert first.approval_rate_pct == 25.0
    second = rows[date(2024, 1, 8)]
    # The approval without a reference adds no reference; the status NULL adds to the total.
    assert (second.approved, second.rejected, second.total) == (0, 1, 2)


def test_percentiles_equal_unweighted_ones(spark):
    cycles = spark.createDataFrame(
        [("t", "approved", d) for d in [0, 0, 1, 3, 3, 3, 8, 20]],
        "tenant_id string, final_status string, cycle_days int")
    got = G.outcome_statistics(cycles).first()
    exact = cycles.agg(*[
        F.round(F.expr(f"percentile(cycle_days, {p}D)"), 1) for p in (0.25, 0.5, 0.75, 0.95)])
    assert (got.p25_days, got.p50_days, got.p75_days, got.p95_days) == tuple(exact.first())
    assert (got.refs, got.avg_cycle_days, got.max_days) == (8, 4.8, 20)


def test_histogram_holds_every_reference(spark):
    cycles = spark.createDataFrame(
        [("t", d) for d in [0, 1, 1, 5, 20]] + [("u", 4), ("u", 4)],
        "tenant_id string, cycle_days int")
    got = {(r.tenant_id, r.bin): r.refs for r in D.cycle_histogram(cycles).collect()}
    assert got == {("t", 1): 1, ("t", 2): 2, ("t", 6): 1, ("t", 20): 1, ("u", 1): 2}


def test_daily_references_over_count(silver):
    cards = G.kpi_cards(G.daily_kpi(silver, "2024-01-31")).filter("tenant_id = 't'").first()
    true = G.distinct_references(silver, "2024-01-31", 90).filter("tenant_id = 't'").first()
    assert cards.total_unique_references > true.unique_references == 3


def test_top_per_tenant_is_cut_before_the_shuffle(silver):
    top = G.top_per_tenant(silver, [F.desc("event_timestamp")], 2)
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()
    assert {(r.tenant_id, r.event_id) for r in top.collect()} == {("t", "7"), ("t", "6"), ("u", "8")}
