"""Daily summaries that add up, medians from counts, loads and releases that are seen once."""

import random
import statistics
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from stratalake import schemas as S
from stratalake.functions.selection import weighted_median
from stratalake.operators import anomaly as A
from stratalake.operators import quality as Q
from stratalake.plans import summaries as Y
from stratalake.session import new_path
from stratalake.sources.publish import read_table
from stratalake.sources.release import release, released

T0 = datetime(2024, 1, 1)


def events(spark, n, seed=1):
    rng = random.Random(seed)
    rows = [("t", f"e{i}", rng.choice([None, *(f"R{j}" for j in range(n // 3))]), T0 + timedelta(hours=rng.randrange(24 * 20))) for i in range(n)]
    return spark.createDataFrame(rows, "tenant_id string, event_id string, reference_id string, event_timestamp timestamp")


def test_sketches_of_days_add_up_to_one_pass(spark):
    silver = events(spark, 6000)
    days = Y.daily_sketches(silver)
    assert days.count() == 20
    about = Y.estimated_references(days, "tenant_id").first()
    whole = silver.agg(F.hll_sketch_estimate(F.hll_sketch_agg("reference_id", F.lit(Y.LG_K))), F.count_distinct("reference_id"), F.max("event_timestamp")).first()
    assert about.events == 6000 and about.last_event_ts == whole[2]
    assert abs(about.references - whole[0]) <= 1 + 4 * Y.ERROR * whole[1]
    assert abs(about.references - whole[1]) <= 1 + 4 * Y.ERROR * whole[1]
    assert Y.exact_references(Y.daily_references(silver), "tenant_id").first().references == whole[1]
    # Merging some days first changes nothing.
    some = Y.in_range(days, F.lit("2024-01-03").cast("date"), F.lit("2024-01-09").cast("date"))
    part = Y.estimated_references(some, "tenant_id").first()
    exact = silver.filter("event_timestamp >= '2024-01-03' AND event_timestamp < '2024-01-10'").agg(F.count("*"), F.count_distinct("reference_id")).first()
    assert part.events == exact[0] and abs(part.references - exact[1]) <= 1 + 4 * Y.ERROR * exact[1]


@pytest.mark.parametrize("keys", [("k",), ()])
def test_weighted_median(spark, keys):
    rng = random.Random(len(keys))
    rows = [(None if i % 11 == 0 else f"k{i % 5}" if i % 3 else "hot", rng.choice([None, -1.5, 2.0, float(rng.randrange(50))])) for i in range(600)]
    rows += [("none", None), ("one", 4.0), ("two", 1.0), ("two", 2.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    counts = df.groupBy("k", "v").agg(F.count("*").alias("n"))
    got = {tuple(r)[:-1]: r.m for r in weighted_median(counts, keys, "v", "n", "m").collect()}
    groups = {}
    for k, v in rows:
        if v is not None:
            groups.setdefault((k,) if keys else (), []).append(v)
    assert got == {k: statistics.median(v) for k, v in groups.items()}


def history(spark, rows):
    return spark.createDataFrame([(t, d, "silver", kind, column, True, value, 0.0, 0, value) for t, d, kind, column, value in rows], S.DQ_RESULTS)


def test_divergence_needs_no_window_over_tenants(spark):
    day = T0.date()
    rows = [(f"t{i}", day, Q.NOT_NULL, "status", float(i % 7)) for i in range(60)] + [("far", day, Q.NOT_NULL, "status", 90.0)]
    rows += [(f"t{i}", day, Q.ROW_COUNT, None, 5.0) for i in range(9)]
    found = A.peer_anomalies(history(spark, rows))
    assert [(r.tenant_id, r.baseline_value) for r in found.collect()] == [("far", 3.0)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and all("_part" in line for line in windows)


def test_null_rate_is_judged_for_key_columns_only(spark):
    day = T0.date()
    rows = [("t", day, Q.NOT_NULL, c, 50.0) for c in ("status", "event_id", "owner", "reference_id")]
    found = A.series_anomalies(history(spark, rows)).filter("metric = 'null_rate'")
    assert {r.column_name for r in found.collect()} == {"event_id", "reference_id"}


def test_daily_run_writes_todays_alerts_of_active_tenants_once(spark):
    days = [(T0 + timedelta(days=i)).date() for i in range(40)]
    rows = [(t, d, Q.ROW_COUNT, None, 10.0 if i in (39, 35, 20) else 100.0) for t in ("on", "off") for i, d in enumerate(days)]
    registry = spark.createDataFrame([("on", "ACTIVE"), ("off", "PENDING")], "tenant_id string, state string")
    path = new_path(spark, "alerts")
    assert A.write_alerts(history(spark, rows), registry, str(days[35]), path)
    assert not A.write_alerts(history(spark, rows), registry, str(days[35]), path)
    first = read_table(spark, path, S.DQ_ALERTS).collect()
    assert {(r.tenant_id, r.detected_at.date()) for r in first} == {("on", days[35])}
    assert {"volume_vs_week", "volume_day_drop"} <= {r.metric for r in first} and len(first) == len({r.metric for r in first})
    assert A.write_alerts(history(spark, rows), registry, str(days[39]), path)
    assert {r.detected_at.date() for r in read_table(spark, path, S.DQ_ALERTS).collect()} == {days[35], days[39]}


def test_a_release_that_fails_its_checks_is_not_seen(spark):
    root, at = new_path(spark, "gold"), F.lit(T0).cast("timestamp")
    df = spark.createDataFrame([("a", 1), ("b", 2)], "tenant_id string, v int")
    rules = [Q.holds("v", F.col("v") > 0, "sev1"), Q.holds("v", F.col("v") > 1, "sev2")]
    schema = df.withColumn("refreshed_at", at).schema
    assert released(spark, root, "x", schema).count() == 0
    ok, checks = release(root, "r1", {"x": (df, (), rules), "y": (df, ("tenant_id",), [])}, at)
    assert ok and checks.filter("NOT success").count() == 1
    bad = df.withColumn("v", -F.col("v"))
    ok, checks = release(root, "r2", {"y": (df.limit(1), ("tenant_id",), []), "x": (bad, (), rules)}, at)
    assert not ok and checks.filter("NOT success AND severity = 'sev1'").count() == 2
    for table in ("x", "y"):
        assert sorted((r.tenant_id, r.v, r.refreshed_at) for r in released(spark, root, table, schema).collect()) == [("a", 1, T0), ("b", 2, T0)]
    assert release(root, "r2", {"x": (df.limit(1), (), rules), "y": (df.limit(1), (), [])}, at)[0]
    assert released(spark, root, "x", schema).count() == 1
    # Written again under its name, a release that is out stays as it is.
    assert release(root, "r2", {"x": (df, (), rules)}, at)[0] and released(spark, root, "x", schema).count() == 1
