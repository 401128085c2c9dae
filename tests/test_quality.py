"""Contract rules on small frames."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from stratalake.operators import quality as Q

T0 = datetime(2024, 1, 31)
COLUMNS = "tenant_id string, k string, v int, at timestamp"


def frame(spark):
    return spark.createDataFrame(
        [("t", "a", 1, T0), ("t", "a", None, T0), ("t", None, 5, T0 - timedelta(hours=30)),
         ("t", None, -1, T0), ("u", "b", 2, T0 - timedelta(hours=27))], COLUMNS)


def results(df):
    return {(r.tenant_id, r.expectation_type, r.column_name):
            (r.success, r.unexpected_count, r.unexpected_pct) for r in df.collect()}


def test_row_rules_ignore_null_values(spark):
    got = results(Q.evaluate(frame(spark), [
        Q.not_null("k", "sev1"), Q.in_set("v", [1, 2], "sev2"),
        Q.between("v", F.lit(0), None, "sev2"), Q.matches("k", "^a$", "sev2"),
        Q.holds("v", F.col("v") >= 0, "sev1")], "x"))
    assert got[("t", Q.NOT_NULL, "k")] == (False, 2, 50.0)
    assert got[("t", Q.IN_SET, "v")] == (False, 2, 50.0)
    assert got[("t", Q.BETWEEN, "v")] == (False, 1, 25.0)
    assert got[("t", Q.REGEX, "k")] == (True, 0, 0.0)
    assert got[("t", Q.EXPRESSION, "v")] == (False, 1, 25.0)
    assert got[("u", Q.REGEX, "k")] == (False, 1, 100.0)


def test_uniqueness(spark):
    got = results(Q.evaluate(frame(spark), [
        Q.unique("k", "sev1"), Q.compound_unique(["k", "at"], "sev1")], "x"))
    assert got[("t", Q.UNIQUE, "k")] == (False, 2, 100.0)
    assert got[("t", Q.COMPOUND_UNIQUE, "k,at")] == (False, 2, 50.0)
    assert got[("u", Q.UNIQUE, "k")] == (True, 0, 0.0)
    nulls = spark.createDataFrame([("t", None, 1, T0), ("t", None, 2, T0)], COLUMNS)
    got = results(Q.evaluate(nulls, [Q.compound_unique(["k", "at"], "sev1")], "x"))
    assert got[("t", Q.COMPOUND_UNIQUE, "k,at")] == (False, 2, 100.0)


def test_freshness_bound(spark):
    rule = Q.column_max("at", Q.bounds(F.lit(T0))["stale_before"], "sev1")
    got = results(Q.evaluate(frame(spark), [rule], "x"))
    assert got[("t", Q.COLUMN_MAX, "at")][0] is True
    assert got[("u", Q.COLUMN_MAX, "at")][0] is False


def test_missing_tenant_fails_the_volume_rule(spark):
    tenants = spark.createDataFrame([("t",), ("gone",)], "tenant_id string")
    got = Q.evaluate(frame(spark), [Q.row_count(1, None, "sev2"), Q.not_null("k", "sev1")], "x",
                     expected_groups=tenants)
    rows = {(r.tenant_id, r.expectation_type): (r.success, r.observed_value) for r in got.collect()}
    assert rows[("gone", Q.ROW_COUNT)] == (False, 0.0)
    assert rows[("gone", Q.NOT_NULL)] == (True, 0.0)
    assert rows[("t", Q.ROW_COUNT)] == (True, 4.0)
    assert ("u", Q.ROW_COUNT) not in rows


def test_one_scan_and_one_shuffle_for_all_row_rules(spark):
    rules = [Q.not_null("k", "sev1"), Q.in_set("v", [1], "sev2"), Q.row_count(1, None, "sev2")]
    plan = Q.evaluate(frame(spark), rules, "x")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_columns_and_backfill(spark):
    df = frame(spark)
    got = results(Q.evaluate(df, [Q.columns_match(["k", "v"], "sev2"),
                                  Q.columns_match(["k", "v"], "sev2", exact=True)], "x")
                  .filter("success").limit(10))
    assert got[("t", Q.COLUMN_SET, None)][0] is True
    live = Q.between("at", F.lit(T0), None, "sev2", live_only=True)
    assert Q.evaluate(df, [live, Q.not_null("k", "sev1")], "x", backfill=True).count() == 2


def test_relationship_and_gaps(spark):
    child = spark.createDataFrame([("t", "a"), ("t", "b"), ("t", "b")], "tenant_id string, k string")
    parent = spark.createDataFrame([("t", "a"), ("t", "a"), ("u", "b")], "tenant_id string, k string")
    row = Q.relationship(child, parent, ["tenant_id", "k"], "k", "x").first()
    assert (row.success, row.unexpected_count) == (False, 2)
    days = spark.createDataFrame(
        [("t", T0.date() - timedelta(days=d)) for d in (0, 1, 2, 4, 5, 9)],
        "tenant_id string, day date")
    gaps = Q.date_gaps(days, "day", "2024-01-31")
    assert {(T0.date() - r.missing_date).days for r in gaps.collect()} == {3, 6}
    assert Q.no_date_gaps(days, "day", "2024-01-31", "gold").first().unexpected_count == 2
