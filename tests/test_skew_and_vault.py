"""Neighbour look-ups with and without heavy keys; hub and satellite rules."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from stratalake.functions.scalars import hash_diff, hash_key
from stratalake.functions.skew import heavy_cuts, in_order, neighbour, newest
from stratalake.operators import vault as V
from stratalake.operators.governance import transitions

T0 = datetime(2024, 1, 1)


def skewed(seed, n=300):
    """One key holds more than a third of all rows."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        key = "hot" if rng.random() < 0.4 else f"k{rng.randrange(20)}"
        value = rng.choice(["a", "b", None])
        at = None if rng.random() < 0.05 else T0 + timedelta(minutes=rng.randrange(3000))
        rows.append((key, at, i, value))
    return rows


def expected_neighbours(rows, step):
    out, groups = {}, {}
    for r in rows:
        groups.setdefault(r[0], []).append(r)
    for g in groups.values():
        g.sort(key=lambda r: (r[1] or datetime.min, r[2]))
        for i, r in enumerate(g):
            j = i + step
            out[r[2]] = (g[j][3],) if 0 <= j < len(g) else None
    return out


@pytest.mark.parametrize("step", [-1, 1])
@pytest.mark.parametrize("parts", [1, 3, 40])
def test_neighbour_is_the_same_however_rows_are_cut(spark, step, parts):
    rows = skewed(7)
    df = spark.createDataFrame(rows, "k string, ts timestamp, id int, v string")
    ordered = cut_into(spark, parts, lambda: in_order(df, ["k"], ["ts", "id"]))
    got = neighbour(ordered, ["k"], F.col("v"), "n", step)
    found = {r.id: None if r.n is None else (r.n.v,) for r in got.collect()}
    assert found == expected_neighbours(rows, step)
    # Of some rows only, the neighbour is the next of those.
    some = neighbour(ordered.filter("id % 7 = 0"), ["k"], F.col("v"), "n", step)
    found = {r.id: None if r.n is None else (r.n.v,) for r in some.collect()}
    assert found == expected_neighbours([r for r in rows if r[2] % 7 == 0], step)


def cut_into(spark, parts, make):
    """in_order with so many parts, however few the rows."""
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        return make()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_a_heavy_key_of_one_time_stays_spread(spark):
    df = spark.range(9000).selectExpr("CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('k', id) END AS k",
                                      "TIMESTAMP '2024-01-01' AS ts", "'same' AS v")
    ordered = cut_into(spark, 12, lambda: in_order(df, ["k"], ["ts"]))
    sizes = [r[1] for r in ordered.groupBy("_part").count().collect()]
    assert len(sizes) == 12 and max(sizes) < 2 * 9000 / 12
    assert ordered.filter("k = 'hot'").select("_part").distinct().count() >= 4
    got = neighbour(ordered, ["k"], F.col("v"), "n", -1)
    assert got.filter("n IS NULL").count() == 6001


def test_hashes_keep_texts_apart(spark):
    rows = spark.createDataFrame(
        [(None, "x"), ("<null>", "x"), ("", "x"), ("a||b", "c"), ("a", "b||c"), ("x", None)], "a string, b string")
    for made in (hash_diff("a", "b"), hash_key("a", "b")):
        assert rows.select(made.alias("h")).distinct().count() == 6


def test_newest_limits_rows_before_the_shuffle(spark):
    df = spark.createDataFrame(skewed(5), "k string, ts timestamp, id int, v string")
    best = newest(df, ["k"], [F.desc("ts"), F.desc("id")])
    plan = best._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
    expected = {}
    for k, ts, i, _ in skewed(5):
        expected[k] = max(expected.get(k, (None, -1)), (ts, i), key=lambda e: (e[0] or datetime.min, e[1]))
    assert {r.k: (r.ts, r.id) for r in best.collect()} == expected


VERSIONS = "tenant_id string, event_id string, event_type string, status string, " \
           "reference_id string, _ingested_at timestamp, _batch_id string"


def versions(spark, rows):
    return V.satellite_versions(spark.createDataFrame(
        [("t", e, "review", s, "R", T0 + timedelta(hours=h), "b") for e, s, h in rows], VERSIONS))


def intervals(df):
    return sorted((r.h_event_hk, r.load_dts, r.load_end_dts, r.status) for r in df.collect())


def test_satellite_keeps_changes_only_and_closes_them(spark):
    rows = versions(spark, [("a", "pending", 0), ("a", "pending", 1), ("a", None, 2),
                            ("a", "pending", 5), ("b", "approved", 3)])
    got = [(r.status, r.load_dts.hour, r.load_end_dts and r.load_end_dts.hour)
           for r in V.satellite_history(rows).orderBy("h_event_hk", "load_dts").collect()]
    assert sorted(got, key=str) == sorted(
        [("pending", 0, 2), (None, 2, 5), ("pending", 5, None), ("approved", 3, None)], key=str)


def test_late_version_reopens_intervals(spark):
    early = versions(spark, [("a", "pending", 0), ("a", "approved", 8), ("b", "pending", 1)])
    late = versions(spark, [("a", "rejected", 4)])
    both = early.unionByName(late)
    after = V.satellite_reload(V.satellite_history(early), both, late)
    assert intervals(after) == intervals(V.satellite_history(both))


def test_batches_in_order_equal_one_load(spark):
    rng = random.Random(5)
    rows = [(f"e{rng.randrange(6)}", rng.choice(["x", "y", None]), h) for h in range(120)]
    satellite = V.satellite_history(versions(spark, rows[:50]))
    for part in (rows[50:51], rows[51:90], rows[90:]):
        batch = versions(spark, part)
        satellite = spark.createDataFrame(
            V.satellite_append(satellite, batch).collect(), satellite.schema)
    expected = V.satellite_history(versions(spark, rows))
    assert sorted(map(str, satellite.collect())) == sorted(map(str, expected.collect()))


def test_satellite_intervals_do_not_overlap(spark):
    rng = random.Random(11)
    rows = versions(spark, [(f"e{rng.randrange(5)}", rng.choice(["x", "y", None]), rng.randrange(400))
                            for _ in range(200)])
    ends = {}
    history = V.satellite_history(rows).orderBy("h_event_hk", "load_dts", "load_end_dts")
    for r in history.filter("load_dts < load_end_dts OR load_end_dts IS NULL").collect():
        assert ends.get(r.h_event_hk, r.load_dts) <= r.load_dts
        ends[r.h_event_hk] = r.load_end_dts or datetime.max


def test_hub_groups_equal_keys_and_only_inserts(spark):
    silver = spark.createDataFrame(
        [("t", "e1", T0), ("t", " E1 ", T0 - timedelta(days=1)), ("t", "e2", T0), ("u", "e1", T0)],
        "tenant_id string, event_id string, event_timestamp timestamp")
    hub = V.hub_rows(silver)
    assert hub.count() == 3
    assert hub.filter("tenant_id = 't'").agg(F.min("load_dts")).first()[0] == T0 - timedelta(days=1)
    assert V.hub_load(hub, silver).count() == 0


def test_transitions(spark):
    log = spark.createDataFrame(
        [("a", "PENDING", T0, 1), ("a", "REGISTERED", T0, 2), ("a", "FAILED", T0, 3),
         ("a", "REGISTERED", T0 + timedelta(days=1), 4), ("b", "ACTIVE", T0, 5),
         ("b", "FAILED", T0, 6), ("c", "PENDING", T0, 7), ("c", "GRANTS_PROVISIONED", T0, 8)],
        "tenant_id string, state string, changed_at timestamp, seq int")
    got = transitions(log)
    assert {r.seq: r.legal for r in got.collect()} == {
        2: True, 3: True, 4: False, 6: False, 8: False}


@pytest.mark.parametrize("parts", [1, 4, 30])
def test_history_is_that_of_each_key_alone_however_keys_are_cut(spark, parts):
    rng = random.Random(parts)
    rows = [(rng.choice(["t", None]), "hot" if rng.random() < 0.5 else f"e{rng.randrange(9)}", rng.choice([None, *range(60)]),
             rng.choice(["x", "x", "y", None])) for _ in range(600)]
    hashed = V.satellite_versions(spark.createDataFrame(
        [(t, e, "review", s, "R", None if h is None else T0 + timedelta(hours=h), "b") for t, e, h, s in rows], VERSIONS))
    cuts = cut_into(spark, parts, lambda: heavy_cuts(hashed, V.SATELLITE_KEYS, V.VERSION_ORDER))
    assert bool(cuts) == (parts > 1)
    history = cut_into(spark, parts, lambda: V.satellite_history(hashed))
    groups, expected = {}, []
    for r in hashed.collect():
        groups.setdefault((r.tenant_id, r.h_event_hk), []).append(r)
    for key, held in groups.items():
        held.sort(key=lambda r: (r._ingested_at or datetime.min, r.hash_diff))
        starts = [r for i, r in enumerate(held) if not i or r.hash_diff != held[i - 1].hash_diff]
        ends = [*(r._ingested_at for r in starts[1:]), None]
        expected += [(*key, r._ingested_at, end, r.hash_diff, r.status) for r, end in zip(starts, ends, strict=True)]
    got = [(r.tenant_id, r.h_event_hk, r.load_dts, r.load_end_dts, r.hash_diff, r.status) for r in history.collect()]
    assert sorted(map(str, got)) == sorted(map(str, expected))


def test_history_shuffles_versions_once(spark):
    rows = versions(spark, [(f"e{i}", "x", i % 7) for i in range(500)])
    plan = V.satellite_history(rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "rangepartitioning" not in plan
