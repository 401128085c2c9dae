"""Merge semantics on small hand-made frames and against a plain Python merge."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from stratalake import schemas as S
from stratalake.operators import silver as SV
from stratalake.operators.lifecycle import activate, register
from stratalake.operators.upsert import insert_absent, update_where, upsert
from stratalake.session import new_path
from stratalake.sources.bronze import append_bronze
from stratalake.sources.publish import read_table

T0, T1 = datetime(2024, 1, 1), datetime(2024, 1, 2)
SOURCE = "tenant_id string, event_id string, event_type string, event_timestamp timestamp, " \
         "source_system string, status string, reference_id string, _ingested_at timestamp, " \
         "_batch_id string"


def source(spark, rows):
    full = [("t", e, "review", T0, "erp", s, "R1", at, b) for e, s, at, b in rows]
    return spark.createDataFrame(full, SOURCE)


def target(spark, rows):
    return SV.silver_from_scratch(source(spark, [(e, s, T0, "b0") for e, s in rows]), F.lit(T0))


def state(df):
    return {r.event_id: (r.status, r.created_at, r.last_updated_at) for r in df.collect()}


def test_null_status_never_updates(spark):
    merged = SV.silver_upsert(
        target(spark, [("a", "pending"), ("b", None), ("c", "pending")]),
        source(spark, [("a", None, T1, "1"), ("b", "approved", T1, "1"),
                       ("c", "approved", T1, "1")]),
        F.lit(T1))
    got = state(merged)
    assert got["a"] == ("pending", T0, T0)
    assert got["b"] == (None, T0, T0)
    assert got["c"] == ("approved", T0, T1)


def test_newest_source_version_wins(spark):
    merged = SV.silver_upsert(
        target(spark, []),
        source(spark, [("a", "pending", T0, "1"), ("a", "approved", T1, "1"),
                       ("a", "rejected", T1, "2")]),
        F.lit(T1))
    assert state(merged) == {"a": ("rejected", T1, T1)}


def test_other_columns_of_a_match_are_kept(spark):
    src = source(spark, [("a", "approved", T1, "9")]).withColumn("reference_id", F.lit("other"))
    row = SV.silver_upsert(target(spark, [("a", "pending")]), src, F.lit(T1)).first()
    assert (row.reference_id, row._batch_id, row.status) == ("R1", "b0", "approved")


def test_repeating_a_merge_changes_nothing(spark):
    src = source(spark, [("a", "approved", T1, "1"), ("n", "pending", T1, "1")])
    once = SV.silver_upsert(target(spark, [("a", "pending")]), src, F.lit(T1))
    twice = SV.silver_upsert(once, src, F.lit(T1 + timedelta(days=1)))
    assert state(once) == state(twice)


def plain_silver(versions):
    """Every version merged on its own, in order of arrival."""
    out = {}
    for e, status, at, batch in sorted(versions, key=lambda v: (v[2], v[3], v[1] is not None, v[1] or "")):
        if e not in out:
            out[e] = [status, batch, at]
        elif status is not None and out[e][0] is not None:
            out[e][0] = status
    return {e: tuple(v) for e, v in out.items()}


def random_versions(seed, n=120):
    rng = random.Random(seed)
    return [(f"e{rng.randrange(30)}", rng.choice(["pending", "approved", "rejected", None]),
             T0 + timedelta(minutes=rng.randrange(40)), f"b{rng.randrange(3)}") for _ in range(n)]


@pytest.mark.parametrize("stored", [False, True])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_any_split_and_order_gives_what_single_merges_give(spark, seed, stored):
    rows, rng = random_versions(seed), random.Random(seed)
    expected = plain_silver(rows)
    for parts in (1, 2, 7):
        rng.shuffle(rows)
        silver = target(spark, [])
        for i in range(parts):
            batch = source(spark, rows[i::parts])
            silver = SV.silver_upsert(silver, SV.event_state(batch) if stored else batch, F.lit(T1), stored)
            silver = spark.createDataFrame(silver.collect(), S.SILVER_STATE)
        assert {r.event_id: (r.status, r._batch_id, r._first_at) for r in silver.collect()} == expected


def test_only_touched_buckets_are_read_and_replaced(spark):
    path = new_path(spark, "silver")
    rows = [(f"e{i}", "pending", T0, "b") for i in range(400)]
    SV.merge_into(spark, path, source(spark, rows), F.lit(T0))

    def files():
        return {r.f: r.n for r in spark.read.parquet(path).select(F.col("_metadata.file_path").alias("f")).groupBy("f").agg(F.count("*").alias("n")).collect()}

    before = files()
    assert len(before) == SV.BUCKETS
    late = source(spark, [("e7", "approved", T1, "c"), ("e8", None, T1, "c")])
    state = SV.event_state(late)
    plan = SV.touched_buckets(read_table(spark, path, S.SILVER_STATE), state)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket#" in plan.split("PartitionFilters: [")[1].split("PushedFilters")[0]
    SV.merge_into(spark, path, late, F.lit(T1))
    touched = {r.bucket for r in SV.silver_from_scratch(late, F.lit(T1)).collect()}
    changed = {f for f in before if f not in files()}
    assert len(changed) == len(touched) <= 2
    got = state_of(spark, path)
    assert len(got) == 400 and got["e7"] == ("approved", T0, T1) and got["e8"] == ("pending", T0, T0)
    SV.merge_into(spark, path, late, F.lit(T1 + timedelta(days=1)))
    assert state_of(spark, path) == got


def state_of(spark, path):
    return state(read_table(spark, path, S.SILVER_STATE))


def test_stored_state_leaves_the_table_unshuffled(spark):
    path, small = new_path(spark, "silver"), new_path(spark, "state")
    SV.merge_into(spark, path, source(spark, [("a", "pending", T0, "1")]), F.lit(T0))
    SV.event_state(source(spark, [("a", "x", T1, "1")])).write.parquet(small)
    merged = SV.silver_upsert(read_table(spark, path, S.SILVER_STATE), spark.read.parquet(small), F.lit(T1), True)
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert "LeftOuter, BuildRight" in plan and "FullOuter" not in plan


def test_incremental_read_reaches_the_folders(spark):
    path = new_path(spark, "bronze")
    days = [(t, f"e{d}", "review", T0, "erp", "{}", T0 + timedelta(weeks=d), "f", "b") for t in ("t", "u", "new") for d in range(10)]
    append_bronze(spark.createDataFrame(days, S.BRONZE_EVENTS), path, "1")
    bronze = read_table(spark, path, S.BRONZE_STORED).drop("load_id")
    marks = spark.createDataFrame([("t", "events", T0 + timedelta(weeks=7)), ("u", "events", T0 + timedelta(weeks=8, hours=1)), ("t", "x", T0)], S.SILVER_WATERMARKS)
    fresh = SV.bronze_since(bronze, marks)
    got = sorted((r.tenant_id, r.event_id) for r in fresh.collect())
    assert got == sorted([("t", "e8"), ("t", "e9"), ("u", "e9"), *(("new", f"e{d}") for d in range(10))])
    filters = fresh._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1].split("PushedFilters")[0]
    assert "ingest_week" in filters and "tenant_id" in filters
    assert fresh.inputFiles() and SV.bronze_since(bronze, marks.limit(0)).count() == 30


def test_watermark_is_what_was_read(spark):
    marks = spark.createDataFrame([("t", "events", T0), ("t", "other", T1)], S.SILVER_WATERMARKS)
    src = source(spark, [("a", "x", T0, "1"), ("b", "x", T0 + timedelta(seconds=1), "1")])
    fresh = SV.bronze_since(src, marks)
    assert [r.event_id for r in fresh.collect()] == ["b"]
    after = SV.watermark_upsert(marks, SV.watermarks_of(fresh))
    assert {(r.table_name, r.last_updated_at) for r in after.collect()} == {
        ("events", T0 + timedelta(seconds=1)), ("other", T1)}


def test_tenant_without_mark_is_read_from_the_start(spark):
    marks = spark.createDataFrame([("other", "events", T1)], S.SILVER_WATERMARKS)
    assert SV.bronze_since(source(spark, [("a", "x", T0, "1")]), marks).count() == 1


def test_registry_insert_and_update(spark):
    known = spark.createDataFrame(
        [("a", "A", "dev", "PENDING", T0, None, None, None)], S.TENANT_REGISTRY)
    tenants = spark.createDataFrame([("a",), ("b",)], "tenant_id string")
    both = register(known, tenants, F.lit(T1), F.lit("prod"))
    rows = {r.tenant_id: (r.display_name, r.env, r.created_at) for r in both.collect()}
    assert rows == {"a": ("A", "dev", T0), "b": ("b", "prod", T1)}
    ready = spark.createDataFrame([("b", T1), ("zz", T1)], "tenant_id string, activated_at timestamp")
    states = {r.tenant_id: r.state for r in activate(both, ready).collect()}
    assert states == {"a": "PENDING", "b": "ACTIVE"}


def test_update_where_ignores_null_condition(spark):
    df = spark.createDataFrame([(1, None), (2, True), (3, False)], "id int, hit boolean")
    got = update_where(df, F.col("hit"), {"id": F.lit(0)})
    assert sorted(r.id for r in got.collect()) == [0, 1, 3]


def test_generic_upsert_without_insert_drops_strangers(spark):
    a = spark.createDataFrame([(1, "x")], "k int, v string")
    b = spark.createDataFrame([(1, "y"), (2, "z")], "k int, v string")
    assert upsert(a, b, ["k"], update={"v": F.col("s.v")}).collect() == [(1, "y")]
    assert [r.k for r in insert_absent(a, b, ["k"]).collect()] == [2]


def test_a_merge_meets_the_stored_rows_in_one_shuffle(spark):
    path = new_path(spark, "silver")
    rows = random_versions(9) + [(None, "pending", T0, "b0"), (None, None, T1, "b1")]
    for i in range(3):
        SV.merge_into(spark, path, source(spark, rows[i::3]), F.lit(T1))
    got = {r.event_id: (r.status, r._batch_id, r._first_at) for r in read_table(spark, path, S.SILVER_STATE).collect() if r.event_id}
    assert got == plain_silver(random_versions(9))
    batch = source(spark, rows[:40]).select(*SV.KEYS, *SV._VERSION)
    stored = read_table(spark, path, S.SILVER_STATE)
    met, joined = (SV._met(stored, batch, F.lit(T0)), SV.silver_upsert(stored, source(spark, rows[:40]), F.lit(T0)))
    assert sorted(map(str, met.collect())) == sorted(map(str, joined.collect()))
    assert SV._met(stored, batch, F.lit(T0))._jdf.queryExecution().executedPlan().toString().count("Exchange hash") == 1
