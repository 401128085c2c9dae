"""Bronze to Silver: typed projection, incremental read, upsert and watermarks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalake import schemas as S
from stratalake.functions.scalars import payload_struct
from stratalake.operators.upsert import upsert
from stratalake.session import new_path
from stratalake.sources.publish import read_table, replace_partitions

KEYS = ("tenant_id", "event_id")
EPOCH = "2000-01-01 00:00:00"


def silver_projection(
    bronze: DataFrame,
    reference_paths: Sequence[str] = ("reference_id", "workflow_id"),
    extra: Sequence[str] = (),
) -> DataFrame:
    """Typed columns of the payload. One parse of the document serves every field.

    A time that cannot be read becomes NULL, which the contracts report; one tenant's
    bad row must not stop the job of all tenants.
    """
    fields = list(dict.fromkeys(["status", *reference_paths, *extra]))
    doc = bronze.withColumn("_doc", payload_struct("payload", fields))
    reference = F.coalesce(*[F.col(f"_doc.{p}") for p in reference_paths])
    return doc.select(
        "tenant_id", "event_id", "event_type",
        F.col("event_timestamp").try_cast("timestamp").alias("event_timestamp"),
        "source_system",
        F.col("_doc.status").alias("status"),
        reference.alias("reference_id"),
        *[F.col(f"_doc.{f}").alias(f) for f in extra],
        "_ingested_at", "_batch_id",
    )


def _arrived_since(marks: DataFrame) -> Column:
    """A bound on tenant and week of arrival that prunes the folders of stored Bronze.

    Marks are one row per tenant and table, and reach the driver as the few weeks they fall
    in with the tenants of each; tenants without a mark are read from the start.
    """
    weeks: dict[object, list[str]] = {}
    for tenant, week in marks.select("tenant_id", F.to_date(F.date_trunc("week", "_mark"))).collect():
        if week is not None:
            weeks.setdefault(week, []).append(tenant)
    bound = ~F.col("tenant_id").isin([t for tenants in weeks.values() for t in tenants]) if weeks else F.lit(True)
    for week, tenants in sorted(weeks.items()):
        bound = bound | (F.col("tenant_id").isin(tenants) & (F.col("ingest_week") >= F.lit(week)))
    return bound


def bronze_since(bronze: DataFrame, watermarks: DataFrame, table: str = "events") -> DataFrame:
    """Rows that arrived after each tenant's own watermark, for all tenants at once.

    Bronze stored by week of arrival (``ingest_week``) is read from those weeks on only.
    """
    marks = (
        watermarks.filter(F.col("table_name") == table)
        .groupBy("tenant_id").agg(F.max("last_updated_at").alias("_mark"))
    )
    if "ingest_week" in bronze.columns:
        bronze = bronze.filter(_arrived_since(marks)).drop("ingest_week")
    mark = F.coalesce("_mark", F.lit(EPOCH).cast("timestamp"))
    return bronze.join(marks, "tenant_id", "left").filter(F.col("_ingested_at") > mark).drop("_mark")


BUCKETS = 8
_FIRST = ("_first_at", "_batch_id", "_first_status", "event_type", "event_timestamp", "source_system", "reference_id")
_LATEST = ("_status_at", "_status_batch", "_latest_status")


def event_state(versions: DataFrame) -> DataFrame:
    """What a set of versions says of each event: ``first``, the earliest version, and
    ``latest``, the newest one with a status, by arrival, then batch id.

    Both are least or greatest rows, so states of parts merge into the state of the whole
    whatever the parts and their order, and merging a part twice changes nothing. Each map
    task sends one row per event.
    """
    first = F.struct(F.col("_ingested_at").alias("_first_at"), F.col("_batch_id"), F.col("status").alias("_first_status"), *_FIRST[3:])
    latest = F.struct(F.col("_ingested_at").alias("_status_at"), F.col("_batch_id").alias("_status_batch"), F.col("status").alias("_latest_status"))
    return versions.groupBy(*KEYS).agg(
        F.min(first).alias("first"), F.max(F.when(F.col("status").isNotNull(), latest)).alias("latest"))


def _in_layout(rows: DataFrame) -> DataFrame:
    """Stored Silver columns of rows with ``first``, ``latest`` and the two stamps.

    The row is what its first version inserted; a later status replaces its status. A first
    version without one is never updated: a NULL on either side compares as unknown.
    """
    status = F.when(F.col("first._first_status").isNotNull(), F.col("latest._latest_status"))
    bucket = F.pmod(F.xxhash64("event_id"), F.lit(BUCKETS)).cast("int")
    made = {"status": status, "bucket": bucket, **{c: F.col(f"first.{c}") for c in _FIRST}, **{c: F.col(f"latest.{c}") for c in _LATEST}}
    return rows.select(*[made.get(c, F.col(c)).alias(c) for c in S.SILVER_STATE.fieldNames()])


def silver_upsert(target: DataFrame, source: DataFrame, run_ts: Column, stored_state: bool = False) -> DataFrame:
    """Silver after a batch, in its stored layout: a changed status is updated, an unknown
    event inserted.

    The result is that of merging every version on its own in order of arrival, however the
    versions are split into batches and in whatever order those come; only the stamps say
    which run changed a row. ``source`` holds versions, or with ``stored_state`` their
    written ``event_state``. Then the target is joined as it lies if Spark finds the files
    of the state small enough to broadcast.
    """
    s = (source if stored_state else event_state(source)).alias("s")
    on = [F.col(f"t.{k}") == F.col(f"s.{k}") for k in KEYS]

    def merged(rows: DataFrame, known: Column) -> DataFrame:
        first = F.least(F.when(known, F.struct(*[F.col(f"t.{c}") for c in _FIRST])), F.col("s.first"))
        latest = F.greatest(F.when(F.col("t._latest_status").isNotNull(), F.struct(*[F.col(f"t.{c}") for c in _LATEST])), F.col("s.latest"))
        status = F.when(first["_first_status"].isNotNull(), latest["_latest_status"])
        kept = known & status.eqNullSafe(F.col("t.status"))
        return _in_layout(rows.select(
            *[F.coalesce(f"t.{k}", f"s.{k}").alias(k) for k in KEYS], first.alias("first"), latest.alias("latest"),
            F.when(known, F.col("t.created_at")).otherwise(run_ts).alias("created_at"),
            F.when(kept, F.col("t.last_updated_at")).otherwise(run_ts).alias("last_updated_at")))

    t = target.withColumn("_in_t", F.lit(True)).alias("t")
    if not stored_state:
        return merged(t.join(s, on, "full_outer"), F.coalesce("t._in_t", F.lit(False)))
    met = target.select(*KEYS).join(source.select(*KEYS), list(KEYS), "left_semi")
    fresh = source.join(met, list(KEYS), "left_anti").select("*", run_ts.alias("created_at"), run_ts.alias("last_updated_at"))
    return merged(t.join(s, on, "left"), F.lit(True)).unionByName(_in_layout(fresh))


def silver_from_scratch(source: DataFrame, run_ts: Column) -> DataFrame:
    """Silver after a first load: what an upsert into an empty table gives."""
    return _in_layout(event_state(source).select("*", run_ts.alias("created_at"), run_ts.alias("last_updated_at")))


def published(silver: DataFrame) -> DataFrame:
    """The columns of Silver that readers see."""
    return silver.select(*S.SILVER_EVENTS.fieldNames())


def touched_buckets(silver: DataFrame, state: DataFrame) -> DataFrame:
    """Stored Silver rows of the tenants and buckets a batch's state falls into.

    The pairs become a filter on the table's folders, so that no other file is listed or
    read. There are at most as many pairs as the table has folders.
    """
    buckets: dict[int, list[str]] = {}
    pairs = state.select("tenant_id", F.pmod(F.xxhash64("event_id"), F.lit(BUCKETS)).cast("int").alias("bucket")).distinct()
    for tenant, bucket in pairs.collect():
        buckets.setdefault(bucket, []).append(tenant)
    touched = F.lit(False)
    for bucket, tenants in sorted(buckets.items()):
        touched = touched | ((F.col("bucket") == bucket) & F.col("tenant_id").isin(tenants))
    return silver.filter(touched)


def merge_into(spark: SparkSession, path: str, versions: DataFrame, run_ts: Column) -> None:
    """Merge a batch into stored Silver: only the folders it touches are read and replaced.

    The batch is read once and written as it is; then it meets the stored rows in one shuffle,
    which deals both by folder and by slices of a folder, so the result is written from where
    it lies. A batch merged again leaves the table as it is.
    """
    where = new_path(spark, "batch")
    batch = versions.select(*KEYS, *_VERSION)
    batch.write.parquet(where)
    batch = spark.read.schema(batch.schema).parquet(where)
    target = touched_buckets(read_table(spark, path, S.SILVER_STATE), batch)
    replace_partitions(_met(target, batch, run_ts), path, S.SILVER_PARTITIONS, dealt=True)


_VERSION = ("_ingested_at", "_batch_id", "status", "event_type", "event_timestamp", "source_system", "reference_id")
_OLD = ("status", "created_at", "last_updated_at")


def _met(target: DataFrame, batch: DataFrame, run_ts: Column) -> DataFrame:
    """What ``silver_upsert`` gives, in its stored layout, from one shuffle of both sides.

    A folder has as many slices as fill all tasks if it holds all rows. A row without a full
    key meets no stored row, as in a join.
    """
    slices = max(1, int(target.sparkSession.conf.get("spark.sql.shuffle.partitions")) // BUCKETS)
    hashed = F.xxhash64("event_id")
    whole = F.col("tenant_id").isNotNull() & F.col("event_id").isNotNull()
    no_latest = [F.lit(None).cast(S.SILVER_STATE[c].dataType).alias(c) for c in _LATEST]
    no_old = [F.lit(None).cast(S.SILVER_STATE[c].dataType).alias(f"_old_{c}") for c in _OLD]
    stored = target.select(
        *KEYS, *_FIRST, *_LATEST, *[F.col(c).alias(f"_old_{c}") for c in _OLD], F.lit(True).alias("_known"),
        F.when(whole, 0).otherwise(F.monotonically_increasing_id() + 1).alias("_apart"))
    new = batch.select(
        *KEYS, *[F.col(v).alias(c) for v, c in zip(_VERSION, _FIRST, strict=True)], *no_latest, *no_old, F.lit(False).alias("_known"),
        F.lit(0).cast("long").alias("_apart"))
    bucket, part = F.pmod(hashed, F.lit(BUCKETS)).cast("int"), F.pmod(F.shiftrightunsigned(hashed, 32), F.lit(slices))
    rows = stored.unionByName(new).withColumns({"bucket": bucket, "_slice": part}).repartition("tenant_id", "bucket", "_slice")
    # A new version is its own newest one; this is not sent but made where it arrives.
    own = F.struct(*[F.col(v).alias(c) for v, c in zip(_FIRST[:3], _LATEST, strict=True)])
    latest = F.when(F.col("_known"), F.when(F.col("_latest_status").isNotNull(), F.struct(*_LATEST))).otherwise(
        F.when(F.col("_first_status").isNotNull(), own))
    state = rows.groupBy("tenant_id", "bucket", "_slice", "event_id", "_apart").agg(
        F.min(F.struct(*_FIRST)).alias("first"), F.max(latest).alias("latest"),
        F.max(F.when(F.col("_known"), F.struct(*[F.col(f"_old_{c}").alias(c) for c in _OLD]))).alias("old"))
    known = F.col("old").isNotNull()
    status = F.when(F.col("first._first_status").isNotNull(), F.col("latest._latest_status"))
    return _in_layout(state.select(
        *KEYS, "first", "latest", F.when(known, F.col("old.created_at")).otherwise(run_ts).alias("created_at"),
        F.when(known & status.eqNullSafe(F.col("old.status")), F.col("old.last_updated_at")).otherwise(run_ts).alias("last_updated_at")))


def watermarks_of(read: DataFrame, table: str = "events") -> DataFrame:
    """New marks: the newest arrival actually read, so rows landing meanwhile are kept."""
    return read.groupBy("tenant_id").agg(F.max("_ingested_at").alias("last_updated_at")).select(
        "tenant_id", F.lit(table).alias("table_name"), "last_updated_at"
    )


def watermark_upsert(watermarks: DataFrame, new: DataFrame) -> DataFrame:
    return upsert(
        watermarks, new, keys=("tenant_id", "table_name"),
        update={"last_updated_at": F.col("s.last_updated_at")}, insert={},
    )


def changes_between(before: DataFrame, after: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Change feed of two snapshots: one row per inserted, deleted or updated key."""
    b = before.select(*KEYS, F.struct(*columns).alias("before"))
    a = after.select(*KEYS, F.struct(*columns).alias("after"))
    kind = (
        F.when(F.col("before").isNull(), "insert")
        .when(F.col("after").isNull(), "delete")
        .when(~F.col("before").eqNullSafe(F.col("after")), "update")
    )
    return (
        b.join(a, list(KEYS), "full_outer")
        .withColumn("change", kind)
        .filter(F.col("change").isNotNull())
    )
