"""Platform tables derived from the driver's parquet files.

Events become Bronze rows (a first version and a later correction of each event),
customers become tenants, orders become change-log entries and changes, line items
become changed files. All of it is column arithmetic on whole tables.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalake import schemas as S
from stratalake.operators.silver import silver_projection
from stratalake.session import new_path
from stratalake.sources.publish import append, read_table

# Fixed clocks: reports look back from AS_OF; the first load runs at FIRST_RUN and
# the second at SECOND_RUN. Orders cover other years and have a clock of their own.
AS_OF = "2024-01-31"
FIRST_RUN = "2024-01-16 00:00:00"
SECOND_RUN = "2024-02-06 00:00:00"
ORDERS_AS_OF = "2001-08-02"

# The columns used of the given tables; declared, so no file is opened to infer them.
GIVEN = {
    "events": "event_id bigint, ts {time}, user_id bigint, event_type string, value double",
    "customer": "c_custkey bigint, c_name string, c_acctbal double, c_mktsegment string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate {time}, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int",
    "supplier": "s_suppkey bigint",
}
UTC_ZONES = ("UTC", "Etc/UTC", "GMT", "Z", "+00:00")

EVENT_TYPES = {
    "click": "submission", "view": "review", "error": "escalation",
    "purchase": "decision", "signup": "notification",
}
STATE_OF_PRIORITY = {
    "1-URGENT": "REGISTERED", "2-HIGH": "GRANTS_PROVISIONED", "3-MEDIUM": "PIPELINES_SCAFFOLDED",
    "4-NOT SPECIFIED": "DASHBOARDS_SCAFFOLDED", "5-LOW": "QUALITY_SCAFFOLDED",
}
CHANGE_TYPES = {
    "O": "QUALITY_SCAFFOLDED", "F": "PIPELINES_SCAFFOLDED", "P": "DASHBOARDS_SCAFFOLDED",
}
FILE_PATHS = [
    "dbt/models/gold_north/kpi.sql", "dbt/models/gold_south/kpi.sql", "agents/north/notes.md",
    "templates/dashboards/kpi_overview.json", "orchestrator/handlers/scaffold_dashboards.py",
    "orchestrator/handlers/activate_tenant.py", "templates/quality_contracts/north.yml",
    "dbt/models/silver/events.sql", "orchestrator/state_machine.py",
    "orchestrator/handlers/register_tenant.py", "promotion/categories.yml", "db/north.grants.sql",
    "README.md",
]
TEAMS = ["data_engineering", "analytics_engineering", "platform_engineering"]
REVIEWERS = ["engineer", "senior_engineer", "data_platform_lead", "senior_engineer_oncall"]


def _case(column: str, mapping: dict[str, str]) -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items())
    return f"CASE {column} {whens} END"


def _pick(index: str, values: list) -> str:
    items = ", ".join("NULL" if v is None else f"'{v}'" for v in values)
    return f"element_at(array({items}), CAST({index} AS INT) + 1)"


def _hours(time: str, hours: str) -> str:
    return f"{time} + make_dt_interval(0, CAST({hours} AS INT))"


REFERENCE = "concat('R', user_id, '-', event_id % 6)"
FIRST_STATUS = _pick("(event_id * 3 + user_id) % 7", S.EVENT_STATUSES)
FIXED_STATUS = _pick("(event_id * 5 + user_id) % 8", [*S.EVENT_STATUSES, None])
FIRST_DELAY, FIXED_DELAY = "event_id % 72", "event_id % 48 + 96"
TENANT = {"shared": "concat('tenant-', user_id % 5)", "fine": "concat('unit-', user_id % 50)"}


def _payload(status: str) -> str:
    # Notifications, which are sign-ups in the source, belong to no business object.
    return f"""to_json(named_struct(
        'workflow_id', concat('WF-', {REFERENCE}),
        'approval_tier', {_pick("event_id % 3", S.APPROVAL_TIERS)},
        'vendor_code', concat('VND-', event_id % 40),
        'amount_usd', value,
        'status', {status},
        'reference_id', CASE WHEN event_type <> 'signup' THEN {REFERENCE} END))"""


def _deviating_payload() -> str:
    tenant, day = "user_id % 5", "CAST(to_date(ts) AS STRING)"
    return f"""to_json(named_struct(
        'status', CASE WHEN {tenant} = 3 THEN CAST(event_id % 7 AS STRING) ELSE {FIRST_STATUS} END,
        'reference_id', CASE WHEN {tenant} <> 2 THEN {REFERENCE} END,
        'due_date', CASE WHEN {tenant} = 0 THEN {day} END,
        'priority', CASE {tenant} WHEN 2 THEN CAST(event_id % 10 AS STRING)
            WHEN 4 THEN concat('P', event_id % 10) END,
        'closed_at', CASE WHEN {tenant} = 3 THEN concat({day}, ' 10:30:00') END,
        'amount_usd', CASE WHEN {tenant} = 3 THEN value END))"""


class Tables:
    """Lazy frames over one data directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._stored: dict[str, DataFrame] = {}

    def raw(self, name: str) -> DataFrame:
        """One of the given tables, zone-free times read as UTC instants.

        In a UTC session the type is declared to the reader, so that look-back filters
        reach the file scan; in other sessions the times have to be converted.
        """
        path, columns = f"{self.sf_dir}/{name}.parquet", GIVEN[name]
        if self.spark.conf.get("spark.sql.session.timeZone") in UTC_ZONES:
            return self.spark.read.schema(columns.format(time="timestamp")).parquet(path)
        df = self.spark.read.schema(columns.format(time="timestamp_ntz")).parquet(path)
        return df.withColumns({
            c: F.col(c).cast("timestamp") for c, kind in df.dtypes if kind == "timestamp_ntz"})

    def stored(
        self, name: str, rows: Callable[[], DataFrame], partition_by: Sequence[str] = ()
    ) -> DataFrame:
        """The rows as a written table, made once per query.

        This cuts the lineage of what is read more than once, survives the loss of an
        executor, and lets Spark decide on broadcasts by the size of the files.
        """
        if name not in self._stored:
            path, df = new_path(self.spark, name), rows()
            append(df, path, partition_by)
            self._stored[name] = read_table(self.spark, path, df.schema)
        return self._stored[name]

    @cached_property
    def events(self) -> DataFrame:
        """Event rows on at least as many tasks as there are cores.

        Writing and parsing JSON is the costly part, and a file smaller than one split
        would put it on one core. Data of many splits is read as it is, unshuffled.
        """
        rows, cores = self.raw("events"), self.spark.sparkContext.defaultParallelism
        if rows.rdd.getNumPartitions() < cores:
            return rows.repartition(cores, "event_id")
        return rows

    def _bronze(self, payload: str, delay: str, batch: str, tenants: str) -> DataFrame:
        return self.events.selectExpr(
            f"{TENANT[tenants]} AS tenant_id",
            "concat('E', event_id) AS event_id",
            f"{_case('event_type', EVENT_TYPES)} AS event_type",
            "ts AS event_timestamp",
            f"{_pick('event_id % 4', S.SOURCE_SYSTEMS)} AS source_system",
            f"{payload} AS payload",
            f"{_hours('ts', delay)} AS _ingested_at",
            "concat('landing/', to_date(ts), '.json') AS _source_file",
            f"concat('{batch}', event_id div 1000) AS _batch_id",
        )

    def bronze_first(self, tenants: str = "shared") -> DataFrame:
        """One version of every event; ``tenants='fine'`` gives fifty tenants, not five."""
        return self._bronze(_payload(FIRST_STATUS), FIRST_DELAY, "batch-", tenants)

    def bronze_fixes(self, tenants: str = "shared") -> DataFrame:
        """A later version of every event; one in eight has lost its status."""
        return self._bronze(_payload(FIXED_STATUS), FIXED_DELAY, "fix-", tenants)

    def bronze(self, tenants: str = "shared") -> DataFrame:
        return self.bronze_first(tenants).unionByName(self.bronze_fixes(tenants))

    def bronze_deviating(self) -> DataFrame:
        """First versions whose payload differs from tenant to tenant.

        Only tenant-1 sends the standard fields. tenant-0 adds a date, tenant-2 lacks
        the reference and adds a number, tenant-3 sends status codes and a time,
        tenant-4 sends text under the name tenant-2 uses for its number.
        """
        return self._bronze(_deviating_payload(), FIRST_DELAY, "batch-", "shared")

    @cached_property
    def silver(self) -> DataFrame:
        """Typed first versions, reference taken from ``$.reference_id`` only."""
        return silver_projection(self.bronze_first(), reference_paths=("reference_id",))

    # --- tenants, change log, changes --------------------------------------------------
    def registry(self) -> DataFrame:
        """One tenant per customer; the account balance decides how far it got."""
        return self.raw("customer").selectExpr(
            "concat('cust-', c_custkey) AS tenant_id", "c_name AS display_name", "'dev' AS env",
            "CASE WHEN c_acctbal >= 2000 THEN 'ACTIVE' WHEN c_acctbal < 0 THEN 'FAILED' "
            "ELSE 'PENDING' END AS state",
            "TIMESTAMP '1995-01-01' AS created_at",
            "CASE WHEN c_acctbal >= 2000 THEN TIMESTAMP '1995-01-02' END AS activated_at",
            "CAST(NULL AS TIMESTAMP) AS deactivated_at",
            "CAST(NULL AS STRING) AS deactivation_reason",
        )

    def change_log(self) -> DataFrame:
        """One entry per order; the component is missing now and then."""
        return self.raw("orders").selectExpr(
            "concat('cust-', o_custkey) AS tenant_id", "o_orderdate AS change_timestamp",
            f"{_case('o_orderstatus', CHANGE_TYPES)} AS change_type",
            "CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN o_orderpriority END AS component",
            "concat('change ', o_orderkey) AS description",
            "CAST(NULL AS STRING) AS changed_by", "CAST(NULL AS STRING) AS pr_url", "'dev' AS env",
        )

    def state_log(self) -> DataFrame:
        """Lifecycle states a tenant went through, one per order."""
        return self.raw("orders").selectExpr(
            "concat('cust-', o_custkey) AS tenant_id",
            "CASE WHEN o_orderstatus = 'F' AND o_totalprice < 50000 THEN 'FAILED' "
            f"ELSE {_case('o_orderpriority', STATE_OF_PRIORITY)} END AS state",
            "o_orderdate AS changed_at", "o_orderkey AS seq",
        )

    def changes(self) -> DataFrame:
        """One proposed change per order, with a title tag on urgent ones."""
        return self.raw("orders").selectExpr(
            "o_orderkey AS change_id",
            "CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus = 'F' THEN '[hotfix] fix' "
            "ELSE 'regular change' END AS title",
            "'' AS body", "o_orderdate AS opened_at",
            f"{_hours('o_orderdate', 'o_custkey % 60')} AS staged_at",
            f"{_hours('o_orderdate', 'o_orderkey % 300')} AS checked_at",
            f"CASE WHEN o_custkey % 3 <> 0 THEN {_hours('o_orderdate', 'o_custkey % 60 + o_orderkey % 50')} END AS canary_at",
            f"CASE WHEN o_orderkey % 4 <> 0 THEN {_hours('o_orderdate', 'o_orderkey % 200')} END AS reviewed_at",
        )

    def changed_files(self) -> DataFrame:
        """Files of each change, one per line item."""
        index = f"(l_partkey + l_linenumber) % {len(FILE_PATHS)}"
        return self.raw("lineitem").selectExpr(
            "l_orderkey AS change_id", f"{_pick(index, FILE_PATHS)} AS path")

    def approvals(self) -> DataFrame:
        """Review approvals of each change, one per line item."""
        return self.raw("lineitem").selectExpr(
            "l_orderkey AS change_id", f"{_pick('l_suppkey % 4', REVIEWERS)} AS role",
            "concat('person-', l_suppkey) AS approver", f"{_pick('(l_suppkey + l_linenumber) % 3', TEAMS)} AS team")
