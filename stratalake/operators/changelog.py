"""Recent changes per tenant, their plain-language summary and its leak check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalake import schemas as S
from stratalake.functions.scalars import change_line, on_or_after
from stratalake.functions.skew import heavy_cuts

MAX_CHANGES = 200
MODEL = "rules"
# Fixed sentences of a summary.
CLOSING = "Please contact your platform team if you have any questions."
# Words a business reader must never see.
TECHNICAL_WORDS = [
    "select", "merge", "insert", "json", "sql", "schema", "bronze", "silver", "vault", "gold",
]


def latest_changes(log: DataFrame, k: int = MAX_CHANGES) -> DataFrame:
    """Newest k entries of each tenant, cut to k per tenant before the shuffle."""
    newest_first = Window.partitionBy("tenant_id").orderBy(
        F.desc("change_timestamp"), F.col("description"))
    return log.withColumn("rank", F.row_number().over(newest_first)).filter(F.col("rank") <= k)


def recent_changes(
    log: DataFrame, registry: DataFrame, as_of, days: int, k: int = MAX_CHANGES
) -> DataFrame:
    """Newest changes of active tenants in the window; quiet tenants have no rows.

    The cut to k rows comes before the join with the registry, so that a busy tenant
    reaches the join with k rows only; the join keeps or drops whole tenants.
    """
    active = registry.filter(F.col("state") == "ACTIVE").select("tenant_id")
    newest = latest_changes(log.filter(on_or_after("change_timestamp", as_of, days)), k)
    return newest.join(active, "tenant_id", "left_semi")


def change_texts(recent: DataFrame) -> DataFrame:
    """All lines of a tenant as one text, newest first (at most k lines each)."""
    line = F.struct("rank", change_line("change_timestamp", "component", "description")
                    .alias("line"))
    lines = F.sort_array(F.collect_list(line))
    return recent.groupBy("tenant_id").agg(
        F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("changes"))


def summary_facts(recent: DataFrame) -> DataFrame:
    """What the summary may say: how many changes and of which kinds."""
    kind = F.col("change_type")
    return recent.groupBy("tenant_id").agg(
        F.count(F.lit(1)).alias("changes"),
        F.sort_array(F.collect_set("change_type")).alias("kinds"),
        F.count_if(kind == "DASHBOARDS_SCAFFOLDED").alias("dashboards"),
        F.count_if(kind == "QUALITY_SCAFFOLDED").alias("quality_rules"),
        F.count_if(kind == "PIPELINES_SCAFFOLDED").alias("pipelines"),
    )


def _counted(n: Column, one: str, many: str) -> Column:
    return F.when(n == 1, one).when(n > 1, F.format_string(many, n))


def summaries(facts: DataFrame, days: int) -> DataFrame:
    n = F.col("changes")
    opening = F.when(
        n == 1, f"In the past {days} days, 1 change was made to your data platform."
    ).otherwise(F.format_string(
        f"In the past {days} days, %d changes were made to your data platform.", n))
    text = F.concat_ws(
        " ", opening,
        _counted(F.col("dashboards"), "1 dashboard update was made.",
                 "%d dashboard updates were made."),
        _counted(F.col("quality_rules"), "1 quality monitoring update was made.",
                 "%d quality monitoring updates were made."),
        _counted(F.col("pipelines"), "1 processing update was made.",
                 "%d processing updates were made."),
        F.lit(CLOSING),
    )
    return facts.select("tenant_id", text.alias("summary"))


def summary_rows(texts: DataFrame, days: int, at: Column) -> DataFrame:
    return texts.select(
        "tenant_id", "summary", F.lit(days).alias("lookback_days"), at.alias("generated_at"),
        F.lit(MODEL).alias("model"),
    ).select(*S.CHANGELOG_SUMMARIES.fieldNames())


def leaks(texts: DataFrame, tenants: DataFrame) -> DataFrame:
    """Words of a text that name a tenant or an internal concept.

    Texts are cut into words and matched by equality, so the work grows with the
    words and not with texts times tenants. Words that are too frequent for one task, as a
    sample finds them, meet the few tenants of such a name where they lie.
    """
    words = texts.select(
        "tenant_id",
        F.explode(F.array_distinct(F.split(F.lower("summary"), r"[^a-z0-9_.\-]+"))).alias("word"),
    ).withColumn("word", F.regexp_replace("word", r"^[.\-]+|[.\-]+$", "")).filter(F.col("word") != "")
    frequent = F.xxhash64("word").isin(list(heavy_cuts(words, ["word"], [])))
    words = words.distinct()
    names = tenants.select(F.lower("tenant_id").alias("word")).distinct()
    named = words.filter(~frequent).join(names.filter(~frequent), "word", "left_semi").unionByName(
        words.filter(frequent).join(F.broadcast(names.filter(frequent)), "word", "left_semi")
    ).withColumn("kind", F.lit("tenant"))
    technical = words.filter(
        F.col("word").isin(TECHNICAL_WORDS) | F.col("word").rlike(r"^\w+_\w+$|^\w+\.\w+")
    ).withColumn("kind", F.lit("technical"))
    return named.unionByName(technical)
