"""From raw documents to packed sequences: five stages, each over all its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalake.llm.decontaminate import decontaminated
from stratalake.llm.exchange import LAST_ID, stored
from stratalake.llm.ngram_join import jaccard_links
from stratalake.llm.packing import pack
from stratalake.llm.queries import table, tokenizer_path
from stratalake.llm.rule_ensemble import accepted
from stratalake.llm.suffix_dedup import remove_repeats


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the rule ensemble accepts."""
    return accepted(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The least document of each group of linked documents; of rows equal in id and text one.

    Documents without words are linked with nothing and stay.
    """
    members, roots = jaccard_links(docs)
    least = members.filter("node IS NOT NULL").select("node").distinct().join(roots, "node", "left_anti") \
        .select(F.col("node.d").alias("_d"), F.col("node.t").alias("_t"))
    rows = docs.select(
        F.struct(*docs.columns).alias("_row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("_d"), F.xxhash64("text").alias("_t"))
    words = F.coalesce(F.col("_row.text"), F.lit("")).rlike("[^\\x20\\x09-\\x0D]")
    kept = rows.filter(words).join(least, ["_d", "_t"], "left_semi").dropDuplicates(["_d", "_t"])
    return kept.unionByName(rows.filter(~words)).select("_row.*")


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the byte strings that earlier documents hold; cut characters go too."""
    return remove_repeats(docs, carry=True).select("_row.*", "text").select(
        *(F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns))


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents left, in full sequences."""
    return pack(docs, tokenizer_path())


STAGES = [
    ("quality classifier", quality), ("n-gram Jaccard join", near_duplicates), ("suffix-array dedup", repeats),
    ("benchmark decontamination", benchmark_free), ("packing", packed),
]
#: A learned model and a tokenizer are beyond SQL; tests/llm/test_corpus_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage keeps is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
