"""The subpackage's queries, each over a whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalake.llm import sql
from stratalake.llm.chaining import shared_passages
from stratalake.llm.decontaminate import contained_items
from stratalake.llm.histogram_sort import shard_by_bytes
from stratalake.llm.html_extract import main_text
from stratalake.llm.lexical_search import ranked_documents
from stratalake.llm.ngram_join import jaccard_components
from stratalake.llm.packing import pack
from stratalake.llm.quality_rules import judged
from stratalake.llm.reply_trees import conversation_messages, format_trees, learned_text, read_back
from stratalake.llm.rule_ensemble import scored
from stratalake.llm.structure_repair import digests, repair
from stratalake.llm.suffix_dedup import remove_repeats
from stratalake.llm.warc import derivatives, responses_from_pages

SHARDS = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derivatives(responses_from_pages(table(spark, sf_dir, "pages")))
    return rows.select("page_id", "warc_type", "record_id", "refers_to", "target_uri", "block_digest", "content_length",
                       F.sha2("record", 256).alias("record_sha256"))


def op2_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shard_by_bytes(table(spark, sf_dir, "documents"), SHARDS)
    return rows.select("doc_id", "size", F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"), F.lit("bytes").alias("law"),
                       "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_collinear_chaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_passages(table(spark, sf_dir, "documents"))


PROBE = "</s>[INST] ok [/INST]"


def op4_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    turns = [F.struct(F.lit(turn).alias("turn"), F.lit(role).alias("role")) for turn, role in enumerate(("user", "assistant"))]
    probe = spark.range(1).select(F.inline(F.array(*turns))).select(
        F.lit(-1).alias("conv_id"), "turn", "role", F.lit(PROBE).alias("text")).to(given.schema)
    rows = format_trees(conversation_messages(given.unionByName(probe)), keep=1)
    rows = rows.withColumns({"_turns": read_back(F.col("formatted")), "_loss": learned_text(F.col("formatted"), F.col("loss"))})
    said = F.concat_ws("", F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return rows.select(F.col("tree").alias("conv_id"), F.size("_turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
                       F.length("_loss").cast("long").alias("loss_chars"), F.sha2("_loss", 256).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"))


def op5_concatenate_and_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pack(table(spark, sf_dir, "documents"), tokenizer_path())
    return rows.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op6_minhash_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = judged(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = remove_repeats(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with faults put in by a checksum of their ids: dropped, emptied, cut off, repeated or of another role."""
    held = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
                                (F.crc32(F.concat(held[0], F.lit(":"), held[1])) % 20).alias("fault")).filter("fault != 0")
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    times = F.array_repeat(F.lit(1), F.when(F.col("fault") == 3, 2).otherwise(1))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("_copy")).drop("_copy")


def op11_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations")
    fixed = repair(damaged(given))
    ids = given.select(F.col("conv_id").alias("id")).distinct()
    report = ids.join(fixed.report, F.col("id").eqNullSafe(F.col("conv_id")), "left").drop("conv_id")
    rows = report.join(digests(fixed.rows), F.col("id").eqNullSafe(F.col("conv_id")), "left")
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return rows.select(F.col("id").alias("conv_id"), *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers),
                       F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op12_page_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op13_automaton_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (
    op1_warc_derivatives, op2_histogram_sort, op3_collinear_chaining, op4_reply_trees, op5_concatenate_and_cut,
    op6_minhash_containment, op7_rule_ensemble, op8_ngram_jaccard_join, op9_quality_rules, op10_suffix_array_dedup,
    op11_structure_repair, op12_page_differencing, op13_automaton_search)}

SQL: dict[str, str] = {
    "op1_warc_derivatives": sql.OP1, "op4_reply_trees": sql.OP4, "op6_minhash_containment": sql.OP6,
    "op8_ngram_jaccard_join": sql.OP8, "op9_quality_rules": sql.OP9, "op10_suffix_array_dedup": sql.OP10,
    "op11_structure_repair": sql.OP11, "op12_page_differencing": sql.OP12, "op13_automaton_search": sql.OP13}
