"""Heuristic document filter: a threshold table compiled into one Spark projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalake.llm.statistics import (
    BLANKS, SYMBOLS, count_of, lines_of, repeats, stop_words, with_repeat_words, words_of)

# rule: (numerator, denominator, least, most); None: no bound. A zero denominator passes.
RULES: dict[str, tuple[str, str, float | None, float | None]] = {
    "mean_word_length": ("word_chars", "n_words", 3.0, 10.0),
    "symbols_per_word": ("n_symbols", "n_words", None, 0.1),
    "stop_words_per_word": ("n_stop_words", "n_words", 0.05, None),
    "duplicate_lines": ("n_dup_lines", "n_lines", None, 0.3),
}
LEAST_WORDS, MOST_REPEAT_PERCENT = 50, 50
STATISTICS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_stop_words", "n_repeat_words"]


def compiled(rules: dict[str, tuple[str, str, float | None, float | None]]) -> Column:
    """The names of the rules a row breaks."""
    def broken(name: str) -> Column:
        part, whole, least, most = rules[name]
        ratio = F.col(part) / F.when(F.col(whole) > 0, F.col(whole))
        bad = F.lit(False)
        if least is not None:
            bad = bad | (ratio < least)
        if most is not None:
            bad = bad | (ratio > most)
        return F.when(F.coalesce(bad, F.lit(False)), F.lit(name))

    return F.filter(F.array(*(broken(name) for name in rules)), lambda n: n.isNotNull())


def judged(docs: DataFrame, rules: dict | None = None, text: str = "text") -> DataFrame:
    """``docs`` with its statistics, ``base_failed``, ``broken_rules`` and ``kept``.

    One scan, no exchange and no user functions. A null text is empty; empty texts fail the
    length rule. Rows are judged one by one, so repeated rows and other columns pass
    through; a given column with the name of an added one, in any case, is replaced.
    """
    added = [*STATISTICS, "base_failed", "broken_rules", "kept"]
    given = [c for c in docs.columns if c.lower() not in added]
    whole = F.coalesce(F.col(text), F.lit(""))
    df = docs.select(F.struct(*given).alias("_row"), whole.alias("_text"), words_of(whole).alias("_words"), lines_of(whole).alias("_lines"))
    df = df.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.translate(F.col("_text"), BLANKS, "")).cast("long"),
        "n_symbols": count_of(F.col("_text"), SYMBOLS),
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": repeats(F.col("_lines")),
        "n_stop_words": stop_words(F.col("_words"))})
    df = with_repeat_words(df, "_words", "n_repeat_words")
    base = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEAT_PERCENT * F.col("n_words"))
    return df.withColumns({"base_failed": base, "broken_rules": compiled(rules or RULES)}) \
        .withColumn("kept", ~F.col("base_failed") & (F.size("broken_rules") == 0)).select("_row.*", *added)
