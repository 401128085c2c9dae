"""Statistics of whole texts as Spark column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = " \t\n\x0b\f\r"
GAP = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"

# Common function words of the languages served.
STOP_WORDS = {
    "en": ["the", "of", "and", "to", "in", "that", "is", "was", "for", "it", "with", "as", "on", "be", "have", "at", "by", "this", "are", "from", "or", "an", "not"],
    "de": ["der", "die", "und", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "ist", "im", "dem", "nicht", "ein", "eine", "für", "er", "es"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "par", "au", "il", "sur", "ne", "pas"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "no", "una", "su", "para", "es", "al", "lo"],
}


def count_of(text: Column, characters: str) -> Column:
    """Number of the given characters in a text."""
    return (F.length(text) - F.length(F.translate(text, characters, ""))).cast("long")


def trimmed(text: Column) -> Column:
    return F.trim(text, F.lit(BLANKS))


def words_of(text: Column) -> Column:
    """Runs of characters other than space and 0x09-0x0D."""
    bare = trimmed(text)
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, GAP))


def lines_of(text: Column) -> Column:
    """The lines that have a word."""
    return F.filter(F.split(text, "\n"), lambda line: trimmed(line) != "")


def repeats(items: Column) -> Column:
    """How many items equal an earlier one."""
    return (F.size(items) - F.size(F.array_distinct(items))).cast("long")


def stop_words(words: Column) -> Column:
    held = sorted({w for group in STOP_WORDS.values() for w in group})
    return F.size(F.filter(words, lambda w: w.isin(held))).cast("long")


def with_repeat_words(df: DataFrame, words: str, out: str) -> DataFrame:
    """Adds the number of words in three-word windows that stand twice or more in the text.

    Windows are sorted with their places, so that equal ones are neighbours; texts whose
    windows all differ skip the sort.
    """
    w = F.col(words)
    df = df.withColumn("_w3", F.when(F.size(w) > 2, F.transform(
        F.slice(w, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0))),
        lambda x, i: F.concat_ws(" ", x, F.get(w, i + 1), F.get(w, i + 2)))))
    df = df.withColumn("_s3", F.when(F.size("_w3") > F.size(F.array_distinct("_w3")), F.sort_array(
        F.transform("_w3", lambda x, i: F.struct(x.alias("t"), i.alias("i"))))))
    s = F.col("_s3")
    df = df.withColumn("_p3", F.filter(
        F.transform(s, lambda x, k: F.when(
            F.coalesce(F.get(s, k - 1)["t"] == x["t"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["t"] == x["t"], F.lit(False)), x["i"])),
        lambda p: p.isNotNull()))
    covered = F.array_distinct(F.flatten(F.transform("_p3", lambda p: F.array(p, p + 1, p + 2))))
    return df.withColumn(out, F.coalesce(F.size(covered), F.lit(0)).cast("long")).withColumn(
        out, F.when(F.col(out) < 0, 0).otherwise(F.col(out))).drop("_w3", "_s3", "_p3")
