"""Quality classifier as a sparse rule ensemble.

Shallow trees are grown on text statistics; every path from a root is a conjunctive rule.
A logistic regression with an L1 penalty weighs the rules and drops most of them. What is
left is compiled into one Spark column expression, so scoring needs no model at hand.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalake.llm.exchange import stored
from stratalake.llm.statistics import SYMBOLS, count_of, lines_of, repeats, stop_words, words_of

FEATURES = ["n_words", "mean_word_length", "symbols_per_word", "digit_share", "upper_share", "mark_share", "bang_share",
            "distinct_words", "duplicate_lines", "stop_word_share"]
TREES, DEPTH, SEED = 24, 3, 17
ITERATIONS = 60
PENALTY = 0.002
HELD_OUT_FOLDS = 5


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the classifier's inputs, computed from the whole text alone; a null text is empty.

    A given column with the name of an added one, in any case, is replaced.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    given = [c for c in docs.columns if c.lower() not in FEATURES]
    df = docs.select(F.struct(*given).alias("_row"), whole.alias("_text"), words_of(whole).alias("_words"), lines_of(whole).alias("_lines"))
    df = df.withColumns({"_n": F.size("_words"), "_chars": F.length("_text"), "_n_lines": F.size("_lines")})

    def share(part: Column, of: str) -> Column:
        return F.when(F.col(of) > 0, part / F.col(of)).otherwise(0.0)

    blanks = count_of(F.col("_text"), " \t\n\x0b\f\r")
    return df.withColumns({
        "n_words": F.col("_n").cast("double"),
        "mean_word_length": share(F.col("_chars") - blanks, "_n"),
        "symbols_per_word": share(count_of(F.col("_text"), SYMBOLS), "_n"),
        "digit_share": share(count_of(F.col("_text"), "0123456789"), "_chars"),
        "upper_share": share(count_of(F.col("_text"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), "_chars"),
        "mark_share": share(count_of(F.col("_text"), ".,;:"), "_n"),
        "bang_share": share(count_of(F.col("_text"), "!?"), "_n"),
        "distinct_words": share(F.size(F.array_distinct("_words")), "_n"),
        "duplicate_lines": share(repeats(F.col("_lines")), "_n_lines"),
        "stop_word_share": share(stop_words(F.col("_words")), "_n"),
    }).select("_row.*", *FEATURES)


Condition = tuple[str, bool, float]  # feature, at most (else above), bound


@dataclass(frozen=True)
class RuleEnsemble:
    rules: tuple[tuple[tuple[Condition, ...], float], ...]
    intercept: float

    def score(self) -> Column:
        """Probability of label 1 from the columns of ``with_statistics``."""
        total = reduce(lambda a, b: a + b, (F.when(holds(r), w).otherwise(0.0) for r, w in self.rules), F.lit(self.intercept))
        return 1 / (1 + F.exp(-total))


def holds(rule: tuple[Condition, ...]) -> Column:
    return reduce(lambda a, b: a & b, (F.col(f) <= bound if at_most else F.col(f) > bound for f, at_most, bound in rule))


def tree_rules(root, features: list[str]) -> set[tuple[Condition, ...]]:
    """All paths below a tree's root as conjunctions; conditions on one side keep the tightest bound."""
    out: set[tuple[Condition, ...]] = set()
    todo = [(root, ())]
    while todo:
        node, path = todo.pop()
        if path:
            tight: dict[tuple[str, bool], float] = {}
            for f, at_most, bound in path:
                old = tight.get((f, at_most), bound)
                tight[f, at_most] = min(old, bound) if at_most else max(old, bound)
            out.add(tuple(sorted((f, side, bound) for (f, side), bound in tight.items())))
        if node.numDescendants():
            f, bound = features[node.split().featureIndex()], float(node.split().threshold())
            todo += [(node.leftChild(), (*path, (f, True, bound))), (node.rightChild(), (*path, (f, False, bound)))]
    return out


def fit(rows: DataFrame, label: str = "label", trees: int = TREES, depth: int = DEPTH, penalty: float = PENALTY, seed: int = SEED) -> RuleEnsemble:
    """Learns from all given rows (statistics and a 0/1 label; null labels are left out).

    Without rows the score is 0.5; with labels of one kind it is their smoothed share.
    """
    rows = stored(rows.filter(F.col(label).isNotNull()).select(*FEATURES, F.col(label).cast("double").alias("label")), "training")
    count, positive = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if positive in (0, count):
        share = (positive + 1) / (count + 2)
        return RuleEnsemble((), float(_logit(share)))
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows)
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, maxBins=64, bootstrap=False, featureSubsetStrategy="onethird", seed=seed).fit(vectors)
    rules = sorted(set().union(*(tree_rules(t._call_java("rootNode"), FEATURES) for t in forest.trees)))
    if not rules:
        return RuleEnsemble((), float(_logit((positive + 1) / (count + 2))))
    names = [f"r{i}" for i in range(len(rules))]
    matrix = rows.select("label", *(holds(r).cast("double").alias(n) for r, n in zip(rules, names, strict=True)))
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=penalty, standardization=False, maxIter=ITERATIONS)
    model = lasso.fit(stored(VectorAssembler(inputCols=names, outputCol="features").transform(matrix).select("features", "label"), "rules"))
    weights = model.coefficients.toArray()
    return RuleEnsemble(tuple((r, float(w)) for r, w in zip(rules, weights, strict=True) if w), float(model.intercept))


def _logit(share: float) -> float:
    import math

    return math.log(share / (1 - share))


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows never learned from: crc32 of the id as text divides by five. A null id is none of them."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % HELD_OUT_FOLDS == 0, F.lit(False))


def learned(statistics: DataFrame, labels: DataFrame) -> RuleEnsemble:
    """An ensemble from the labelled rows of ``statistics`` (doc_id and inputs) that are not held out."""
    known = labels.filter(F.col("quality").isNotNull()).select(F.col("doc_id").alias("_id"), F.col("quality").alias("label"))
    return fit(statistics.filter(~held_out()).join(known, F.col("doc_id") == F.col("_id")))


def scored(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of each given row, by an ensemble learned from ``labels``.

    A null or empty text is scored like any other, from its zero statistics. Repeated rows
    are scored alike; repeated labels all count. Only doc_id and text are read.
    """
    rows = stored(with_statistics(docs.select("doc_id", "text")).drop("text"), "statistics")
    score = learned(rows, labels).score()
    return rows.select("doc_id", held_out().alias("held_out"), score.alias("score")) \
        .withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, unchanged, that score at least ``threshold``.

    Statistics are worked out for the labelled rows to learn from them, and once for each row
    to score it; they are not written.
    """
    known = labels.filter(F.col("quality").isNotNull()).select("doc_id")
    ensemble = learned(with_statistics(docs.select("doc_id", "text").join(known, "doc_id", "left_semi")).drop("text"), labels)
    inner = F.struct(*docs.columns).alias("_row")
    return with_statistics(docs.select(inner, "text")).filter(ensemble.score() >= threshold).select("_row.*")
