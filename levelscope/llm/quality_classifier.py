"""Quality classifier: a sparse ensemble of rules over text statistics.

A random forest of shallow trees is grown on a bounded sample of labelled rows; every path
from a root to a node becomes a conjunctive rule over the statistics. A logistic regression
with an L1 penalty weighs the rules, most of them with 0. What is left is compiled into one
Spark column: the logistic function of the weights of the rules that hold. Scoring a corpus
is a projection over whole texts.

Nulls and ties: a null text scores as an empty one. Labels that repeat a doc_id count once,
by their mean (a tie is 1); a null label is none. If labels of one class only are there,
the score is their share. Rows that repeat a doc_id are scored each on their own. Further
columns of the input are not read.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bucket_of, written
from .quality_rules import ratio, words

#: Labelled rows that the model is fitted on, at most.
MOST_LABELS = 20_000
TREES, DEPTH = 20, 3
PENALTY = 0.002
THRESHOLD = 0.7

FEATURES = (
    "length", "mean_word_length", "symbol_ratio", "pipe_ratio", "upper_ratio", "digit_ratio", "mark_ratio",
    "distinct_ratio", "adjacent_ratio", "dup_line_ratio", "short_ratio", "newline_ratio", "exclamation_ratio",
)


def features(docs: DataFrame) -> DataFrame:
    """The statistics of each whole text; ``_row`` holds all columns of its row."""
    text = F.col("text")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    own = docs.select(row, F.coalesce("text", F.lit("")).alias("text")).withColumn("words", words(text))

    def count(pattern: str) -> Column:
        return F.regexp_count(text, F.lit(pattern))

    lines = F.split(text, "\n")
    counted = own.select(
        "_row",
        F.size("words").alias("n_words"),
        F.greatest(F.length(text) - count(r"[\x20\x09-\x0D]"), F.lit(0)).alias("word_chars"),
        count(r"[#*$%&<>]").alias("n_symbols"),
        count(r"\|").alias("n_pipes"),
        count("!").alias("n_exclamations"),
        F.length(F.regexp_replace(text, r"\P{Lu}+", "")).alias("n_upper"),
        count(r"[0-9]").alias("n_digits"),
        count(r"[.,;:?]").alias("n_marks"),
        F.size(F.array_distinct("words")).alias("n_distinct"),
        count(r"(?<![^\x20\x09-\x0D])([^\x20\x09-\x0D]+) (?=\1(?:[\x20\x09-\x0D]|$))").alias("n_adjacent"),
        F.size(lines).alias("n_lines"),
        (F.size(lines) - F.size(F.array_distinct(lines))).alias("n_dup_lines"),
        count(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D]{1,3}(?=[\x20\x09-\x0D]|$)").alias("n_short"),
    )
    return counted.select(
        "_row",
        F.log10(F.col("n_words") + 1.0).alias("length"),
        ratio("word_chars", "n_words").alias("mean_word_length"),
        ratio("n_symbols", "word_chars").alias("symbol_ratio"),
        ratio("n_pipes", "n_words").alias("pipe_ratio"),
        ratio("n_upper", "word_chars").alias("upper_ratio"),
        ratio("n_digits", "word_chars").alias("digit_ratio"),
        ratio("n_marks", "n_words").alias("mark_ratio"),
        ratio("n_distinct", "n_words").alias("distinct_ratio"),
        ratio("n_adjacent", "n_words").alias("adjacent_ratio"),
        ratio("n_dup_lines", "n_lines").alias("dup_line_ratio"),
        ratio("n_short", "n_words").alias("short_ratio"),
        ratio("n_lines", "n_words").alias("newline_ratio"),
        ratio("n_exclamations", "n_words").alias("exclamation_ratio"),
    )


def labelled(docs: DataFrame, labels: DataFrame, modulus: int = 4, held_out: int = 2, most: int = MOST_LABELS) -> DataFrame:
    """doc_id, text and label of at most ``most`` rows that learning may use, by hash order."""
    mean = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("double").alias("label"))
    open_ = mean.where(bucket_of(F.col("doc_id"), modulus) != held_out)
    chosen = open_.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")


def _rules(forest) -> list[tuple[tuple[int, str, float], ...]]:
    """Each path from a root to a node below it, as (feature, '<=' or '>', threshold)."""
    found: dict[tuple, None] = {}

    def walk(node, path: tuple) -> None:
        if path:
            found.setdefault(tuple(sorted(path)))
        if node.subtreeDepth() == 0:
            return
        split = node.split()
        feature, threshold = split.featureIndex(), split.threshold()
        walk(node.leftChild(), (*path, (feature, "<=", threshold)))
        walk(node.rightChild(), (*path, (feature, ">", threshold)))

    for tree in forest.trees:
        walk(tree._call_java("rootNode"), ())
    return list(found)


def _holds(rule: tuple[tuple[int, str, float], ...]) -> Column:
    out = F.lit(True)
    for feature, side, threshold in rule:
        value = F.col(FEATURES[feature])
        out = out & (value <= threshold if side == "<=" else value > threshold)
    return out


class RuleEnsemble:
    """Rules with weights and an intercept; ``score()`` is their Spark column."""

    def __init__(self, rules: list[tuple], weights: list[float], intercept: float):
        self.rules, self.weights, self.intercept = rules, weights, intercept

    def score(self) -> Column:
        total = F.lit(self.intercept)
        for rule, weight in zip(self.rules, self.weights, strict=True):
            total = total + F.when(_holds(rule), F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))

    def describe(self) -> list[str]:
        return [f"{w:+.3f} if " + " and ".join(f"{FEATURES[f]} {side} {t:.4g}" for f, side, t in rule) for rule, w in zip(self.rules, self.weights, strict=True)]


def fit(rows: DataFrame, trees: int = TREES, depth: int = DEPTH, penalty: float = PENALTY) -> RuleEnsemble:
    """The ensemble for ``rows`` of the features and a label."""
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if len(counts) < 2:
        share = next(iter(counts), 0.5)
        return RuleEnsemble([], [], 20.0 * (share - 0.5) if counts else 0.0)
    data = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows).select("label", "features")
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, maxBins=64, featureSubsetStrategy="onethird", minInstancesPerNode=10, seed=7).fit(data)
    rules = _rules(forest)
    facts = rows.select("label", *[_holds(r).cast("double").alias(f"r{k}") for k, r in enumerate(rules)])
    facts = VectorAssembler(inputCols=[f"r{k}" for k in range(len(rules))], outputCol="features").transform(facts).select("label", "features")
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=penalty, standardization=False, maxIter=60).fit(facts)
    kept = [(r, float(w)) for r, w in zip(rules, lasso.coefficients.toArray(), strict=True) if w]
    return RuleEnsemble([r for r, _ in kept], [w for _, w in kept], float(lasso.intercept))


def train(docs: DataFrame, labels: DataFrame) -> RuleEnsemble:
    rows = labelled(docs, labels)
    return fit(written(features(rows).select("_row.label", *FEATURES), "labelled"))


def classify(docs: DataFrame, model: RuleEnsemble, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    scored = features(docs.select("doc_id", "text")).select("_row.doc_id", model.score().alias("score"))
    held = bucket_of(F.col("doc_id"), 4) == 2
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model: RuleEnsemble, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, as they are, that the classifier doesn't reject."""
    # The partition's number makes the score non-deterministic to Catalyst, which else moves the
    # filter below the features and evaluates their expressions again for each rule that reads them.
    scored = features(docs).select("_row", (model.score() + 0.0 * F.spark_partition_id()).alias("_score"))
    return scored.where(F.col("_score") >= threshold).select("_row.*")
