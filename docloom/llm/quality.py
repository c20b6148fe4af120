"""Quality classifier: a sparse ensemble of rules compiled into Spark column expressions.

A small random forest over text statistics gives tree paths; every path from a root to a
node is a conjunction of comparisons, a rule. A lasso-penalised logistic regression over
the rules' 0/1 values keeps the few that matter, and the score is one column expression:
the logistic function of the weighted sum of the rules that hold. Statistics are JVM
functions of the document's own row, so scoring neither shuffles nor leaves the JVM.

Null and empty texts have all statistics 0 and get the score these give. Rows of ``labels``
without a label or without a document are not learned from; several labels of one document
count each. Where only one class (or nothing) is labelled, the model is a constant.
Extra columns of ``docs`` stay as they are; ``score`` and ``reject`` refuse frames that have
one of ``TAKEN``. Repeated rows are learned from, and scored, each. A text is handled whole.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.base import id_remainder, stored

TAKEN = {"_stats", "_score", "_row"}
Condition = tuple[str, str, float]  # statistic, "<=" or ">", threshold


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def _left(text: Column, pattern: str) -> Column:
    """Characters that remain when every match is cut out."""
    return F.length(F.regexp_replace(text, pattern, ""))


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a text that is not null, by name."""
    chars = F.length(text)
    # Splitting at one plain character takes Spark's fast path.
    tokens = F.split(F.replace(text, F.lit("\n"), F.lit(" ")), " ")
    lines = F.split(text, "\n")
    # What is neither letter nor white space: a short string the other counts are made from.
    rest = F.regexp_replace(text, "[\\p{L}\\s]+", "")
    n_tokens, n_lines = F.size(tokens), F.size(lines)
    return {
        "log_chars": F.log1p(chars.cast("double")),
        "word_length": _share(chars, n_tokens),
        # Grows with the logarithms, so that it means the same in short and long texts.
        "variety": F.log1p(F.size(F.array_distinct(tokens))) / F.log1p(n_tokens),
        "distinct_lines": _share(F.size(F.array_distinct(lines)), n_lines),
        "line_words": _share(n_tokens, n_lines),
        "upper": _share(_left(text, "[^\\p{Lu}]+"), chars),
        "letters": _share(chars - F.length(rest) - n_tokens + 1, chars),
        "digits": _share(_left(rest, "[^0-9]+"), chars),
        "marks": _share(_left(rest, "[^!?#$%&*|<>{}=~^_]+"), chars),
        "stops": _share(_left(rest, "[^.,;:]+"), n_tokens),
    }


NAMES = (
    "log_chars", "word_length", "variety", "distinct_lines", "line_words",
    "upper", "letters", "digits", "marks", "stops",
)


def with_statistics(docs: DataFrame) -> DataFrame:
    """``docs`` with one column ``_stats``, a struct of the statistics."""
    if clash := TAKEN & set(docs.columns):
        raise ValueError(f"columns in the way: {sorted(clash)}")
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumn("_stats", F.struct(*(c.alias(n) for n, c in statistics(text).items())))


@dataclass(frozen=True)
class RuleEnsemble:
    intercept: float
    rules: tuple[tuple[tuple[Condition, ...], float], ...]

    def score(self, stats: str = "_stats") -> Column:
        total = F.lit(self.intercept)
        for conditions, weight in self.rules:
            total = total + F.when(holds(conditions, stats), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def holds(conditions: tuple[Condition, ...], stats: str = "_stats") -> Column:
    out = F.lit(True)
    for name, sign, threshold in conditions:
        value = F.col(f"{stats}.{name}")
        out = out & ((value <= threshold) if sign == "<=" else (value > threshold))
    return out


def tree_paths(model) -> list[tuple[Condition, ...]]:
    """The path to every node but the roots, each once, merged to one bound per side."""
    found: dict[tuple[Condition, ...], None] = {}

    def walk(node, path: dict[tuple[str, str], float]) -> None:
        if path:
            found[tuple((n, s, t) for (n, s), t in sorted(path.items()))] = None
        if node.subtreeDepth() == 0:
            return
        name, at = NAMES[node.split().featureIndex()], node.split().threshold()
        for child, sign, tighter in ((node.leftChild(), "<=", min), (node.rightChild(), ">", max)):
            key = (name, sign)
            walk(child, {**path, key: tighter(path.get(key, at), at)})

    for tree in model.trees:
        walk(tree._call_java("rootNode"), {})
    return list(found)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    trees: int = 12,
    depth: int = 3,
    penalty: float = 0.001,
    modulus: int = 3,
    held_out: int = 1,
) -> RuleEnsemble:
    """Learn from all labelled documents whose id remainder is not ``held_out``."""
    marked = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
        .where(id_remainder(modulus) != held_out)
        .select("doc_id", F.col("quality").cast("double").alias("_label"))
    )
    # Only statistics are joined: texts never enter a shuffle.
    rows = with_statistics(docs.select("doc_id", "text")).drop("text").join(marked, "doc_id")
    learned = stored(rows.select("_label", "_stats"), "quality-statistics")
    counts = {r["_label"]: r["count"] for r in learned.groupBy("_label").count().collect()}
    yes, total = counts.get(1.0, 0), sum(counts.values())
    prior = math.log((yes + 0.5) / (total - yes + 0.5))
    if not 0 < yes < total:
        return RuleEnsemble(prior, ())
    vectors = VectorAssembler(inputCols=list(NAMES), outputCol="features").transform(
        learned.select("_label", "_stats.*")
    )
    # In the trees either class weighs half, so that rare junk still shapes them.
    weight = F.when(F.col("_label") == 1.0, total / (2 * yes)).otherwise(total / (2 * (total - yes)))
    forest = RandomForestClassifier(
        labelCol="_label", weightCol="_weight", numTrees=trees, maxDepth=depth, seed=7,
        featureSubsetStrategy="0.5", maxBins=64,
    ).fit(vectors.withColumn("_weight", weight))
    paths = tree_paths(forest)
    flags = learned.select(
        "_label", *(holds(p).cast("double").alias(f"_r{i}") for i, p in enumerate(paths))
    )
    flagged = VectorAssembler(inputCols=[f"_r{i}" for i in range(len(paths))], outputCol="features")
    lasso = LogisticRegression(
        labelCol="_label", elasticNetParam=1.0, regParam=penalty, maxIter=40, standardization=False
    ).fit(flagged.transform(flags).select("_label", "features"))
    weights = [(p, float(w)) for p, w in zip(paths, lasso.coefficients.toArray()) if w != 0.0]
    return RuleEnsemble(float(lasso.intercept), tuple(weights))


def score(docs: DataFrame, model: RuleEnsemble) -> DataFrame:
    """``docs`` with ``_score`` in place of the statistics."""
    return with_statistics(docs).withColumn("_score", model.score()).drop("_stats")


def reject(docs: DataFrame, model: RuleEnsemble, least: float = 0.5) -> DataFrame:
    """The documents that reach the least score, with their own columns.

    Spark does not move a condition below a projection that numbers rows: without the number
    it would put the statistics' expressions into the condition once per rule that reads them.
    """
    numbered = with_statistics(docs).withColumn("_row", F.monotonically_increasing_id())
    good = (model.score() >= least) & (F.col("_row") >= 0)
    return numbered.where(good).drop("_stats", "_row")
