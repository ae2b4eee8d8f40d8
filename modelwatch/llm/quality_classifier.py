"""Quality classifier by a sparse rule ensemble (operator 2).

A small random forest is grown on statistics of labelled texts. Every path of its trees is a conjunctive
rule; a logistic regression with an L1 penalty weighs all rules and drops most of them. What is left is a
sum of conditions, compiled into one Spark column expression, so scoring needs neither the forest nor Python.

Statistics are shares of the text, never its length, language, source or id: a clean text of unusual
length should not be punished. Results for odd input: null text counts as empty; an empty text has all shares zero
and is scored by the same rules; equal texts have equal scores; repeated label rows of a document count
once (the lowest label); null labels are left out; with only one class among the labels the score is that
class's smoothed share for every row.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stored
from .common import table
from .textstats import share, with_counts

#: At most about so many labelled rows are used to fit; a larger set is thinned by the hash of the id.
SAMPLE_ROWS = 200_000


def statistics() -> dict[str, Column]:
    return {"symbols": share("n_symbols", "n_words"), "dup_lines": share("n_dup_lines", "n_lines"),
            "repeats": share("n_repeat_words", "n_words"), "word_length": share("word_chars", "n_words"),
            "upper": share("n_upper", "word_chars"), "digits": share("n_digits", "word_chars"),
            "letters": share("n_letters", "word_chars"),
            "variety": F.when(F.col("n_words") > 1, F.log(F.col("n_distinct_words")) / F.log(F.col("n_words"))).otherwise(0.0)}


@dataclass(frozen=True)
class Rule:
    """Conditions (statistic, "<=" or ">", cut) that must all hold."""

    conditions: tuple[tuple[str, str, float], ...]

    def column(self) -> Column:
        parts = [F.col(s) <= cut if op == "<=" else F.col(s) > cut for s, op, cut in self.conditions]
        held = parts[0]
        for p in parts[1:]:
            held = held & p
        return held.cast("double")


@dataclass(frozen=True)
class RuleModel:
    intercept: float
    weights: tuple[tuple[Rule, float], ...]

    def score(self) -> Column:
        total = F.lit(self.intercept)
        for rule, w in self.weights:
            total = total + rule.column() * w
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def paths(tree_text: str, names: list[str]) -> set[Rule]:
    """Every node of a printed tree as the conjunction that leads to it; bounds on one statistic are merged."""
    found, stack = set(), []
    for line in tree_text.splitlines():
        m = re.match(r"(\s*)(If|Else) \(feature (\d+) (<=|>) ([-\d.eE]+)\)", line)
        if not m:
            continue
        depth = len(m[1])
        stack = [x for x in stack if x[0] < depth] + [(depth, names[int(m[3])], m[4], float(m[5]))]
        tight: dict[tuple[str, str], float] = {}
        for _, name, op, cut in stack:
            old = tight.get((name, op), cut)
            tight[name, op] = min(old, cut) if op == "<=" else max(old, cut)
        found.add(Rule(tuple(sorted((n, op, c) for (n, op), c in tight.items()))))
    return found


def fit(labelled: DataFrame, label: str = "label", trees: int = 12, depth: int = 3, penalty: float = 0.002,
        seed: int = 7) -> RuleModel:
    """``labelled``: the statistics and a 0/1 label. Grows, extracts, weighs; keeps rules with a weight."""
    names = list(statistics())
    tally = {r[label]: r["n"] for r in labelled.groupBy(label).agg(F.count("*").alias("n")).collect()}
    if len(tally) < 2:
        ones, total = tally.get(1, 0), sum(tally.values())
        return RuleModel(math.log((ones + 1) / (total - ones + 1)), ())
    rows = VectorAssembler(inputCols=names, outputCol="x").transform(labelled.withColumn(label, F.col(label).cast("double")))
    forest = RandomForestClassifier(featuresCol="x", labelCol=label, numTrees=trees, maxDepth=depth, maxBins=64, seed=seed).fit(rows)
    rules = sorted(set().union(*[paths(t.toDebugString, names) for t in forest.trees]), key=lambda r: r.conditions)
    held = labelled.select(F.col(label).cast("double").alias(label), *[r.column().alias(f"r{i}") for i, r in enumerate(rules)])
    held = VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="x").transform(held).select(label, "x")
    lasso = LogisticRegression(featuresCol="x", labelCol=label, elasticNetParam=1.0, regParam=penalty, maxIter=60,
                               standardization=False).fit(held)
    return RuleModel(float(lasso.intercept), tuple((r, float(w)) for r, w in zip(rules, lasso.coefficients) if abs(w) > 1e-9))


def training_rows(stats: DataFrame, labels: DataFrame, label: str, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per labelled document. ``stats`` without an id meets no label."""
    one = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(label).alias("label"))
    n = one.count()
    if n > sample_rows:
        one = one.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * sample_rows / n))
    names = list(statistics())
    return stats.join(one, "doc_id").select("label", *names)


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    stats = stored(with_counts(docs, without=("text",)).select("doc_id", *[c.alias(n) for n, c in statistics().items()]), "op2-stats")
    rows = stored(training_rows(stats.where(~held_out()), labels, "quality"), "op2-train")
    model = fit(rows)
    scored = stats.select("doc_id", held_out().alias("held_out"), model.score().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))
