"""Quality rules by weak supervision (operator 6).

Nine rules look at the counts of a text and vote good (1), bad (-1) or abstain (0). Nobody says how far a
rule can be trusted: expectation-maximisation over the vote patterns of all documents estimates for each
rule how often it votes each way on good and on bad texts, and the share of good texts. The posterior of
"good" then decides instead of "all rules must pass". Rules are taken as independent given the class.

Results for odd input: null text counts as empty; an empty text fails the base rules; equal texts get equal
results; repeated rows stay repeated; an empty table gives an empty one (the model is then the prior).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stored
from .common import table
from .textstats import share, with_counts

VOTES = (-1, 0, 1)


def rules() -> dict[str, Column]:
    """Name -> vote. Each rule has a clear zone on both sides and abstains in between."""
    def vote(good: Column, bad: Column) -> Column:
        return F.when(bad, -1).when(good, 1).otherwise(0)

    symbols, dup, repeat = share("n_symbols", "n_words"), share("n_dup_lines", "n_lines"), share("n_repeat_words", "n_words")
    mean, upper = share("word_chars", "n_words"), share("n_upper", "word_chars")
    density, letters = share("n_symbols", "word_chars"), share("n_letters", "word_chars")
    digits, distinct = share("n_digits", "word_chars"), share("n_distinct_words", "n_words")
    return {"symbols": vote(symbols < 0.02, symbols > 0.1),
            "density": vote(density < 0.004, density > 0.02),
            "letters": vote(letters > 0.93, letters < 0.85),
            "dup_lines": vote((dup == 0) & (F.col("n_lines") > 1), dup > 0.3),
            "repeats": vote(repeat < 0.15, repeat > 0.4),
            "word_length": vote((mean >= 3) & (mean <= 9), (mean < 2) | (mean > 14)),
            "upper": vote(upper < 0.15, upper > 0.4),
            "digits": vote(digits < 0.1, digits > 0.4),
            "distinct": vote(distinct > 0.3, distinct < 0.05)}


@dataclass(frozen=True)
class VoteModel:
    """prior: share of good texts; good, bad: for each rule, probability of each vote in that class."""

    prior: float
    good: dict[str, tuple[float, ...]]
    bad: dict[str, tuple[float, ...]]

    def log_odds(self) -> Column:
        total = F.lit(math.log(self.prior / (1 - self.prior)))
        for name, vote in rules().items():
            g, b = self.good[name], self.bad[name]
            by_vote = F.lit(0.0)
            for v, pg, pb in zip(VOTES, g, b):
                by_vote = F.when(vote == v, math.log(pg / pb)).otherwise(by_vote)
            total = total + by_vote
        return total

    def posterior(self) -> Column:
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-self.log_odds()))


#: What a rule is believed to do before any text is seen: votes bad, abstains, votes good on good and on bad texts.
BELIEF_GOOD, BELIEF_BAD = (0.02, 0.18, 0.80), (0.60, 0.25, 0.15)


def em(patterns: list[tuple[tuple[int, ...], int]], names: list[str], rounds: int = 60, trust: float = 0.1) -> VoteModel:
    """Class-conditional vote tables from (votes, count) rows.

    The belief counts as ``trust`` times as many texts as there are, which keeps the classes from changing places or
    settling on one kind of bad text alone. A bad vote starts as heavy as three good ones. Patterns are taken in sorted
    order, so the same counts give the same model.
    """
    patterns = sorted(patterns)
    total = sum(n for _, n in patterns)
    weight = [1 / (1 + math.exp(-1.4 * sum(v if v > 0 else 3 * v for v in votes))) for votes, _ in patterns]
    believed = max(1.0, trust * total)
    for _ in range(rounds):
        good_n = sum(w * n for w, (_, n) in zip(weight, patterns))
        prior = (good_n + 0.8 * believed) / (total + believed)
        tables = []
        for side, belief in ((lambda w: w, BELIEF_GOOD), (lambda w: 1 - w, BELIEF_BAD)):
            cells = [[believed * b for b in belief] for _ in names]
            for w, (votes, n) in zip(weight, patterns):
                for j, v in enumerate(votes):
                    cells[j][v + 1] += side(w) * n
            tables.append([[c / sum(row) for c in row] for row in cells])
        good, bad = tables
        weight = []
        for votes, _ in patterns:
            odds = math.log(prior / (1 - prior)) + sum(math.log(good[j][v + 1] / bad[j][v + 1]) for j, v in enumerate(votes))
            weight.append(1 / (1 + math.exp(-max(-700.0, min(700.0, odds)))))
    return VoteModel(prior, {n: tuple(good[j]) for j, n in enumerate(names)}, {n: tuple(bad[j]) for j, n in enumerate(names)})


def fit(counted: DataFrame) -> VoteModel:
    """Vote patterns of all rows, aggregated on the cluster: at most 3^9 rows reach the driver."""
    named = rules()
    rows = counted.select(*[v.alias(n) for n, v in named.items()]).groupBy(*named).agg(F.count("*").alias("n")).collect()
    return em([(tuple(r[n] for n in named), r["n"]) for r in rows], list(named))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judged(counted: DataFrame, model: VoteModel, threshold: float = 0.5) -> DataFrame:
    """Adds base_failed, posterior and kept to counted rows."""
    return (counted.withColumn("base_failed", base_failed()).withColumn("posterior", model.posterior())
            .withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold)))


def keep_good(docs: DataFrame, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The documents that pass, with their own columns.

    The texts are counted twice, once for the model and once for the verdict; nothing but vote patterns
    is shuffled. Columns of ``docs`` that have the name of a count are set aside while judging.
    """
    own = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"))
    model = fit(with_counts(docs.select(F.col(f"`{text}`").alias("body")), "body", without=("body",)))
    return judged(with_counts(packed, text, row="row"), model, threshold).where("kept").select(*[F.col(f"row.`{c}`").alias(c) for c in own])


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = stored(with_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), without=("text",)), "op6")
    return judged(counted, fit(counted)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")
