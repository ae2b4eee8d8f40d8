"""URL filters by a character language-model ratio (operator 5). DataFrame operations only.

URLs that a rule allows or blocks train two variable-order Markov models of characters, up to four characters of
context, each order smoothed with the next shorter one by how many different characters follow the
context (Witten-Bell). A URL no rule covers is judged by the mean over its characters of the difference of
the two log-likelihoods. The models see all that follows ``://``, query and fragment included, and the whole string where there is no ``://``.

The cut lies where a rule-allowed and a rule-blocked URL would be misjudged equally often under normal scores: means and deviations of both classes
calibrate it. They are taken from covered URLs that the models have not seen: one in HELD_OUT different ones, picked by hash, trains nothing.

Counts grow with the table; the rules are a short list in the program. Results for
odd input: a null URL or one without ``://`` has empty host and path; null and empty ones are judged on the end mark alone; equal URLs get equal
verdicts; repeated rows stay; without any allowed or blocked URL that class is taken as uniform, and the cut as 0. If one class has no held-out URL, all covered
ones calibrate. Further columns pass through, but for those named like a result, which are replaced.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stored
from .common import table

ORDER = 4
ALPHABET = 257
PAD, END = "\x01", "\x02"
#: One in so many different URLs calibrates; different URLs whose characters one task spells out.
HELD_OUT, URLS_A_TASK = 5, 5000


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = [Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/")]


def with_parts(urls: DataFrame, url: str = "url") -> DataFrame:
    """Adds host (A-Z lower-cased), path, and ``u``, what the models see."""
    whole = F.coalesce(F.col(f"`{url}`"), F.lit(""))
    at = F.instr(whole, "://")
    rest = F.when(at > 0, F.substring(whole, at + 3, F.length(whole))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    low = F.translate(host, string.ascii_uppercase, string.ascii_lowercase)
    seen = F.when(at > 0, F.concat(low, F.substring(rest, F.length(host) + 1, F.length(rest)))).otherwise(whole)
    return urls.withColumns({"host": low, "path": path, "u": seen})


def with_rule(parts: DataFrame, rules: list[Rule]) -> DataFrame:
    """Adds rule (its text, null if none fits) and rule_verdict; the longest fitting rule wins."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
        name, verdict = F.when(fits, r.text).otherwise(name), F.when(fits, r.verdict).otherwise(verdict)
    return parts.withColumn("rule", name).withColumn("rule_verdict", verdict)


def grams(column: str) -> Column:
    """Every character with its context, the end mark last: strings of ORDER + 1 characters."""
    padded = F.concat(F.lit(PAD * ORDER), F.col(column), F.lit(END))
    return F.transform(F.sequence(F.lit(1), F.length(column) + 1), lambda i: F.substring(padded, i, F.lit(ORDER + 1)))


def model(counts: DataFrame) -> DataFrame:
    """(gram, ratio): log of the allowed over the blocked model's probability, for each gram of ``counts`` (gram, allow, block)."""
    below = None
    for k in range(ORDER + 1):
        own = counts.groupBy(F.substring("gram", ORDER + 1 - k, k + 1).alias("g")).agg(F.sum("allow").alias("allow"), F.sum("block").alias("block"))
        own = own.withColumn("ctx", F.substring("g", 1, k))
        sums = []
        for side in ("allow", "block"):
            sums += [F.sum(side).alias(f"n_{side}"), F.sum((F.col(side) > 0).cast("long")).alias(f"t_{side}")]
        rows = own.join(own.groupBy("ctx").agg(*sums), "ctx")
        if below is None:
            lower = {side: F.lit(1.0 / ALPHABET) for side in ("allow", "block")}
        else:
            rows = rows.join(below, F.substring("g", 2, k) == below["low"])
            lower = {side: F.col(f"p_{side}") for side in ("allow", "block")}
        made = {side: F.when(F.col(f"n_{side}") + F.col(f"t_{side}") == 0, lower[side]).otherwise(
            (F.col(side) + F.col(f"t_{side}") * lower[side]) / (F.col(f"n_{side}") + F.col(f"t_{side}"))) for side in ("allow", "block")}
        below = stored(rows.select(F.col("g").alias("low"), made["allow"].alias("p_allow"), made["block"].alias("p_block")), f"order{k}")
    return below.select(F.col("low").alias("gram"), (F.log("p_allow") - F.log("p_block")).alias("ratio"))


def with_scores(parts: DataFrame) -> DataFrame:
    """Different ``u`` of ``parts`` (u, allow, block) with the score of each, through one join of characters and model.

    A URL is carried through the join as 96 bits of hashes. Common grams are hot keys of that join, whose parts Spark splits.
    """
    parts = parts.repartition(max(1, parts.count() // URLS_A_TASK))  # files are split by bytes, but the work goes by rows
    spelled = parts.select(F.xxhash64("u").alias("h"), F.hash("u").alias("h2"), "allow", "block", F.explode(grams("u")).alias("gram"))
    counts = stored(spelled.groupBy("gram").agg(F.sum("allow").alias("allow"), F.sum("block").alias("block")), "grams")
    ratios = model(counts)
    marks = spelled.select("h", "h2", "gram").join(ratios, "gram")
    return marks.groupBy("h", "h2").agg(F.round(F.sum("ratio") / F.count("*"), 9).alias("score"))


def cut(scored: DataFrame) -> float:
    """Where both classes of rule-covered URLs (score, allow, block) are misjudged equally often."""
    def moments(side: str) -> list[Column]:
        n, x = F.sum(side), F.col("score")
        return [n.alias(f"n_{side}"), F.sum(F.col(side) * x).alias(f"m_{side}"), F.sum(F.col(side) * x * x).alias(f"s_{side}")]

    r = scored.agg(*moments("allow"), *moments("block")).first()
    if not r["n_allow"] or not r["n_block"]:
        return 0.0
    mean = {s: r[f"m_{s}"] / r[f"n_{s}"] for s in ("allow", "block")}
    dev = {s: max(r[f"s_{s}"] / r[f"n_{s}"] - mean[s] ** 2, 0.0) ** 0.5 + 1e-6 for s in ("allow", "block")}
    return round((mean["allow"] * dev["block"] + mean["block"] * dev["allow"]) / (dev["allow"] + dev["block"]), 9)


def judged(urls: DataFrame, url: str = "url", rules: list[Rule] = RULES) -> DataFrame:
    """``urls`` plus host, path, rule, score and verdict."""
    rows = with_rule(with_parts(urls, url), rules)
    known = [F.sum((F.col("rule_verdict") == v).cast("long")).alias(v) for v in ("allow", "block")]
    different = stored(rows.groupBy("u").agg(*known).na.fill(0), "urls")
    held = F.pmod(F.xxhash64("u"), F.lit(HELD_OUT)) == 0
    trained = different.select("u", *[F.when(held, 0).otherwise(F.col(c)).cast("long").alias(c) for c in ("allow", "block")])
    scores = stored(with_scores(trained), "scores")
    keyed = different.select("u", "allow", "block", F.xxhash64("u").alias("h"), F.hash("u").alias("h2"))
    scored = stored(keyed.join(scores, ["h", "h2"]).select(F.col("u").alias("x"), "allow", "block", "score"), "scored")
    aside = scored.where(F.pmod(F.xxhash64("x"), F.lit(HELD_OUT)) == 0)
    both = aside.agg(F.sum("allow"), F.sum("block")).first()
    limit = cut(aside if all(both) else scored)
    met = rows.join(scored.select("x", "score"), rows["u"] == F.col("x"))
    verdict = F.coalesce("rule_verdict", F.when(F.col("score") >= limit, "allow").otherwise("block"))
    return met.withColumn("verdict", verdict).drop("u", "x", "rule_verdict")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "score")
