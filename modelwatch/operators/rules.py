"""Evidence, the ordered cause rules and hypothesis bookkeeping, for all alerts at once."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions.scalars import micros
from ..schemas import present

EVIDENCE = ["alert_id", "scope_id", "evidence_type", "step", "position", "status", "description", "feature_name",
            "score", "data"]


@dataclass(frozen=True)
class RuleConfig:
    """Names and limits the rules look for."""

    bug_feature: str = fv.BUG_FEATURE
    skew_feature: str = fv.SKEW_FEATURE
    accuracy_drop: float = fv.ACCURACY_DROP
    audit_counts_as_skew: bool = True


def _evidence(rows: DataFrame, kind: str, step: int, status: str, position: Column, description: Column,
              feature: Column | None = None, score: Column | None = None, data: list[str] = ()) -> DataFrame:
    text = lambda c: F.lit(None).cast("string") if c is None else c
    return rows.select(
        "alert_id", "scope_id", F.lit(kind).alias("evidence_type"), F.lit(step).alias("step"),
        position.cast("long").alias("position"), F.lit(status).alias("status"), description.alias("description"),
        text(feature).alias("feature_name"),
        (F.lit(None) if score is None else score).cast("double").alias("score"),
        F.to_json(F.struct(*data)).alias("data"))


def drift_evidence(drift: DataFrame) -> DataFrame:
    return _evidence(drift.where("is_drifted"), "feature_drift", 1, "drift_detected", F.col("feature_pos"),
                     F.col("summary"), F.col("feature_name"), F.col("p_value"),
                     ["feature_name", "baseline_count", "target_count", "baseline_mean", "target_mean",
                      "baseline_std", "target_std", "ks_stat", "p_value", "is_drifted"])


def registry_evidence(report: DataFrame) -> DataFrame:
    """Alerts on models with more than one version."""
    return _evidence(report.where(F.col("version_count") > 1), "model_registry_diff", 2, "multiple_versions_detected", F.lit(0), F.col("summary"),
                     score=F.col("accuracy_delta"),
                     data=["model_name", "version_count", "latest_version", "previous_version", "accuracy_delta", "param_changes", "metric_changes"])


def commit_evidence(commits: DataFrame) -> DataFrame:
    """The commits near an alert. The payload names a commit by its hash; diffs stay where they are, in the commit table."""
    newest_first = -micros(F.col("committed_at"))
    return _evidence(commits, "git_commit", 3, "commit_found", newest_first, F.col("summary"),
                     data=present(commits, ["commit_hash", "author", "date", "message", "changed_files"]))


def label_evidence(labels: DataFrame) -> DataFrame:
    return _evidence(labels.where("is_drifted"), "label_drift", 4, "drift_detected", F.lit(0), F.col("summary"),
                     score=F.col("drift_delta"),
                     data=["baseline_count", "target_count", "baseline_mean", "target_mean", "drift_delta"])


def freshness_evidence(freshness: DataFrame) -> DataFrame:
    return _evidence(freshness.where("is_stale"), "feature_staleness", 5, "staleness_detected", F.lit(0),
                     F.col("summary"), score=F.col("mean_lag_days"),
                     data=["matched_count", "mean_lag_days", "max_lag_days"])


def audit_evidence(audit: DataFrame, features: list[str] | None = None) -> DataFrame:
    """Served-versus-stored mismatches, as a sixth kind of evidence, in the order of ``features``."""
    text = F.format_string("Feature '%s' served values differ from stored ones in %.4f of rows (median ratio %.4f).",
                           "feature_name", "mismatch_rate", F.coalesce("median_ratio", F.lit(float("nan"))))
    place = F.coalesce(F.array_position(F.array(*[F.lit(f) for f in features]), F.col("feature_name")), F.lit(0)) if features else F.lit(0)
    return _evidence(audit.where("is_skewed"), "serving_skew", 6, "mismatch_detected", place, text,
                     F.col("feature_name"), F.col("median_ratio"),
                     ["feature_name", "matched_count", "mismatch_rate", "median_ratio"])


def payload(evidence: DataFrame, path: str, kind: str, data: str = "data") -> DataFrame:
    """(evidence row's keys, value): what lies at ``path`` of each payload, as ``kind``; text payloads are parsed, VARIANT ones are read.

    Null where the payload has no such place. ``kind`` is a type name, maps and structs included.
    """
    whole = F.col(data) if dict(evidence.dtypes)[data] == "variant" else F.try_parse_json(F.col(data))
    return evidence.select(*[c for c in evidence.columns if c != data], F.try_variant_get(whole, path, kind).alias("value"))


def evidence_all(*parts: DataFrame) -> DataFrame:
    """All evidence; (step, position) gives its order within an alert."""
    return reduce(DataFrame.unionByName, [p.select(*EVIDENCE) for p in parts])


def root_cause(evidence: DataFrame, alerts: DataFrame, config: RuleConfig = RuleConfig()) -> DataFrame:
    """The first rule that holds names the cause; alerts without any are control cases.

    Evidence is read once: everything the rules ask is an aggregate per alert, combined map-side.
    """
    kind, score = F.col("evidence_type"), F.col("score")
    drift = kind == "feature_drift"
    of = lambda feature: drift & (F.col("feature_name") == feature)
    at = lambda test: F.when(test, F.struct("position", F.coalesce("feature_name", F.lit("")), "description"))  # ties go by name, then text
    flags = evidence.groupBy("alert_id").agg(
        F.bool_or(kind == "git_commit").alias("commit"), F.bool_or(drift).alias("drift"),
        F.bool_or(of(config.bug_feature)).alias("bug_drift"), F.bool_or(of(config.skew_feature)).alias("skew_drift"),
        F.bool_or(kind == "feature_staleness").alias("stale"), F.bool_or(kind == "label_drift").alias("labels"),
        F.bool_or(kind == "serving_skew").alias("audit"),
        F.count(F.lit(1)).alias("n_evidence"), F.collect_set(kind).alias("types"),
        F.min(F.when(kind == "model_registry_diff", score)).alias("accuracy_delta"),
        F.max(F.when(kind == "feature_staleness", score)).alias("lag"),
        F.min_by("feature_name", at(drift)).alias("first_drift"),
        F.min_by("feature_name", at(kind == "serving_skew")).alias("audit_feature"),
        F.min_by("description", at(kind == "git_commit")).alias("commit_text"))

    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    skewed = yes("skew_drift") | (yes("audit") if config.audit_counts_as_skew else F.lit(False))
    rules = [
        ("pipeline_bug", yes("commit") & yes("bug_drift"), [F.lit(config.bug_feature), F.col("commit_text")]),
        ("stale_feature", yes("stale"), [F.col("lag")]),
        ("bad_model_deploy", F.coalesce(F.col("accuracy_delta") < config.accuracy_drop, F.lit(False)), []),
        ("label_shift", yes("labels"), []),
        ("serving_skew", skewed, [F.when(yes("skew_drift"), F.lit(config.skew_feature)).otherwise(F.col("audit_feature"))]),
        ("feature_drift", yes("drift"), [F.col("first_drift")]),
        (fv.CONTROL, F.lit(True), []),
    ]
    choose = lambda value: F.coalesce(*[F.when(test, value(cause, args)) for cause, test, args in rules])
    all_causes = F.array(*[F.lit(c) for c in fv.CAUSES])
    return (alerts.join(flags, "alert_id", "left")
            .withColumns({"cause": choose(lambda cause, args: F.lit(cause)),
                          "confidence": choose(lambda cause, args: F.lit(fv.CONFIDENCE[cause])),
                          "reasoning": choose(lambda cause, args: F.format_string(fv.REASONING[cause], *args))})
            .select(*alerts.columns, "cause", "confidence", "reasoning",
                    F.array_except(all_causes, F.array("cause")).alias("ruled_out"),
                    F.coalesce("n_evidence", F.lit(0)).alias("n_evidence"),
                    F.coalesce(F.size("types"), F.lit(0)).cast("long").alias("n_types")))


def hypothesis_status(causes: DataFrame) -> DataFrame:
    """The six hypotheses of each alert: the chosen cause's is proven, the others are eliminated."""
    fixed = F.array(*[F.struct(F.lit(h).alias("hypothesis_id"), F.lit(c).alias("stands_for"), F.lit(t).alias("text"))
                      for h, c, t in fv.HYPOTHESES])
    return (causes.select("alert_id", "scope_id", "cause", F.posexplode(fixed).alias("position", "h"))
            .select("alert_id", "scope_id", "position", "h.hypothesis_id", "h.text",
                    F.when(F.col("h.stands_for") == F.col("cause"), "proven").otherwise("eliminated").alias("status")))


def evidence_hypothesis(evidence: DataFrame, hypotheses: DataFrame, config: RuleConfig = RuleConfig()) -> DataFrame:
    """The hypothesis each evidence row speaks to: the last one whose text carries the type's keyword."""
    listed = (hypotheses.groupBy("alert_id")
              .agg(F.sort_array(F.collect_list(F.struct("position", "text", "status"))).alias("_h")))
    kind = F.col("evidence_type")
    word = reduce(lambda acc, kv: F.when(kind == kv[0], kv[1]).otherwise(acc), fv.EVIDENCE_KEYWORDS.items(),
                  F.lit(None).cast("string"))
    on_skew_feature = (kind == "feature_drift") & (F.col("feature_name") == config.skew_feature)
    matches = F.filter("_h", lambda h: F.lower(h["text"]).contains(word)
                       | (on_skew_feature & F.lower(h["text"]).contains("skew")))
    return (evidence.join(listed, "alert_id", "left")
            .withColumn("_m", matches).withColumn("_m", F.get("_m", F.size("_m") - 1))
            .withColumn("hypothesis", F.coalesce("_m.text", F.lit(fv.NO_HYPOTHESIS)))
            .withColumn("hypothesis_status", F.coalesce("_m.status", F.lit(fv.UNRESOLVED)))
            .drop("_h", "_m"))
