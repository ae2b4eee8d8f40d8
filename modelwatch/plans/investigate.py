"""From alerts to causes: all detectors for all alerts in one job."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..operators import commits as commit_ops
from ..operators import registry, rules
from ..operators.alerts import AlertBook, alert_book, within
from ..operators.asof import HOT_ROWS
from ..operators.audit import serving_skew_audit
from ..operators.drift import feature_drift
from ..operators.freshness import feature_freshness
from ..operators.labels import label_shift
from ..session import stored_side_by_side


@dataclass(frozen=True)
class Settings:
    """What an investigation looks for; defaults are the documented ones."""

    features: list[str] | None = None
    alpha: float = fv.DRIFT_ALPHA
    min_n: int = fv.MIN_SAMPLES
    p_value: str = "corrected"
    label_drop: float = fv.LABEL_DROP
    stale_days: float = fv.STALE_DAYS
    watched_path: str | None = fv.WATCHED_PATH
    commit_days: int = 1
    audit_features: list[str] = field(default_factory=list)
    max_mismatch: float = 0.05
    hot_rows: int | None = HOT_ROWS
    snapshots: str | None = None
    rules: rules.RuleConfig = rules.RuleConfig()


def gather_evidence(alerts: DataFrame | AlertBook, view: DataFrame, logs: DataFrame, versions: DataFrame,
                    commits: DataFrame, settings: Settings = Settings(), store: bool = False) -> DataFrame:
    """Positive findings of all detectors. With ``store`` the detectors run side by side and their findings are written to the work folder."""
    book, s = alert_book(alerts), settings
    parts = {
        "drift": lambda: rules.drift_evidence(feature_drift(view, book, s.features, s.alpha, s.min_n, s.p_value)),
        "registry": lambda: rules.registry_evidence(registry.alert_report(versions, book.frame)),
        "commits": lambda: rules.commit_evidence(commit_ops.in_window(commits, book, s.watched_path, s.commit_days)),
        "labels": lambda: rules.label_evidence(label_shift(logs, book, s.label_drop, s.min_n)),
        "freshness": lambda: rules.freshness_evidence(feature_freshness(logs, view, book, s.stale_days, s.min_n, hot_rows=s.hot_rows, snapshots=s.snapshots)),
    }
    if s.audit_features:
        parts["audit"] = lambda: rules.audit_evidence(audit_alerts(logs, view, book, s), s.audit_features)
    return rules.evidence_all(*(stored_side_by_side(parts) if store else [make() for make in parts.values()]))


def audit_alerts(logs: DataFrame, view: DataFrame, book: AlertBook, s: Settings) -> DataFrame:
    """Served-versus-stored audit of each alert's active window."""
    served = logs.where(within(logs, "ts", book.start, book.end)).select("scope_id", "entity_id", "ts", *s.audit_features)
    active = (book.meet(served, "ts", ["alert_id", "active_start", "active_end"], [("active_start", "active_end")])
              .where(F.col("ts").between(F.col("active_start"), F.col("active_end")))
              .drop("active_start", "active_end"))
    tie = "ingest_seq" if "ingest_seq" in view.columns else None
    return serving_skew_audit(active, view, s.audit_features, ["scope_id", "entity_id"], ["alert_id", "scope_id"],
                              tie=tie, max_mismatch=s.max_mismatch, hot_rows=s.hot_rows)


@dataclass(frozen=True)
class Investigation:
    """Evidence rows, causes per alert, hypotheses, and from them the two log tables."""

    evidence: DataFrame
    causes: DataFrame
    hypotheses: DataFrame
    settings: Settings

    def investigations(self, run_ts: Column) -> DataFrame:
        """Investigation-log rows; ids depend on alert and run time only, so a rerun repeats them."""
        return self.causes.select(
            investigation_id(run_ts).alias("investigation_id"), "alert_id", "scope_id", run_ts.alias("ts"),
            "alert_metric", "alert_value", "alert_ts", F.lit("completed").alias("status"), "cause", "confidence",
            "ruled_out", "reasoning")

    def evidence_records(self, run_ts: Column) -> DataFrame:
        """Evidence-log rows, each with the hypothesis it speaks to."""
        runs = self.causes.select("alert_id", investigation_id(run_ts).alias("investigation_id"))
        return (rules.evidence_hypothesis(self.evidence, self.hypotheses, self.settings.rules)
                .join(runs, "alert_id")
                .select("investigation_id", "scope_id", "step", "position", "hypothesis",
                        F.col("hypothesis_status").alias("status"), "evidence_type",
                        F.col("description").alias("evidence_summary"), F.col("data").alias("evidence_data")))


def investigation_id(run_ts: Column) -> Column:
    return F.sha2(F.concat_ws("|", "alert_id", run_ts.cast("string")), 256)


def run(alerts: DataFrame | AlertBook, view: DataFrame, logs: DataFrame, versions: DataFrame, commits: DataFrame,
        settings: Settings = Settings(), store_evidence: bool = True) -> Investigation:
    """Detect, gather, eliminate, conclude.

    The evidence (positive findings only, so small beside the inputs) is written to the work folder
    first, each detector's by a job of its own: causes, hypotheses and records all read it from there, and each detector runs once. With
    ``store_evidence=False`` everything stays one plan, which is slow to analyse.
    """
    book = alert_book(alerts)
    evidence = gather_evidence(book, view, logs, versions, commits, settings, store_evidence)
    causes = rules.root_cause(evidence, book.frame, settings.rules)
    return Investigation(evidence, causes, rules.hypothesis_status(causes), settings)
