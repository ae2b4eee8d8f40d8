"""Label-rate shift per alert."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from .alerts import AlertBook, alert_book, two_window_slice, within
from .drift import sample_status


def label_shift(logs: DataFrame, alerts: DataFrame | AlertBook, threshold: float = fv.LABEL_DROP,
                min_n: int = fv.MIN_SAMPLES, ts: str = "ts", label: str = "true_label",
                closed: bool = True) -> DataFrame:
    """Did the label rate drop by at least ``threshold`` from the quiet part of the active window
    (its start to one day before the alert) to the rest (alert to its end)? Rows without label are
    skipped; rises never count.
    """
    book = alert_book(alerts)
    day_before = F.col("alert_ts") - F.expr("INTERVAL 1 DAY")
    labelled = logs.where(F.col(label).isNotNull() & within(logs, ts, book.start, book.end))
    rows = two_window_slice(labelled.select("scope_id", ts, label), book, ts,
                            base=(F.col("active_start"), day_before),
                            target=(F.col("alert_ts"), F.col("active_end")), closed=closed)
    y = F.col(label).cast("double")
    stats = rows.groupBy("alert_id").agg(
        F.count_if("in_base").alias("baseline_count"), F.count_if("in_target").alias("target_count"),
        F.avg(F.when(F.col("in_base"), y)).alias("baseline_mean"),
        F.avg(F.when(F.col("in_target"), y)).alias("target_mean"))
    out = (book.frame.select("alert_id", "scope_id").join(stats, "alert_id", "left")
           .withColumn("baseline_count", F.coalesce("baseline_count", F.lit(0)))
           .withColumn("target_count", F.coalesce("target_count", F.lit(0)))
           .withColumn("status", F.when(F.col("baseline_count") + F.col("target_count") == 0, "empty")
                       .otherwise(sample_status(F.col("baseline_count"), F.col("target_count"), min_n))))
    ok = F.col("status") == "ok"
    out = (out.withColumn("baseline_mean", F.when(ok, F.col("baseline_mean")))
              .withColumn("target_mean", F.when(ok, F.col("target_mean")))
              .withColumn("drift_delta", F.col("baseline_mean") - F.col("target_mean")))
    return out.select(
        "alert_id", "scope_id", "status", "baseline_count", "target_count", "baseline_mean", "target_mean",
        "drift_delta", F.coalesce(F.col("drift_delta") >= threshold, F.lit(False)).alias("is_drifted"),
        F.when(ok, F.format_string(fv.SUMMARY_LABELS, F.col("baseline_mean"), F.col("target_mean"),
                                   F.col("drift_delta"), F.lit(float(threshold)))).alias("summary"))
