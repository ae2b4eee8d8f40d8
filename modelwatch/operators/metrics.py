"""Prediction quality: classification metrics, daily accuracy, alert derivation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def classification_metrics(df: DataFrame, keys: list[str], prediction: str = "prediction",
                           label: str = "true_label") -> DataFrame:
    """Accuracy, precision, recall and F1 of the labelled rows of each group; 0 for empty denominators."""
    p, y = F.col(prediction) == 1, F.col(label) == 1
    counts = (df.where(F.col(label).isNotNull()).groupBy(*keys)
              .agg(F.count_if(p & y).alias("tp"), F.count_if(p & ~y).alias("fp"),
                   F.count_if(~p & y).alias("fn"), F.count_if(~p & ~y).alias("tn")))
    ratio = lambda num, den: F.coalesce(num / F.nullif(den, F.lit(0)), F.lit(0.0))
    tp, fp, fn, tn = [F.col(c) for c in ("tp", "fp", "fn", "tn")]
    return counts.select(*keys, "tp", "fp", "fn", "tn",
                         ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"), ratio(tp, tp + fp).alias("precision"),
                         ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1_score"))


def daily_accuracy(logs: DataFrame, ts: str = "ts", prediction: str = "prediction",
                   label: str = "true_label") -> DataFrame:
    """Share of right predictions per scope and serving day; ``n`` counts the rows it is taken over."""
    hit = (F.col(prediction) == F.col(label)).cast("double")
    return (logs.where(F.col(label).isNotNull()).groupBy("scope_id", F.to_date(ts).alias("day"))
            .agg(F.count(hit).alias("n"), F.avg(hit).alias("accuracy")))


def derived_alerts(daily: DataFrame, trailing_days: int = 7, z: float = 1.96) -> DataFrame:
    """Days whose accuracy falls below the trailing mean by more than z standard errors.

    Input is one row per scope and day, so the window is small whatever the log volume.
    """
    w = Window.partitionBy("scope_id").orderBy("day").rowsBetween(-trailing_days, -1)
    p = F.sum(F.col("accuracy") * F.col("n")).over(w) / F.nullif(F.sum("n").over(w), F.lit(0))
    return (daily.withColumn("expected", p).withColumn("days_seen", F.count(F.lit(1)).over(w))
            .withColumn("lower_bound",
                        F.col("expected") - z * F.sqrt(F.col("expected") * (1 - F.col("expected")) / F.col("n")))
            .where((F.col("days_seen") == trailing_days) & (F.col("accuracy") < F.col("lower_bound")))
            .select("scope_id", F.col("day").alias("alert_day"), F.lit("accuracy").alias("alert_metric"),
                    F.col("accuracy").alias("alert_value"), "expected", "lower_bound"))


def alert_rows(derived: DataFrame, model_name: str, baseline_days: int = 30, active_days: int = 10) -> DataFrame:
    """Derived alerts as rows of the alerts table, with windows around the alert day."""
    day = F.col("alert_day").cast("timestamp_ntz")
    ago = lambda n: day - F.make_dt_interval(days=F.lit(n))
    return derived.select(
        F.sha2(F.concat_ws("|", "scope_id", F.col("alert_day").cast("string")), 256).alias("alert_id"),
        "scope_id", F.lit(model_name).alias("model_name"), "alert_metric", "alert_value", day.alias("alert_ts"),
        ago(active_days + baseline_days).alias("baseline_start"), ago(active_days + 1).alias("baseline_end"),
        ago(active_days).alias("active_start"), (day + F.make_dt_interval(days=F.lit(active_days))).alias("active_end"))
