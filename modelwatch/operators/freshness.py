"""How old were the features that predictions used?"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions.scalars import days_between
from .alerts import AlertBook, alert_book, day_pruning, within
from .asof import HOT_ROWS, pit_join
from .snapshots import bounded_view


def feature_lags(logs: DataFrame, view: DataFrame, alerts: DataFrame | AlertBook, ts: str = "ts",
                 entity: str = "entity_id", hot_rows: int | None = HOT_ROWS, snapshots: str | None = None) -> DataFrame:
    """Each log row inside the alerts' span with the time of the feature row it saw, and the lag in days.

    Matched once per log row, whatever the number of alerts that will look at it. With ``snapshots``, a folder of
    carry-forward snapshots, the view is read from the one before the span on; otherwise from its beginning.
    """
    book = alert_book(alerts)
    left = logs.where(within(logs, ts, book.start, book.end)).select("scope_id", entity, F.col(ts).alias("event_ts"))
    right = _seen(view, book, ts, entity, snapshots).withColumnRenamed(ts, "feature_ts")
    return (pit_join(left, right, ["scope_id", entity], "event_ts", "feature_ts", features=[],
                     matched_ts="feature_ts", hot_rows=hot_rows)
            .withColumn("lag_days", days_between(F.col("event_ts"), F.col("feature_ts"))))


def _seen(view: DataFrame, book: AlertBook, ts: str, entity: str, snapshots: str | None) -> DataFrame:
    """Feature times that a row in the alerts' span can have seen."""
    columns = ["scope_id", entity, ts]
    if snapshots and book.count:
        return bounded_view(view, snapshots, datetime.fromisoformat(book.start), datetime.fromisoformat(book.end), columns, ts)
    return view.where((F.col(ts) <= F.lit(book.end).cast(view.schema[ts].dataType)) & day_pruning(view, None, book.end)).select(*columns)


def feature_freshness(logs: DataFrame, view: DataFrame, alerts: DataFrame | AlertBook,
                      threshold_days: float = fv.STALE_DAYS, min_n: int = fv.MIN_SAMPLES, ts: str = "ts",
                      entity: str = "entity_id", hot_rows: int | None = HOT_ROWS, snapshots: str | None = None) -> DataFrame:
    """Matched rows, mean and largest lag over each alert's active window; stale if the mean exceeds
    the threshold. Also the share of rows above it, which a few very old rows cannot move. A scope is empty if it has no
    log row in the window or no feature row up to the end of the alerts' span.
    """
    book = alert_book(alerts)
    lags = feature_lags(logs, view, book, ts, entity, hot_rows, snapshots)
    stats = (book.meet(lags, "event_ts", ["alert_id", "active_start", "active_end"], [("active_start", "active_end")])
             .where(F.col("event_ts").between(F.col("active_start"), F.col("active_end")))
             .groupBy("alert_id")
             .agg(F.count(F.lit(1)).alias("log_count"), F.count("lag_days").alias("matched_count"),
                  F.avg("lag_days").alias("mean_lag_days"), F.max("lag_days").alias("max_lag_days"),
                  F.avg((F.col("lag_days") > threshold_days).cast("double")).alias("share_over_threshold")))
    filled = _seen(view, book, ts, entity, snapshots).select("scope_id").distinct().withColumn("_has_features", F.lit(True))
    out = (book.frame.select("alert_id", "scope_id").join(stats, "alert_id", "left").join(filled, "scope_id", "left")
           .withColumn("log_count", F.coalesce("log_count", F.lit(0)))
           .withColumn("matched_count", F.coalesce("matched_count", F.lit(0)))
           .withColumn("status", F.when((F.col("log_count") == 0) | F.col("_has_features").isNull(), "empty")
                       .when(F.col("matched_count") < min_n, "insufficient").otherwise("ok")))
    ok = F.col("status") == "ok"
    out = out.withColumns({c: F.when(ok, F.col(c)) for c in ("mean_lag_days", "max_lag_days", "share_over_threshold")})
    return out.select(
        "alert_id", "scope_id", "status", "log_count", "matched_count", "mean_lag_days", "max_lag_days",
        "share_over_threshold",
        F.coalesce(F.col("mean_lag_days") > threshold_days, F.lit(False)).alias("is_stale"),
        F.when(ok, F.format_string(fv.SUMMARY_FRESHNESS, F.col("mean_lag_days"), F.col("max_lag_days"),
                                   F.lit(str(threshold_days)))).alias("summary"))
