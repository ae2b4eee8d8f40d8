"""Rows that several test modules make."""

from datetime import datetime


def ts(text):
    return datetime.fromisoformat(text)


ALERT_DDL = ("alert_id string, scope_id string, model_name string, alert_metric string, alert_value double, "
             "alert_ts timestamp_ntz, baseline_start timestamp_ntz, baseline_end timestamp_ntz, "
             "active_start timestamp_ntz, active_end timestamp_ntz")


def alert(spark, scope="s", alert_ts="2026-08-05", model="m",
          windows=("2026-07-01", "2026-07-30", "2026-08-01", "2026-08-10"), alert_id=None):
    return spark.createDataFrame(
        [(alert_id or f"a-{scope}", scope, model, "accuracy", 0.7, ts(alert_ts), *[ts(w) for w in windows])], ALERT_DDL)
