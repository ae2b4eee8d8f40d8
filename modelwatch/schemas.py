"""Table schemas and run-time discovery of feature columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import fixed_values as fv

KEY_COLUMNS = {"scope_id", "entity_id", "ts", "ingest_seq", "event_date", "scope_bucket", "event_id",
               "prediction", "probability", "true_label"}

MODEL_VERSIONS = T.StructType([
    T.StructField("scope_id", T.StringType()),
    T.StructField("model_name", T.StringType()),
    T.StructField("version", T.IntegerType()),
    T.StructField("run_id", T.StringType()),
    T.StructField("params", T.MapType(T.StringType(), T.StringType())),
    T.StructField("metrics", T.MapType(T.StringType(), T.DoubleType())),
])

FILE_DIFF = T.StructType([
    T.StructField("file_path", T.StringType()),
    T.StructField("deleted_file", T.BooleanType()),
    T.StructField("new_file", T.BooleanType()),
    T.StructField("diff_text", T.StringType()),
])

COMMITS = T.StructType([
    T.StructField("scope_id", T.StringType()),
    T.StructField("commit_hash", T.StringType()),
    T.StructField("author", T.StringType()),
    T.StructField("committed_at", T.TimestampNTZType()),
    T.StructField("message", T.StringType()),
    T.StructField("changed_files", T.ArrayType(T.StringType())),
    T.StructField("diffs", T.ArrayType(FILE_DIFF)),
])

ALERTS = T.StructType([
    T.StructField("alert_id", T.StringType()),
    T.StructField("scope_id", T.StringType()),
    T.StructField("model_name", T.StringType()),
    T.StructField("alert_metric", T.StringType()),
    T.StructField("alert_value", T.DoubleType()),
    T.StructField("alert_ts", T.TimestampNTZType()),
    T.StructField("baseline_start", T.TimestampNTZType()),
    T.StructField("baseline_end", T.TimestampNTZType()),
    T.StructField("active_start", T.TimestampNTZType()),
    T.StructField("active_end", T.TimestampNTZType()),
])

SERVING_LOGS = T.StructType([
    T.StructField("scope_id", T.StringType()),
    T.StructField("id", T.LongType()),
    T.StructField("entity_id", T.StringType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("income_band", T.IntegerType()),
    T.StructField("credit_score", T.IntegerType()),
    T.StructField("debt_to_income", T.DoubleType()),
    T.StructField("employment_years", T.IntegerType()),
    T.StructField("prediction", T.IntegerType()),
    T.StructField("probability", T.DoubleType()),
    T.StructField("true_label", T.IntegerType()),
])

INVESTIGATIONS = T.StructType([
    T.StructField("investigation_id", T.StringType()),
    T.StructField("alert_id", T.StringType()),
    T.StructField("scope_id", T.StringType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("alert_metric", T.StringType()),
    T.StructField("alert_value", T.DoubleType()),
    T.StructField("alert_ts", T.TimestampNTZType()),
    T.StructField("status", T.StringType()),
    T.StructField("cause", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("ruled_out", T.ArrayType(T.StringType())),
    T.StructField("reasoning", T.StringType()),
])

EVIDENCE_RECORDS = T.StructType([
    T.StructField("investigation_id", T.StringType()),
    T.StructField("scope_id", T.StringType()),
    T.StructField("step", T.IntegerType()),
    T.StructField("position", T.LongType()),
    T.StructField("hypothesis", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("evidence_type", T.StringType()),
    T.StructField("evidence_summary", T.StringType()),
    T.StructField("evidence_data", T.VariantType()),
])

SCENARIOS = T.StructType([
    T.StructField("scenario_id", T.StringType()),
    T.StructField("injected_failure", T.StringType()),
    T.StructField("injected_feature", T.StringType()),
    T.StructField("injection_date", T.DateType()),
    T.StructField("true_root_cause", T.StringType()),
    T.StructField("evidence_should_include", T.ArrayType(T.StringType())),
    T.StructField("git_commit_hash", T.StringType()),
])

RESULTS = T.StructType([
    T.StructField("scenario_id", T.StringType()),
    T.StructField("failure_mode", T.StringType()),
    T.StructField("predicted_cause", T.StringType()),
    T.StructField("is_correct", T.BooleanType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("latency_sec", T.DoubleType()),
    T.StructField("evidence_correct", T.BooleanType()),
    T.StructField("reasoning", T.StringType()),
])


def feature_columns(df: DataFrame) -> list[str]:
    """Numeric columns of a view that are neither keys nor metadata; a default list if none."""
    skip = KEY_COLUMNS | set(fv.EXCLUDED_COLUMNS)
    found = [f.name for f in df.schema if f.name not in skip and isinstance(f.dataType, T.NumericType)]
    return found or list(fv.DEFAULT_FEATURES)


def present(df: DataFrame, names: list[str]) -> list[str]:
    """The requested names that exist, in request order."""
    return [n for n in names if n in df.columns]
