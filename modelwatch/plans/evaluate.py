"""Labelled scenarios, and how well investigations answer them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions.scalars import hash_slot
from ..operators.logs import latest_investigation


def scenario_table(ids: DataFrame, ordinal: str = "ordinal", scenario_id: str | None = None,
                   first_day: str = "2026-08-03", days: int = 6, seed: str = "42") -> DataFrame:
    """One scenario per id: failure modes in turn, a repeatable injection day, expected evidence by mode."""
    modes = F.array(*[F.struct(
        F.lit(mode).alias("mode"), F.lit(feature).cast("string").alias("feature"),
        F.array(*[F.lit(e) for e in expected]).cast("array<string>").alias("expected"), F.lit(text).alias("text"))
        for mode, feature, expected, text in fv.SCENARIO_MODES])
    name = F.col(scenario_id) if scenario_id else F.format_string("sc_%03d", F.col(ordinal))
    return (ids.withColumn("scenario_id", name)
            .withColumn("_m", F.element_at(modes, (F.pmod(F.col(ordinal) - 1, F.lit(len(fv.SCENARIO_MODES))) + 1).cast("int")))
            .select("scenario_id", F.col("_m.mode").alias("injected_failure"), F.col("_m.feature").alias("injected_feature"),
                    F.date_add(F.lit(first_day).cast("date"), hash_slot(F.col("scenario_id"), seed, days).cast("int"))
                     .alias("injection_date"),
                    F.col("_m.text").alias("true_root_cause"), F.col("_m.expected").alias("evidence_should_include"),
                    F.lit(None).cast("string").alias("git_commit_hash")))


def evidence_types(evidence: DataFrame) -> DataFrame:
    """The distinct evidence types of each investigation (at most as many as there are detectors)."""
    return evidence.groupBy("investigation_id").agg(F.collect_set("evidence_type").alias("types"))


def covered(expected: Column, types: Column) -> Column:
    """Every expected kind that is known has its evidence type among those logged."""
    known = F.create_map(*[F.lit(x) for kv in fv.EXPECTED_EVIDENCE_TYPES.items() for x in kv])
    return F.forall(expected, lambda e: F.try_element_at(known, e).isNull()
                    | F.array_contains(types, F.try_element_at(known, e)))


def evidence_coverage(scenarios: DataFrame, investigations: DataFrame, evidence: DataFrame) -> DataFrame:
    """Does the latest investigation of each scenario log all expected evidence? Without one: no."""
    newest = latest_investigation(investigations).withColumnRenamed("scope_id", "scenario_id")
    empty = F.array().cast("array<string>")
    return (scenarios.select("scenario_id", "injected_failure", "evidence_should_include")
            .join(newest, "scenario_id", "left")
            .join(evidence_types(evidence), "investigation_id", "left")
            .withColumn("types", F.coalesce("types", empty))
            .withColumn("evidence_correct", F.col("investigation_id").isNotNull()
                        & covered(F.col("evidence_should_include"), F.col("types"))))


def score(investigations: DataFrame, evidence: DataFrame, scenarios: DataFrame,
          latency: Column | None = None) -> DataFrame:
    """Result rows: predicted against injected failure, evidence coverage, confidence and latency.

    Latency is a column of the investigation rows (default: run time minus alert time, in seconds);
    a scenario without investigation counts as a wrong answer with confidence 0.
    """
    if latency is None:
        latency = F.timestamp_diff("MICROSECOND", "alert_ts", "ts") / F.lit(1e6)
    rows = evidence_coverage(scenarios, investigations, evidence).withColumn("latency_sec", latency)
    return rows.select(
        "scenario_id", F.col("injected_failure").alias("failure_mode"),
        F.coalesce("cause", F.lit("error")).alias("predicted_cause"),
        F.coalesce(F.col("cause") == F.col("injected_failure"), F.lit(False)).alias("is_correct"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        F.coalesce("latency_sec", F.lit(0.0)).alias("latency_sec"), "evidence_correct",
        F.coalesce("reasoning", F.lit("")).alias("reasoning"))


def _percent(flag: str) -> Column:
    return F.coalesce(F.avg(F.col(flag).cast("double")) * 100, F.lit(0.0))


def summary(results: DataFrame) -> DataFrame:
    """Totals; zeros for an empty set."""
    control = F.when(F.col("failure_mode") == fv.CONTROL, (~F.col("is_correct")).cast("double"))
    return results.agg(
        F.count(F.lit(1)).alias("total_evaluated"), _percent("is_correct").alias("overall_accuracy"),
        _percent("evidence_correct").alias("evidence_correctness"),
        F.coalesce(F.avg(control) * 100, F.lit(0.0)).alias("false_hypothesis_rate"),
        F.coalesce(F.avg("latency_sec"), F.lit(0.0)).alias("mean_latency"))


def breakdown(results: DataFrame) -> DataFrame:
    """Totals (failure_type null) and one row per failure mode, in one pass."""
    return (results.groupingSets([[], [F.col("failure_mode")]], F.col("failure_mode"))
            .agg(F.count(F.lit(1)).alias("count"), _percent("is_correct").alias("accuracy"),
                 _percent("evidence_correct").alias("evidence_correctness"), F.avg("latency_sec").alias("avg_latency"))
            .withColumnRenamed("failure_mode", "failure_type"))
