"""Served values against the values the feature store held at that moment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .asof import HOT_ROWS, pit_join
from .quantiles import exact_median


def served_pairs(logs: DataFrame, view: DataFrame, features: list[str], by: list[str], ts: str = "ts",
                 tie: str | None = None, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """(keys, feature, served, stored) for every served value with a stored counterpart."""
    stored = view.select(*by, ts, *([tie] if tie else []), *[F.col(f).alias(f"_stored_{f}") for f in features])
    joined = pit_join(logs, stored, by, ts, ts, [f"_stored_{f}" for f in features], tie=tie, hot_rows=hot_rows)
    sides = F.array(*[F.struct(F.lit(f).alias("feature_name"), F.col(f).cast("double").alias("served"),
                               F.col(f"_stored_{f}").cast("double").alias("stored")) for f in features])
    keep = [c for c in logs.columns if c not in features]
    return (joined.select(*keep, F.inline(sides))
            .where(F.col("served").isNotNull() & F.col("stored").isNotNull()))


def serving_skew_audit(logs: DataFrame, view: DataFrame, features: list[str], by: list[str],
                       keys: list[str], ts: str = "ts", tie: str | None = None, tolerance: float = 1e-9,
                       max_mismatch: float = 0.05, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Mismatch rate and median served/stored ratio per (keys, feature), from one as-of join."""
    pairs = served_pairs(logs, view, features, by, ts, tie, hot_rows)
    group = [*keys, "feature_name"]
    off = F.abs(F.col("served") - F.col("stored")) > tolerance * F.greatest(F.abs("served"), F.abs("stored"), F.lit(1.0))
    ratios = pairs.select(*group, (F.col("served") / F.nullif(F.col("stored"), F.lit(0.0))).alias("ratio"),
                          off.cast("long").alias("off"), F.lit(1).alias("row"))
    stats = exact_median(ratios, group, "ratio", totals={"matched_count": "row", "mismatches": "off"})
    rate = F.col("mismatches") / F.col("matched_count")
    return stats.select(*group, "matched_count", rate.alias("mismatch_rate"), F.col("median").alias("median_ratio"),
                        (rate > max_mismatch).alias("is_skewed"))
