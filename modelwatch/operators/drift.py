"""Distribution drift of every feature of every alert, in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions.kstest import with_p_value
from ..functions.scalars import usable
from ..schemas import feature_columns, present
from ..session import broadcast_within
from . import cells
from .alerts import AlertBook, alert_book, two_window_slice
from .splits import SLOTS, place, points_of, slot_picks

KEYS = ["alert_id", "feature_name"]


def long_features(sliced: DataFrame, features: list[str]) -> DataFrame:
    """One row per (alert, feature, value) with window flags; null and NaN values dropped.

    Inlined from an array rather than unpivoted: an unpivot hides from the optimizer that keys are not
    null, and the two uses of the counts then differ by a filter and cannot share their shuffle.
    """
    cells = F.array(*[F.struct(F.lit(f).alias("feature_name"), F.col(f).cast("double").alias("v")) for f in features])
    return sliced.select("alert_id", "in_base", "in_target", F.inline(cells)).where(usable(F.col("v")))


def two_window_profile(view: DataFrame, alerts: DataFrame | AlertBook, features: list[str] | None = None,
                       ts: str = "ts") -> DataFrame:
    """Count, mean and population deviation of each feature in both windows."""
    rows = long_features(two_window_slice(view, alerts, ts), features or feature_columns(view))
    in_base, in_target = F.when(F.col("in_base"), F.col("v")), F.when(F.col("in_target"), F.col("v"))
    return rows.groupBy(*KEYS).agg(
        F.count(in_base).alias("baseline_count"), F.count(in_target).alias("target_count"),
        F.avg(in_base).alias("baseline_mean"), F.avg(in_target).alias("target_mean"),
        F.stddev_pop(in_base).alias("baseline_std"), F.stddev_pop(in_target).alias("target_std"))


def value_counts(long: DataFrame) -> DataFrame:
    """How often each value occurs in either window: ties, and with them hot values, collapse map-side."""
    return long.groupBy(*KEYS, "v").agg(
        F.count_if("in_base").alias("cb"), F.count_if("in_target").alias("ct"))


def ks_table(counts: DataFrame, groups: int, slots: int = SLOTS) -> DataFrame:
    """Counts, means, deviations and the two-sample KS distance per (alert, feature), exact.

    ``counts`` is shuffled once more, by (alert, feature, bucket), so that a dominant feature is spread
    over ``slots`` + 1 tasks. Within a bucket the ECDF difference is known up to the bucket's offset;
    its extremes are all that the last, small step needs: max |offset + d| over a bucket is reached at
    the largest or the smallest d.
    """
    heads = (slot_picks(counts, KEYS, "v",
                        F.sum("cb").alias("cb"), F.sum("ct").alias("ct"),
                        F.sum(F.when(F.col("cb") > 0, F.col("v") * F.col("cb"))).alias("sb"), F.sum(F.when(F.col("ct") > 0, F.col("v") * F.col("ct"))).alias("st"),
                        slots=slots)
             .groupBy(*KEYS)
             .agg(points_of().alias("_points"), F.sum("cb").alias("baseline_count"), F.sum("ct").alias("target_count"),
                  (F.sum("sb") / F.nullif(F.sum("cb"), F.lit(0))).alias("baseline_mean"),
                  (F.sum("st") / F.nullif(F.sum("ct"), F.lit(0))).alias("target_mean")))
    heads = broadcast_within(heads, groups, 8 * slots + 200)

    in_bucket = Window.partitionBy(*KEYS, "_bucket").orderBy("v")
    totals = ["baseline_count", "target_count", "baseline_mean", "target_mean"]
    share = lambda num, den: F.col(num) / F.nullif(F.col(den), F.lit(0))
    buckets = (place(counts.join(heads, KEYS), "v", slots)
               .withColumns({"rb": F.sum("cb").over(in_bucket), "rt": F.sum("ct").over(in_bucket)})
               .withColumn("d", share("rb", "baseline_count") - share("rt", "target_count"))
               .groupBy(*KEYS, "_bucket")
               .agg(*[F.first(c).alias(c) for c in totals],
                    F.sum("cb").alias("nb"), F.sum("ct").alias("nt"), F.max("d").alias("dmax"), F.min("d").alias("dmin"),
                    F.sum(F.when(F.col("cb") > 0, F.col("cb")) * F.pow(F.col("v") - F.col("baseline_mean"), F.lit(2))).alias("qb"),
                    F.sum(F.when(F.col("ct") > 0, F.col("ct")) * F.pow(F.col("v") - F.col("target_mean"), F.lit(2))).alias("qt")))

    before = Window.partitionBy(*KEYS).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offset = (F.coalesce(F.sum("nb").over(before), F.lit(0)) / F.nullif(F.col("baseline_count"), F.lit(0))
              - F.coalesce(F.sum("nt").over(before), F.lit(0)) / F.nullif(F.col("target_count"), F.lit(0)))
    return (buckets.withColumn("o", offset)
            .groupBy(*KEYS)
            .agg(*[F.first(c).alias(c) for c in totals],
                 F.sqrt(F.sum("qb") / F.first("baseline_count")).alias("baseline_std"),
                 F.sqrt(F.sum("qt") / F.first("target_count")).alias("target_std"),
                 F.max(F.greatest(F.abs(F.col("o") + F.col("dmax")), F.abs(F.col("o") + F.col("dmin")))).alias("ks_stat")))


def sample_status(n1: Column, n2: Column, min_n: int = fv.MIN_SAMPLES) -> Column:
    """The minimum-sample guard, as a value instead of an error."""
    return F.when(F.least(n1, n2) < min_n, "insufficient").otherwise("ok")


def feature_drift(view: DataFrame, alerts: DataFrame | AlertBook, features: list[str] | None = None,
                  alpha: float = fv.DRIFT_ALPHA, min_n: int = fv.MIN_SAMPLES, p_value: str = "corrected",
                  ts: str = "ts", slots: int = SLOTS, closed: bool = True, by_day: bool | None = None) -> DataFrame:
    """Two-sample KS drift verdict for every (alert, feature).

    A feature that the view lacks, or a window with too few rows, yields a row with a status and no
    verdict; it never stops the other rows. Where a scope has several alerts (or ``by_day`` says so) their windows are composed
    from day cells, which are counted once and stored; otherwise each window's rows are counted apart, in one lazy plan. Both give the same.
    """
    book = alert_book(alerts)
    features = features or feature_columns(view)
    known = present(view, features)
    pairs = (book.frame.select("alert_id", "scope_id", F.posexplode(F.array(*[F.lit(f) for f in features])))
             .withColumnRenamed("pos", "feature_pos").withColumnRenamed("col", "feature_name"))
    if not known:
        stats = pairs.select(*KEYS, *[F.lit(None).cast("double").alias(c) for c in (
            "baseline_count", "target_count", "baseline_mean", "target_mean", "baseline_std", "target_std", "ks_stat")])
    elif book.count and (book.count > book.scopes if by_day is None else by_day):
        stats = cells.ks_of_windows(*cells.stored_cells(view, book, known, ts, closed), known, slots)
    else:
        long = long_features(two_window_slice(view, book, ts, closed=closed), known)
        stats = ks_table(value_counts(long), book.count * len(known), slots)

    n1, n2 = [F.coalesce(F.col(c).cast("long"), F.lit(0)) for c in ("baseline_count", "target_count")]
    missing = F.lit(False) if len(known) == len(features) else ~F.col("feature_name").isin(*known)
    rows = (pairs.join(stats, KEYS, "left").withColumns({
        "baseline_count": n1, "target_count": n2,
        "status": F.when(missing, "missing_feature").otherwise(sample_status(n1, n2, min_n))}))
    ok = F.col("status") == "ok"
    measured = ["baseline_mean", "target_mean", "baseline_std", "target_std", "ks_stat"]
    rows = with_p_value(rows.withColumns({c: F.when(ok, F.col(c)) for c in measured}), p_value)
    return rows.select(
        "alert_id", "scope_id", "feature_name", "feature_pos", "status", "baseline_count", "target_count", *measured,
        F.when(ok, F.col("p_value")).alias("p_value"),
        F.coalesce(ok & (F.col("p_value") < alpha), F.lit(False)).alias("is_drifted"),
        F.when(ok, F.format_string(fv.SUMMARY_DRIFT, "feature_name", "baseline_mean", "target_mean", "p_value"))
         .alias("summary"))
