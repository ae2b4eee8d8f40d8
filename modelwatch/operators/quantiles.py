"""Exact medians of groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import broadcast_within, stored
from .splits import SLOTS, place, points_of, slot_picks


def exact_median(df: DataFrame, keys: list[str], value: str, slots: int = SLOTS,
                 totals: dict[str, str] | None = None) -> DataFrame:
    """Median (mean of the two middle values) of ``value`` per group, nulls skipped.

    Equal values collapse first; bucket totals tell which bucket holds the middle ranks, and only that
    bucket's values are ranked. The collapsed values and the cuts are each used several times, so they
    are stored; the number of groups is then known, and with it whether the cuts may be broadcast.
    ``totals`` (new name -> column) are summed over all rows of each group on the way.
    """
    totals = totals or {}
    counts = stored(df.groupBy(*keys, F.col(value).alias("v")).agg(
        F.count(F.col(value)).alias("c"), *[F.sum(c).alias(name) for name, c in totals.items()]), "counts")
    heads = (slot_picks(counts, keys, "v", F.sum("c").alias("c"), *[F.sum(n).alias(n) for n in totals], slots=slots)
             .groupBy(*keys).agg(points_of().alias("_points"), F.sum("c").alias("n"), *[F.sum(n).alias(n) for n in totals]))
    heads = stored(heads, "cuts")
    points = broadcast_within(heads.select(*keys, "_points", "n"), heads.count(), 8 * slots + 64)
    placed = place(counts.where(F.col("v").isNotNull()).select(*keys, "v", "c").join(points, keys), "v", slots)
    up_to = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    low, high = F.floor((F.col("n") + 1) / 2), F.ceil((F.col("n") + 1) / 2)
    middle = (placed.groupBy(*keys, "_bucket").agg(F.sum("c").alias("_in"), F.first("n").alias("n"))
              .withColumn("_end", F.sum("_in").over(up_to)).withColumn("_start", F.col("_end") - F.col("_in"))
              .where((F.col("_end") >= low) & (F.col("_start") < high))
              .select(*keys, "_bucket", "_start"))
    rank = Window.partitionBy(*keys, "_bucket").orderBy("v")
    ranked = (placed.join(middle, [*keys, "_bucket"])
              .withColumn("_to", F.col("_start") + F.sum("c").over(rank))
              .withColumn("_from", F.col("_to") - F.col("c"))
              .where((F.col("_to") >= low) & (F.col("_from") < high)))
    medians = ranked.groupBy(*keys).agg(F.avg("v").alias("median"))
    return heads.select(*keys, *totals).join(medians, keys, "left") if totals else medians
