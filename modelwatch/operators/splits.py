"""Exact order statistics over groups of any size.

A window ordered by value would put a whole group into one task. These helpers cut each group at
values of its own into many ordered buckets, so that the tasks share even one dominant group. The cut
points are chosen by the values' hashes alone: every one of ``slots`` hash slots gives its
smallest-hash value. That is a bounded, order-independent aggregate, so a recomputed task (after a
lost executor) sees the same cuts; any cuts give exact results, as long as all rows see the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOTS = 255


def slot_picks(df: DataFrame, keys: list[str], value: str, *extra: Column, slots: int = SLOTS) -> DataFrame:
    """One cut value per (keys, hash slot), plus any extra aggregates; combines map-side."""
    h = F.xxhash64(F.col(value))
    return (df.groupBy(*keys, F.pmod(h, F.lit(slots)).alias("_slot"))
              .agg(F.min_by(F.col(value), h).alias("_pick"), *extra))


def points_of(pick: str = "_pick") -> Column:
    """Aggregate: the sorted cut values of a group; at most ``slots`` of them."""
    return F.array_sort(F.collect_list(pick))


def place(df: DataFrame, value: str, slots: int = SLOTS, points: str = "_points") -> DataFrame:
    """Replace the cut array by ``_bucket``: how many cut values lie below ``value``.

    A binary search with one projection per step, so that it stays in generated code (a lambda over the
    array would be interpreted, three times slower). Rows without cuts get bucket 0.
    """
    pos = F.col("_bucket")
    df = df.withColumn("_bucket", F.lit(0))
    for step in [1 << b for b in reversed(range(slots.bit_length()))]:
        df = df.withColumn("_bucket", F.when(F.get(points, pos + (step - 1)) < F.col(value), pos + step).otherwise(pos))
    return df.drop(points)
