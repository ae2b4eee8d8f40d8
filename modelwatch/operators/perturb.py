"""Repeatable failure injection on real tables, to test detectors at any scale.

Rows are chosen by an md5 slot of their key and a seed, so the choice does not depend on partitioning
and any SQL engine can repeat it. Only rows from the cutover day on change.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions.scalars import hash_slot
from ..session import broadcast_within, stored


def after(cutover: Column | str, ts: str = "ts") -> Column:
    """From the cutover day on; a null cutover (scope not affected) is never reached."""
    return F.coalesce(F.to_date(ts) >= F.lit(cutover).cast("date"), F.lit(False))


def weighted_band(key: Column, seed: str, weights: list[int]) -> Column:
    """Band 1..n drawn from weights per thousand."""
    slot = hash_slot(key, seed)
    band, edge = F.lit(len(weights)), sum(weights)
    for i in range(len(weights) - 1, 0, -1):
        edge -= weights[i]
        band = F.when(slot < edge, F.lit(i)).otherwise(band)
    return band


def shift_band(df: DataFrame, column: str, key: str, cutover: Column | str, ts: str = "ts", seed: str = "band",
               weights: list[int] | None = None) -> DataFrame:
    """Draw a discrete feature anew from shifted weights."""
    drawn = weighted_band(F.col(key), seed, weights or fv.BAND_WEIGHTS_SHIFTED)
    return df.withColumn(column, F.when(after(cutover, ts), drawn).otherwise(F.col(column)))


def zero_fraction(df: DataFrame, column: str, key: str, cutover: Column | str, ts: str = "ts", seed: str = "zero",
                  per_thousand: int = fv.ZEROED_PER_THOUSAND) -> DataFrame:
    """Set a share of a feature's values to 0."""
    hit = after(cutover, ts) & (hash_slot(F.col(key), seed) < per_thousand)
    return df.withColumn(column, F.when(hit, F.lit(0).cast(df.schema[column].dataType)).otherwise(F.col(column)))


def rescale(df: DataFrame, column: str, cutover: Column | str, ts: str = "ts", factor: float = fv.UNIT_FACTOR) -> DataFrame:
    """Multiply a served value (a unit mix-up)."""
    return df.withColumn(column, F.when(after(cutover, ts), F.col(column) * factor).otherwise(F.col(column)))


def thin_positives(df: DataFrame, label: str, key: str, cutover: Column | str, ts: str = "ts", seed: str = "thin",
                   keep_per_thousand: int = int(fv.LABEL_SHIFT_FACTOR * 1000)) -> DataFrame:
    """Turn positives into negatives, keeping a share."""
    hit = after(cutover, ts) & (F.col(label) == 1) & (hash_slot(F.col(key), seed) >= keep_per_thousand)
    return df.withColumn(label, F.when(hit, F.lit(0).cast(df.schema[label].dataType)).otherwise(F.col(label)))


def withhold_updates(view: DataFrame, cutover: Column | str, ts: str = "ts") -> DataFrame:
    """Drop the updates from the cutover day on (a stopped feed)."""
    return view.where(~after(cutover, ts))


def shuffle_labels(df: DataFrame, label: str, key: str, group: str = "scope_id", seed: str = "shuffle",
                   digits: int = 3) -> DataFrame:
    """A permutation of the label column within each group: every row takes the label of the next one in md5 order, the
    last that of the first.

    The order is cut by its first ``digits`` hexadecimal digits, so that no task sorts a whole group; the last row
    of a cut takes the label that opens the next one. The result is the same for any number of digits and rows.
    """
    order = F.md5(F.concat(F.lit(seed), F.coalesce(F.col(key).cast("string"), F.lit(""))))
    spread = df.withColumn("_h", order).withColumn("_slot", F.substring("_h", 1, digits))
    box = F.struct(F.col(label).alias("x"))
    place = F.struct("_h", key)
    by_slot = Window.partitionBy("_g").orderBy("_s")
    heads = (spread.groupBy(F.col(group).alias("_g"), F.col("_slot").alias("_s")).agg(F.min_by(box, place).alias("_head"))
             .withColumn("_next", F.coalesce(F.lead("_head").over(by_slot),
                                             F.first("_head").over(by_slot.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))))
    inner = Window.partitionBy(group, "_slot").orderBy("_h", key)
    moved = spread.withColumn("_lead", F.lead(box).over(inner))
    return (moved.join(heads, moved[group].eqNullSafe(heads["_g"]) & (moved["_slot"] == heads["_s"]))
            .withColumn(label, F.coalesce("_lead", "_next")["x"]).drop("_g", "_s", "_h", "_slot", "_head", "_next", "_lead"))
