"""Point-in-time joins and latest-row lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import present
from ..session import broadcast_within
from .splits import SLOTS, place, points_of, slot_picks

HOT_ROWS = 5_000_000
MOST_HOT = 8192
LOST_SLOTS = 4096
MAX_IN_LIST = 500


def _hot_points(rows: DataFrame, keys: list[str], hot_rows: int, slots: int) -> DataFrame:
    """Entities with more than ``hot_rows`` rows, each with its time cuts; the MOST_HOT largest of them.

    Nothing runs before the join does. An entity beyond the largest MOST_HOT holds less than one in MOST_HOT of all rows, so
    it keeps no task busy alone; the limit bounds what is broadcast to MOST_HOT * (8 * slots + 64) bytes.
    """
    hot = rows.groupBy(*keys).count().where(F.col("count") > hot_rows).orderBy(F.desc("count"), *keys).limit(MOST_HOT).select(*keys)
    picks = slot_picks(rows.join(F.broadcast(hot), keys, "left_semi"), keys, "_t", slots=slots)
    return picks.groupBy(*keys).agg(points_of().alias("_points"))


def _tie_break(tie: str | None, features: list[str]) -> Column:
    """Orders rows of equal time: the tie column, else a content hash (rows without content are alike)."""
    if tie:
        return F.col(tie).cast("long")
    return F.xxhash64(*features) if features else F.lit(0).cast("long")


def pit_join(left: DataFrame, right: DataFrame, by: list[str] | str, left_ts: str = "ts", right_ts: str = "ts",
             features: list[str] | None = None, tie: str | None = None, matched_ts: str | None = None,
             hot_rows: int | None = HOT_ROWS, slots: int = SLOTS) -> DataFrame:
    """Each left row with the features of the latest right row at or before its time, per entity.

    Both sides go into one union that is sorted once per entity; the latest right row travels down as
    one struct, so that a null feature stays null instead of being filled from an older row. Right rows
    without time or entity cannot match; left rows without a match keep null features. Of right rows
    with equal times the highest ``tie`` wins (without a tie column: a fixed pick by content hash).

    Entities above ``hot_rows`` rows are cut at ``slots`` times into buckets of their own; each bucket
    starts from the closing row of the buckets before it, so the result is the same. Finding them costs
    one pre-aggregated pass over the key columns, inside the same action; where none is found, adaptive execution drops the rest
    of that branch. ``hot_rows=None`` leaves it out.
    """
    by = [by] if isinstance(by, str) else list(by)
    features = present(right, features if features is not None else
                       [c for c in right.columns if c not in by and c not in (right_ts, tie)])
    clash = set(features) & set(left.columns)
    if clash:
        raise ValueError(f"feature names already used on the left side: {sorted(clash)}")
    keys = [f"_k{i}" for i in range(len(by))]
    payload = F.struct(*features, F.col(right_ts).alias("_matched"))
    order = _tie_break(tie, features)
    known = right.where(F.col(right_ts).isNotNull())
    for c in by:
        known = known.where(F.col(c).isNotNull())
    r = known.select(*[F.col(c).alias(k) for c, k in zip(by, keys)], F.col(right_ts).alias("_t"),
                     F.lit(0).alias("_side"), order.alias("_q"), payload.alias("_r"))
    l = left.select(*[F.col(c).alias(k) for c, k in zip(by, keys)], F.col(left_ts).alias("_t"),
                    F.lit(1).alias("_side"), F.lit(None).cast("long").alias("_q"), F.struct("*").alias("_l"))
    # Left rows without entity or time match nothing, wherever they are: spread them over many tasks.
    lost = F.col("_t").isNull()
    for k in keys:
        lost = lost | F.col(k).isNull()
    l = l.withColumn("_salt", F.when(lost, 1 + F.pmod(F.xxhash64("_l"), F.lit(LOST_SLOTS))).otherwise(0))
    rows = l.unionByName(r.withColumn("_salt", F.lit(0).cast("long")), allowMissingColumns=True)

    parts = [*keys, "_salt"]
    if hot_rows is not None:
        points = F.broadcast(_hot_points(rows.where(~lost).select(*keys, "_t"), keys, hot_rows, slots))
        rows = place(rows.join(points, keys, "left").withColumn("_hot", F.col("_points").isNotNull()), "_t", slots)
        rows = rows.unionByName(_carried(rows, keys), allowMissingColumns=True)
        parts.append("_bucket")

    w = (Window.partitionBy(*parts).orderBy("_t", "_side", "_q")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = rows.withColumn("_m", F.last("_r", ignorenulls=True).over(w)).where(F.col("_side") == 1)
    out = [F.col(f"_m.{f}").alias(f) for f in features]
    if matched_ts:
        out.append(F.col("_m._matched").alias(matched_ts))
    return found.select("_l.*", *out)


def _carried(rows: DataFrame, keys: list[str]) -> DataFrame:
    """For every bucket of a hot entity: the last right row of the buckets before it, sorted first."""
    stamp = F.when(F.col("_side") == 0, F.struct("_t", "_q"))
    closing = (rows.where("_hot")
               .groupBy(*keys, "_bucket").agg(F.max_by("_r", stamp).alias("_r")))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    return (closing.withColumn("_r", F.last("_r", ignorenulls=True).over(before))
            .where(F.col("_r").isNotNull())
            .withColumns({"_side": F.lit(0), "_salt": F.lit(0).cast("long")}))


def latest(view: DataFrame, by: list[str] | str, ts: str = "ts", features: list[str] | None = None,
           ids: list | DataFrame | None = None, tie: str | None = None) -> DataFrame:
    """The newest row of each entity; equal times go to the highest ``tie``.

    ``ids`` restricts the entities: a short list (pushed to the scan), a long list or a frame (semi
    join). An empty list gives an empty result. The rank filter keeps one row per entity already map-side.
    """
    by = [by] if isinstance(by, str) else list(by)
    keep = present(view, features if features is not None else
                   [c for c in view.columns if c not in by and c not in (ts, tie)])
    if isinstance(ids, DataFrame):
        view = view.join(ids, by, "left_semi")
    elif ids is not None and len(ids) > MAX_IN_LIST:
        wanted = view.sparkSession.createDataFrame([(i,) for i in ids], view.select(by[0]).schema)
        view = view.join(broadcast_within(wanted, len(ids), 64), by[0], "left_semi")
    elif ids is not None:
        view = view.where(F.col(by[0]).isin(list(ids))) if ids else view.where(F.lit(False))
    order = [F.col(ts).desc_nulls_last()]
    order.append(_tie_break(tie, keep).desc_nulls_last())
    w = Window.partitionBy(*by).orderBy(*order)
    return view.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).select(*by, ts, *keep)


def before_after(df: DataFrame, cutover: Column | str, ts: str = "ts") -> DataFrame:
    """Flag the rows from the cutover day on."""
    return df.withColumn("after", F.to_date(ts) >= F.lit(cutover).cast("date"))
