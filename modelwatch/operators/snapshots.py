"""Carry-forward snapshots of a feature view: each entity's latest row as a day begins.

With them an as-of join of a time window reads the window's own days and one snapshot, however long the view's history is. A snapshot
is made from the one before it and the days in between, so no step reads more than that either.
"""

from __future__ import annotations

import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .alerts import day_pruning
from .asof import HOT_ROWS, latest, pit_join


def between_days(view: DataFrame, ts: str, first: datetime.date | None, after: Column | datetime.datetime | datetime.date | None) -> DataFrame:
    """Rows from the start of day ``first`` to before ``after``; both bounds prune ``event_date`` where the view has it."""
    kind = view.schema[ts].dataType
    if first is not None:
        view = view.where((F.col(ts) >= F.lit(first).cast(kind)) & day_pruning(view, first, None))
    if after is not None:
        view = view.where((F.col(ts) < F.lit(after).cast(kind)) & day_pruning(view, None, after))
    return view


def snapshot_days(spark: SparkSession, path: str) -> list[datetime.date]:
    """Days that have a snapshot below ``path``, oldest first; read from the folder names."""
    try:
        days = spark.read.parquet(path).select("snapshot_date").distinct().collect()
    except AnalysisException as missing:
        if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return []
    return sorted(r.snapshot_date for r in days)


def take_snapshots(view: DataFrame, path: str, days: list[datetime.date], by: list[str], features: list[str], ts: str = "ts", tie: str | None = None) -> None:
    """Write, for each day, the latest row of each entity before the day begins, into ``path/snapshot_date=<day>``.

    Days are done in order; each starts from the newest earlier snapshot and reads only the view's days since. A day that is there already is
    written anew, as a whole. Rows that arrive late, with times before a snapshot, enter those that are taken again.
    Rows without time or entity are in none. Equal times go to the highest ``tie``.
    """
    spark = view.sparkSession
    columns = [*by, ts, *([tie] if tie else []), *features]
    known = view.where(F.col(ts).isNotNull())
    for c in by:
        known = known.where(F.col(c).isNotNull())
    done = snapshot_days(spark, path)
    for day in sorted(days):
        earlier = max((d for d in done if d < day), default=None)
        rows = between_days(known, ts, earlier, day).select(*columns)
        if earlier is not None:
            rows = rows.unionByName(spark.read.parquet(path).where(F.col("snapshot_date") == F.lit(earlier)).select(*columns))
        newest = latest(rows, by, ts, [c for c in columns if c not in by and c != ts], tie=None if tie is None else tie)
        newest.select(*columns).write.mode("overwrite").parquet(f"{path}/snapshot_date={day.isoformat()}")
        done = sorted({*done, day})


def bounded_view(view: DataFrame, path: str, start: datetime.datetime, end: datetime.datetime, columns: list[str], ts: str = "ts") -> DataFrame:
    """What an as-of of times in [start, end] can match: one snapshot, and the view's rows from its day to ``end``.

    Without a snapshot at or before ``start`` the view is read from its beginning.
    """
    spark = view.sparkSession
    first = max((d for d in snapshot_days(spark, path) if d <= start.date()), default=None)
    kind = view.schema[ts].dataType
    rows = between_days(view, ts, first, None).where((F.col(ts) <= F.lit(end).cast(kind)) & day_pruning(view, None, end)).select(*columns)
    if first is None:
        return rows
    return rows.unionByName(spark.read.parquet(path).where(F.col("snapshot_date") == F.lit(first)).select(*columns))


def pit_join_within(left: DataFrame, view: DataFrame, path: str, start: datetime.datetime, end: datetime.datetime, by: list[str], features: list[str], ts: str = "ts",
                    tie: str | None = None, matched_ts: str | None = None, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """``pit_join`` of the left rows with times in [start, end], its right side bounded by a snapshot. Rows outside are left out."""
    kind = left.schema[ts].dataType
    asked = left.where(F.col(ts).between(F.lit(start).cast(kind), F.lit(end).cast(kind)) & day_pruning(left, start, end))
    right = bounded_view(view, path, start, end, [*by, ts, *([tie] if tie else []), *features], ts)
    return pit_join(asked, right, by, ts, ts, features, tie, matched_ts, hot_rows)
