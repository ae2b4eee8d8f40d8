"""Alert windows: one small table, joined to all rows at once."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import session

ROW_BYTES = 400


@dataclass(frozen=True)
class AlertBook:
    """Alerts with their count, number of scopes and outermost times, read in one small action.

    The count decides whether the table may be broadcast; the times become literals in scan filters,
    so that partitions and row groups outside every window are never read.
    """

    frame: DataFrame
    count: int
    start: object
    end: object
    scopes: int = 0

    def meet(self, rows: DataFrame, ts: str, columns: list[str | Column], spans: list[tuple[str, str]]) -> DataFrame:
        """Rows beside the alerts of their scope; ``spans`` names the (start, end) columns that matter.

        Few alerts are broadcast. Too many for that are spread over the days of their spans and joined on
        scope and day: a row then meets only alerts of its day, and a dominant scope is split by day.
        The caller still tests the times themselves.
        """
        alerts = self.frame.select("scope_id", *columns)
        if self.count * ROW_BYTES <= session.BROADCAST_BYTES:
            return rows.join(F.broadcast(alerts), "scope_id")
        days = [F.coalesce(F.sequence(F.to_date(a), F.to_date(b)), F.array().cast("array<date>")) for a, b in spans]
        alerts = alerts.withColumn("_day", F.explode(reduce(F.array_union, days)))
        return rows.withColumn("_day", F.to_date(ts)).join(alerts, ["scope_id", "_day"]).drop("_day")


def alert_book(alerts: DataFrame | AlertBook) -> AlertBook:
    if isinstance(alerts, AlertBook):
        return alerts
    row = alerts.agg(
        F.count(F.lit(1)),
        F.min(F.least("baseline_start", "active_start", "alert_ts")).cast("string"),
        F.max(F.greatest("baseline_end", "active_end", "alert_ts")).cast("string"), F.count_distinct("scope_id")).first()
    return AlertBook(alerts, *row)


def day_pruning(df: DataFrame, start, end, reach: int = 0) -> Column:
    """Condition on ``event_date``, the day of the row's time by which the sinks partition, so that other days' files
    are not listed for reading; true for frames without that column.

    A day is added on both sides, as the day may have been taken in another time zone. A bound of None is open.
    """
    kind = dict(df.dtypes).get("event_date")
    if kind != "date":
        return F.lit(True)
    after = F.lit(True) if start is None else F.col("event_date") >= F.date_sub(F.lit(start).cast("date"), reach + 1)
    before = F.lit(True) if end is None else F.col("event_date") <= F.date_add(F.lit(end).cast("date"), reach + 1)
    return after & before


def within(df: DataFrame, ts: str, start, end) -> Column:
    """``ts`` in [start, end], the bounds as literals of the column's own type (so they push down)."""
    kind = df.schema[ts].dataType
    kind = kind if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)) else T.TimestampNTZType()
    return F.col(ts).between(F.lit(start).cast(kind), F.lit(end).cast(kind)) & day_pruning(df, start, end)


def two_window_slice(rows: DataFrame, alerts: DataFrame | AlertBook, ts: str = "ts",
                     base: tuple[Column, Column] | None = None,
                     target: tuple[Column, Column] | None = None, closed: bool = True) -> DataFrame:
    """Rows of each alert's scope that fall in its baseline or target window, with both flags.

    Windows are closed at both ends and may overlap; ``closed=False`` leaves the upper ends out.
    """
    book = alert_book(alerts)
    b0, b1 = base or (F.col("baseline_start"), F.col("baseline_end"))
    t0, t1 = target or (F.col("active_start"), F.col("active_end"))
    windows = ["alert_id", b0.alias("_b0"), b1.alias("_b1"), t0.alias("_t0"), t1.alias("_t1")]

    def inside(a: str, b: str) -> Column:
        upper = F.col(ts) <= F.col(b) if closed else F.col(ts) < F.col(b)
        return (F.col(ts) >= F.col(a)) & upper

    near = rows.where(within(rows, ts, book.start, book.end))
    return (book.meet(near, ts, windows, [("_b0", "_b1"), ("_t0", "_t1")])
                .withColumns({"in_base": inside("_b0", "_b1"), "in_target": inside("_t0", "_t1")})
                .where(F.col("in_base") | F.col("in_target"))
                .drop("_b0", "_b1", "_t0", "_t1"))
