"""Day cells: mergeable counts from which every window of every alert is composed.

A scope's time is cut into days, and a day only where some window begins or ends inside it. Rows are counted once per
(scope, unit, feature, value), whatever the number of alerts; a window is a run of consecutive units. Windows that overlap share
their cells, so rows are never multiplied by alerts, and rows meet only the cuts of their own scope and day: a dominant
scope is spread over its days.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import usable
from ..session import broadcast_within, stored
from .alerts import AlertBook, within
from .splits import SLOTS, place, points_of, slot_picks

#: Units of one day; cuts inside a day are numbered below it.
DAY_SPAN = 1 << 32
#: Cells of one (scope, feature) that a single task takes; beyond it the feature is cut by value. Cells that one task handles together.
HOT_CELLS, TASK_CELLS = 1_000_000, 500_000
#: Numbers that a task holds in one table of (values, units) or (values, alerts).
TABLE_CELLS = 2_000_000


def _instant(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("timestamp_ntz")


def _position(at: Column) -> Column:
    """How many cuts of the day lie before an instant: those that take their own instant with them, and those that leave it behind."""
    return F.size(F.filter("befores", lambda s: s <= at)) + F.size(F.filter("afters", lambda e: e < at))


def _unit(day: Column, position: Column) -> Column:
    return F.unix_date(day).cast("long") * DAY_SPAN + position


@dataclass(frozen=True)
class UnitWindows:
    """Windows as runs of units.

    days: (scope_id, day, befores, afters), every day that a window touches, with the cuts inside it.
    spans: (alert_id, scope_id, lo0, hi0, lo1, hi1), the units of baseline and target; an empty window has lo > hi.
    """

    days: DataFrame
    spans: DataFrame
    day_rows: int


def unit_windows(book: AlertBook, base: tuple[Column, Column] | None = None, target: tuple[Column, Column] | None = None,
                 closed: bool = True) -> UnitWindows:
    """Cut the alerts' windows. Windows with a missing end, or that end before they begin, hold nothing."""
    b0, b1 = base or (F.col("baseline_start"), F.col("baseline_end"))
    t0, t1 = target or (F.col("active_start"), F.col("active_end"))
    sides = F.array(*[F.struct(F.lit(side).alias("side"), _instant(a).alias("a"), _instant(b).alias("b")) for side, a, b in ((0, b0, b1), (1, t0, t1))])
    windows = book.frame.select("alert_id", "scope_id", F.inline(sides)).where("a <= b")
    touched = windows.select("scope_id", "a", "b", F.explode(F.sequence(F.to_date("a"), F.to_date("b"))).alias("day"))
    inner = lambda c: (F.to_date(c) == F.col("day")) & (F.col(c) != _instant("day"))  # noqa: E731  midnight cuts nothing
    start = F.array(F.when(inner("a"), F.col("a")), *([] if closed else [F.when(inner("b"), F.col("b"))]))
    end = F.array(F.when(F.to_date("b") == F.col("day"), F.col("b"))) if closed else F.array().cast("array<timestamp_ntz>")
    days = stored(touched.select("scope_id", "day", start.alias("s"), end.alias("e")).groupBy("scope_id", "day").agg(
        F.array_compact(F.array_distinct(F.flatten(F.collect_set("s")))).alias("befores"), F.array_compact(F.array_distinct(F.flatten(F.collect_set("e")))).alias("afters")), "days")
    at = lambda c, shift: _unit(F.to_date(c), _position(F.col(c)) - shift)
    cuts = days.withColumnRenamed("day", "_day")
    lo = windows.join(cuts, (windows["scope_id"] == cuts["scope_id"]) & (F.to_date("a") == F.col("_day"))).select(
        "alert_id", windows["scope_id"], "side", at("a", 0).alias("lo"), "b")
    both = lo.join(cuts, (lo["scope_id"] == cuts["scope_id"]) & (F.to_date("b") == F.col("_day"))).select(
        "alert_id", lo["scope_id"], "side", "lo", at("b", 0 if closed else 1).alias("hi"))
    pick = lambda side, c, none: F.coalesce(F.max(F.when(F.col("side") == side, F.col(c))), F.lit(none)).alias(f"{c}{side}")
    spans = both.groupBy("alert_id", "scope_id").agg(pick(0, "lo", 1), pick(0, "hi", 0), pick(1, "lo", 1), pick(1, "hi", 0))
    return UnitWindows(days, stored(spans, "spans"), days.count())


def with_units(rows: DataFrame, windows: UnitWindows, ts: str = "ts") -> DataFrame:
    """The rows inside some window's days, with the unit each lies in."""
    days = broadcast_within(windows.days.withColumnRenamed("day", "_day"), windows.day_rows, 96)
    placed = rows.withColumn("_day", F.to_date(ts)).join(days, ["scope_id", "_day"])
    return placed.withColumn("unit", _unit(F.col("_day"), _position(_instant(ts)))).drop("_day", "befores", "afters")


def day_cells(rows: DataFrame, features: list[str], windows: UnitWindows, ts: str = "ts") -> DataFrame:
    """(scope_id, feature_name, unit, v, n): how often each usable value occurs; cells of disjoint rows add up."""
    values = F.array(*[F.struct(F.lit(f).alias("feature_name"), F.col(f).cast("double").alias("v")) for f in features])
    return (with_units(rows.select("scope_id", ts, *features), windows, ts).select("scope_id", "unit", F.inline(values)).where(usable(F.col("v")))
            .groupBy("scope_id", "feature_name", "unit", "v").agg(F.count(F.lit(1)).alias("n")))


def in_windows(units: DataFrame, windows: UnitWindows) -> DataFrame:
    """``units`` (scope_id, unit, ...) beside the alerts whose windows hold them, with flags; joined on scope and day."""
    lo, hi = F.least(*[F.when(F.col(f"lo{s}") <= F.col(f"hi{s}"), F.col(f"lo{s}")) for s in (0, 1)]), F.greatest(*[F.when(F.col(f"lo{s}") <= F.col(f"hi{s}"), F.col(f"hi{s}")) for s in (0, 1)])
    day = lambda unit: F.floor(unit / DAY_SPAN)
    spread = windows.spans.where(lo.isNotNull()).withColumn("_day", F.explode(F.sequence(day(lo), day(hi))))
    inside = lambda s: F.col("unit").between(F.col(f"lo{s}"), F.col(f"hi{s}"))
    return (units.withColumn("_day", day(F.col("unit"))).join(spread, ["scope_id", "_day"])
            .withColumns({"in_base": inside(0), "in_target": inside(1)}).where("in_base OR in_target").drop("_day", "lo0", "hi0", "lo1", "hi1"))


# ---- Kolmogorov-Smirnov distances and moments of all alerts over one feature ------------------------------------


def _moments(v: np.ndarray, n: np.ndarray, unit: np.ndarray, units: int) -> tuple[np.ndarray, ...]:
    """Per unit: count, mean and squared deviations of the finite values, and how many are +inf and -inf."""
    finite = np.isfinite(v)
    w = np.where(finite, n, 0)
    x = np.where(finite, v, 0.0)
    total = np.bincount(unit, w, units)
    mean = np.bincount(unit, w * x, units) / np.maximum(total, 1)
    off = np.bincount(unit, w * (x - mean[unit]) ** 2, units)
    return total, mean, off, np.bincount(unit, np.where(v == np.inf, n, 0), units), np.bincount(unit, np.where(v == -np.inf, n, 0), units)


def _window_moments(parts: tuple[np.ndarray, ...], lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(count, mean, squared deviations) of runs [lo, hi) of units, merged from the units' own."""
    total, mean, off, up, down = parts
    member = (np.arange(len(total)) >= lo[:, None]) & (np.arange(len(total)) < hi[:, None])
    n = member @ total
    m = (member @ (total * mean)) / np.maximum(n, 1)
    q = member @ off + (np.where(member, total, 0) * (mean - m[:, None]) ** 2).sum(axis=1)
    ups, downs = member @ up, member @ down
    odd = (ups > 0) | (downs > 0)
    m = np.where(odd, np.where(ups * downs > 0, np.nan, np.where(ups > 0, np.inf, -np.inf)), m)
    return (n + ups + downs).astype(np.int64), m, np.where(odd, np.nan, q)


def compare_windows(v: np.ndarray, unit: np.ndarray, n: np.ndarray, lo: np.ndarray, hi: np.ndarray, totals: np.ndarray | None) -> list[np.ndarray]:
    """For each alert: counts, means, squared deviations of both windows (base, target) and the extremes of the ECDF difference.

    ``lo`` and ``hi`` (2, alerts) are first and last units. ``totals`` (2, alerts) are the windows' whole counts where the cells are but a part of
    the values. Values are walked in order, a table of (values, units) at a time.
    """
    units, at = np.unique(unit, return_inverse=True)
    first, last = np.searchsorted(units, lo, "left"), np.searchsorted(units, hi, "right")
    last = np.maximum(first, last)
    parts = _moments(v, n, at, len(units))
    made = [_window_moments(parts, first[s], last[s]) for s in (0, 1)]
    whole = np.stack([made[0][0], made[1][0]]) if totals is None else totals
    order = np.argsort(v, kind="stable")
    v, at, n = v[order], at[order], n[order]
    rank = np.cumsum(np.r_[True, v[1:] != v[:-1]]) - 1
    alerts = lo.shape[1]
    top, low = np.full(alerts, -np.inf), np.full(alerts, np.inf)
    carried = np.zeros(len(units))
    step = max(1, TABLE_CELLS // len(units))
    edges = np.searchsorted(rank, np.arange(0, rank[-1] + 1 + step, step))
    for start, stop in zip(edges[:-1], edges[1:]):
        rows = rank[start:stop] - rank[start]
        table = np.zeros((rows[-1] + 1, len(units)))
        np.add.at(table, (rows, at[start:stop]), n[start:stop])
        table = np.cumsum(table, axis=0) + carried
        carried = table[-1]
        upto = np.concatenate([np.zeros((len(table), 1)), np.cumsum(table, axis=1)], axis=1)
        wide = max(1, TABLE_CELLS // len(table))
        for k in range(0, alerts, wide):
            some = slice(k, k + wide)
            share = [(upto[:, last[s, some]] - upto[:, first[s, some]]) / np.where(whole[s, some] > 0, whole[s, some], np.nan) for s in (0, 1)]
            d = share[0] - share[1]
            top[some], low[some] = np.maximum(top[some], d.max(axis=0)), np.minimum(low[some], d.min(axis=0))
    return [made[0][0], made[0][1], made[0][2], made[1][0], made[1][1], made[1][2], top, low]


OUT = ("alert_id string, feature_name string, bucket int, nb long, mb double, qb double, nt long, mt double, qt double, dmax double, dmin double")


def _compare(key: tuple, cells: pa.Table, asked: pa.Table) -> pa.Table:
    """``compare_windows`` for each (scope, feature, bucket) of one task's share of cells and alerts."""
    names = ["scope_id", "feature_name", "bucket"]
    numbers = {tuple(r.values()): k for k, r in enumerate(asked.select(names).group_by(names).aggregate([]).to_pylist())}
    place_of = lambda t: np.array([numbers.get(x, -1) for x in zip(*[t.column(c).to_pylist() for c in names])], np.int64)
    of_cell, of_ask = place_of(cells), place_of(asked)
    v, unit, n = (cells.column(c).to_numpy() for c in ("v", "unit", "n"))
    spans = {c: asked.column(c).to_numpy() for c in ("lo0", "hi0", "lo1", "hi1", "n0", "n1")}
    ids = np.array(asked.column("alert_id").to_pylist(), object)
    by_cell, by_ask = np.argsort(of_cell, kind="stable"), np.argsort(of_ask, kind="stable")
    out: list[list] = [[] for _ in range(11)]
    for (scope, feature, bucket), k in numbers.items():
        own = by_cell[slice(*np.searchsorted(of_cell[by_cell], [k, k + 1]))]
        who = by_ask[slice(*np.searchsorted(of_ask[by_ask], [k, k + 1]))]
        if not len(own):
            continue
        lo, hi = (np.stack([spans[f"{c}{s}"][who] for s in (0, 1)]) for c in ("lo", "hi"))
        whole = np.stack([spans["n0"][who], spans["n1"][who]])
        with np.errstate(invalid="ignore"):
            made = compare_windows(v[own], unit[own], n[own], lo, hi, None if whole[0, 0] < 0 else whole)
        for column, values in zip(out, [ids[who].tolist(), [feature] * len(who), [bucket] * len(who), *[x.tolist() for x in made]]):
            column += values
    kinds = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.float64()]
    arrays = [pa.array([None if isinstance(x, float) and k >= 9 and x != x else x for x in column], kind) for k, (column, kind) in enumerate(zip(out, kinds))]
    return pa.table(arrays, names=[c.split()[0] for c in OUT.split(", ")])


def _bucketed(cells: DataFrame, hot: DataFrame, slots: int) -> tuple[DataFrame, DataFrame]:
    """Cells with the value bucket of hot features (0 for the others), and (scope_id, feature_name, bucket) of hot ones."""
    keys = ["scope_id", "feature_name"]
    picks = stored(slot_picks(cells.join(hot, keys, "left_semi"), keys, "v", slots=slots).groupBy(*keys).agg(points_of().alias("_points")), "cuts")
    placed = place(cells.join(broadcast_within(picks, picks.count(), 8 * slots + 64), keys, "left"), "v", slots).withColumnRenamed("_bucket", "bucket")
    return placed, picks.select(*keys, F.explode(F.sequence(F.lit(0), F.size("_points"))).alias("bucket"))


def ks_of_windows(cells: DataFrame, windows: UnitWindows, features: list[str], slots: int = SLOTS, hot_cells: int = HOT_CELLS) -> DataFrame:
    """Counts, means, deviations and exact KS distance per (alert_id, feature_name), from stored ``day_cells``.

    A task takes the cells of some (scope, feature) together with the windows of its alerts. A feature with more than ``hot_cells`` cells is cut by
    value into up to ``slots`` + 1 buckets; a bucket needs only the windows' whole counts, and its offset is added at the end.
    """
    keys = ["scope_id", "feature_name"]
    asked = windows.spans.select("*", F.explode(F.array(*[F.lit(f) for f in features])).alias("feature_name"))
    asked = asked.withColumns({"bucket": F.lit(0), "n0": F.lit(-1).cast("long"), "n1": F.lit(-1).cast("long")})
    hot = stored(cells.groupBy(*keys).count().where(F.col("count") > hot_cells).select(*keys), "hot")
    cells_of = cells.withColumn("bucket", F.lit(0))
    if not hot.isEmpty():
        cells_of, buckets = _bucketed(cells, hot, slots)
        counted = in_windows(cells.join(hot, keys, "left_semi").groupBy(*keys, "unit").agg(F.sum("n").alias("n")), windows).groupBy("alert_id", "feature_name").agg(
            *[F.coalesce(F.sum(F.when(F.col(w), F.col("n"))), F.lit(0)).alias(f"n{s}") for s, w in ((0, "in_base"), (1, "in_target"))])
        asked = asked.join(hot, keys, "left_anti").unionByName(
            asked.drop("bucket", "n0", "n1").join(buckets, keys).join(counted, ["alert_id", "feature_name"], "left").withColumns(
                {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("n0", "n1")}))
    n, cores = cells.count(), cells.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, n // TASK_CELLS, min(cores, n // 5000))
    share = F.pmod(F.xxhash64(*keys, "bucket"), F.lit(tasks)).alias("share")
    pieces = (cells_of.select("*", share).groupBy("share").cogroup(asked.select("*", share).groupBy("share")).applyInArrow(_compare, OUT))
    before = Window.partitionBy("alert_id", "feature_name").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("alert_id", "feature_name")
    some = lambda c, x: F.when(F.col(c) > 0, x)
    for side, count in (("b", "baseline"), ("t", "target")):
        pieces = pieces.withColumns({f"{count}_count": F.sum(f"n{side}").over(whole),
                                     f"{count}_mean": F.sum(some(f"n{side}", F.col(f"n{side}") * F.col(f"m{side}"))).over(whole) / F.nullif(F.sum(f"n{side}").over(whole), F.lit(0)),
                                     f"o{side}": F.coalesce(F.sum(f"n{side}").over(before), F.lit(0))})
    offset = F.col("ob") / F.nullif(F.col("baseline_count"), F.lit(0)) - F.col("ot") / F.nullif(F.col("target_count"), F.lit(0))
    squares = lambda side, mean: some(f"n{side}", F.col(f"q{side}") + F.col(f"n{side}") * F.pow(F.col(f"m{side}") - F.col(mean), F.lit(2)))
    totals = ["baseline_count", "target_count", "baseline_mean", "target_mean"]
    return (pieces.withColumns({"o": offset, "sb": squares("b", "baseline_mean"), "st": squares("t", "target_mean")})
            .groupBy("alert_id", "feature_name").agg(
                *[F.first(c).alias(c) for c in totals],
                F.sqrt(F.sum("sb") / F.first("baseline_count")).alias("baseline_std"), F.sqrt(F.sum("st") / F.first("target_count")).alias("target_std"),
                F.max(F.greatest(F.abs(F.col("o") + F.col("dmax")), F.abs(F.col("o") + F.col("dmin")))).alias("ks_stat")))


def stored_cells(rows: DataFrame, book: AlertBook, features: list[str], ts: str = "ts", closed: bool = True) -> tuple[DataFrame, UnitWindows]:
    """``day_cells`` of the alerts' whole span, written once, and the windows they were cut for."""
    windows = unit_windows(book, closed=closed)
    return stored(day_cells(rows.where(within(rows, ts, book.start, book.end)), features, windows, ts), "cells"), windows
