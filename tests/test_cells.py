"""Day cells give every window what counting its rows apart gives."""

from datetime import timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F
from support import ALERT_DDL, ts

from modelwatch import session
from modelwatch.operators import cells, drift
from modelwatch.operators.alerts import alert_book

FEATURES = ["x", "k"]
OUT = ["alert_id", "feature_name", "status", "baseline_count", "target_count"]
NUMBERS = ["baseline_mean", "target_mean", "baseline_std", "target_std", "ks_stat"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(6)
    start = ts("2026-07-01")
    made = []
    for _ in range(3000):
        at = start + timedelta(hours=int(rng.integers(0, 24 * 30))) if rng.random() < .5 else start + timedelta(seconds=int(rng.integers(0, 86400 * 30)))
        made.append((str(rng.choice(["p", "q", "r"], p=[.8, .15, .05])), None if rng.random() < .01 else at, float(rng.normal()), float(rng.integers(0, 7)) if rng.random() > .02 else None))
    made += [("p", start + timedelta(days=9), float("inf"), float("nan")), ("p", start + timedelta(days=9), float("-inf"), 1.0), (None, start, 1.0, 1.0)]
    return spark.createDataFrame(made, "scope_id string, ts timestamp_ntz, x double, k double").cache()


@pytest.fixture(scope="module")
def alerts(spark):
    """Overlapping windows, ends inside days and at midnight, shared ends, one instant, upside down, missing, a scope without rows."""
    rng = np.random.default_rng(7)
    start = ts("2026-07-01")
    made = []
    for k in range(25):
        a, b, c, d = sorted(int(x) for x in rng.integers(0, 30 * 24, 4))
        at = [start + timedelta(hours=h) for h in (a, b, c, d)] if k % 3 else [start + timedelta(days=h // 24) for h in (a, b, c, d)]
        made.append((f"a{k}", str(rng.choice(["p", "q"])), "m", "accuracy", .5, at[2], *at))
    day = lambda n: start + timedelta(days=n)
    made += [("same", "p", "m", "accuracy", .5, day(3), day(2), day(2), day(3), day(3)), ("back", "p", "m", "accuracy", .5, day(3), day(8), day(2), day(3), day(9)),
             ("none", "q", "m", "accuracy", .5, day(3), None, day(2), day(3), day(20)), ("nowhere", "z", "m", "accuracy", .5, day(3), day(1), day(2), day(3), day(4)),
             ("both", "p", "m", "accuracy", .5, day(3), day(1), day(20), day(1), day(20))]
    return spark.createDataFrame(made, ALERT_DDL).cache()


def run(rows, alerts, **kw):
    got = drift.feature_drift(rows, alerts, [*FEATURES, "absent"], p_value="asymptotic", **kw).collect()
    return {(r.alert_id, r.feature_name): [r[c] for c in OUT + NUMBERS] for r in got}


def same(a, b):
    assert a.keys() == b.keys() and a
    for k in a:
        assert a[k][:5] == b[k][:5]
        assert a[k][5:] == pytest.approx(b[k][5:], abs=1e-9, nan_ok=True), k


@pytest.mark.parametrize("closed", [True, False])
def test_same_as_rows(rows, alerts, closed):
    same(run(rows, alerts, closed=closed, by_day=True), run(rows, alerts, closed=closed, by_day=False))


def test_hot_features_and_small_tables(rows, alerts, monkeypatch):
    want = run(rows, alerts, by_day=False)
    for name, value in (("HOT_CELLS", 50), ("TASK_CELLS", 40), ("TABLE_CELLS", 64)):
        monkeypatch.setattr(cells, name, value)
    book = alert_book(alerts)
    made, windows = cells.stored_cells(rows, book, FEATURES)
    got = {(r.alert_id, r.feature_name): r for r in cells.ks_of_windows(made, windows, FEATURES, 7, hot_cells=50).collect()}
    for (a, f), w in want.items():
        r = got.get((a, f))
        if r is None or w[2] != "ok":
            continue
        assert [r.baseline_count, r.target_count] == w[3:5]
        assert [r[c] for c in NUMBERS] == pytest.approx(w[5:], abs=1e-9, nan_ok=True), (a, f)


def test_too_many_days_to_broadcast(rows, alerts, monkeypatch):
    want = run(rows, alerts, by_day=True)
    monkeypatch.setattr(session, "BROADCAST_BYTES", 0)
    same(run(rows, alerts, by_day=True), want)


def test_cells_of_parts_add_up(rows, alerts):
    windows = cells.unit_windows(alert_book(alerts))
    keys = ["scope_id", "feature_name", "unit", "v"]
    whole = cells.day_cells(rows, FEATURES, windows)
    parts = cells.day_cells(rows.where("x < 0"), FEATURES, windows).unionByName(cells.day_cells(rows.where("x >= 0"), FEATURES, windows))
    added = parts.groupBy(*keys).agg(F.sum("n").alias("n"))
    assert sorted(map(tuple, added.collect())) == sorted(map(tuple, whole.collect()))


def test_rows_meet_days_not_alerts(rows, alerts):
    windows = cells.unit_windows(alert_book(alerts))
    assert cells.with_units(rows, windows).count() <= rows.count()  # one row each, whatever the number of alerts
    plan = cells.in_windows(cells.day_cells(rows, FEATURES, windows), windows)._jdf.queryExecution().optimizedPlan().toString()
    join = next(line for line in plan.splitlines() if "Join Inner" in line and "scope_id" in line)
    assert join.count("scope_id#") == 2 and "_day#" in join, join


def test_units_count_what_windows_hold(rows, alerts):
    windows = cells.unit_windows(alert_book(alerts))
    units = cells.with_units(rows.where("ts is not null and scope_id is not null"), windows).groupBy("scope_id", "unit").agg(F.count("*").alias("n"))
    got = {r.alert_id: (r.b, r.t) for r in cells.in_windows(units, windows).groupBy("alert_id").agg(
        F.sum(F.when(F.col("in_base"), F.col("n")).otherwise(0)).alias("b"), F.sum(F.when(F.col("in_target"), F.col("n")).otherwise(0)).alias("t")).collect()}
    all_rows = [(r.scope_id, r.ts) for r in rows.collect() if r.ts and r.scope_id]
    for a in alerts.collect():
        count = lambda x, y: sum(s == a.scope_id and x is not None and y is not None and x <= t <= y for s, t in all_rows)
        want = count(a.baseline_start, a.baseline_end), count(a.active_start, a.active_end)
        assert got.get(a.alert_id, (0, 0)) == want, a.alert_id
