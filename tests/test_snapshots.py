"""As-of joins that read a window and one snapshot give what the whole history gives."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F
from support import alert, ts

from modelwatch.operators import asof, freshness, snapshots

BY, FEATURES = ["scope_id", "entity_id"], ["x", "y"]
DAYS = [date(2026, 7, 11), date(2026, 7, 4), date(2026, 7, 18)]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A view by day with nulls, ties and entities that were last seen long ago; a log; snapshots."""
    rnd = random.Random(3)
    at = lambda: ts("2026-07-01") + timedelta(hours=rnd.randrange(24 * 25))
    rows = [(rnd.choice("pq"), f"e{rnd.randrange(40)}", at(), i, rnd.choice((None, rnd.random())), float(i)) for i in range(500)]
    rows += [("p", "old", ts("2026-07-01T05:00:00"), 900, 1.5, 2.5), ("p", None, at(), 901, 1.0, 1.0), (None, "e1", at(), 902, 1.0, 1.0), ("q", "e1", None, 903, 1.0, 1.0)]
    rows += [("p", "tie", ts("2026-07-03"), i, float(i), 0.0) for i in (7, 3, 9)]
    folder = tmp_path_factory.mktemp("snapshots")
    view = spark.createDataFrame(rows, "scope_id string, entity_id string, ts timestamp_ntz, ingest_seq long, x double, y double")
    view.withColumn("event_date", F.to_date("ts")).write.partitionBy("event_date").parquet(str(folder / "view"))
    log = [(rnd.choice("pq"), rnd.choice(["old", "tie", *(f"e{k}" for k in range(45))]), at(), i) for i in range(400)]
    view = spark.read.parquet(str(folder / "view"))
    snapshots.take_snapshots(view, str(folder / "snap"), DAYS, BY, FEATURES, tie="ingest_seq")
    return view, spark.createDataFrame(log, "scope_id string, entity_id string, ts timestamp_ntz, id long"), str(folder / "snap")


@pytest.mark.parametrize("day", sorted(DAYS))
def test_a_snapshot_is_the_latest_row_before_its_day(spark, tables, day):
    view, _, path = tables
    want = {}
    for r in view.collect():
        if None not in (r.ts, r.scope_id, r.entity_id) and r.ts.date() < day:
            key, row = (r.scope_id, r.entity_id), (r.ts, r.ingest_seq, r.x, r.y)
            want[key] = max(row, want.get(key, row), key=lambda x: x[:2])
    got = spark.read.parquet(path).where(F.col("snapshot_date") == F.lit(day)).collect()
    assert {(r.scope_id, r.entity_id): (r.ts, r.ingest_seq, r.x, r.y) for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("start,end", [("2026-07-12T10:00:00", "2026-07-15"), ("2026-07-18", "2026-07-25"), ("2026-07-02", "2026-07-03"), ("2026-07-11", "2026-07-11")])
def test_same_as_the_whole_history(tables, start, end):
    view, log, path = tables
    got = snapshots.pit_join_within(log, view, path, ts(start), ts(end), BY, FEATURES, tie="ingest_seq", matched_ts="at")
    want = asof.pit_join(log.where(F.col("ts").between(ts(start), ts(end))), view, BY, features=FEATURES, tie="ingest_seq", matched_ts="at")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.select(got.columns).collect()), key=str)


def test_both_bounds_reach_the_scan(tables):
    view, log, path = tables
    plan = snapshots.bounded_view(view, path, ts("2026-07-12"), ts("2026-07-15"), [*BY, "ts"])._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line]
    of_view, of_snapshot = [next(s for s in scans if c in s.split("ReadSchema")[0].split("PartitionFilters")[1]) for c in ("event_date", "snapshot_date")]
    assert ">= 2026-07-10" in of_view and "<= 2026-07-16" in of_view and "(snapshot_date#" in of_snapshot and "= 2026-07-11)" in of_snapshot


def test_a_day_taken_again_holds_late_rows(spark, tables, tmp_path):
    view, _, _ = tables
    path = str(tmp_path / "snap")
    snapshots.take_snapshots(view.where("entity_id <> 'old'"), path, [date(2026, 7, 4)], BY, FEATURES, tie="ingest_seq")
    assert spark.read.parquet(path).where("entity_id = 'old'").count() == 0
    snapshots.take_snapshots(view, path, [date(2026, 7, 4), date(2026, 7, 5)], BY, FEATURES, tie="ingest_seq")
    assert [r.n for r in spark.read.parquet(path).where("entity_id = 'old'").groupBy("snapshot_date").agg(F.count("*").alias("n")).collect()] == [1, 1]
    assert snapshots.snapshot_days(spark, path) == [date(2026, 7, 4), date(2026, 7, 5)] and snapshots.snapshot_days(spark, str(tmp_path / "none")) == []


def test_freshness_over_snapshots(spark, tables):
    view, log, path = tables
    alerts = alert(spark, "p", "2026-07-16", windows=("2026-07-12", "2026-07-14", "2026-07-15", "2026-07-20")).union(
        alert(spark, "none", "2026-07-16", windows=("2026-07-12", "2026-07-14", "2026-07-15", "2026-07-20")))
    run = lambda **k: sorted(map(tuple, freshness.feature_freshness(log, view, alerts, **k).collect()), key=str)
    assert run() == run(snapshots=path) and {r[2] for r in run()} == {"ok", "empty"}
