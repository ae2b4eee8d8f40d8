import math
from datetime import timedelta
from itertools import combinations

import numpy as np
import pytest
from support import ALERT_DDL, alert, ts
from pyspark.sql import functions as F

from modelwatch import session
from modelwatch.functions import kstest
from modelwatch.operators import drift, labels, quantiles
from modelwatch.operators.alerts import alert_book, two_window_slice

BASE, TARGET = "2026-07-10", "2026-08-05"


def frame(spark, base, target, scope="s"):
    rows = [(scope, ts(BASE), None if x is None else float(x)) for x in base]
    rows += [(scope, ts(TARGET), None if x is None else float(x)) for x in target]
    return spark.createDataFrame(rows, "scope_id string, ts timestamp_ntz, x double")


def numpy_ks(a, b):
    a, b = np.sort(a), np.sort(b)
    v = np.concatenate([a, b])
    return float(np.max(np.abs(np.searchsorted(a, v, side="right") / len(a) - np.searchsorted(b, v, side="right") / len(b))))


def one(spark, base, target, **kw):
    return drift.feature_drift(frame(spark, base, target), alert(spark), ["x"], **kw).first()


@pytest.mark.parametrize("slots", [1, 3, 255])
@pytest.mark.parametrize("kind", ["continuous", "ties", "heavy"])
def test_ks_equals_numpy(spark, slots, kind):
    rng = np.random.default_rng(5)
    a, b = {"continuous": (rng.normal(0, 1, 700), rng.normal(.2, 1, 500)),
            "ties": (rng.integers(0, 6, 400), rng.integers(1, 7, 300)),
            "heavy": (np.r_[rng.normal(0, 1, 300), np.full(300, 7.0)], np.r_[rng.exponential(50, 200), np.full(150, 7.0)])}[kind]
    r = one(spark, a, b, p_value="asymptotic", slots=slots)
    assert r.ks_stat == pytest.approx(numpy_ks(a, b), abs=1e-12)
    assert r.baseline_mean == pytest.approx(np.mean(a)) and r.target_std == pytest.approx(np.std(b))
    assert (r.baseline_count, r.target_count) == (len(a), len(b))


def test_guard_nulls_and_extremes(spark):
    few = one(spark, range(9), range(10))
    assert (few.status, few.is_drifted, few.ks_stat) == ("insufficient", False, None)
    assert (few.baseline_count, few.target_count) == (9, 10)
    ok = one(spark, list(range(10)) + [None, math.nan], range(10))
    assert (ok.status, ok.baseline_count, ok.ks_stat, ok.p_value) == ("ok", 10, 0.0, 1.0)
    same = one(spark, [1] * 20, [1] * 20)
    assert (same.ks_stat, same.p_value, same.is_drifted) == (0.0, 1.0, False)
    far = one(spark, range(20), range(100, 120))
    assert far.ks_stat == 1.0 and far.is_drifted and far.p_value < 1e-8
    assert far.summary.startswith("Feature 'x' mean shifted from 9.5000 to 109.5000 (KS p-value: ")


def test_missing_feature_and_empty_scope_are_rows(spark):
    alerts = alert(spark).union(alert(spark, "none"))
    got = {(r.alert_id, r.feature_name): r.status for r in
           drift.feature_drift(frame(spark, range(20), range(20)), alerts, ["x", "absent"]).collect()}
    assert got == {("a-s", "x"): "ok", ("a-s", "absent"): "missing_feature", ("a-none", "x"): "insufficient",
                   ("a-none", "absent"): "missing_feature"}


def test_window_edges_are_inside(spark):
    rows = spark.createDataFrame([("s", ts(t)) for t in ("2026-07-01", "2026-07-30", "2026-07-30T00:00:01", "2026-08-10")],
                                 "scope_id string, ts timestamp_ntz")
    got = [(r.in_base, r.in_target) for r in two_window_slice(rows, alert(spark)).orderBy("ts").collect()]
    assert got == [(True, False), (True, False), (False, True)]
    assert two_window_slice(rows, alert(spark), closed=False).count() == 1


def test_many_alerts_in_one_job_equal_single_runs(spark):
    rng = np.random.default_rng(1)
    rows = frame(spark, rng.normal(size=200), rng.normal(.5, 1, 200), "p").union(
        frame(spark, rng.normal(size=200), rng.normal(size=200), "q"))
    a, b = alert(spark, "p"), alert(spark, "q")
    both = {r.alert_id: r.ks_stat for r in drift.feature_drift(rows, a.union(b), ["x"]).collect()}
    assert both == {r.alert_id: r.ks_stat for x in (a, b) for r in drift.feature_drift(rows, x, ["x"]).collect()}


def test_too_many_alerts_to_broadcast_give_the_same(spark, monkeypatch):
    rng = np.random.default_rng(4)
    at = lambda: ts("2026-07-01") + timedelta(minutes=int(rng.integers(0, 60 * 24 * 41)))
    rows = spark.createDataFrame([(rng.choice(["p", "q"]), at(), float(rng.normal()), int(rng.integers(2))) for _ in range(600)],
                                 "scope_id string, ts timestamp_ntz, x double, true_label int")
    alerts = alert(spark, "p").union(alert(spark, "q", alert_ts="2026-08-01")).union(
        alert(spark, "q", windows=("2026-07-20T05:00:00", "2026-08-04", "2026-08-01", "2026-08-09T07:00:00"), alert_id="overlap"))

    def run():
        return [sorted(df.collect()) for df in (
            two_window_slice(rows, alerts).select("alert_id", "ts", "x", "in_base", "in_target"),
            drift.feature_drift(rows, alerts, ["x"], p_value="asymptotic").select("alert_id", "ks_stat", "p_value"),
            labels.label_shift(rows, alerts).select("alert_id", "baseline_count", "target_count", "status"))]
    few = run()
    monkeypatch.setattr(session, "BROADCAST_BYTES", 0)
    plan = two_window_slice(rows, alerts)._jdf.queryExecution().optimizedPlan().toString()
    assert "rightHint=(strategy=broadcast)" not in plan and "_day" in plan
    assert run() == few and few[0]


def enumerated_p(d_num, n1, n2):
    hits = total = 0
    for pick in combinations(range(n1 + n2), n1):
        chosen, i, j, d = set(pick), 0, 0, 0
        for t in range(n1 + n2):
            i, j = (i + 1, j) if t in chosen else (i, j + 1)
            d = max(d, abs(i * n2 - j * n1))
        total += 1
        hits += d >= d_num
    return hits / total


@pytest.mark.parametrize("n1,n2", [(5, 7), (6, 6), (4, 9), (1, 8), (8, 1), (3, 3)])
def test_exact_p_equals_enumeration(n1, n2):
    for d_num in range(0, n1 * n2 + 1, max(1, n1 * n2 // 9)):
        assert kstest.exact_p(d_num / (n1 * n2), n1, n2) == pytest.approx(enumerated_p(d_num, n1, n2), abs=1e-12)


def test_known_p_values(spark):
    assert kstest.exact_p(.06, 1000, 900) == pytest.approx(.0630, abs=5e-5)
    assert kstest.exact_p(.0625, 1000, 900) == pytest.approx(.0467, abs=5e-5)
    row = spark.createDataFrame([(.06, 1000, 900)], "d double, a long, b long")
    assert row.select(kstest.asymptotic_p(F.col("d"), F.col("a"), F.col("b"))).first()[0] == pytest.approx(.0660, abs=5e-5)
    # one-sample reference value: K(10, 0.274) = 0.6284796...; two samples of 20 have effective size 10
    row = spark.createDataFrame([(.274, 20, 20)], "d double, a long, b long")
    assert row.select(kstest.finite_n_p(F.col("d"), F.col("a"), F.col("b"))).first()[0] == pytest.approx(1 - .6284796, abs=2e-3)


@pytest.mark.parametrize("n,k", [(30, 7), (1000, 61), (10_000, 200)])
def test_exact_p_equals_closed_form_for_equal_sizes(n, k):
    """P(D >= k/n) = 2 sum (-1)^(i-1) C(2n, n - ik) / C(2n, n): the reflection principle."""
    log = lambda i: 2 * math.lgamma(n + 1) - math.lgamma(n - i * k + 1) - math.lgamma(n + i * k + 1)
    closed = 2 * sum((-1) ** (i - 1) * math.exp(log(i)) for i in range(1, n // k + 1))
    assert kstest.exact_p(k / n, n, n) == pytest.approx(closed, rel=1e-8)


def test_one_p_method_for_every_size(spark):
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=60), rng.normal(.4, 1, 50)
    r = one(spark, a, b)
    assert r.p_value == pytest.approx(kstest.exact_p(numpy_ks(a, b), 60, 50), abs=.03)
    r = one(spark, a, b, p_value="exact")
    assert r.p_value == pytest.approx(kstest.exact_p(numpy_ks(a, b), 60, 50), abs=1e-12)


def test_counts_are_shuffled_once_and_reused(spark, tmp_path):
    frame(spark, range(50), range(50)).write.parquet(str(tmp_path / "v"))
    alert(spark).write.parquet(str(tmp_path / "a"))
    df = drift.feature_drift(spark.read.parquet(str(tmp_path / "v")), spark.read.parquet(str(tmp_path / "a")), ["x"],
                             p_value="asymptotic", by_day=False)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "ReusedExchange" in plan
    scans = [line for line in plan.splitlines() if "FileScan parquet" in line and "x#" in line]
    assert len(scans) == 1 and "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in scans[0]


def test_label_shift_limits(spark):
    def run(quiet, late):
        rows = [("s", ts("2026-08-02"), y) for y in quiet] + [("s", ts("2026-08-06"), y) for y in late]
        return labels.label_shift(spark.createDataFrame(rows, "scope_id string, ts timestamp_ntz, true_label int"),
                                  alert(spark)).first()
    exact = run([1] * 10 + [0] * 10, [1] * 7 + [0] * 13)                   # 0.50 -> 0.35
    assert exact.drift_delta == pytest.approx(.15) and exact.is_drifted == (0.5 - 0.35 >= 0.15)
    assert run([1] * 8 + [0] * 8, [1] * 4 + [0] * 12).is_drifted             # a drop of exactly 0.25
    assert not run([1] * 4 + [0] * 16, [1] * 10 + [0] * 10).is_drifted       # rises never count
    assert run([1] * 10, [None] * 10 + [0] * 9).status == "insufficient"     # unlabelled rows are skipped
    assert run([None], [None]).status == "empty"


@pytest.mark.parametrize("slots", [1, 4, 255])
def test_exact_median(spark, slots):
    rng = np.random.default_rng(3)
    groups = {"even": rng.normal(size=100), "odd": rng.normal(size=101), "ties": rng.integers(0, 3, 40), "one": np.array([4.0])}
    rows = [(g, float(x)) for g, xs in groups.items() for x in xs] + [("odd", None)]
    got = {r.g: r.median for r in quantiles.exact_median(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", slots).collect()}
    assert got == pytest.approx({g: float(np.median(x)) for g, x in groups.items()})


def test_empty_alert_table(spark):
    empty = spark.createDataFrame([], ALERT_DDL)
    assert alert_book(empty).count == 0
    assert drift.feature_drift(frame(spark, range(20), range(20)), empty, ["x"]).count() == 0
