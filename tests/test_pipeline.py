import os
from datetime import timedelta

import pytest
from support import alert, ts
from pyspark.sql import functions as F

from modelwatch import fixed_values as fv
from modelwatch import schemas
from modelwatch.functions.scalars import clamp_int, logistic_score
from modelwatch.operators import asof, audit, commits, drift, freshness, labels, logs, metrics, perturb
from modelwatch.operators import logs as investigation_logs
from modelwatch.plans import investigate, training
from modelwatch.sources import sinks, tables
from modelwatch.streaming import jobs

CUT = "2026-08-05"


@pytest.fixture(scope="module")
def rows(spark):
    """Independent draws per row: 12 000 feature updates over history and serving days, one scope."""
    n = 12_000
    at = F.lit("2026-07-01").cast("timestamp_ntz") + F.make_dt_interval(mins=(F.col("id") * 41 * 24 * 60 / n).cast("int"))
    u = lambda seed, key="id": (perturb.hash_slot(F.col(key), seed, 1_000_000) + 0.5) / 1e6
    df = spark.range(n).select(
        F.lit("s").alias("scope_id"), F.format_string("usr_%d", F.col("id") % 50).alias("entity_id"), at.alias("ts"),
        F.col("id").alias("ingest_seq"), perturb.weighted_band(F.col("id"), "b", fv.BAND_WEIGHTS).alias("income_band"),
        clamp_int(680 + 70 * F.sqrt(-2 * F.log(u("x"))) * F.cos(6.283185307 * u("y"))).alias("credit_score"),
        (0.1 + 0.9 * u("d") * u("e")).alias("debt_to_income"), (40 * u("f") * u("g")).cast("int").alias("employment_years"))
    p = logistic_score(F.col("credit_score"), F.col("income_band"), F.col("debt_to_income"), F.col("employment_years"))
    return df.withColumn("true_label", (u("l", "ingest_seq") < p).cast("int")).withColumn("prediction", (p > .5).cast("int")).cache()


def one_alert(spark):
    return alert(spark, windows=("2026-07-01", "2026-07-30", "2026-08-01", "2026-08-10"))


def drifted(spark, view):
    return {r.feature_name for r in drift.feature_drift(view, one_alert(spark), fv.DEFAULT_FEATURES, alpha=1e-4).collect() if r.is_drifted}


def test_discovery(rows, spark):
    assert schemas.feature_columns(rows) == fv.DEFAULT_FEATURES
    assert schemas.feature_columns(spark.createDataFrame([("a", "b")], "user_id string, note string")) == fv.DEFAULT_FEATURES


def test_each_injection_raises_its_detector_and_only_that(spark, rows):
    assert drifted(spark, rows) == set()
    assert drifted(spark, perturb.shift_band(rows, "income_band", "ingest_seq", CUT, seed="b2")) == {"income_band"}
    bug = perturb.zero_fraction(rows, "credit_score", "ingest_seq", CUT)
    assert drifted(spark, bug) == {"credit_score"}
    assert bug.where("credit_score = 0").agg(F.min(F.to_date("ts"))).first()[0].isoformat() == "2026-08-05"
    assert drifted(spark, perturb.rescale(rows, "debt_to_income", CUT)) == {"debt_to_income"}


def test_thinned_labels_are_a_shift(spark, rows):
    assert not labels.label_shift(rows, one_alert(spark)).first().is_drifted
    thin = perturb.thin_positives(rows, "true_label", "ingest_seq", CUT)
    assert labels.label_shift(thin, one_alert(spark)).first().is_drifted


def test_withheld_updates_are_stale(spark, rows):
    served = rows.withColumn("ts", F.col("ts") + F.expr("INTERVAL 1 HOUR"))
    fresh = freshness.feature_freshness(served, rows, one_alert(spark)).first()
    assert fresh.status == "ok" and not fresh.is_stale and fresh.mean_lag_days == pytest.approx(1 / 24, abs=.01)
    stale = freshness.feature_freshness(served, perturb.withhold_updates(rows, CUT), one_alert(spark)).first()
    assert stale.is_stale and stale.max_lag_days > 4 and stale.share_over_threshold > .4


def test_freshness_limits(spark):
    view = spark.createDataFrame([("s", "u", ts("2026-08-01"))], "scope_id string, entity_id string, ts timestamp_ntz")
    at = lambda n, hours: spark.createDataFrame([("s", "u", ts("2026-08-01") + timedelta(hours=hours))] * n, view.schema)
    run = lambda l, v=view: freshness.feature_freshness(l, v, one_alert(spark)).first()
    assert (run(at(10, 12)).mean_lag_days, run(at(10, 12)).is_stale) == (.5, False)
    assert run(at(10, 13)).is_stale
    assert run(at(9, 13)).status == "insufficient"
    assert run(at(10, 13), view.where("false")).status == "empty"
    assert run(at(10, 13).where("false")).status == "empty"


def test_audit_sees_served_scale(spark, rows):
    served = perturb.rescale(rows.select("scope_id", "entity_id", "ts", "debt_to_income", "income_band"), "debt_to_income",
                             F.lit("2026-07-01").cast("date"))
    got = {r.feature_name: r for r in audit.serving_skew_audit(
        served, rows, ["debt_to_income", "income_band"], ["scope_id", "entity_id"], ["scope_id"], tie="ingest_seq").collect()}
    assert got["debt_to_income"].is_skewed and got["debt_to_income"].median_ratio == pytest.approx(100)
    assert not got["income_band"].is_skewed and got["income_band"].mismatch_rate == 0


def test_shuffled_labels_are_a_permutation(spark, rows):
    results = []
    for digits in (1, 3):
        out = perturb.shuffle_labels(rows, "true_label", "ingest_seq", digits=digits)
        results.append({r.ingest_seq: r.true_label for r in out.collect()})
        both = rows.select("ingest_seq", F.col("true_label").alias("old")).join(out, "ingest_seq")
        r = both.agg(F.count("*"), F.sum("old"), F.sum("true_label"), F.corr("old", "true_label")).first()
        assert r[0] == 12_000 and r[1] == r[2] and abs(r[3]) < .05
    assert results[0] == results[1]


def test_investigation_end_to_end(spark, rows):
    versions = spark.createDataFrame([("s", "m", 1, "r1", {"a": "1"}, {"accuracy": .8})], schemas.MODEL_VERSIONS)
    commit = spark.createDataFrame([("s", "c1", "ann", ts("2026-08-05T03:00:00"), "refactor", [fv.WATCHED_PATH], [])], schemas.COMMITS)
    served = rows.withColumn("ts", F.col("ts") + F.expr("INTERVAL 1 HOUR"))

    def cause(view=rows, log=served, v=versions, c=commit.where("false"), **kw):
        s = investigate.Settings(alpha=1e-4, **kw)
        return investigate.run(one_alert(spark), view, log, v, c, s, store_evidence=False).causes.first().cause

    two = versions.union(spark.createDataFrame([("s", "m", 2, "r2", {"a": "1"}, {"accuracy": .5})], schemas.MODEL_VERSIONS))
    assert cause() == "control"
    assert cause(view=perturb.shift_band(rows, "income_band", "ingest_seq", CUT)) == "feature_drift"
    assert cause(v=two) == "bad_model_deploy"
    assert cause(view=perturb.zero_fraction(rows, "credit_score", "ingest_seq", CUT), c=commit) == "pipeline_bug"
    assert cause(log=perturb.thin_positives(served, "true_label", "ingest_seq", CUT)) == "label_shift"
    assert cause(log=perturb.rescale(served, "debt_to_income", CUT), audit_features=fv.DEFAULT_FEATURES) == "serving_skew"
    assert cause(view=perturb.withhold_updates(rows, CUT)) == "stale_feature"


def test_stored_evidence_gives_the_same_causes(spark, rows):
    versions = spark.createDataFrame([], schemas.MODEL_VERSIONS)
    args = (one_alert(spark), perturb.shift_band(rows, "income_band", "ingest_seq", CUT), rows, versions,
            spark.createDataFrame([], schemas.COMMITS), investigate.Settings(p_value="asymptotic"))
    a, b = investigate.run(*args), investigate.run(*args, store_evidence=False)
    assert a.causes.collect() == b.causes.collect() and a.evidence.count() == b.evidence.count() > 0


def test_metrics(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 1, 0), ("a", 0, 1), ("a", 0, 0), ("a", 1, None), ("b", 0, 0)],
                               "g string, prediction int, true_label int")
    got = {r.g: r for r in metrics.classification_metrics(df, ["g"]).collect()}
    assert (got["a"].accuracy, got["a"].precision, got["a"].recall, got["a"].f1_score) == (.5, .5, .5, .5)
    assert (got["b"].accuracy, got["b"].precision, got["b"].recall, got["b"].f1_score) == (1, 0, 0, 0)


def test_derived_alerts_find_the_bad_day(spark):
    days = [("s", ts("2026-08-01") + timedelta(days=d, minutes=m), 1, int(m % 5 > 0) if d < 9 else m % 2)
            for d in range(10) for m in range(100)]
    log = spark.createDataFrame(days, "scope_id string, ts timestamp_ntz, prediction int, true_label int")
    found = metrics.derived_alerts(metrics.daily_accuracy(log)).collect()
    assert [str(r.alert_day) for r in found] == ["2026-08-10"]
    made = metrics.alert_rows(metrics.derived_alerts(metrics.daily_accuracy(log)), "m").first()
    assert (str(made.active_start), str(made.baseline_end)) == ("2026-07-31 00:00:00", "2026-07-30 00:00:00")


def test_clamp(spark):
    row = spark.createDataFrame([(849.9,), (-5.0,), (9000.0,), (300.0,)], "x double")
    assert [r[0] for r in row.select(clamp_int(F.col("x"))).collect()] == [849, 300, 850, 300]


def test_training_is_repeatable(spark, rows):
    p = logistic_score(F.col("credit_score"), F.col("income_band"), F.col("debt_to_income"), F.col("employment_years"))
    view = rows.select("scope_id", "entity_id", "ts", "ingest_seq", *fv.DEFAULT_FEATURES)
    data = training.training_set(rows.select("scope_id", "entity_id", "ts", F.col("ingest_seq").alias("id")), view,
                                 ["scope_id", "entity_id"], fv.DEFAULT_FEATURES, p, "id", tie="ingest_seq")
    model, row = training.fit_and_evaluate(data, fv.DEFAULT_FEATURES, "id")
    m = row.first()
    assert m.metrics["accuracy"] > .7 and set(m.metrics) == {"accuracy", "f1_score", "precision", "recall"}
    assert m.params == {"model_type": "RandomForestClassifier", "n_estimators": "50", "max_depth": "5"}
    scored = training.score(model, data)
    assert scored.where("probability < 0 or probability > 1 or prediction not in (0, 1)").count() == 0
    assert scored.select(F.countDistinct("probability")).first()[0] > 10     # real probabilities, not a constant


def test_assemble_joins_by_key(spark):
    requests = spark.createDataFrame([("b", 1), ("a", 0), ("c", 1)], "entity_id string, prediction int")
    online = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "entity_id string, x double")
    assert {(r.entity_id, r.prediction, r.x) for r in logs.assemble(requests, online, "entity_id").collect()} == {("b", 1, 2.0), ("a", 0, 1.0)}


# ---- sources and sinks ------------------------------------------------------------------------


def test_push_parses_times_and_prunes_days(spark, tmp_path):
    path = str(tmp_path / "view")
    df = spark.createDataFrame([("u", "2026-08-01 10:00:00", 1), ("u", "2026-08-02 10:00:00", 2)], "entity_id string, ts string, x int")
    sinks.push_features(df, path, scope="s")
    sinks.push_features(df, path, scope="s")
    back = tables.read_feature_view(spark, path)
    assert back.count() == 4 and dict(back.dtypes)["ts"] == "timestamp_ntz"
    assert sorted(p for p in os.listdir(path) if p.startswith("event_date")) == ["event_date=2026-08-01", "event_date=2026-08-02"]
    plan = back.where(F.col("event_date") == F.lit("2026-08-02").cast("date"))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan


def test_rerun_replaces_its_own_days_only(spark, tmp_path):
    path = str(tmp_path / "logs")
    make = lambda scope, day, x: spark.createDataFrame([(scope, ts(day), x)], "scope_id string, ts timestamp_ntz, x int")
    sinks.append_logs(make("a", "2026-08-01", 1).union(make("b", "2026-08-01", 2)), path)
    sinks.replace_scopes(make("a", "2026-08-01", 3), path)
    assert {(r.scope_id, r.x) for r in spark.read.parquet(path).collect()} == {("a", 3), ("b", 2)}


def test_tables_are_created_once_and_scopes_reset(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS mw_test")
    try:
        assert len(tables.create_tables(spark, "mw_test")) == 3
        assert tables.create_tables(spark, "mw_test") == []
        row = [("a", 1, "u", ts("2026-08-01"), 3, 720, .35, 5, 1, .88, 1), ("b", 2, "u", ts("2026-08-01"), 3, 720, .35, 5, 1, .88, None)]
        df = sinks.laid_out(spark.createDataFrame(row, schemas.SERVING_LOGS))
        df.select(*spark.table("mw_test.serving_logs").columns).write.insertInto("mw_test.serving_logs")
        sinks.rerun_scope(df.where("false"), "mw_test.serving_logs", "a")
        left = spark.table("mw_test.serving_logs").collect()
        assert [(r.scope_id, r.income_band, r.probability, r.true_label) for r in left] == [("b", 3, .88, None)]
        later = df.where("scope_id = 'b'").withColumn("ts", F.col("ts") + F.expr("INTERVAL 1 DAY"))
        sinks.rerun_scope(later, "mw_test.serving_logs", "b")
        assert [str(r.event_date) for r in spark.table("mw_test.serving_logs").collect()] == ["2026-08-02"]
    finally:
        spark.sql("DROP DATABASE mw_test CASCADE")


def saved_rows(spark, ids, run="r"):
    inv = spark.createDataFrame([(i, f"a-{i}", "s", ts("2026-08-05"), "accuracy", .7, ts("2026-08-05"), "completed", "control", 1.0, ["label_shift"], run) for i in ids], schemas.INVESTIGATIONS)
    ev = spark.createDataFrame([(i, "s", 1, k, "h", "proven", "feature_drift", "text", '{"ks_stat": 0.5}') for i in ids for k in (0, 1)],
                               "investigation_id string, scope_id string, step int, position long, hypothesis string, status string, evidence_type string, evidence_summary string, evidence_data string")
    return inv, ev


def test_investigations_and_results_are_saved(spark, tmp_path):
    sinks.save_investigations(*saved_rows(spark, ["i"]), str(tmp_path))
    back = sinks.read_saved(spark, str(tmp_path), "evidence")
    assert back.select(F.variant_get("evidence_data", "$.ks_stat", "double")).first()[0] == .5
    assert [f.name for f in schemas.EVIDENCE_RECORDS] == [c for c in back.columns if c != "run_id"]
    res = spark.createDataFrame([("sc_001", "control", "control", True, 1.0, 1.5, True, "")], schemas.RESULTS)
    sinks.save_results(res, str(tmp_path / "results"))
    assert tables.read_results(spark, str(tmp_path / "results")).collect() == res.collect()


def test_saved_runs_hold_no_doubles(spark, tmp_path):
    """The same run twice, an overlapping run, and one that broke off before its marker, in part and as a whole."""
    path = str(tmp_path)
    count = lambda: (sorted((r.investigation_id, r.reasoning) for r in sinks.read_saved(spark, path).collect()), sinks.read_saved(spark, path, "evidence").count())
    first = sinks.save_investigations(*saved_rows(spark, ["i", "j"]), path)
    assert sinks.save_investigations(*saved_rows(spark, ["j", "i"]), path) == first and count() == ([("i", "r"), ("j", "r")], 4)
    inv, ev = saved_rows(spark, ["k"])
    ev.withColumn("evidence_data", F.parse_json("evidence_data")).write.parquet(f"{path}/evidence/run_id=broken")
    assert count() == ([("i", "r"), ("j", "r")], 4)
    inv.write.parquet(f"{path}/investigations/run_id=broken")
    assert count() == ([("i", "r"), ("j", "r")], 4)
    sinks.save_investigations(inv, ev, path, "broken")
    assert count() == ([("i", "r"), ("j", "r"), ("k", "r")], 6)
    sinks.save_investigations(*saved_rows(spark, ["i"], "later"), path, "later")
    assert count() == ([("i", "later"), ("j", "r"), ("k", "r")], 6)
    sinks.save_investigations(*[x.where("false") for x in saved_rows(spark, ["i"])], path)
    assert count()[1] == 6


def test_created_tables_take_an_investigation(spark, rows):
    spark.sql("CREATE DATABASE IF NOT EXISTS mw_logs")
    try:
        tables.create_tables(spark, "mw_logs")
        made = investigate.run(one_alert(spark), rows, rows, spark.createDataFrame([], schemas.MODEL_VERSIONS), spark.createDataFrame([], schemas.COMMITS))
        run_ts = F.lit("2026-08-06").cast("timestamp_ntz")
        for frame, name in ((made.investigations(run_ts), "investigation_logs"), (made.evidence_records(run_ts).withColumn("evidence_data", F.parse_json("evidence_data")), "evidence_records")):
            table = spark.table(f"mw_logs.{name}")
            assert sorted(frame.columns) == sorted(table.columns)
            frame.select(*table.columns).write.insertInto(f"mw_logs.{name}")
        assert spark.table("mw_logs.investigation_logs").count() == 1
    finally:
        spark.sql("DROP DATABASE mw_logs CASCADE")


def test_push_append_replace_read_share_one_layout(spark, tmp_path):
    """The chain on one table: the folders do not follow the scopes, files are sorted, and what is replaced is replaced alone."""
    path = str(tmp_path / "t")
    day = lambda d: ts("2026-08-01") + timedelta(days=d)
    make = lambda scopes, days, x: spark.createDataFrame([(s, "u", day(d), x) for s in scopes for d in days], "scope_id string, entity_id string, ts timestamp_ntz, x int")
    many = [f"s{k}" for k in range(200)]
    sinks.push_features(make(many, (0, 1), 1), path)
    sinks.append_logs(make(["s1", "s2", None], (1, 2), 2), path)
    sinks.replace_scopes(make(["s1", None], (1,), 3).union(make(["new"], (5,), 3)), path)
    want = {(s, d, 1): 1 for s in many for d in (0, 1)} | {("s1", 2, 2): 1, ("s2", 1, 2): 1, ("s2", 2, 2): 1, (None, 2, 2): 1, ("s1", 1, 3): 1, (None, 1, 3): 1, ("new", 5, 3): 1}
    del want["s1", 1, 1]
    got = [(r.scope_id, (r.ts - day(0)).days, r.x) for r in spark.read.parquet(path).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    folders = [(a, b) for a in os.listdir(path) if a.startswith("event_date") for b in os.listdir(f"{path}/{a}") if b.startswith("scope_bucket")]
    assert len(folders) <= 4 * tables.SCOPE_BUCKETS
    one = sinks.of_scopes(spark.read.parquet(path), ["s7"])
    assert one.count() == 2 and "scope_bucket#" in one._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1].split("PushedFilters")[0]
    for f in spark.read.parquet(path).inputFiles()[:5]:
        keys = [(r.scope_id or "", r.ts) for r in spark.read.parquet(f).collect()]
        assert keys == sorted(keys)
    sinks.replace_scopes(make(["s9"], (0,), 4), str(tmp_path / "fresh"))
    assert spark.read.parquet(str(tmp_path / "fresh")).count() == 1


def test_window_operators_prune_days_by_themselves(spark, tmp_path):
    days = [(f"u{d % 3}", ts("2026-07-20") + timedelta(days=d, hours=23, minutes=59), d, d % 2) for d in range(30)]
    sinks.push_features(spark.createDataFrame(days, "entity_id string, ts timestamp_ntz, x int, true_label int"), str(tmp_path / "view"), scope="s")
    made = [("s", f"c{d}", "ann", ts("2026-07-20") + timedelta(days=d), "m", [fv.WATCHED_PATH], []) for d in range(30)]
    sinks.push_features(spark.createDataFrame(made, schemas.COMMITS), str(tmp_path / "commits"), ts="committed_at")
    view, log = tables.read_feature_view(spark, str(tmp_path / "view")), spark.read.parquet(str(tmp_path / "commits"))
    a = alert(spark, alert_ts="2026-08-06", windows=("2026-07-25", "2026-08-01", "2026-08-03", "2026-08-08"))
    for rows_of, run in [(view, lambda v: logs.in_time(v, "2026-08-02 00:00:00", "2026-08-05 00:00:00").select("entity_id", "ts", "x")),
                         (view, lambda v: drift.feature_drift(v, a, ["x"], min_n=1)),
                         (view, lambda v: labels.label_shift(v, a, min_n=1)),
                         (view, lambda v: freshness.feature_freshness(v, v, a, min_n=1, hot_rows=None)),
                         (log, lambda v: commits.in_window(v, a).select("commit_hash", "summary"))]:
        got = run(rows_of)
        assert "PartitionFilters: [isnotnull(event_date" in got._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(str, got.collect())) == sorted(map(str, run(rows_of.drop("event_date")).collect())) != []


def test_a_scope_is_replaced_whole_in_dynamic_mode_too(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS mw_dynamic")
    setting = "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "dynamic")
    try:
        tables.create_tables(spark, "mw_dynamic")
        row = [(s, 1, "u", ts("2026-08-01"), 3, 720, .35, 5, 1, .88, 1) for s in "ab"]
        df = sinks.laid_out(spark.createDataFrame(row, schemas.SERVING_LOGS))
        df.select(*spark.table("mw_dynamic.serving_logs").columns).write.insertInto("mw_dynamic.serving_logs")
        sinks.rerun_scope(df.where("scope_id = 'b'").withColumn("ts", F.col("ts") + F.expr("INTERVAL 1 DAY")), "mw_dynamic.serving_logs", "b")
        assert sorted((r.scope_id, str(r.event_date)) for r in spark.table("mw_dynamic.serving_logs").collect()) == [
            ("a", "2026-08-01"), ("b", "2026-08-02")]
        assert spark.conf.get(setting) == "dynamic"
    finally:
        spark.conf.set(setting, before)
        spark.sql("DROP DATABASE mw_dynamic CASCADE")


def test_paged_evidence_is_bounded(spark):
    inv = spark.createDataFrame([("big", 1), ("small", 2), ("none", 3)], "investigation_id string, x int")
    n = 100_000
    ev = spark.range(n).select(F.lit("big").alias("investigation_id"), F.lit(3).alias("step"), F.col("id").alias("position"), F.lit("git_commit").alias("evidence_type"))
    ev = ev.unionByName(spark.createDataFrame([("small", 1, 0, "feature_drift")], ev.schema))
    pages = investigation_logs.paged(inv, ev, 1000).cache()
    assert pages.agg(F.max(F.size("evidence"))).first()[0] == 1000 and pages.count() == n // 1000 + 2
    flat = [e.position for r in pages.where("investigation_id = 'big'").orderBy("page").collect() for e in r.evidence]
    assert flat == list(range(n))
    rest = {r.investigation_id: (r.page, r.pages, len(r.evidence)) for r in pages.where("investigation_id <> 'big'").collect()}
    assert rest == {"small": (1, 1, 1), "none": (1, 1, 0)}


def test_scenarios_are_read_from_a_json_array(spark, tmp_path):
    (tmp_path / "metadata.json").write_text(
        '[{"scenario_id": "sc_001", "injected_failure": "control", "injected_feature": null, "injection_date": "2026-08-03",'
        '"true_root_cause": "none", "evidence_should_include": []}]')
    row = tables.read_scenarios(spark, str(tmp_path / "metadata.json")).first()
    assert (row.scenario_id, str(row.injection_date), row.evidence_should_include, row.git_commit_hash) == ("sc_001", "2026-08-03", [], None)


# ---- streaming --------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def arrivals(spark, rows, tmp_path_factory):
    """Three files, out of time order, the last one repeating events of the first."""
    path = str(tmp_path_factory.mktemp("arrivals") / "in")
    df = rows.withColumn("event_id", F.col("ingest_seq")).withColumn("value", F.col("debt_to_income"))
    third = F.col("ingest_seq") % 3
    for part in (df.where(third == 1), df.where(third == 0), df.where(third == 2).union(df.where("ingest_seq % 300 = 1"))):
        part.coalesce(1).write.mode("append").parquet(path)
    return path


def test_push_once_drops_repeats(spark, arrivals, tmp_path):
    stream = jobs.read_stream(spark, arrivals, spark.read.parquet(arrivals).schema, files_per_batch=1)
    out, state = str(tmp_path / "view"), str(tmp_path / "state")
    jobs.push_once(stream, out, state)
    got = spark.read.parquet(out)
    assert spark.read.parquet(arrivals).count() > 12_000
    assert got.count() == got.select("event_id").distinct().count() == 12_000
    jobs.push_once(stream, out, state)                       # nothing new: nothing written
    assert spark.read.parquet(out).count() == 12_000


def test_daily_metrics_equal_batch(spark, arrivals, tmp_path):
    source = spark.read.parquet(arrivals)
    stream = jobs.read_stream(spark, arrivals, source.schema, files_per_batch=1)
    jobs.daily_metrics(stream, str(tmp_path / "t"), str(tmp_path / "s"))
    got = {str(r.day): (r.n, round(r.accuracy, 9), round(r.label_rate, 9))
           for r in jobs.current(spark, str(tmp_path / "t"), ["scope_id", "day"]).collect()}
    want = {str(r.day): (r.n, round(r.accuracy, 9), round(r.y, 9)) for r in
            metrics.daily_accuracy(source).join(source.groupBy(F.to_date("ts").alias("day")).agg(F.avg("true_label").alias("y")), "day").collect()}
    assert got == want and len(os.listdir(tmp_path / "t")) >= 3               # several micro-batches, merged on read


def test_streams_do_not_depend_on_the_session_zone(spark, arrivals, tmp_path):
    zone = spark.conf.get("spark.sql.session.timeZone")
    want = {(str(r.day), r.n) for r in metrics.daily_accuracy(spark.read.parquet(arrivals)).collect()}
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        stream = jobs.read_stream(spark, arrivals, spark.read.parquet(arrivals).schema)
        jobs.daily_metrics(stream, str(tmp_path / "t"), str(tmp_path / "s"))
        got = {(str(r.day), r.n) for r in jobs.current(spark, str(tmp_path / "t"), ["scope_id", "day"]).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert got == want


def test_online_features_equal_batch(spark, arrivals, rows, tmp_path):
    from modelwatch.operators.asof import latest
    stream = jobs.read_stream(spark, arrivals, spark.read.parquet(arrivals).schema, files_per_batch=1)
    jobs.online_features(stream, str(tmp_path / "t"), str(tmp_path / "s"), ["entity_id"], ["credit_score"])
    now = jobs.current(spark, str(tmp_path / "t"), ["entity_id"], ["ts", "ingest_seq"])
    want = latest(rows, "entity_id", features=["credit_score"], tie="ingest_seq")
    assert {(r.entity_id, r.credit_score) for r in now.collect()} == {(r.entity_id, r.credit_score) for r in want.collect()}
    jobs.compact(spark, str(tmp_path / "t"), str(tmp_path / "c"), ["entity_id"], ["ts", "ingest_seq"])
    assert spark.read.parquet(str(tmp_path / "c")).count() == 50


def test_state_equals_batch(spark, arrivals, rows, tmp_path):
    """Keyed state after several micro-batches and a restart, read back by the state reader."""
    schema = spark.read.parquet(arrivals).schema
    for _ in range(2):  # the second run finds nothing new
        jobs.online_state(jobs.read_stream(spark, arrivals, schema, files_per_batch=1), str(tmp_path / "o"), ["entity_id"], ["credit_score"])
        jobs.daily_state(jobs.read_stream(spark, arrivals, schema, files_per_batch=1), str(tmp_path / "d"), feature="credit_score")
    whole = spark.read.parquet(arrivals)
    want = {r.entity_id: (r.ts, r.credit_score) for r in asof.latest(whole, "entity_id", features=["credit_score"], tie="ingest_seq").collect()}
    got = jobs.read_online_state(spark, str(tmp_path / "o")).collect()
    assert {r.entity_id: (r.ts, r.credit_score) for r in got} == want and len(got) == len(want)
    daily = {(r.scope_id, r.d): (r.n, round(r.a, 9)) for r in whole.groupBy("scope_id", F.to_date("ts").alias("d")).agg(
        F.count("*").alias("n"), F.avg((F.col("prediction") == F.col("true_label")).cast("double")).alias("a")).collect()}
    assert {(r.scope_id, r.day): (r.n, round(r.accuracy, 9)) for r in jobs.read_daily_state(spark, str(tmp_path / "d")).collect()} == daily


def test_late_rows_are_what_the_watermark_drops(spark, tmp_path):
    ddl = "scope_id string, ts timestamp_ntz, value double, prediction int, true_label int, id int"
    parts = [[("s", "2026-07-10T12:00:00"), ("s", "2026-07-01T01:00:00")], [("s", "2026-07-20T00:00:00"), ("s", "2026-07-02T00:00:00")],
             [("s", "2026-07-17T23:00:00"), ("t", "2026-07-18T00:00:00"), ("s", "2026-07-03T00:00:00"), ("s", "2026-07-21T00:00:00")]]
    for k, part in enumerate(parts):
        made = [(s, ts(t), 1.0, 1, 1, 10 * k + i) for i, (s, t) in enumerate(part)]
        spark.createDataFrame(made, ddl).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = lambda: jobs.read_stream(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema)
        jobs.late_rows(stream(), str(tmp_path / "side"), str(tmp_path / "s1"), "2 days")
        jobs.daily_metrics(stream(), str(tmp_path / "t"), str(tmp_path / "s2"), delay="2 days")
    late = {r.id for r in spark.read.parquet(str(tmp_path / "side" / "late")).collect()}
    assert late == {11, 20, 22}  # before the 8th in the second arrival, before the 18th in the third
    counted = sum(r.n for r in jobs.current(spark, str(tmp_path / "t"), ["scope_id", "day"]).collect())
    assert counted + len(late) == 8
