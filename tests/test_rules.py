import pytest
from support import alert, ts
from pyspark.sql import functions as F

from modelwatch import fixed_values as fv
from modelwatch.operators import commits, logs, registry, rules
from modelwatch.plans import evaluate, investigate

DDL = ("alert_id string, scope_id string, evidence_type string, step int, position long, status string, "
       "description string, feature_name string, score double, data string")
STEP = {"feature_drift": 1, "model_registry_diff": 2, "git_commit": 3, "label_drift": 4, "feature_staleness": 5, "serving_skew": 6}


def evidence(spark, *rows):
    return spark.createDataFrame(
        [("a-s", "s", kind, STEP[kind], i, "x", f"{kind} on {feature}", feature, score, "{}")
         for i, (kind, feature, score) in enumerate(rows)], DDL)


DRIFT = lambda f: ("feature_drift", f, .001)
COMMIT, STALE, LABEL = ("git_commit", None, None), ("feature_staleness", None, 2.5), ("label_drift", None, .2)
DEPLOY = lambda delta: ("model_registry_diff", None, delta)


@pytest.mark.parametrize("rows,cause,proven", [
    ([DRIFT("income_band")], "feature_drift", "h1"),
    ([COMMIT, DRIFT("credit_score")], "pipeline_bug", "h3"),
    ([STALE, DEPLOY(-.3)], "stale_feature", "h6"),
    ([DEPLOY(-.06)], "bad_model_deploy", "h2"),
    ([DEPLOY(-.05)], "control", None),
    ([DEPLOY(None)], "control", None),
    ([LABEL, DRIFT("debt_to_income")], "label_shift", "h4"),
    ([DRIFT("debt_to_income"), DRIFT("income_band")], "serving_skew", "h5"),
    ([("serving_skew", "income_band", 100.0)], "serving_skew", "h5"),
    ([COMMIT], "control", None),
    ([COMMIT, DRIFT("income_band")], "feature_drift", "h1"),
    ([COMMIT, DRIFT("credit_score"), STALE, DEPLOY(-.3), LABEL], "pipeline_bug", "h3"),
    ([], "control", None),
])
def test_rule_order(spark, rows, cause, proven):
    found = rules.root_cause(evidence(spark, *rows), alert(spark))
    row = found.first()
    assert row.cause == cause
    assert row.confidence == {"pipeline_bug": .98, "control": 1.0}.get(cause, .95)
    assert row.ruled_out == [c for c in fv.CAUSES if c != cause]
    status = {h.hypothesis_id: h.status for h in rules.hypothesis_status(found).collect()}
    assert status == {h: "proven" if h == proven else "eliminated" for h, _, _ in fv.HYPOTHESES}


def test_reasoning_names_first_drifted_feature_and_newest_commit(spark):
    rows = evidence(spark, DRIFT("b"), DRIFT("a"))
    assert rules.root_cause(rows, alert(spark)).first().reasoning == "Upstream feature drift detected on feature 'b'."
    late = evidence(spark, STALE)
    assert "over 2.50 days old" in rules.root_cause(late, alert(spark)).first().reasoning
    bug = evidence(spark, COMMIT, DRIFT("credit_score"))
    assert rules.root_cause(bug, alert(spark)).first().reasoning.endswith("detected. git_commit on None")


def test_skew_audit_is_optional(spark):
    rows = evidence(spark, ("serving_skew", "income_band", 100.0))
    config = rules.RuleConfig(audit_counts_as_skew=False)
    assert rules.root_cause(rows, alert(spark), config).first().cause == "control"


def test_evidence_speaks_to_last_matching_hypothesis(spark):
    rows = evidence(spark, DRIFT("income_band"), DRIFT("debt_to_income"), DEPLOY(-.3), COMMIT, LABEL, STALE)
    hyp = rules.hypothesis_status(rules.root_cause(rows, alert(spark)))
    got = {(r.evidence_type, r.feature_name): r.hypothesis for r in rules.evidence_hypothesis(rows, hyp).collect()}
    text = {h: t for h, _, t in fv.HYPOTHESES}
    assert got == {("feature_drift", "income_band"): text["h1"], ("feature_drift", "debt_to_income"): text["h5"],
                   ("model_registry_diff", None): text["h2"], ("git_commit", None): text["h3"],
                   ("label_drift", None): text["h4"], ("feature_staleness", None): text["h6"]}
    none = rules.evidence_hypothesis(rows.limit(1), hyp.where(F.lit(False))).first()
    assert (none.hypothesis, none.hypothesis_status) == ("General Evidence", "unresolved")


def versions(spark):
    p1 = {"model_type": "RandomForestClassifier", "n_estimators": "50", "max_depth": "5"}
    m1 = {"accuracy": .82, "f1_score": .85, "precision": .84, "recall": .86}
    p2, m2 = {**p1, "max_depth": "7", "seed": "1"}, {"accuracy": .55, "f1_score": .60}
    return spark.createDataFrame([("s", "A", 1, "r1", p1, m1), ("s", "A", 2, "r2", p2, m2), ("s", "A", 10, "r10", p2, m2),
                                  ("s", "B", 1, "b1", p1, m1), ("t", "A", 1, "r1", p1, m1), ("t", "A", 2, "r2", p2, m2)],
                                 "scope_id string, model_name string, version int, run_id string, "
                                 "params map<string,string>, metrics map<string,double>")


def test_registry_payload_and_single_version(spark):
    v = spark.createDataFrame([("s", "A", 1, "r1", {"trees": "50", "old": "x"}, {"accuracy": .9, "auc": .8}), ("s", "A", 2, "r2", {"trees": "60", "new": "y"}, {"accuracy": .7, "loss": .5}),
                               ("s", "B", 3, "r3", {"b": "2", "a": "1"}, {"f1": .25, "accuracy": .5}), ("s", "C", 1, "r4", None, None)],
                              "scope_id string, model_name string, version int, run_id string, params map<string,string>, metrics map<string,double>")
    report = {r.model_name: r for r in registry.registry_report(v).collect()}
    a, b, c = (report[k] for k in "ABC")
    assert {k: tuple(x) for k, x in a.param_changes.items()} == {"trees": ("50", "60"), "old": ("x", None), "new": (None, "y")}
    assert {k: tuple(x) for k, x in a.metric_changes.items()} == {"accuracy": (.9, .7, pytest.approx(-.2)), "auc": (.8, None, None), "loss": (None, .5, None)}
    assert (a.latest_params, a.latest_metrics) == ({"trees": "60", "new": "y"}, {"accuracy": .7, "loss": .5})
    assert (b.status, b.version_count, b.latest_version, b.latest_run_id, b.param_changes) == ("single_version", 1, "3", "r3", None)
    assert b.summary == "Only model version 3 is registered. Parameters: {'a': '1', 'b': '2'}. Metrics: {'accuracy': 0.5, 'f1': 0.25}."
    assert c.summary == "Only model version 1 is registered. Parameters: {}. Metrics: {}."
    assert a.summary == "Compared version 2 vs version 1. Param changes: [new, old, trees]. Metric deltas: {accuracy: -0.2000}."
    alerts = spark.createDataFrame([("x", "s", "A"), ("y", "s", "B"), ("z", "s", "none")], "alert_id string, scope_id string, model_name string")
    evidence = rules.registry_evidence(registry.alert_report(v, alerts))
    changes = rules.payload(evidence, "$.metric_changes", "map<string,struct<previous:double,latest:double,delta:double>>").collect()
    assert [(r.alert_id, {k: tuple(x) for k, x in r.value.items()}) for r in changes] == [("x", {"accuracy": (.9, .7, pytest.approx(-.2)), "auc": (.8, None, None), "loss": (None, .5, None)})]
    kept = evidence.withColumn("data", F.parse_json("data"))  # as the log stores it
    assert rules.payload(kept, "$.param_changes.trees.latest", "string").first().value == "60"
    assert rules.payload(kept, "$.nothing", "string").first().value is None
    lines = {(r.model_name, r.kind, r.key): (r.previous, r.latest, r.latest_number) for r in registry.report_lines(registry.registry_report(v)).collect()}
    assert lines["B", "latest_param", "a"] == (None, "1", None) and lines["A", "param_change", "old"] == ("x", None, None) and ("C", "latest_param", "a") not in lines


def test_ties_go_by_name(spark):
    rows = [("a", "s", "git_commit", 3, -5, "commit_found", d, None, None, None) for d in ("Commit by z", "Commit by b", "Commit by c")]
    rows += [("a", "s", "feature_drift", 1, 0, "drift_detected", "d", "credit_score", .01, None)]
    alerts = spark.createDataFrame([("a", "s")], "alert_id string, scope_id string")
    ddl = "alert_id string, scope_id string, evidence_type string, step int, position long, status string, description string, feature_name string, score double, data string"
    for order in (rows, rows[::-1]):
        assert "Commit by b" in rules.root_cause(spark.createDataFrame(order, ddl), alerts).first().reasoning


def test_registry(spark):
    v = versions(spark)
    heads = {(r.scope_id, r.model_name): (r.version_count, r.latest_version, r.previous_version, r.status)
             for r in registry.version_summary(v).collect()}
    assert heads == {("s", "A"): (3, "10", "2", "ok"), ("s", "B"): (1, "1", None, "single_version"), ("t", "A"): (2, "2", "1", "ok")}
    params = {(r.scope_id, r.key): (r.previous, r.latest) for r in registry.param_diff(v).collect()}
    assert params == {("t", "max_depth"): ("5", "7"), ("t", "seed"): (None, "1")}
    metrics = {(r.scope_id, r.key): r.delta for r in registry.metric_diff(v).collect()}
    assert metrics == {("s", "accuracy"): 0, ("s", "f1_score"): 0, ("t", "accuracy"): pytest.approx(-.27),
                       ("t", "f1_score"): pytest.approx(-.25), ("t", "precision"): None, ("t", "recall"): None}
    report = {(r.scope_id, r.model_name): r for r in registry.registry_report(v).collect()}
    assert report[("t", "A")].summary == ("Compared version 2 vs version 1. Param changes: [max_depth, seed]. "
                                          "Metric deltas: {accuracy: -0.2700, f1_score: -0.2500}.")
    assert report[("s", "B")].accuracy_delta is None
    alerts = alert(spark, "t", model="A").union(alert(spark, "t", model="gone", alert_id="x"))
    assert {r.alert_id: (r.status, r.version_count) for r in registry.alert_report(v, alerts).collect()} == {
        "a-t": ("ok", 2), "x": ("no_versions", 0)}
    history = {r.version: r.previous_version for r in registry.version_history(v).where("scope_id = 's' and model_name = 'A'").collect()}
    assert history == {1: None, 2: 1, 10: 2}


COMMIT_DDL = ("scope_id string, commit_hash string, author string, committed_at timestamp_ntz, message string, changed_files array<string>, "
              "diffs array<struct<file_path:string,deleted_file:boolean,new_file:boolean,diff_text:string>>")


def history(spark):
    path, diff = "repo/src/pipeline/processing.py", "@@ -1 +1,2 @@\n-old\n+new\n+more\n same"
    row = lambda h, at, f, text, scope="s": (scope, h, "ann", ts(at), f" fix {scope} ", [f], [(f, False, False, text)])
    return spark.createDataFrame([
        row("in", "2026-08-05T06:00:00", path, diff), row("other", "2026-08-05T06:00:00", "README", diff),
        row("out", "2026-08-07T00:00:00", path, diff), row("empty", "2026-08-05T01:00:00", path, ""),
        row("low", "2026-08-04T00:00:00", path, diff), row("high", "2026-08-06T00:00:00", path, diff),
        row("foreign", "2026-08-05T06:00:00", path, diff, "t")], COMMIT_DDL)


def test_commits(spark):
    found = {r.commit_hash: r for r in commits.in_window(history(spark), alert(spark)).collect()}
    assert set(found) == {"in", "empty", "low", "high"}
    assert found["in"].summary == "Commit by ann on 2026-08-05 06:00:00: fix s"
    everything = commits.in_window(history(spark), alert(spark), path=None)
    assert {r.commit_hash for r in everything.collect()} == {"in", "other", "empty", "low", "high"}
    lines = {r.commit_hash: (r.additions, r.deletions, r.meta, r.context, r.lines)
             for r in commits.diff_line_profile(history(spark)).collect()}
    assert lines["in"] == (2, 1, 1, 1, 5) and lines["empty"] == (0, 0, 0, 0, 0)


def results(spark):
    return spark.createDataFrame([
        ("sc_001", "control", "control", True, 1.0, 1.5, True, ""), ("sc_002", "feature_drift", "feature_drift", True, .95, 2.1, True, ""),
        ("sc_003", "bad_model_deploy", "control", False, .5, 1.9, False, "")],
        "scenario_id string, failure_mode string, predicted_cause string, is_correct boolean, confidence double, latency_sec double, "
        "evidence_correct boolean, reasoning string")


def test_evaluation_totals(spark):
    s = evaluate.summary(results(spark)).first()
    assert (s.total_evaluated, round(s.overall_accuracy, 2), round(s.evidence_correctness, 2), s.false_hypothesis_rate,
            round(s.mean_latency, 2)) == (3, 66.67, 66.67, 0.0, 1.83)
    assert tuple(evaluate.summary(results(spark).where("false")).first()) == (0, 0.0, 0.0, 0.0, 0.0)
    by = {r.failure_type: (r["count"], r.accuracy) for r in evaluate.breakdown(results(spark)).collect()}
    assert by == {None: (3, pytest.approx(66.6667, abs=1e-3)), "control": (1, 100.0), "feature_drift": (1, 100.0),
                  "bad_model_deploy": (1, 0.0)}


def test_scenario_table(spark):
    table = evaluate.scenario_table(spark.range(1, 15).withColumnRenamed("id", "ordinal"))
    rows = table.orderBy("scenario_id").collect()
    assert [r.injected_failure for r in rows] == fv.FAILURE_MODES * 2
    assert all("2026-08-03" <= str(r.injection_date) <= "2026-08-08" for r in rows)
    assert rows[3].evidence_should_include == ["git_commit_hash", "feature_store_drift_stat"] and rows[3].injected_feature == "credit_score"
    assert table.collect() == table.collect()


INV_DDL = "investigation_id string, scope_id string, ts timestamp_ntz, alert_ts timestamp_ntz, cause string, confidence double, reasoning string"


def investigations(spark):
    return spark.createDataFrame([
        ("i1", "sc_002", ts("2026-08-05T10:00:00"), ts("2026-08-05"), "control", 1.0, ""),
        ("i2", "sc_002", ts("2026-08-05T12:00:00"), ts("2026-08-05"), "feature_drift", .95, ""),
        ("i3", "sc_001", ts("2026-08-05T00:00:02"), ts("2026-08-05"), "control", 1.0, "")], INV_DDL)


def records(spark):
    return spark.createDataFrame([("i2", "sc_002", "feature_drift", "a"), ("i2", "sc_002", "feature_drift", "b")],
                                 "investigation_id string, scope_id string, evidence_type string, evidence_summary string")


def test_scoring_uses_newest_investigation(spark):
    scenarios = evaluate.scenario_table(spark.range(1, 4).withColumnRenamed("id", "ordinal"))
    got = {r.scenario_id: r for r in evaluate.score(investigations(spark), records(spark), scenarios).collect()}
    assert (got["sc_002"].predicted_cause, got["sc_002"].is_correct, got["sc_002"].evidence_correct) == ("feature_drift", True, True)
    assert (got["sc_001"].is_correct, got["sc_001"].evidence_correct, got["sc_001"].latency_sec) == (True, True, 2.0)
    assert (got["sc_003"].predicted_cause, got["sc_003"].is_correct, got["sc_003"].evidence_correct) == ("error", False, False)


def test_coverage_ignores_unknown_names(spark):
    row = spark.createDataFrame([(["git_commit_hash", "something"], ["git_commit"]), (["label_drift_stat"], ["git_commit"])],
                                "e array<string>, t array<string>")
    assert [r[0] for r in row.select(evaluate.covered(F.col("e"), F.col("t"))).collect()] == [True, False]


def test_nested_logs(spark):
    got = {r.investigation_id: r.evidence for r in logs.nested(investigations(spark), records(spark)).collect()}
    assert got["i1"] == [] and [e.evidence_summary for e in got["i2"]] == ["a", "b"]


def test_triage(spark):
    scenarios = evaluate.scenario_table(spark.range(1, 5).withColumnRenamed("id", "ordinal"))
    present = spark.createDataFrame([("sc_001",), ("sc_004",), ("sc_004",)], "scope_id string")
    got = {r.scenario_id: (r.bucket, r.risk) for r in logs.triage(logs.scenario_status(scenarios, present)).collect()}
    assert got == {"sc_001": ("resolved", "Informational"), "sc_002": ("pending", "High Risk"),
                   "sc_003": ("pending", "Critical Risk"), "sc_004": ("active", "Critical Risk")}


def test_investigation_rows_repeat(spark):
    causes = rules.root_cause(evidence(spark, DRIFT("income_band")), alert(spark))
    inv = investigate.Investigation(evidence(spark, DRIFT("income_band")), causes, rules.hypothesis_status(causes), investigate.Settings())
    at = F.lit("2026-08-06").cast("timestamp_ntz")
    assert inv.investigations(at).first().investigation_id == inv.investigations(at).first().investigation_id
    record = inv.evidence_records(at).first()
    assert record.investigation_id == inv.investigations(at).first().investigation_id
    assert (record.hypothesis, record.status) == (fv.HYPOTHESES[0][2], "proven")
