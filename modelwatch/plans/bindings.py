"""The operators bound to the shared test tables: one function per query.

Roles: ``events`` is the serving log and, by event type, the feature view; ``customer`` gives each
user a scope (market segment or nation); ``orders`` by year are model versions; ``pages`` are commits.
Every frame below is derived from the tables, so all work grows with them.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions.scalars import clamp_int, hash_slot, logistic_score
from ..operators import asof, audit, commits, drift, freshness, labels, logs, metrics, perturb, registry, rules, snapshots
from ..operators.alerts import two_window_slice
from ..schemas import feature_columns
from ..session import stored, work_dir
from ..sources import sinks
from ..streaming import jobs
from . import evaluate, investigate, training

FEATURES = ["value", "k"]
LANGUAGE_SCOPES = {"en": "AUTOMOBILE", "fr": "BUILDING", "de": "FURNITURE", "es": "MACHINERY"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stamp(column: str | Column) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def cutover() -> Column:
    return F.lit("2024-01-16").cast("date")


def r6(column: str | Column) -> Column:
    """Rounded for comparison. The nudge takes exact halves (means of prices over 32 rows end in one) the
    same way in both engines, whose last bits differ; adding zero turns a negative zero into zero.
    """
    x = F.col(column) if isinstance(column, str) else column
    return F.round(x + F.lit(1e-10), 6) + F.lit(0.0)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: r6(c) for c in columns})


def ntz(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


# ---- frames -----------------------------------------------------------------------------------


def with_log_columns(events: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("double")
    return events.select(
        F.col("event_type").alias("scope_id"), F.col("event_id").alias("ingest_seq"), "event_id",
        F.col("user_id").alias("entity_id"), "ts", "value", k.alias("k"),
        (F.col("value") > 50).cast("int").alias("true_label"), (k > 50).cast("int").alias("prediction"))


def event_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as logs, scoped by event type."""
    return with_log_columns(table(spark, sf_dir, "events"))


def purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_logs(spark, sf_dir).where(F.col("scope_id") == "purchase")


def others(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_logs(spark, sf_dir).where(F.col("scope_id") != "purchase")


def by_segment(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    """The same rows, scoped by the user's market segment."""
    segment = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("entity_id"), F.col("c_mktsegment").alias("scope_id"))
    return rows.join(segment, "entity_id")


def alert_frame(scopes: DataFrame, alert_id: Column, model: Column, value: Column, alert: Column,
                windows: list[Column]) -> DataFrame:
    names = ["baseline_start", "baseline_end", "active_start", "active_end"]
    return scopes.select(
        alert_id.alias("alert_id"), "scope_id", model.alias("model_name"), F.lit("accuracy").alias("alert_metric"),
        value.alias("alert_value"), alert.alias("alert_ts"), *[w.alias(n) for w, n in zip(windows, names)])


def scope_alerts(rows: DataFrame) -> DataFrame:
    """One alert per scope: its accuracy since the alert time."""
    hit = (F.col("prediction") == F.col("true_label")).cast("double")
    scopes = rows.groupBy("scope_id").agg(F.avg(F.when(F.col("ts") >= ntz("2024-01-20"), hit)).alias("v"))
    windows = [ntz("2024-01-01"), ntz("2024-01-15"), ntz("2024-01-16"), ntz("2024-01-30")]
    return stored(alert_frame(scopes, F.concat(F.lit("alert-"), "scope_id"), F.lit("1-URGENT"), F.col("v"),
                              ntz("2024-01-20"), windows), "alerts")


def day_alerts(rows: DataFrame) -> DataFrame:
    """One alert per scope and day, with overlapping windows around the day."""
    days = rows.select("scope_id", F.to_date("ts").cast("timestamp_ntz").alias("day")).distinct()
    move = lambda n: F.col("day") + F.make_dt_interval(days=F.lit(n))
    return stored(alert_frame(days, F.concat_ws("-", "scope_id", F.date_format("day", "yyyyMMdd")), F.lit("1-URGENT"),
                              F.lit(0.0), F.col("day"), [move(-10), move(-1), F.col("day"), move(3)]), "alerts")


def segment_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    events = event_logs(spark, sf_dir).withColumnRenamed("scope_id", "event_type")
    rows = by_segment(spark, sf_dir, events)
    view = rows.where(F.col("event_type") == "purchase").select("scope_id", "entity_id", "ts", "ingest_seq", *FEATURES)
    served = rows.where(F.col("event_type") != "purchase")
    return scope_alerts(served), view, served, model_versions(spark, sf_dir), page_commits(spark, sf_dir)


def fleet_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """A model, and an alert, for every user."""
    rows = (event_logs(spark, sf_dir).withColumnRenamed("scope_id", "event_type")
            .withColumn("scope_id", F.col("entity_id").cast("string")))
    view = rows.where(F.col("event_type") == "purchase").select("scope_id", "entity_id", "ts", "ingest_seq", *FEATURES)
    served = rows.where(F.col("event_type") != "purchase")
    orders = table(spark, sf_dir, "orders").withColumn("scope_id", F.col("o_custkey").cast("string"))
    found = page_commits(spark, sf_dir).withColumn("scope_id", F.col("commit_hash"))
    return scope_alerts(served), view, served, order_versions(orders), found


def model_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model per market segment and order priority; a version per order year."""
    segment = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"),
                                                      F.col("c_mktsegment").alias("scope_id"))
    return order_versions(table(spark, sf_dir, "orders").join(segment, "o_custkey"))


def order_versions(orders: DataFrame) -> DataFrame:
    share = lambda s: F.avg((F.col("o_orderstatus") == s).cast("double"))
    stats = (orders
             .groupBy("scope_id", F.col("o_orderpriority").alias("model_name"),
                      (F.year("o_orderdate") - 1994).alias("version"))
             .agg(share("F").alias("accuracy"), share("O").alias("open_share"), F.avg("o_totalprice").alias("price"),
                  F.count_if(F.col("o_orderstatus") == "F").alias("f"), F.count_if(F.col("o_orderstatus") == "O").alias("o"),
                  F.count_if(F.col("o_orderstatus") == "P").alias("p")))
    modal = (F.when((F.col("f") >= F.col("o")) & (F.col("f") >= F.col("p")), "F")
             .when(F.col("o") >= F.col("p"), "O").otherwise("P"))
    recent = F.col("version") > 6
    params = F.map_filter(F.create_map(
        F.lit("modal_status"), modal, F.lit("kind"), F.lit("forest"),
        F.lit("seed"), F.when(recent, F.lit("1"))), lambda k, v: v.isNotNull())
    numbers = F.map_filter(F.create_map(
        F.lit("accuracy"), F.col("accuracy"), F.lit("price"), F.col("price"),
        F.lit("open_share"), F.when(~recent, F.col("open_share"))), lambda k, v: v.isNotNull())
    return stats.select("scope_id", "model_name", "version",
                        F.concat_ws("/", "scope_id", "model_name", F.col("version").cast("string")).alias("run_id"),
                        params.alias("params"), numbers.alias("metrics"))


def page_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as commits of the segment that owns their language; the page source is the diff."""
    lang = F.regexp_extract("url", r"example\.[a-z]+/([a-z]+)/", 1)
    scopes = F.create_map(*[F.lit(x) for kv in LANGUAGE_SCOPES.items() for x in kv])
    at = ntz("2024-01-01") + F.make_dt_interval(mins=hash_slot(F.col("page_id"), "commit", 43200).cast("int"))
    return table(spark, sf_dir, "pages").select(
        F.try_element_at(scopes, lang).alias("scope_id"), F.col("page_id").cast("string").alias("commit_hash"),
        F.lit("author").alias("author"), at.alias("committed_at"),
        F.concat(F.lit("change page "), F.col("page_id").cast("string")).alias("message"),
        F.array("url").alias("changed_files"),
        F.array(F.struct(F.col("url").alias("file_path"), F.lit(False).alias("deleted_file"),
                         F.lit(False).alias("new_file"), F.col("html").alias("diff_text"))).alias("diffs"))


# ---- scans, slices, profiles ------------------------------------------------------------------


def scan_feature_view(spark, sf_dir):
    return purchases(spark, sf_dir).select("event_id", "entity_id", stamp("ts").alias("ts"), "value", "k")


def logs_in_window(spark, sf_dir):
    rows = logs.in_time(event_logs(spark, sf_dir), "2024-01-10", "2024-01-20")
    return rows.select("event_id", "scope_id", stamp("ts").alias("ts"), "prediction", "true_label")


def discovered_features(spark, sf_dir):
    """Feature columns found in the view's schema, with their non-null counts."""
    view = purchases(spark, sf_dir)
    found = feature_columns(view)
    return (view.unpivot([], found, "feature_name", "v").groupBy("feature_name").agg(F.count("v").alias("n")))


def two_window(spark, sf_dir):
    rows = event_logs(spark, sf_dir)
    return (two_window_slice(rows, scope_alerts(rows))
            .select("alert_id", "event_id", F.col("in_base").cast("int").alias("in_base"),
                    F.col("in_target").cast("int").alias("in_target")))


def two_window_profile(spark, sf_dir):
    rows = event_logs(spark, sf_dir)
    out = drift.two_window_profile(rows, scope_alerts(rows), FEATURES)
    return rounded(out, "baseline_mean", "target_mean", "baseline_std", "target_std")


def before_after_profile(spark, sf_dir):
    rows = asof.before_after(event_logs(spark, sf_dir), cutover())
    out = rows.groupBy("scope_id", F.col("after").cast("int").alias("after")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean_value"), F.avg("k").alias("mean_k"))
    return rounded(out, "mean_value", "mean_k")


DRIFT_OUT = ["alert_id", "feature_name", "status", "baseline_count", "target_count", "baseline_mean", "target_mean",
             "baseline_std", "target_std", "ks_stat", "p_value", "is_drifted"]
DRIFT_ROUND = ["baseline_mean", "target_mean", "baseline_std", "target_std", "ks_stat", "p_value"]


def lineitem_drift(spark, sf_dir, p_value):
    items = table(spark, sf_dir, "lineitem").withColumn("scope_id", F.col("l_returnflag"))
    windows = [ntz("1996-01-01"), ntz("1996-12-31"), ntz("1998-01-01"), ntz("1998-06-30")]
    alerts = alert_frame(items.select("scope_id").distinct(), F.col("scope_id"), F.lit("m"), F.lit(0.0),
                         ntz("1998-01-01"), windows)
    features = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    return drift.feature_drift(items, alerts, features, p_value=p_value, ts="l_shipdate")


def feature_drift(spark, sf_dir):
    return rounded(lineitem_drift(spark, sf_dir, "asymptotic").select(*DRIFT_OUT), *DRIFT_ROUND)


def feature_drift_corrected(spark, sf_dir):
    """As feature_drift, with the finite-size correction of the p-values."""
    return rounded(lineitem_drift(spark, sf_dir, "corrected").select(*DRIFT_OUT), *DRIFT_ROUND)


def user_alerts(rows: DataFrame) -> DataFrame:
    """One alert per user over short windows."""
    windows = [ntz("2024-01-01"), ntz("2024-01-06"), ntz("2024-01-16"), ntz("2024-01-21")]
    return alert_frame(rows.select("scope_id").distinct(), F.col("scope_id"), F.lit("m"), F.lit(0.0), ntz("2024-01-16"), windows)


def feature_drift_exact(spark, sf_dir):
    """Exact p-values of every user's few rows."""
    rows = event_logs(spark, sf_dir).withColumn("scope_id", F.col("entity_id").cast("string"))
    return rounded(drift.feature_drift(rows, user_alerts(rows), FEATURES, p_value="exact").select(*DRIFT_OUT), *DRIFT_ROUND)


def drift_all_alerts(spark, sf_dir):
    rows = event_logs(spark, sf_dir)
    out = drift.feature_drift(rows, day_alerts(rows), FEATURES, p_value="asymptotic")
    return rounded(out.select(*DRIFT_OUT), *DRIFT_ROUND)


def drift_status(spark, sf_dir):
    """One alert per user over short windows: many users have too few rows, and one feature is missing."""
    rows = event_logs(spark, sf_dir).withColumn("scope_id", F.col("entity_id").cast("string"))
    alerts = user_alerts(rows)
    return (drift.feature_drift(rows, alerts, [*FEATURES, "absent"], p_value="asymptotic")
            .select("alert_id", "feature_name", "status", "baseline_count", "target_count"))


# ---- as-of ------------------------------------------------------------------------------------


def pit_features(spark, sf_dir):
    right = purchases(spark, sf_dir).select("entity_id", "ts", "ingest_seq", F.col("value").alias("f_value"),
                                            F.col("k").alias("f_k"))
    left = others(spark, sf_dir).select("event_id", "entity_id", "ts")
    out = asof.pit_join(left, right, "entity_id", features=["f_value", "f_k"], tie="ingest_seq", matched_ts="f_ts")
    return out.select("event_id", "entity_id", "f_value", "f_k", stamp("f_ts").alias("f_ts"))


def purchase_snapshots(spark, sf_dir) -> tuple[DataFrame, str]:
    """The purchases as a feature view, and a folder with its snapshots of three days."""
    view = purchases(spark, sf_dir).select("entity_id", "ts", "ingest_seq", F.col("value").alias("f_value"), F.col("k").alias("f_k"))
    path = work_dir(spark, "snapshots")
    snapshots.take_snapshots(view, path, [date(2024, 1, d) for d in (8, 15, 22)], ["entity_id"], ["f_value", "f_k"], tie="ingest_seq")
    return view, path


def feature_snapshots(spark, sf_dir):
    """Each user's latest features as three days begin, each day carried on from the one before."""
    _, path = purchase_snapshots(spark, sf_dir)
    return spark.read.parquet(path).select(F.col("snapshot_date").cast("string").alias("day"), "entity_id", stamp("ts").alias("ts"), "f_value", "f_k")


def pit_window(spark, sf_dir):
    """pit_features for a few days, from one snapshot and the days since."""
    view, path = purchase_snapshots(spark, sf_dir)
    left = others(spark, sf_dir).select("event_id", "entity_id", "ts")
    out = snapshots.pit_join_within(left, view, path, datetime(2024, 1, 16), datetime(2024, 1, 20, 12), ["entity_id"], ["f_value", "f_k"], tie="ingest_seq", matched_ts="f_ts")
    return out.select("event_id", "entity_id", "f_value", "f_k", stamp("f_ts").alias("f_ts"))


def pit_orders(spark, sf_dir):
    """Shipments with the customer's latest order at ship time."""
    orders = table(spark, sf_dir, "orders")
    left = (table(spark, sf_dir, "lineitem").join(orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"),
                                                  "l_orderkey")
            .select("l_orderkey", "l_linenumber", "o_custkey", F.col("l_shipdate").alias("ts")))
    right = orders.select("o_custkey", "o_orderkey", F.col("o_orderdate").alias("order_ts"),
                          F.col("o_totalprice").alias("last_price"), F.col("o_orderkey").alias("last_order"))
    out = asof.pit_join(left, right, "o_custkey", "ts", "order_ts", ["last_price", "last_order"], tie="o_orderkey")
    return out.select("l_orderkey", "l_linenumber", "o_custkey", stamp("ts").alias("ts"), "last_price",
                      F.col("last_order").cast("double").alias("last_order"))


def online_features(spark, sf_dir):
    ids = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity_id"))
    out = asof.latest(purchases(spark, sf_dir), "entity_id", features=FEATURES, ids=ids, tie="ingest_seq")
    return out.select("entity_id", stamp("ts").alias("ts"), *FEATURES)


def assembled_log(spark, sf_dir):
    online = asof.latest(purchases(spark, sf_dir), "entity_id", features=FEATURES, tie="ingest_seq").drop("ts")
    requests = others(spark, sf_dir).select("event_id", "entity_id", "prediction", "true_label")
    return logs.assemble(requests, online, "entity_id")


def feature_freshness(spark, sf_dir):
    alerts, view, served, _, _ = segment_inputs(spark, sf_dir)
    out = freshness.feature_freshness(served, view, alerts, threshold_days=2.0).drop("scope_id", "summary")
    return rounded(out, "mean_lag_days", "max_lag_days", "share_over_threshold")


def serving_skew_audit(spark, sf_dir):
    _, view, served, _, _ = segment_inputs(spark, sf_dir)
    served = served.select("scope_id", "entity_id", "ts", *FEATURES)
    out = audit.serving_skew_audit(served, view, FEATURES, ["scope_id", "entity_id"], ["scope_id"], tie="ingest_seq")
    return rounded(out, "mismatch_rate", "median_ratio")


def score_column() -> Column:
    return logistic_score(clamp_int(F.col("f_value") * 5), F.col("f_k") / 20, F.col("f_value") / 600, F.col("f_k") / 10)


def training_rows(spark, sf_dir) -> DataFrame:
    view = purchases(spark, sf_dir).select("entity_id", "ts", "ingest_seq", F.col("value").alias("f_value"),
                                           F.col("k").alias("f_k"))
    return training.training_set(others(spark, sf_dir).select("event_id", "entity_id", "ts"), view, ["entity_id"],
                                 ["f_value", "f_k"], score_column(), "event_id", tie="ingest_seq")


def training_set(spark, sf_dir):
    return rounded(training_rows(spark, sf_dir).select("event_id", "f_value", "f_k", "probability", F.col("label").cast("double").alias("label")),
                   "probability")


def clamp_truncate(spark, sf_dir):
    return event_logs(spark, sf_dir).select("event_id", clamp_int(F.col("value") * 5).alias("score"))


def logistic(spark, sf_dir):
    rows = event_logs(spark, sf_dir)
    p = logistic_score(clamp_int(F.col("value") * 5), F.col("k") / 20, F.col("value") / 600, F.col("k") / 10,
                       shifted=perturb.after(cutover()))
    return rows.select("event_id", r6(p).alias("probability"))


# ---- labels and metrics -----------------------------------------------------------------------


def label_shift(spark, sf_dir):
    rows = event_logs(spark, sf_dir)
    out = labels.label_shift(rows, scope_alerts(rows), threshold=0.02).drop("scope_id", "summary")
    return rounded(out, "baseline_mean", "target_mean", "drift_delta")


def classification_metrics(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", (F.col("n_chars") > 1000).cast("int").alias("prediction"))
    rows = docs.join(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("true_label")), "doc_id")
    return rounded(metrics.classification_metrics(rows, ["lang"]), "accuracy", "precision", "recall", "f1_score")


def daily_accuracy(spark, sf_dir):
    out = metrics.daily_accuracy(event_logs(spark, sf_dir)).withColumn("day", F.col("day").cast("string"))
    return rounded(out, "accuracy")


def derived_alerts(spark, sf_dir):
    out = metrics.derived_alerts(metrics.daily_accuracy(event_logs(spark, sf_dir)), z=1.0)
    return rounded(out.withColumn("alert_day", F.col("alert_day").cast("string")), "alert_value", "expected", "lower_bound")


# ---- registry and commits ---------------------------------------------------------------------


def registry_versions(spark, sf_dir):
    return registry.version_summary(model_versions(spark, sf_dir))


def latest_two_versions(spark, sf_dir):
    return registry.latest_two(model_versions(spark, sf_dir)).select(
        "scope_id", "model_name", F.col("version").cast("long").alias("version"),
        F.col("version_rank").cast("long").alias("version_rank"), "run_id")


def version_history(spark, sf_dir):
    return registry.version_history(model_versions(spark, sf_dir)).select(
        "scope_id", "model_name", F.col("version").cast("double").alias("version"),
        F.col("previous_version").cast("double").alias("previous_version"))


def registry_param_diff(spark, sf_dir):
    return registry.param_diff(model_versions(spark, sf_dir))


def registry_metric_diff(spark, sf_dir):
    return rounded(registry.metric_diff(model_versions(spark, sf_dir)), "previous", "latest", "delta")


def registry_report(spark, sf_dir):
    """Reports of a model per customer and order priority, many of which have one version only; a row for each entry of their maps."""
    orders = table(spark, sf_dir, "orders").withColumn("scope_id", F.col("o_custkey").cast("string"))
    return rounded(registry.report_lines(registry.registry_report(order_versions(orders))), "previous_number", "latest_number", "delta")


def commits_in_window(spark, sf_dir):
    alerts, _, _, _, found = segment_inputs(spark, sf_dir)
    return commits.in_window(found, alerts, path="example.com").select(
        "alert_id", "commit_hash", stamp("committed_at").alias("committed_at"), "message", "summary",
        F.element_at("changed_files", 1).alias("changed_file"))


def diff_line_profile(spark, sf_dir):
    return commits.diff_line_profile(page_commits(spark, sf_dir)).drop("scope_id")


# ---- evidence, rules, investigation -----------------------------------------------------------

SEGMENT_SETTINGS = investigate.Settings(
    features=FEATURES, p_value="asymptotic", label_drop=0.02, stale_days=2.5, watched_path="example.com",
    rules=rules.RuleConfig(bug_feature="k", skew_feature="value"))


def segment_investigation(spark, sf_dir) -> investigate.Investigation:
    return investigate.run(*segment_inputs(spark, sf_dir), SEGMENT_SETTINGS)


def evidence_all(spark, sf_dir):
    return (rounded(segment_investigation(spark, sf_dir).evidence, "score")
            .select("alert_id", "evidence_type", "step", "position", "status", "feature_name", "score"))


def evidence_text(spark, sf_dir):
    """One sentence per positive finding (labels, freshness, commits: numbers with two to four decimals)."""
    evidence = segment_investigation(spark, sf_dir).evidence
    return evidence.select("alert_id", "evidence_type", "position", "description")


def evidence_payload(spark, sf_dir):
    """Metric changes read back out of the payload of the registry evidence."""
    evidence = segment_investigation(spark, sf_dir).evidence.where("evidence_type = 'model_registry_diff'")
    found = rules.payload(evidence, "$.metric_changes", "map<string,struct<previous:double,latest:double,delta:double>>")
    return rounded(found.select("alert_id", F.explode("value").alias("key", "v")).select("alert_id", "key", "v.previous", "v.latest", "v.delta"), "previous", "latest", "delta")


def root_cause(spark, sf_dir):
    return (segment_investigation(spark, sf_dir).causes
            .select("alert_id", "scope_id", "cause", "confidence", F.concat_ws(",", "ruled_out").alias("ruled_out")))


def hypothesis_status(spark, sf_dir):
    return segment_investigation(spark, sf_dir).hypotheses


def evidence_hypothesis(spark, sf_dir):
    inv = segment_investigation(spark, sf_dir)
    return (rules.evidence_hypothesis(inv.evidence, inv.hypotheses, SEGMENT_SETTINGS.rules)
            .select("alert_id", "evidence_type", "position", "hypothesis", "hypothesis_status"))


def investigate_segments(spark, sf_dir):
    """The flagship: every alert with its cause, confidence, ruled-out causes and evidence counts."""
    causes = segment_investigation(spark, sf_dir).causes
    return causes.select("alert_id", "scope_id", "alert_metric", r6("alert_value").alias("alert_value"), "cause",
                         "confidence", F.concat_ws(",", "ruled_out").alias("ruled_out"), "n_evidence", "n_types")


def investigate_fleet(spark, sf_dir):
    """One alert per user, all in one run."""
    causes = investigate.run(*fleet_inputs(spark, sf_dir), SEGMENT_SETTINGS).causes
    return causes.select("alert_id", r6("alert_value").alias("alert_value"), "cause", "confidence", "n_evidence", "n_types")


def two_runs(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Investigation and evidence logs after two runs, at the alert time and one day later."""
    inv = segment_investigation(spark, sf_dir)
    first, second = F.col("alert_ts"), F.col("alert_ts") + F.expr("INTERVAL 1 DAY")
    # ids are built from alert and run time, so that the check can repeat them
    shown = lambda df, at: df.withColumn("ts", at)
    runs = shown(inv.causes, first).unionByName(shown(inv.causes, second)).withColumn(
        "investigation_id", F.concat_ws("|", "alert_id", stamp("ts")))
    ids = runs.where(F.col("ts") == F.col("alert_ts")).select("alert_id", "investigation_id")
    return runs, inv.evidence.join(ids, "alert_id")


def latest_investigation(spark, sf_dir):
    runs, _ = two_runs(spark, sf_dir)
    return logs.latest_investigation(runs).select("scope_id", "investigation_id", stamp("ts").alias("ts"), "cause")


def investigations_nested(spark, sf_dir):
    """Newest first, evidence as a list; only the first of the two runs has any."""
    runs, evidence = two_runs(spark, sf_dir)
    out = logs.nested(runs.select("investigation_id", "scope_id", "ts", "cause"),
                      evidence.select("investigation_id", "step", "position", "evidence_type"))
    return (out.orderBy(F.desc("ts"), "investigation_id")
            .select("investigation_id", stamp("ts").alias("ts"), "cause", F.size("evidence").cast("long").alias("n_evidence"),
                    F.concat_ws(",", F.transform("evidence", lambda e: e["evidence_type"])).alias("evidence_types")))


def investigations_paged(spark, sf_dir):
    """The same in rows of at most two items."""
    runs, evidence = two_runs(spark, sf_dir)
    out = logs.paged(runs.select("investigation_id", "cause"), evidence.select("investigation_id", "step", "position", "evidence_type"), 2)
    return out.select("investigation_id", "page", "pages", "cause", F.concat_ws(",", F.transform("evidence", lambda e: e["evidence_type"])).alias("evidence_types"))


def saved_investigations(spark, sf_dir):
    """Two runs saved, one of them twice, beside one whose save broke off: what readers see."""
    runs, evidence = two_runs(spark, sf_dir)
    path, first = work_dir(spark, "saved"), F.col("ts") == F.col("alert_ts")
    records = evidence.select("investigation_id", "step", "position", "evidence_type", F.col("data").alias("evidence_data"))
    for part, found in ((first, records), (first, records), (~first, records.where("false"))):
        sinks.save_investigations(runs.where(part).select("investigation_id", "scope_id", "ts", "cause"), found, path)
    records.withColumn("evidence_data", F.parse_json("evidence_data")).write.parquet(f"{path}/evidence/run_id=broken")
    counts = sinks.read_saved(spark, path, "evidence").groupBy("investigation_id").agg(F.count(F.lit(1)).alias("n"))
    return (sinks.read_saved(spark, path).join(counts, "investigation_id", "left")
            .select("investigation_id", stamp("ts").alias("ts"), "cause", F.coalesce("n", F.lit(0)).alias("n_evidence")))


# ---- scenarios and evaluation -----------------------------------------------------------------


def customer_scenarios(spark, sf_dir) -> DataFrame:
    ids = table(spark, sf_dir, "customer").select((F.col("c_custkey") + 1).alias("ordinal"))
    return evaluate.scenario_table(ids, first_day="2024-01-17")


def scenario_table(spark, sf_dir):
    return customer_scenarios(spark, sf_dir).select(
        "scenario_id", "injected_failure", "injected_feature", F.col("injection_date").cast("string").alias("injection_date"),
        "true_root_cause", F.concat_ws(",", "evidence_should_include").alias("expected"))


def customer_status(spark, sf_dir) -> DataFrame:
    rows = event_logs(spark, sf_dir).select(F.format_string("sc_%03d", F.col("entity_id") + 1).alias("scope_id"))
    return logs.scenario_status(customer_scenarios(spark, sf_dir), rows)


def scenario_status(spark, sf_dir):
    return customer_status(spark, sf_dir).select("scenario_id", "injected_failure",
                                                 F.col("is_materialized").cast("int").alias("is_materialized"))


def triage_bucket(spark, sf_dir):
    return logs.triage(customer_status(spark, sf_dir)).select("scenario_id", "bucket", "risk")


def scenarios_limit(spark, sf_dir):
    return logs.first_scenarios(customer_scenarios(spark, sf_dir), 20).select("scenario_id", "injected_failure")


NATION_FEATURES = ["band", "k", "value"]
NATION_SETTINGS = investigate.Settings(
    features=NATION_FEATURES, p_value="asymptotic", stale_days=2.0, watched_path=None,
    audit_features=NATION_FEATURES, rules=rules.RuleConfig(bug_feature="k", skew_feature="value"))


def injected(spark, sf_dir) -> tuple[DataFrame, tuple]:
    """Failures injected per nation by its scenario: (scenarios, investigation inputs).

    Feature view: purchases, signups and errors; serving log: clicks and views, served with the
    features the view held at their time.
    """
    nations = table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 1).cast("long").alias("ordinal"))
    scenarios = evaluate.scenario_table(nations, first_day="2024-01-17")
    owner = (table(spark, sf_dir, "customer")
             .select(F.col("c_custkey").alias("entity_id"), F.format_string("sc_%03d", F.col("c_nationkey") + 1).alias("scope_id"))
             .join(scenarios.select(F.col("scenario_id").alias("scope_id"), "injected_failure", "injection_date"), "scope_id"))
    rows = (event_logs(spark, sf_dir).withColumnRenamed("scope_id", "event_type").join(owner, "entity_id")
            .withColumn("band", perturb.weighted_band(F.col("event_id"), "band", fv.BAND_WEIGHTS)))
    cut = lambda mode: F.when(F.col("injected_failure") == mode, F.col("injection_date"))

    served = F.col("event_type").isin("click", "view")
    view = perturb.shift_band(rows.where(~served), "band", "event_id", cut("feature_drift"))
    view = perturb.zero_fraction(view, "k", "event_id", cut("pipeline_bug"))
    view = perturb.withhold_updates(view, cut("stale_feature"))
    view = stored(view.select("scope_id", "entity_id", "ts", "ingest_seq", *NATION_FEATURES), "view")

    truth = (F.col("k") > 50).cast("int")
    requests = rows.where(served).select("scope_id", "entity_id", "ts", "event_id", "injected_failure", "injection_date",
                                         truth.alias("true_label"))
    requests = perturb.thin_positives(requests, "true_label", "event_id", cut("label_shift"))
    version = F.when(perturb.after(cut("bad_model_deploy")), 2).otherwise(1)
    right = hash_slot(F.col("event_id"), "model") < F.when(F.col("version") == 2, 500).otherwise(850)
    requests = (requests.withColumn("version", version)
                .withColumn("prediction", F.when(right, F.col("true_label")).otherwise(1 - F.col("true_label"))))
    log = asof.pit_join(requests, view, ["scope_id", "entity_id"], features=NATION_FEATURES, tie="ingest_seq")
    log = stored(perturb.rescale(log, "value", cut("serving_skew")), "logs")

    hit = (F.col("prediction") == F.col("true_label")).cast("double")
    late = F.when(F.to_date("ts") >= F.col("injection_date"), hit)
    per_scope = log.groupBy("scope_id", "injection_date").agg(F.avg(late).alias("v"))
    windows = [ntz("2024-01-01"), ntz("2024-01-14"), ntz("2024-01-15"), ntz("2024-01-30")]
    alerts = alert_frame(per_scope, F.col("scope_id"), F.lit("events"), F.col("v"),
                         F.col("injection_date").cast("timestamp_ntz"), windows)
    versions = (log.groupBy("scope_id", "version").agg(F.avg(hit).alias("accuracy"))
                .select("scope_id", F.lit("events").alias("model_name"), "version",
                        F.concat_ws("/", "scope_id", F.col("version").cast("string")).alias("run_id"),
                        F.create_map(F.lit("kind"), F.lit("hash")).alias("params"),
                        F.create_map(F.lit("accuracy"), F.col("accuracy")).alias("metrics")))
    return scenarios, (stored(alerts, "alerts"), view, log, versions, nation_commits(spark, sf_dir, scenarios))


def nation_commits(spark, sf_dir, scenarios: DataFrame) -> DataFrame:
    """Pages as commits of a nation each, spread over the ten days around its injection day."""
    owner = F.format_string("sc_%03d", hash_slot(F.col("page_id"), "owner", 25) + 1)
    minutes = hash_slot(F.col("page_id"), "commit", 14400).cast("int")
    return (table(spark, sf_dir, "pages").select("page_id", "url")
            .withColumn("scope_id", owner)
            .join(scenarios.select(F.col("scenario_id").alias("scope_id"), "injection_date"), "scope_id")
            .select("scope_id", F.col("page_id").cast("string").alias("commit_hash"), F.lit("author").alias("author"),
                    (F.col("injection_date").cast("timestamp_ntz") - F.expr("INTERVAL 5 DAY")
                     + F.make_dt_interval(mins=minutes)).alias("committed_at"),
                    F.concat(F.lit("change page "), F.col("page_id").cast("string")).alias("message"),
                    F.array("url").alias("changed_files")))


def scored(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    scenarios, inputs = injected(spark, sf_dir)
    inv = investigate.run(*inputs, NATION_SETTINGS)
    run_ts = F.col("alert_ts") + F.expr("INTERVAL 2 HOUR")
    records = inv.evidence.join(inv.causes.select("alert_id", investigate.investigation_id(run_ts).alias("investigation_id")),
                                "alert_id")
    return scenarios, evaluate.score(inv.investigations(run_ts), records, scenarios)


def eval_results(spark, sf_dir):
    _, results = scored(spark, sf_dir)
    return (results.withColumn("is_correct", F.col("is_correct").cast("int"))
            .withColumn("evidence_correct", F.col("evidence_correct").cast("int")).drop("reasoning"))


def eval_summary(spark, sf_dir):
    _, results = scored(spark, sf_dir)
    return rounded(evaluate.summary(results), "overall_accuracy", "evidence_correctness", "false_hypothesis_rate",
                   "mean_latency")


def eval_breakdown(spark, sf_dir):
    _, results = scored(spark, sf_dir)
    return rounded(evaluate.breakdown(results), "accuracy", "evidence_correctness", "avg_latency")


def evidence_coverage(spark, sf_dir):
    """Is the evidence that each nation's scenario calls for among what its investigation logged?"""
    scenarios, inputs = injected(spark, sf_dir)
    inv = investigate.run(*inputs, NATION_SETTINGS)
    run_ts = F.col("alert_ts")
    ids = inv.causes.select("alert_id", investigate.investigation_id(run_ts).alias("investigation_id"))
    out = evaluate.evidence_coverage(scenarios, inv.investigations(run_ts), inv.evidence.join(ids, "alert_id"))
    return out.select("scenario_id", F.array_join(F.array_sort("types"), ",").alias("types"),
                      F.col("evidence_correct").cast("int").alias("evidence_correct"))


# ---- perturbations ----------------------------------------------------------------------------


def perturb_shift(spark, sf_dir):
    rows = event_logs(spark, sf_dir).withColumn("band", perturb.weighted_band(F.col("event_id"), "band", fv.BAND_WEIGHTS))
    return perturb.shift_band(rows, "band", "event_id", cutover()).select("event_id", "band")


def perturb_zero(spark, sf_dir):
    return perturb.zero_fraction(event_logs(spark, sf_dir), "k", "event_id", cutover()).select("event_id", "k")


def perturb_scale(spark, sf_dir):
    return rounded(perturb.rescale(event_logs(spark, sf_dir), "value", cutover()).select("event_id", "value"), "value")


def perturb_labels(spark, sf_dir):
    return perturb.thin_positives(event_logs(spark, sf_dir), "true_label", "event_id", cutover()).select("event_id", "true_label")


def perturb_stale(spark, sf_dir):
    return perturb.withhold_updates(purchases(spark, sf_dir), cutover()).select("event_id", "entity_id", stamp("ts").alias("ts"))


def perturb_shuffle(spark, sf_dir):
    rows = perturb.shuffle_labels(event_logs(spark, sf_dir), "true_label", "event_id")
    return rows.select("event_id", "scope_id", "true_label")


# ---- model and streams ------------------------------------------------------------------------


def forest_rows(spark, sf_dir) -> DataFrame:
    return training_rows(spark, sf_dir).where(F.col("label").isNotNull())


def forest_metrics(spark, sf_dir):
    _, row = training.fit_and_evaluate(forest_rows(spark, sf_dir), ["f_value", "f_k"], "event_id")
    return row.select("scope_id", "model_name", "version", F.explode("metrics").alias("metric", "value"))


def forest_scores(spark, sf_dir):
    rows = training_rows(spark, sf_dir)
    train, _ = training.split(rows.where(F.col("label").isNotNull()), "event_id")
    model = training.fit(train, ["f_value", "f_k"])
    return training.score(model, rows).select("event_id", "prediction", r6("probability").alias("probability"))


def event_stream(spark, sf_dir) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    return with_log_columns(jobs.read_stream(spark, f"{sf_dir}/events*.parquet", schema))


def stream_daily_metrics(spark, sf_dir):
    state = work_dir(spark, "daily")
    jobs.daily_state(event_stream(spark, sf_dir), state)
    rows = jobs.read_daily_state(spark, state)
    return rounded(rows.withColumn("day", F.col("day").cast("string")), "accuracy", "label_rate", "feature_mean")


def stream_online_features(spark, sf_dir):
    state = work_dir(spark, "online")
    jobs.online_state(event_stream(spark, sf_dir).where(F.col("scope_id") == "purchase"), state, ["entity_id"], FEATURES)
    return jobs.read_online_state(spark, state).select("entity_id", stamp("ts").alias("ts"), *FEATURES)


def stream_push(spark, sf_dir):
    """Purchases pushed to a view, which a second run over the same files does not double."""
    out = work_dir(spark, "push")
    for run in ("first", "again"):
        jobs.push_once(event_stream(spark, sf_dir).where(F.col("scope_id") == "purchase"), f"{out}/view", f"{out}/{run}")
    return spark.read.parquet(f"{out}/view").select("event_id", "entity_id", stamp("ts").alias("ts"), *FEATURES)


def stream_late_rows(spark, sf_dir):
    """Events in three arrivals, the last of which brings a tenth of all days: how many rows a five-day watermark would drop."""
    out = work_dir(spark, "late")
    rows = event_logs(spark, sf_dir)
    held = hash_slot(F.col("event_id"), "arrival") < 100
    early = F.to_date("ts") <= F.lit("2024-01-20").cast("date")
    for part in (~held & early, ~held & ~early, held):
        rows.where(part).write.mode("append").parquet(f"{out}/in")
        jobs.late_rows(jobs.read_stream(spark, f"{out}/in", rows.schema), f"{out}/out", f"{out}/state", "5 days")
    late = spark.read.parquet(f"{out}/out/late")
    return late.groupBy("scope_id", F.to_date("ts").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "scan_feature_view": scan_feature_view,
    "logs_in_window": logs_in_window,
    "discovered_features": discovered_features,
    "two_window_slice": two_window,
    "two_window_profile": two_window_profile,
    "before_after_profile": before_after_profile,
    "feature_drift": feature_drift,
    "feature_drift_corrected": feature_drift_corrected,
    "feature_drift_exact": feature_drift_exact,
    "drift_all_alerts": drift_all_alerts,
    "drift_status": drift_status,
    "pit_features": pit_features,
    "feature_snapshots": feature_snapshots,
    "pit_window": pit_window,
    "pit_orders": pit_orders,
    "online_features": online_features,
    "assembled_log": assembled_log,
    "feature_freshness": feature_freshness,
    "serving_skew_audit": serving_skew_audit,
    "training_set": training_set,
    "clamp_truncate": clamp_truncate,
    "logistic_score": logistic,
    "label_shift": label_shift,
    "classification_metrics": classification_metrics,
    "daily_accuracy": daily_accuracy,
    "derived_alerts": derived_alerts,
    "registry_versions": registry_versions,
    "latest_two_versions": latest_two_versions,
    "version_history": version_history,
    "registry_param_diff": registry_param_diff,
    "registry_metric_diff": registry_metric_diff,
    "registry_report": registry_report,
    "commits_in_window": commits_in_window,
    "diff_line_profile": diff_line_profile,
    "evidence_all": evidence_all,
    "evidence_text": evidence_text,
    "evidence_payload": evidence_payload,
    "root_cause": root_cause,
    "hypothesis_status": hypothesis_status,
    "evidence_hypothesis": evidence_hypothesis,
    "investigate": investigate_segments,
    "investigate_fleet": investigate_fleet,
    "latest_investigation": latest_investigation,
    "investigations_nested": investigations_nested,
    "investigations_paged": investigations_paged,
    "saved_investigations": saved_investigations,
    "scenario_table": scenario_table,
    "scenario_status": scenario_status,
    "triage_bucket": triage_bucket,
    "scenarios_limit": scenarios_limit,
    "eval_results": eval_results,
    "eval_summary": eval_summary,
    "eval_breakdown": eval_breakdown,
    "evidence_coverage": evidence_coverage,
    "perturb_shift": perturb_shift,
    "perturb_zero": perturb_zero,
    "perturb_scale": perturb_scale,
    "perturb_labels": perturb_labels,
    "perturb_stale": perturb_stale,
    "perturb_shuffle": perturb_shuffle,
    "forest_metrics": forest_metrics,
    "forest_scores": forest_scores,
    "stream_daily_metrics": stream_daily_metrics,
    "stream_online_features": stream_online_features,
    "stream_push": stream_push,
    "stream_late_rows": stream_late_rows,
}
