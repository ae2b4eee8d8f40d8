"""Names, texts, thresholds and constants that results must carry exactly.

Nothing here is logic. Everything is stated once, in natural order, and used by name.
"""

# Causes in the order in which ruled-out lists name them.
CONTROL = "control"
CAUSES = [
    "feature_drift",
    "bad_model_deploy",
    "pipeline_bug",
    "label_shift",
    "serving_skew",
    "stale_feature",
]

# Failure modes in the round-robin order of the scenario table.
FAILURE_MODES = [
    "control",
    "feature_drift",
    "bad_model_deploy",
    "pipeline_bug",
    "label_shift",
    "serving_skew",
    "stale_feature",
]

# Hypotheses (id, cause it stands for, text) in evaluation order.
HYPOTHESES = [
    ("h1", "feature_drift", "Upstream feature drift in model inputs."),
    ("h2", "bad_model_deploy", "A poorly trained/configured model v2 was deployed."),
    ("h3", "pipeline_bug", "Feature preprocessing pipeline code bug committed recently."),
    ("h4", "label_shift", "Label distribution shift in ground truth outcomes."),
    ("h5", "serving_skew", "Training/serving preprocessing skew on feature debt_to_income."),
    ("h6", "stale_feature", "Stale features being served due to feature store ingestion failure."),
]

# Evidence type -> word looked for in a hypothesis text.
EVIDENCE_KEYWORDS = {
    "feature_drift": "drift",
    "model_registry_diff": "deploy",
    "git_commit": "pipeline",
    "label_drift": "label",
    "feature_staleness": "stale",
    "serving_skew": "skew",
}
NO_HYPOTHESIS = "General Evidence"
UNRESOLVED = "unresolved"

# Expected-evidence name -> evidence type that satisfies it.
EXPECTED_EVIDENCE_TYPES = {
    "git_commit_hash": "git_commit",
    "feature_store_drift_stat": "feature_drift",
    "model_registry_diff": "model_registry_diff",
    "label_drift_stat": "label_drift",
    "feature_store_staleness_stat": "feature_staleness",
}

# Scenario table, one entry per failure mode:
# (mode, injected feature, expected evidence, root-cause text).
SCENARIO_MODES = [
    ("control", None, [],
     "No failure injected. Performance degradation is due to normal statistical noise."),
    ("feature_drift", "income_band", ["feature_store_drift_stat"],
     "Upstream feature drift. The distribution of input feature 'income_band' shifted downward."),
    ("bad_model_deploy", None, ["model_registry_diff"],
     "Bad model deployment. Model version 2 was trained with shuffled labels, resulting in random predictions."),
    ("pipeline_bug", "credit_score", ["git_commit_hash", "feature_store_drift_stat"],
     "Transformation bug in credit_score processing causing a subset of values to corrupt to 0."),
    ("label_shift", None, ["label_drift_stat"],
     "Label distribution shift. Macro-economic changes caused a drop in borrower approval rates."),
    ("serving_skew", "debt_to_income", ["feature_store_drift_stat"],
     "Training/serving skew. Preprocessing mismatch where debt_to_income is scaled as percentage (x100) instead of decimal."),
    ("stale_feature", None, ["feature_store_staleness_stat"],
     "Stale features. Feature store ingestion pipeline crashed, serving outdated borrower features from the historical training period."),
]

# Reasoning sentence per cause (arguments: see rules.root_cause).
REASONING = {
    "pipeline_bug": "Transformation bug in %s processing detected. %s",
    "stale_feature": "Stale feature store records detected. Feature age lag check shows that online serving "
                     "queries returned borrower records that are over %.2f days old.",
    "bad_model_deploy": "Bad model deployment detected. Model version 2 was trained with shuffled labels, "
                        "resulting in random predictions and a corresponding drop in accuracy compared to version 1.",
    "label_shift": "Label distribution shift detected. Average true labels (approval rate) dropped by more than "
                   "15%% between baseline and target periods.",
    "serving_skew": "Training/serving preprocessing skew detected on %s.",
    "feature_drift": "Upstream feature drift detected on feature '%s'.",
    "control": "No failure injected. Performance degradation is due to normal statistical noise.",
}

# Confidence per cause.
CONFIDENCE = {
    "pipeline_bug": 0.98,
    "stale_feature": 0.95,
    "bad_model_deploy": 0.95,
    "label_shift": 0.95,
    "serving_skew": 0.95,
    "feature_drift": 0.95,
    "control": 1.0,
}

# One-sentence detector summaries (printf formats).
SUMMARY_DRIFT = "Feature '%s' mean shifted from %.4f to %.4f (KS p-value: %.4e)."
SUMMARY_LABELS = "Target approval rate shifted from %.4f to %.4f (Delta: %.4f, Threshold: %.4f)."
SUMMARY_FRESHNESS = ("Feature store staleness check: average feature age lag is %.2f days "
                     "(Max: %.2f days, Threshold: %s days).")
SUMMARY_COMMIT = "Commit by %s on %s: %s"
SUMMARY_VERSIONS = "Compared version %d vs version %d. Param changes: [%s]. Metric deltas: {%s}."
SUMMARY_SINGLE_VERSION = "Only model version %d is registered. Parameters: {%s}. Metrics: {%s}."

# Thresholds.
MIN_SAMPLES = 10
DRIFT_ALPHA = 0.05
LABEL_DROP = 0.15
STALE_DAYS = 0.5
ACCURACY_DROP = -0.05

# Feature columns.
EXCLUDED_COLUMNS = ["user_id", "timestamp", "id", "created_at"]
DEFAULT_FEATURES = ["income_band", "credit_score", "debt_to_income", "employment_years"]
BUG_FEATURE = "credit_score"
SKEW_FEATURE = "debt_to_income"
WATCHED_PATH = "src/pipeline/processing.py"

# Logistic score coefficients, shift factor and clamp range.
LOGISTIC = {
    "intercept": -1.2,
    "center": 600.0,
    "credit_score": 0.012,
    "income_band": 0.7,
    "debt_to_income": -3.2,
    "employment_years": 0.06,
}
LABEL_SHIFT_FACTOR = 0.4
SCORE_MIN, SCORE_MAX = 300, 850

# Weights (per thousand) of the five bands, before and after the shift.
BAND_WEIGHTS = [50, 150, 400, 300, 100]
BAND_WEIGHTS_SHIFTED = [400, 300, 200, 80, 20]
ZEROED_PER_THOUSAND = 300
UNIT_FACTOR = 100.0

# Random forest.
FOREST_TREES, FOREST_DEPTH, FOREST_SEED = 50, 5, 42

# Dashboard triage.
RISK_LABELS = {
    "control": "Informational",
    "pipeline_bug": "Critical Risk",
    "bad_model_deploy": "Critical Risk",
}
RISK_DEFAULT = "High Risk"
