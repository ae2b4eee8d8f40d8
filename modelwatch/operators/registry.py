"""Model versions: latest against previous, parameters and metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed_values as fv

MODEL = ["scope_id", "model_name"]


def latest_two(versions: DataFrame) -> DataFrame:
    """The two highest versions of each model, by number; rank 1 is the latest. Of a version registered again
    the newest run stands for it.
    """
    number = F.col("version").cast("int")
    again = Window.partitionBy(*MODEL, number).orderBy(F.col("run_id").desc())
    w = Window.partitionBy(*MODEL).orderBy(number.desc())
    return (versions.withColumn("_run", F.row_number().over(again)).where(F.col("_run") == 1).drop("_run")
            .withColumn("version_rank", F.row_number().over(w)).where(F.col("version_rank") <= 2))


def version_history(versions: DataFrame) -> DataFrame:
    """Every version with the one before it."""
    w = Window.partitionBy(*MODEL).orderBy(F.col("version").cast("int"), F.col("run_id"))
    return versions.withColumn("previous_version", F.lag("version").over(w))


def version_summary(versions: DataFrame) -> DataFrame:
    """Version count, latest and previous version of each model."""
    counts = versions.groupBy(*MODEL).agg(F.count_distinct("version").alias("version_count"))
    pick = lambda rank, c: F.max(F.when(F.col("version_rank") == rank, F.col(c).cast("string")))
    heads = latest_two(versions).groupBy(*MODEL).agg(
        pick(1, "version").alias("latest_version"), pick(2, "version").alias("previous_version"),
        pick(1, "run_id").alias("latest_run_id"))
    return (heads.join(counts, MODEL)
            .withColumn("status", F.when(F.col("previous_version").isNull(), "single_version").otherwise("ok")))


def _entries(column: str, kind: str) -> Column:
    """A map's entries as (kind, key, text, number)."""
    number = (lambda v: v) if kind == "metric" else (lambda v: F.lit(None).cast("double"))
    return F.transform(F.map_entries(column), lambda e: F.struct(
        F.lit(kind).alias("kind"), e["key"].alias("key"), e["value"].cast("string").alias("text"),
        number(e["value"]).alias("number")))


def diff(versions: DataFrame) -> DataFrame:
    """Changed parameters and all metrics of the two highest versions, in one long table.

    Both sides of every key of either version: a full outer join, done as one grouping. A parameter is
    listed if its value changed, appeared or disappeared; a metric always, its delta only where both
    versions have it. A model with one version has nothing to compare and yields no rows.
    """
    two = (latest_two(versions)
           .withColumn("_n", F.max("version_rank").over(Window.partitionBy(*MODEL))).where(F.col("_n") == 2))
    long = two.select(*MODEL, "version_rank", F.inline(F.concat(_entries("params", "param"), _entries("metrics", "metric"))))
    side = lambda rank, c: F.max(F.when(F.col("version_rank") == rank, F.col(c)))
    sides = long.groupBy(*MODEL, "kind", "key").agg(
        side(2, "text").alias("previous"), side(1, "text").alias("latest"),
        side(2, "number").alias("previous_number"), side(1, "number").alias("latest_number"))
    return (sides.where((F.col("kind") == "metric") | ~F.col("previous").eqNullSafe(F.col("latest")))
            .withColumn("delta", F.col("latest_number") - F.col("previous_number")))


def param_diff(versions: DataFrame) -> DataFrame:
    """Parameters whose value changed, appeared or disappeared (missing side: null)."""
    return diff(versions).where(F.col("kind") == "param").select(*MODEL, "key", "previous", "latest")


def metric_diff(versions: DataFrame) -> DataFrame:
    """All metrics of both versions; the delta only where both have it."""
    return diff(versions).where(F.col("kind") == "metric").select(
        *MODEL, "key", F.col("previous_number").alias("previous"), F.col("latest_number").alias("latest"), "delta")


def alert_report(versions: DataFrame, alerts: DataFrame) -> DataFrame:
    """The report of each alert's model; a model without any version is a row with a status."""
    return (alerts.select("alert_id", *MODEL).join(registry_report(versions), MODEL, "left")
            .withColumns({"status": F.coalesce("status", F.lit("no_versions")),
                          "version_count": F.coalesce("version_count", F.lit(0))}))


def _listed(entries: Column, form: str, *values) -> Column:
    """``form`` filled in from each entry of a map's sorted entries, joined by commas."""
    return F.array_join(F.transform(F.array_sort(entries), lambda e: F.format_string(form, *[v(e) for v in values])), ", ")


def registry_report(versions: DataFrame) -> DataFrame:
    """One row per model: counts, versions, what the latest run was given and reached, what changed, and the summary sentence.

    latest_params, latest_metrics: the latest version's own maps, whatever the number of versions. param_changes (key -> previous, latest) and
    metric_changes (key -> previous, latest, delta) are null for a model with one version; accuracy_delta stands alone for the rules.
    """
    param, metric = F.col("kind") == "param", F.col("kind") == "metric"
    pairs = lambda test, value: F.map_from_entries(F.array_sort(F.collect_list(F.when(test, F.struct("key", value.alias("value"))))))
    changes = (diff(versions).groupBy(*MODEL)
               .agg(F.max(F.when(metric & (F.col("key") == "accuracy"), F.col("delta"))).alias("accuracy_delta"),
                    pairs(param, F.struct("previous", "latest")).alias("param_changes"),
                    pairs(metric, F.struct(F.col("previous_number").alias("previous"), F.col("latest_number").alias("latest"), "delta")).alias("metric_changes")))
    own = latest_two(versions).where(F.col("version_rank") == 1).select(*MODEL, F.col("params").alias("latest_params"), F.col("metrics").alias("latest_metrics"))
    deltas = F.filter(F.map_entries("metric_changes"), lambda e: e["value"]["delta"].isNotNull())
    many = F.format_string(fv.SUMMARY_VERSIONS, F.col("latest_version").cast("int"), F.col("previous_version").cast("int"),
                           F.coalesce(F.array_join(F.array_sort(F.map_keys("param_changes")), ", "), F.lit("")),
                           F.coalesce(F.array_join(F.array_sort(F.transform(deltas, lambda e: F.format_string("%s: %.4f", e["key"], e["value"]["delta"]))), ", "), F.lit("")))
    one = F.format_string(fv.SUMMARY_SINGLE_VERSION, F.col("latest_version").cast("int"),
                          F.coalesce(_listed(F.map_entries("latest_params"), "'%s': '%s'", lambda e: e["key"], lambda e: e["value"]), F.lit("")),
                          F.coalesce(_listed(F.map_entries("latest_metrics"), "'%s': %s", lambda e: e["key"], lambda e: e["value"].cast("string")), F.lit("")))
    return (version_summary(versions).join(own, MODEL, "left").join(changes, MODEL, "left")
            .withColumn("summary", F.when(F.col("status") == "ok", many).otherwise(one)))


def report_lines(report: DataFrame) -> DataFrame:
    """A report's maps as rows: (model, status, counts, kind, key, previous, latest, previous_number, latest_number, delta)."""
    text, number = F.lit(None).cast("string"), F.lit(None).cast("double")

    def lines(column: str, kind: str, fill) -> Column:
        made = F.transform(F.map_entries(column), lambda e: F.struct(F.lit(kind).alias("kind"), e["key"].alias("key"), *[
            x.alias(n) for n, x in zip(("previous", "latest", "previous_number", "latest_number", "delta"), fill(e["value"]))]))
        return F.coalesce(made, F.array().cast("array<struct<kind:string,key:string,previous:string,latest:string,previous_number:double,latest_number:double,delta:double>>"))

    every = F.concat(lines("latest_params", "latest_param", lambda v: (text, v, number, number, number)),
                     lines("latest_metrics", "latest_metric", lambda v: (text, text, number, v, number)),
                     lines("param_changes", "param_change", lambda v: (v["previous"], v["latest"], number, number, number)),
                     lines("metric_changes", "metric_change", lambda v: (text, text, v["previous"], v["latest"], v["delta"])))
    return report.select(*MODEL, "status", "version_count", "latest_version", "previous_version", "latest_run_id", F.inline(every))
