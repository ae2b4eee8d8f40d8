"""Serving-log assembly and investigation-log reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed_values as fv
from .alerts import day_pruning


def assemble(requests: DataFrame, online: DataFrame, by: list[str] | str) -> DataFrame:
    """Requests with the online features of their entity, joined by key (never by position)."""
    return requests.join(online, by, "inner")


def in_time(logs: DataFrame, start: str, end: str, ts: str = "ts") -> DataFrame:
    """Rows with ``ts`` in the closed interval; the bounds are literals and push down to the scan."""
    kind = logs.schema[ts].dataType
    return logs.where(F.col(ts).between(F.lit(start).cast(kind), F.lit(end).cast(kind)) & day_pruning(logs, start, end))


def latest_investigation(investigations: DataFrame) -> DataFrame:
    """The newest investigation of each scope."""
    row = F.struct(*[c for c in investigations.columns if c != "scope_id"])
    return (investigations.groupBy("scope_id").agg(F.max_by(row, F.struct("ts", "investigation_id")).alias("i"))
            .select("scope_id", "i.*"))


def nested(investigations: DataFrame, evidence: DataFrame) -> DataFrame:
    """Each investigation with its evidence as a sorted list; an empty list where there is none."""
    fields = [c for c in evidence.columns if c not in ("investigation_id", "scope_id")]
    first = [c for c in ("ordinal", "evidence_type") if c in fields]
    item = F.struct(*first, *[c for c in fields if c not in first])
    lists = evidence.groupBy("investigation_id").agg(F.sort_array(F.collect_list(item)).alias("evidence"))
    empty = F.array().cast(lists.schema["evidence"].dataType)
    return (investigations.join(lists, "investigation_id", "left")
            .withColumn("evidence", F.coalesce("evidence", empty)))


def paged(investigations: DataFrame, evidence: DataFrame, size: int = 100) -> DataFrame:
    """``nested`` in rows of bounded length: (investigation..., page, pages, evidence), at most ``size`` items a row, in the order of the evidence.

    An investigation without evidence is one empty page. Items are numbered in sorted order, which spills; only pages are ever lists.
    """
    fields = [c for c in evidence.columns if c not in ("investigation_id", "scope_id")]
    order = [c for c in ("step", "position", "evidence_type") if c in fields] or fields
    w = Window.partitionBy("investigation_id")
    numbered = evidence.select("investigation_id", F.struct(*order, *[c for c in fields if c not in order]).alias("item"),
                               F.row_number().over(w.orderBy(*order)).alias("n"))
    lists = (numbered.groupBy("investigation_id", F.ceil(F.col("n") / size).cast("long").alias("page"))
             .agg(F.sort_array(F.collect_list(F.struct("n", "item"))).alias("e")).select("investigation_id", "page", F.col("e.item").alias("evidence")))
    counts = evidence.groupBy("investigation_id").agg(F.ceil(F.count(F.lit(1)) / size).cast("long").alias("pages"))
    one = F.lit(1).cast("long")
    return (investigations.join(counts, "investigation_id", "left").join(lists, "investigation_id", "left")
            .withColumns({"page": F.coalesce("page", one), "pages": F.coalesce("pages", one),
                          "evidence": F.coalesce("evidence", F.array().cast(lists.schema["evidence"].dataType))}))


def scenario_status(scenarios: DataFrame, logs: DataFrame) -> DataFrame:
    """Scenarios with a flag that tells whether data of their scope exist."""
    present = logs.select(F.col("scope_id").alias("scenario_id")).distinct().withColumn("_has", F.lit(True))
    return (scenarios.join(present, "scenario_id", "left")
            .withColumn("is_materialized", F.col("_has").isNotNull()).drop("_has"))


def first_scenarios(scenarios: DataFrame, n: int) -> DataFrame:
    return scenarios.orderBy("scenario_id").limit(n)


def triage(status: DataFrame) -> DataFrame:
    """Dashboard bucket and risk tier of each scenario."""
    control = F.col("injected_failure") == fv.CONTROL
    bucket = (F.when(~F.col("is_materialized"), "pending").when(control, "resolved").otherwise("active"))
    risk: Column = F.lit(fv.RISK_DEFAULT)
    for cause, text in fv.RISK_LABELS.items():
        risk = F.when(F.col("injected_failure") == cause, text).otherwise(risk)
    return status.withColumn("bucket", bucket).withColumn("risk", risk)
