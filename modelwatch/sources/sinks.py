"""Writing feature views, serving logs, investigations and evaluation results.

Views and logs have one layout: a folder a day, in it one a bucket of scopes by hash, in it files sorted by scope and time. So the number of folders does
not follow the number of scopes, a scan for a day reads that day, and a scan for a scope skips the row groups of the others.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stored
from .tables import PARTITIONS, SCOPE_BUCKETS, parse_times


def bucket_of(scope: Column) -> Column:
    """The bucket of a scope; rows without a scope are in bucket 0."""
    return F.when(scope.isNull(), 0).otherwise(F.pmod(F.xxhash64(scope.cast("string")), F.lit(SCOPE_BUCKETS))).cast("int")


def laid_out(df: DataFrame, ts: str = "ts") -> DataFrame:
    """``df`` with its times parsed and the two partition columns set."""
    df = parse_times(df, ts)
    return df.withColumns({"event_date": F.to_date(ts), "scope_bucket": bucket_of(F.col("scope_id")) if "scope_id" in df.columns else F.lit(0)})


def of_scopes(rows: DataFrame, scopes: list[str]) -> DataFrame:
    """Rows of a few scopes, with the condition on their buckets that leaves other folders unread."""
    return rows.where(F.col("scope_id").isin(scopes) & F.col("scope_bucket").isin([_bucket(rows.sparkSession, s) for s in scopes]))


def _bucket(spark: SparkSession, scope: str) -> int:
    return spark.range(1).select(bucket_of(F.lit(scope)).alias("b")).first()["b"]


def _sorted(df: DataFrame, ts: str) -> DataFrame:
    """Rows in the order of the layout. The rebalance hint lets AQE write few, even files a folder and split one that is far larger than the others."""
    order = [c for c in (*PARTITIONS, "scope_id", ts) if c in df.columns]
    return df.hint("rebalance", *PARTITIONS).sortWithinPartitions(*order)


def push_features(df: DataFrame, path: str, scope: str | None = None, ts: str = "ts") -> None:
    """Append to a feature view, for one scope or for those the rows name."""
    if scope is not None:
        df = df.withColumn("scope_id", F.lit(scope))
    _sorted(laid_out(df, ts), ts).write.mode("append").partitionBy(*PARTITIONS).parquet(path)


def append_logs(df: DataFrame, path: str, ts: str = "ts") -> None:
    """Append predictions."""
    push_features(df, path, None, ts)


def replace_scopes(df: DataFrame, path: str, ts: str = "ts") -> None:
    """Replace what the table holds for the (scope, day) pairs that ``df`` brings; all else stays.

    The folders that these pairs lie in are read, and written anew with the other scopes' rows and the new ones; logs and feature
    views alike, so that a rerun over the same days doubles neither.
    """
    new = laid_out(df, ts)
    try:
        held = df.sparkSession.read.parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
    else:
        pairs = new.select("scope_id", "event_date", "scope_bucket").distinct()
        near = held.join(pairs.select(*PARTITIONS).distinct(), PARTITIONS, "left_semi")
        gone = pairs.select(F.col("scope_id").alias("s"), F.col("event_date").alias("d"))
        rest = near.join(gone, F.col("scope_id").eqNullSafe(F.col("s")) & (F.col("event_date") == F.col("d")), "left_anti")
        new = new.unionByName(rest, allowMissingColumns=True)
    _sorted(new, ts).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PARTITIONS).parquet(path)


def rerun_scope(df: DataFrame, table: str, scope: str, ts: str = "ts") -> None:
    """Replace everything a catalog table holds for one scope, all days included, by the rows of ``df``, which may be none.

    One statement writes the scope's bucket of all days that keep rows; days that the scope leaves without any are emptied
    one by one. It runs in a session of its own, so the caller's settings are not touched.
    """
    spark = df.sparkSession
    columns = spark.table(table).columns
    bucket = _bucket(spark, scope)
    held = spark.table(table).where(F.col("scope_bucket") == bucket)
    new = laid_out(df.withColumn("scope_id", F.lit(scope)), ts)
    # stored, as a statement cannot read the table that it overwrites
    after = stored(held.where(~F.col("scope_id").eqNullSafe(scope)).select(*columns).unionByName(new.select(*columns)), "rerun")
    days = lambda rows: {r["event_date"] for r in rows.select("event_date").distinct().collect()}
    emptied = days(held.where(F.col("scope_id").eqNullSafe(scope))) - days(after)
    view = f"rerun_{uuid.uuid4().hex}"
    _sorted(after, ts).createOrReplaceGlobalTempView(view)
    own = spark.newSession()
    own.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    plain = [c for c in columns if c not in PARTITIONS]
    try:
        own.sql(f"INSERT OVERWRITE TABLE {table} PARTITION ({', '.join(PARTITIONS)}) SELECT {', '.join(f'`{c}`' for c in [*plain, *PARTITIONS])} FROM global_temp.{view}")
        for day in sorted(emptied):
            own.sql(f"INSERT OVERWRITE TABLE {table} PARTITION (event_date = DATE '{day}', scope_bucket = {bucket}) SELECT {', '.join(f'`{c}`' for c in plain)} FROM global_temp.{view} WHERE false")
    finally:
        spark.catalog.dropGlobalTempView(view)
    spark.catalog.refreshTable(table)


# ---- investigations ------------------------------------------------------------------------------------


def save_investigations(investigations: DataFrame, evidence: DataFrame, path: str, run_id: str | None = None) -> str:
    """Save one run: its log rows and evidence rows as folders of the run, written as a whole, then a marker that makes them visible.

    ``run_id`` defaults to a hash of the investigations' ids, so that the same run saved again, or by two writers, lands in the same folders. A
    save that broke off has no marker and is not seen until it is done again. Nothing that was saved before is read. The payload is stored as VARIANT.
    """
    spark = investigations.sparkSession
    if run_id is None:
        ids = investigations.agg(F.bit_xor(F.xxhash64("investigation_id")).alias("h"), F.count(F.lit(1)).alias("n")).first()
        run_id = f"{(ids['h'] or 0) & (1 << 64) - 1:016x}-{ids['n']}"
    typed = dict(evidence.dtypes)["evidence_data"] == "variant"
    records = evidence if typed else evidence.withColumn("evidence_data", F.parse_json("evidence_data"))
    for rows, folder in ((records, "evidence"), (investigations, "investigations")):
        rows.write.mode("overwrite").parquet(f"{path}/{folder}/run_id={run_id}")
    spark.range(1).select(F.current_timestamp().alias("saved_at")).coalesce(1).write.mode("overwrite").parquet(f"{path}/saved/run_id={run_id}")
    return run_id


def read_saved(spark: SparkSession, path: str, what: str = "investigations") -> DataFrame:
    """The log rows ("investigations") or "evidence" of all runs that were saved completely, with their ``run_id``.

    An investigation that several runs saved comes from the one saved last.
    """
    saved = spark.read.schema("saved_at timestamp, run_id string").parquet(f"{path}/saved")
    owners = spark.read.parquet(f"{path}/investigations").select("investigation_id", F.col("run_id").cast("string").alias("run_id")).distinct().join(saved, "run_id")
    newest = owners.groupBy("investigation_id").agg(F.max_by("run_id", F.struct("saved_at", "run_id")).alias("run_id"))
    rows = spark.read.parquet(f"{path}/{what}").withColumn("run_id", F.col("run_id").cast("string"))
    return rows.join(newest, ["investigation_id", "run_id"], "left_semi")


def save_results(results: DataFrame, path: str) -> None:
    results.write.mode("overwrite").json(path)
