"""The daily loop as streaming jobs on file sources.

Each job drains what has arrived and stops (``availableNow``). What is kept current by key lives in the job's state store: one row a key, updated
where it is, and read back by the state reader, so that a read costs what the state holds and not all that ever changed.

The jobs with an output table write one folder per micro-batch instead: a repeated batch overwrites its own folder, so a restart after
a failure neither loses nor doubles anything, and no batch rewrites the table. Readers take each key's newest version.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions.scalars import as_instant, as_ntz


def read_stream(spark: SparkSession, path: str, schema: T.StructType, ts: str = "ts",
                files_per_batch: int | None = None) -> DataFrame:
    """Parquet files as a stream; event time as an instant, which watermarks need."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path).withColumn(ts, as_instant(F.col(ts)))


def _drain(writer) -> StreamingQuery:
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def push_once(stream: DataFrame, path: str, checkpoint: str, key: str = "event_id", ts: str = "ts",
              ) -> StreamingQuery:
    """Append to a feature view every event that it does not hold yet, however late it comes.

    A micro-batch is compared with the days of the view that it touches, so a batch that is repeated after a
    failure adds only what is missing.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        rows = (batch.withColumn(ts, as_ntz(F.col(ts))).withColumn("event_date", F.to_date(ts)).dropDuplicates([key, "event_date"]))
        try:
            seen = batch.sparkSession.read.parquet(path)
        except AnalysisException as missing:
            if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
        else:
            first, last = rows.agg(F.min("event_date"), F.max("event_date")).first()
            seen = seen.where(F.col("event_date").between(F.lit(first), F.lit(last))).select(key, "event_date")
            rows = rows.join(seen, [key, "event_date"], "left_anti")
        rows.write.mode("append").partitionBy("event_date").parquet(path)

    return _drain(stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write))


def daily_metrics(stream: DataFrame, path: str, checkpoint: str, delay: str | None = None, ts: str = "ts",
                  feature: str = "value") -> StreamingQuery:
    """Daily row count, accuracy, label rate and feature mean per scope, kept current as rows arrive.

    The state is one row per scope and day. Without ``delay`` it is kept and no row is ever too late; with it,
    days older than that leave the state and rows for them are dropped.
    """
    stream = stream.withWatermark(ts, delay) if delay else stream
    hit = (F.col("prediction") == F.col("true_label")).cast("double")
    daily = (stream.groupBy(F.window(ts, "1 day"), "scope_id")
             .agg(F.count(F.lit(1)).alias("n"), F.avg(hit).alias("accuracy"),
                  F.avg(F.col("true_label").cast("double")).alias("label_rate"), F.avg(feature).alias("feature_mean"))
             .select("scope_id", F.to_date(as_ntz(F.col("window.start"))).alias("day"), "n", "accuracy", "label_rate", "feature_mean"))
    return _drain(daily.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
                  .foreachBatch(_write_version(path)))


def _write_version(path: str):
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
    return write


def online_features(stream: DataFrame, path: str, checkpoint: str, by: list[str], features: list[str],
                    ts: str = "ts", tie: str = "ingest_seq") -> StreamingQuery:
    """Each micro-batch's newest row per entity, as one version of the latest-per-entity table."""
    def write(batch: DataFrame, batch_id: int) -> None:
        row = F.struct(ts, tie, *features)
        newest = batch.groupBy(*by).agg(F.max_by(row, F.struct(ts, tie)).alias("r")).select(*by, "r.*")
        _write_version(path)(newest.withColumn(ts, as_ntz(F.col(ts))), batch_id)
    return _drain(stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write))


# ---- keyed state ---------------------------------------------------------------------------------------

#: What ``daily_state`` keeps for each scope and day, in the order of its aggregates: a count, then sum and count of each mean.
DAILY_STATE = "struct<n:bigint,hit:double,hit_n:bigint,label:double,label_n:bigint,feature:double,feature_n:bigint>"


def _keep(aggregated: DataFrame, checkpoint: str) -> StreamingQuery:
    """Run an aggregation for its state alone."""
    return _drain(aggregated.writeStream.outputMode("update").format("noop").option("checkpointLocation", checkpoint))


def read_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(key, value) of the newest committed state of a job."""
    return spark.read.format("statestore").load(checkpoint).select("key", "value")


def online_state(stream: DataFrame, checkpoint: str, by: list[str], features: list[str], ts: str = "ts", tie: str = "ingest_seq") -> StreamingQuery:
    """Keep each entity's newest row; a row that comes late changes nothing. ``read_online_state`` returns them."""
    row = F.struct(F.col(ts).alias("ts"), F.col(tie).alias("tie"), *features)
    return _keep(stream.groupBy(*by).agg(F.max_by(row, F.struct(ts, tie)).alias("r")), checkpoint)


def read_online_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    rows = read_state(spark, checkpoint).select("key.*", "value.valueWithExtremumOrdering.*")
    return rows.withColumn("ts", as_ntz(F.col("ts")))


def daily_state(stream: DataFrame, checkpoint: str, ts: str = "ts", feature: str = "value") -> StreamingQuery:
    """Keep daily row count, accuracy, label rate and feature mean per scope; no row is ever too late."""
    hit = (F.col("prediction") == F.col("true_label")).cast("double")
    means = [hit, F.col("true_label").cast("double"), F.col(feature).cast("double")]
    return _keep(stream.groupBy(F.window(ts, "1 day"), "scope_id").agg(F.count(F.lit(1)).alias("n"), *[F.avg(m).alias(f"m{i}") for i, m in enumerate(means)]), checkpoint)


def read_daily_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(scope_id, day, n, accuracy, label_rate, feature_mean) of ``daily_state``."""
    rows = read_state(spark, checkpoint).select("key.scope_id", F.to_date(as_ntz(F.col("key.window.start"))).alias("day"), F.col("value").cast(DAILY_STATE).alias("v"))
    mean = lambda c: F.col(f"v.{c}") / F.nullif(F.col(f"v.{c}_n"), F.lit(0))
    return rows.select("scope_id", "day", "v.n", mean("hit").alias("accuracy"), mean("label").alias("label_rate"), mean("feature").alias("feature_mean"))


def late_rows(stream: DataFrame, path: str, checkpoint: str, delay: str, ts: str = "ts") -> StreamingQuery:
    """Set aside the rows that ``daily_metrics`` with this ``delay`` would drop: those of days that end no later than the newest time of all
    earlier micro-batches less ``delay``. Each batch writes its late rows and its newest time to folders of its own, so a repeated one repeats them.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        try:
            marks = spark.read.schema("newest timestamp, batch_id long").parquet(f"{path}/marks").where(F.col("batch_id") < batch_id)
            limit = marks.agg((F.max("newest") - F.expr(f"INTERVAL {delay}")).alias("m")).first()["m"]
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            limit = None
        over = F.window(ts, "1 day")["end"] <= F.lit(limit).cast("timestamp")
        late = batch.where(over if limit is not None else F.lit(False)).withColumn(ts, as_ntz(F.col(ts)))
        late.write.mode("overwrite").parquet(f"{path}/late/batch_id={batch_id}")
        batch.agg(F.max(ts).alias("newest")).write.mode("overwrite").parquet(f"{path}/marks/batch_id={batch_id}")

    return _drain(stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write))


# ---- tables of versions --------------------------------------------------------------------------------


def current(spark: SparkSession, path: str, keys: list[str], order: list[str] = ("batch_id",)) -> DataFrame:
    """The newest version of each key of a table that a job keeps current."""
    versions = spark.read.parquet(path)
    row = F.struct(*[c for c in versions.columns if c not in keys])
    return versions.groupBy(*keys).agg(F.max_by(row, F.struct(*order)).alias("r")).select(*keys, "r.*").drop("batch_id")


def compact(spark: SparkSession, path: str, target: str, keys: list[str], order: list[str] = ("batch_id",)) -> None:
    """Write the current state as a table of its own (for readers, or to start afresh from)."""
    current(spark, path, keys, order).write.mode("overwrite").parquet(target)
