"""Reading tables, and creating them when missing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas


#: Partition columns of views and logs, and how many buckets the scopes of a day are dealt into.
PARTITIONS, SCOPE_BUCKETS = ["event_date", "scope_bucket"], 16


def read_feature_view(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_table(spark: SparkSession, fmt: str = "parquet", path: str | None = None, **options: str) -> DataFrame:
    """Any Spark source by configuration (parquet, json, jdbc, ...).

    A JDBC read is parallel only with partitionColumn, lowerBound, upperBound and numPartitions set.
    """
    return spark.read.format(fmt).options(**options).load(path)


def read_scenarios(spark: SparkSession, path: str) -> DataFrame:
    """Labelled scenarios: a JSON array of objects."""
    return spark.read.schema(schemas.SCENARIOS).json(path, multiLine=True)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.RESULTS).json(path)


def create_tables(spark: SparkSession, database: str = "default") -> list[str]:
    """Create the fixed log tables that do not exist yet; existing ones stay as they are.

    Serving logs are partitioned as ``sinks`` lays them out. The two log tables take what an investigation's ``investigations`` and ``evidence_records`` return.
    """
    parts = [T.StructField("event_date", T.DateType()), T.StructField("scope_bucket", T.IntegerType())]
    fixed = {"serving_logs": (T.StructType([*schemas.SERVING_LOGS.fields, *parts]), PARTITIONS),
             "investigation_logs": (schemas.INVESTIGATIONS, []),
             "evidence_records": (schemas.EVIDENCE_RECORDS, [])}
    created = []
    for name, (schema, parts) in fixed.items():
        full = f"{database}.{name}"
        if not spark.catalog.tableExists(full):
            writer = spark.createDataFrame([], schema).write.format("parquet")
            (writer.partitionBy(*parts) if parts else writer).saveAsTable(full)
            created.append(full)
    return created


def parse_times(df: DataFrame, *columns: str) -> DataFrame:
    """Text or instants to zone-free timestamps; other columns as they are."""
    for c in columns:
        if not isinstance(df.schema[c].dataType, T.TimestampNTZType):
            df = df.withColumn(c, F.to_timestamp_ntz(F.col(c)) if isinstance(df.schema[c].dataType, T.StringType)
                               else F.col(c).cast("timestamp_ntz"))
    return df
