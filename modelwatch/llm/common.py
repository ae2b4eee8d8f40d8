"""Helpers shared by the operators of this folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Rows of one Arrow batch at most; texts are long, and a batch is held by the JVM and by Python.
BATCH_ROWS = 1000
#: Text handled together inside a Python worker; bounds its memory however many rows an Arrow batch holds.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's rows per Arrow batch to BATCH_ROWS, if they are more."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(setting)) <= BATCH_ROWS:
        spark.conf.set(setting, BATCH_ROWS)


def with_columns_by_batch(df: DataFrame, inputs: list[str], fn: Callable[..., list[pa.Array]],
                          fields: list[T.StructField], without: tuple[str, ...] = ()) -> DataFrame:
    """``df`` plus ``fields``, which ``fn`` computes from the ``inputs`` arrays of each Arrow batch.

    A column of ``df`` that has the name of a new one is replaced by it; all others but ``without`` pass through.
    """
    small_batches(df.sparkSession)
    new = {f.name.lower() for f in fields}
    kept = [c for c in df.columns if c.lower() not in new or c in inputs]
    base = df.select(*[df[f"`{c}`"] for c in kept])
    clash = [c for c in kept if c.lower() in new]
    if clash:
        raise ValueError(f"input columns have the names of results: {clash}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = fn(*[batch.column(batch.schema.get_field_index(c)) for c in inputs])
            passed = [batch.column(k) for k, c in enumerate(kept) if c not in without]
            yield pa.RecordBatch.from_arrays([*passed, *made], names=names)

    schema = T.StructType([*[f for f in base.schema.fields if f.name not in without], *fields])
    names = schema.fieldNames()
    return base.mapInArrow(run, schema)


def slices(texts: list[str], limit: int = SLICE_BYTES) -> Iterator[list[str]]:
    """Runs of whole texts of about ``limit`` characters; a longer text is a run of its own."""
    run, size = [], 0
    for t in texts:
        if run and size + len(t) > limit:
            yield run
            run, size = [], 0
        run.append(t)
        size += len(t)
    if run:
        yield run


def strings(column: pa.Array) -> list[str]:
    """Python strings, null as empty."""
    return [t or "" for t in column.to_pylist()]


def bounded_batches(spark: SparkSession, rows: int = BATCH_ROWS, size: int = 32 << 20) -> None:
    """Arrow batches of at most ``rows`` rows and about ``size`` bytes, whichever comes first, for plans of this session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
