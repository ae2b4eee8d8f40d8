"""Session helpers: shared work folder and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_BYTES = 64 * 1024 * 1024


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below the cluster's ``spark.checkpoint.dir``.

    The setting is read from the session. Only a local[...] session that has none (tests) gets a
    scratch folder of its own; on a cluster a missing setting is an error, because a machine-local
    folder would be lost with its machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="modelwatch-")
    return f"{root.rstrip('/')}/modelwatch/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared work folder and read back.

    Used where several consumers would otherwise each recompute a long lineage; the files outlive lost
    executors.
    """
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_side_by_side(frames: dict[str, Callable[[], DataFrame]]) -> list[DataFrame]:
    """``stored`` for several independent frames, each made and run in a thread of its own.

    Small jobs that do not need each other then fill the cluster together, and each is planned alone: one plan over all of
    them would be analysed anew with every step that follows.
    """
    with ThreadPoolExecutor(max_workers=max(1, len(frames))) as pool:
        return list(pool.map(lambda item: stored(item[1](), item[0]), frames.items()))


def broadcast_within(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """Broadcast ``df`` only if ``rows * row_bytes`` stays below the limit.

    Beyond it the frame is returned without a hint: the join is then planned as a shuffle join, whose
    hot keys AQE splits.
    """
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df
