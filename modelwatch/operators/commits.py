"""Code changes near an alert, and the shape of their diffs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from .alerts import AlertBook, alert_book, day_pruning


def in_window(commits: DataFrame, alerts: DataFrame | AlertBook, path: str | None = fv.WATCHED_PATH,
              days: int = 1) -> DataFrame:
    """Commits of the alert's scope within ``days`` of it (both ends included) that touch ``path``.

    Without a path all commits count. The alert span also bounds the scan.
    """
    book = alert_book(alerts)
    if path is not None:
        commits = commits.where(F.exists("changed_files", lambda f: f.contains(path)))
    reach = F.expr(f"INTERVAL {int(days)} DAY")
    kind = commits.schema["committed_at"].dataType
    near = (F.col("committed_at").between(F.lit(book.start).cast(kind) - reach, F.lit(book.end).cast(kind) + reach)
            & day_pruning(commits, book.start, book.end, int(days)))
    windows = ["alert_id", (F.col("alert_ts") - reach).alias("_from"), (F.col("alert_ts") + reach).alias("_to")]
    return (book.meet(commits.where(near), "committed_at", windows, [("_from", "_to")])
            .where(F.col("committed_at").between(F.col("_from"), F.col("_to")))
            .drop("_from", "_to")
            .withColumn("message", F.trim("message"))
            .withColumn("date", F.date_format("committed_at", "yyyy-MM-dd HH:mm:ss"))
            .withColumn("summary", F.format_string(fv.SUMMARY_COMMIT, "author", "date", "message")))


def diff_line_profile(commits: DataFrame) -> DataFrame:
    """Lines per class of every changed file, from the whole diff text; no shuffle."""
    files = commits.select("scope_id", "commit_hash", F.explode("diffs").alias("d"))
    lines = F.when(F.length("d.diff_text") > 0, F.split("d.diff_text", "\n", -1)).otherwise(F.array())
    count = lambda test: F.size(F.filter("_lines", test)).cast("long")
    return (files.withColumn("_lines", lines)
            .select("scope_id", "commit_hash", F.col("d.file_path").alias("file_path"),
                    count(lambda x: x.startswith("+")).alias("additions"),
                    count(lambda x: x.startswith("-")).alias("deletions"),
                    count(lambda x: x.startswith("@@")).alias("meta"),
                    F.size("_lines").cast("long").alias("lines"))
            .withColumn("context", F.col("lines") - F.col("additions") - F.col("deletions") - F.col("meta")))
