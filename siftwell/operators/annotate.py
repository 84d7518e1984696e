"""Backfill of extraction states into old results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell import schema as S
from siftwell.functions import rules
from siftwell.operators import ranking, selection


def annotation_targets(latest: DataFrame, inventory: DataFrame, take_all: bool = False, top: int = S.REPORT_TOP, min_prob: float = S.REPORT_MIN_PROB) -> DataFrame:
    """Judged rows with the path of their key's last inventory row; by default those that a report shows."""
    rows = latest.filter(rules.no_error())
    if not take_all:
        rows = rows.join(ranking.surfaced_keys(latest, top, min_prob), "dedupe_key", "left_semi")
    today = selection.last_by_key(inventory).select("dedupe_key", F.col("path").alias("file_path"), F.col("ext").alias("file_ext"), F.col("category").alias("file_category"), F.col("size").alias("file_size"))
    return rows.join(today, "dedupe_key")


def backfill(targets: DataFrame, extracted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows to append, keys to scan anew).

    ``extracted`` has dedupe_key, metadata_only and extraction_status as they
    are now. Only rows without a stored status are appended; a stored status
    is never replaced, but a file that could not be read and now can is listed.
    """
    now = extracted.select("dedupe_key", F.col("metadata_only").alias("_only"), F.col("extraction_status").alias("_status"))
    joined = targets.join(now, "dedupe_key")
    missing = joined.filter("extraction_status is null")
    appended = missing.withColumn("extraction_status", F.col("_status")).withColumn("metadata_only", F.col("_only")).drop("_status", "_only", "file_path", "file_ext", "file_category", "file_size", "first_seq")
    again = joined.filter("extraction_status <> 'ok' and _status = 'ok'").select("dedupe_key", "path")
    return appended, again
