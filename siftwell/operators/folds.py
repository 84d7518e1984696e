"""Current state from append-only logs: one row per key.

``seq`` is the order of appending. A fold is one aggregate with ``max_by``,
combined before the shuffle, so a key with many rows costs no sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.functions import rules


def _latest(log: DataFrame, key: str, order: Column) -> DataFrame:
    """The row with the greatest ``order`` of each key, and the key's ``first_seq``."""
    row = F.struct(*[F.col(c) for c in log.columns])
    return log.groupBy(F.col(key).alias("_key")).agg(F.max_by(row, order).alias("_row"), F.min("seq").alias("first_seq")).select("_row.*", "first_seq")


def results_latest(log: DataFrame) -> DataFrame:
    """The last success of each dedupe_key, or its last error if it has none.

    An empty error text counts as none here. Rows without a key are no results.
    """
    return _latest(log.filter("dedupe_key is not null"), "dedupe_key", F.struct(rules.no_error().alias("good"), F.col("seq")))


def decisions_latest(log: DataFrame) -> DataFrame:
    """The last successful decision of each directory; failed ones are asked again."""
    return _latest(log.filter(rules.no_error() & F.col("path").isNotNull()), "path", F.col("seq"))


def ocr_excerpts(log: DataFrame) -> DataFrame:
    """Excerpts of the keys whose last recognition went well; a later failure hides an earlier text."""
    return _latest(log.filter("dedupe_key is not null"), "dedupe_key", F.col("seq")).filter("ocr_status = 'ok' and excerpt <> ''")


def resolved_keys(log: DataFrame) -> DataFrame:
    """Keys with any row whose error is null; an empty error text is not resolved."""
    return log.filter("error is null and dedupe_key is not null").select("dedupe_key").distinct()
