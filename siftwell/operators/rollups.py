"""Counts by category, directory and subtree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell import schema as S
from siftwell.functions import money, paths, rules


def category_counts(inventory: DataFrame) -> DataFrame:
    return inventory.groupBy("category").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))


def top_level_counts(inventory: DataFrame) -> DataFrame:
    return inventory.groupBy(paths.top_level(F.col("path"), F.col("root")).alias("top_level")).agg(F.count(F.lit(1)).alias("files")).orderBy(F.desc("files"), "top_level")


def directory_rollup(rows: DataFrame, top: int = S.ROLLUP_TOP) -> DataFrame:
    """The directories with most rows, ties by first appearance."""
    return rows.groupBy(paths.parent(F.col("path")).alias("dir")).agg(F.count(F.lit(1)).alias("files"), F.min("first_seq").alias("first")).orderBy(F.desc("files"), "first").limit(top).drop("first")


def subtree_rollup(latest: DataFrame, min_value: float = S.MIN_VALUE, min_prob: float = S.REPORT_MIN_PROB) -> DataFrame:
    """One row per directory at any depth over the valid rows below it.

    Rows are summed by their own directory first; only those sums go to every
    directory above.
    """
    valid = latest.filter(rules.is_valid()).withColumn("notable", rules.is_included(min_value, min_prob))
    own = F.col("notable")
    direct = valid.groupBy(paths.parent(F.col("path")).alias("own")).agg(
        F.min(paths.ancestors(F.col("path"))).alias("above"),  # the same for all rows of a directory
        F.count(F.lit(1)).alias("scanned_subtree"),
        F.count_if(own).alias("notable_subtree"),
        *[F.count_if(own & rules.at_least(rules.probability(c), min_prob)).alias(c) for c in S.CATEGORIES],
        F.max(F.when(own, F.col("value_score"))).alias("max_value"),
        F.coalesce(F.sum(F.when(own, F.col("size"))), F.lit(0)).alias("notable_bytes"),
    )
    return direct.withColumn("dir", F.explode("above")).groupBy("dir").agg(
        F.sum("scanned_subtree").alias("scanned_subtree"),
        F.sum("notable_subtree").alias("notable_subtree"),
        F.sum(F.when(F.col("own") == F.col("dir"), F.col("notable_subtree")).otherwise(0)).alias("notable_direct"),
        *[F.sum(c).alias(c) for c in S.CATEGORIES],
        F.max("max_value").alias("max_value"),
        F.sum("notable_bytes").alias("notable_bytes"),
    )


def manifest_totals(rows: DataFrame, min_prob: float = S.MANIFEST_MIN_PROB) -> DataFrame:
    verified = rules.verified_label(F.col("extraction_status")).isin("content", "ocr")
    return rows.agg(
        F.count(F.lit(1)).alias("files"),
        F.count_if(verified).alias("verified"),
        F.count_if(~verified).alias("name_only"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"),
        *[F.count_if(rules.at_least(rules.probability(c), min_prob)).alias(c) for c in S.CATEGORIES],
    )


def report_summary(latest: DataFrame, min_value: float = S.MIN_VALUE, min_prob: float = S.REPORT_MIN_PROB) -> DataFrame:
    """One row: scanned counts all latest rows, errors included."""
    label = rules.verified_label(F.col("extraction_status"))
    return latest.agg(
        F.count(F.lit(1)).alias("scanned"),
        F.count_if(~rules.no_error()).alias("errors"),
        F.count_if(rules.is_valid() & rules.is_included(min_value, min_prob)).alias("notable"),
        *[F.count_if(rules.is_valid() & (label == v)).alias(f"label_{v.replace('-', '_')}") for v in S.VERIFIED_LABELS],
        F.count_if(rules.is_valid() & rules.at_least(rules.probability("credentials"), min_prob)).alias("credential_hits"),
        money.cost(F.sum(F.coalesce("input_tokens", F.lit(0).cast("long"))).cast("double")).alias("spend"),
    )


def category_tallies(latest: DataFrame, min_prob: float = S.REPORT_MIN_PROB) -> DataFrame:
    """Notable rows of each category, verified and not."""
    from siftwell.operators.ranking import by_category

    verified = rules.verified_label(F.col("extraction_status")).isin("content", "ocr")
    return by_category(latest, min_prob).groupBy("category_name").agg(F.count(F.lit(1)).alias("files"), F.count_if(verified).alias("verified"), F.count_if(~verified).alias("name_only"))


def credential_warnings(latest: DataFrame, min_prob: float = S.CREDENTIAL_WARNING) -> DataFrame:
    """All latest rows that may hold credentials, included in the manifest or not."""
    p = rules.probability("credentials")
    return latest.filter(rules.no_error() & rules.at_least(p, min_prob)).withColumn("credential_prob", p).orderBy(F.desc("credential_prob"), "first_seq")
