"""Agreement between two runs of a judge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.functions import rules


BUCKETS = 256


def rows_below(counts: DataFrame, value: str, number: str = "_n") -> DataFrame:
    """``counts`` (a row per distinct value and its number of rows) with ``below``: the rows of smaller values.

    Values are cut at approximate quantiles into ``BUCKETS`` ranges, which are
    summed on their own and then shifted by the ranges before.
    """
    cuts = counts.approxQuantile(value, [i / BUCKETS for i in range(1, BUCKETS)], 0.001)
    edges = F.array(*[F.lit(c) for c in sorted(set(cuts))]) if cuts else F.array().cast("array<double>")
    ranged = counts.withColumn("_range", F.size(F.filter(edges, lambda c: c <= F.col(value))))
    sums = ranged.groupBy("_range").agg(F.sum(number).alias("_sum"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # of BUCKETS rows
    shifts = sums.select("_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_shift"))
    inside = Window.partitionBy("_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    own = ranged.withColumn("_own", F.coalesce(F.sum(number).over(inside), F.lit(0)))
    return own.join(shifts, "_range").withColumn("below", F.col("_own") + F.col("_shift")).drop("_range", "_own", "_shift")


def average_ranks(rows: DataFrame, value: str, rank: str) -> DataFrame:
    """``rows`` with the rank of ``value``, equal values sharing their mean rank."""
    counts = rows.groupBy(value).agg(F.count(F.lit(1)).alias("_n"))
    ranked = rows_below(counts, value).withColumn(rank, F.col("below") + (F.col("_n") + 1) / 2.0).drop("_n", "below")
    return rows.join(ranked, value)


def spearman(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """One row: the rank correlation of two columns, nulls left out."""
    good = pairs.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    ranked = average_ranks(average_ranks(good, a, "_ra"), b, "_rb")
    return ranked.agg(F.corr("_ra", "_rb").alias("spearman"), F.count(F.lit(1)).alias("pairs"))


def flips(pairs: DataFrame, before: Column, after: Column) -> DataFrame:
    """One row: the share of rows whose flag changed."""
    return pairs.agg(F.avg(F.when(before != after, 1.0).otherwise(0.0)).alias("flip_rate"), F.count(F.lit(1)).alias("pairs"))


def crossings(pairs: DataFrame, before: Column, after: Column) -> DataFrame:
    """One row: rows that crossed a threshold either way, and precision and recall of the later flag by the earlier."""
    both = F.count_if(before & after)
    return pairs.agg(
        F.count(F.lit(1)).alias("pairs"), F.count_if(before & ~after).alias("lost"), F.count_if(~before & after).alias("gained"),
        (both / F.nullif(F.count_if(after), F.lit(0))).alias("precision"), (both / F.nullif(F.count_if(before), F.lit(0))).alias("recall"),
    )


def kinds(decisions: DataFrame) -> DataFrame:
    """Directories and their files by the kind they were judged to be."""
    return decisions.groupBy("kind").agg(F.count(F.lit(1)).alias("directories"), F.sum("file_count").alias("files"))


def threshold_recall(results: DataFrame, decisions: DataFrame, threshold: float, wanted: Column | None = None) -> DataFrame:
    """What a directory threshold keeps: recall of the wanted rows, and the share of all rows saved.

    Rows of directories without an answer count as worth 1.
    """
    wanted = rules.is_included() if wanted is None else wanted
    joined = results.join(decisions.select(F.col("path").alias("dir"), "worth_scanning"), "dir", "left").withColumn("_worth", F.coalesce("worth_scanning", F.lit(1.0)))
    keeps = F.col("_worth") >= threshold
    return joined.agg(
        F.count(F.lit(1)).alias("files"), F.count_if(wanted).alias("wanted"), F.count_if(wanted & keeps).alias("kept"), F.count_if(~keeps).alias("saved"),
    ).withColumn("recall", F.col("kept") / F.nullif("wanted", F.lit(0)))
