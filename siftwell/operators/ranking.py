"""Ranks, top-k and the collapse of siblings.

Ties are broken by first appearance (``first_seq``), as a stable sort does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell import schema as S
from siftwell.functions import paths, rules


def overall_top(latest: DataFrame, top: int = S.REPORT_TOP) -> DataFrame:
    """The best valid rows with their rank; the rank is numbered over those rows alone."""
    best = latest.filter(rules.is_valid()).orderBy(F.desc("value_score"), "first_seq").limit(top)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("value_score"), "first_seq")))  # of `top` rows


def by_category(latest: DataFrame, min_prob: float) -> DataFrame:
    """One row per valid row and category at or over ``min_prob``: category_name, probability."""
    pairs = F.array(*[F.struct(F.lit(c).alias("category_name"), rules.probability(c).alias("probability")) for c in S.CATEGORIES])
    return latest.filter(rules.is_valid()).withColumn("_p", F.explode(pairs)).select("*", "_p.category_name", "_p.probability").drop("_p").filter(rules.at_least(F.col("probability"), min_prob))


def category_top(latest: DataFrame, min_prob: float = S.REPORT_MIN_PROB, top: int = S.CATEGORY_TOP) -> DataFrame:
    """The most probable rows of each category, with their rank there."""
    best = Window.partitionBy("category_name").orderBy(F.desc("probability"), "first_seq")
    return by_category(latest, min_prob).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)


def surfaced_keys(latest: DataFrame, top: int = S.REPORT_TOP, min_prob: float = S.REPORT_MIN_PROB) -> DataFrame:
    """Keys that a report shows anywhere."""
    return overall_top(latest, top).select("dedupe_key").union(category_top(latest, min_prob).select("dedupe_key")).distinct()


def collapse_siblings(rows: DataFrame, group: list[str], order: list[Column], most: int = S.MAX_PER_DIR, directory: str = "dir") -> DataFrame:
    """Keep ``most`` rows of each directory; the next one becomes a marker with ``hidden`` = how many are left out.

    ``group`` are the sections in which rows collapse on their own. Ranks are
    those the rows had before.
    """
    keys = [*group, directory]
    # ranked rows are cut before the shuffle and counts are combined there, so a directory of any size makes no large group
    kept = rows.withColumn("_pos", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_pos") <= most + 1)
    counts = rows.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.count(F.lit(1)).alias("_n"))
    joined = kept.join(counts, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return joined.withColumn("hidden", F.when(F.col("_pos") > most, F.col("_n") - most).otherwise(0)).drop("_pos", "_n", *[f"_{k}" for k in keys])


def split_sections(ranked: DataFrame) -> DataFrame:
    """``ranked`` with section: content is verified here, a recognised text is not."""
    return ranked.withColumn("section", F.when(rules.verified_label(F.col("extraction_status")) == "content", "verified").otherwise("unverified"))


def copy_order() -> list[Column]:
    path = F.col("path")
    return [F.lower(paths.parent(path)), F.lower(paths.name(path)), F.col("first_seq")]


def ocr_candidates(latest: DataFrame, top: int = S.OCR_TOP, min_value: float = S.MIN_VALUE, take_all: bool = False, limit: int | None = None) -> DataFrame:
    """Rows to recognise: the best of enough value, or all in order of appearance."""
    ext = paths.extension(paths.name(F.col("path")))
    rows = latest.filter(rules.is_ocr_eligible(ext))
    if not take_all:
        rows = rows.filter(rules.at_least(F.col("value_score"), min_value)).orderBy(F.desc("value_score"), "first_seq").limit(top)
    return rows if limit is None else rows.orderBy(*([] if take_all else [F.desc("value_score")]), "first_seq").limit(limit)


def stratified_sample(rows: DataFrame, per_bucket: int, seed: int = S.SAMPLE_SEED) -> DataFrame:
    """Up to ``per_bucket`` rows of each value bucket [0, 1), [1, 2), [2, 3], by a seeded hash of the key."""
    bucket = F.least(F.floor("value_score"), F.lit(2))
    w = Window.partitionBy("bucket").orderBy(F.md5(F.concat("dedupe_key", F.lit(str(seed)))), "dedupe_key")
    return rows.filter("value_score is not null").withColumn("bucket", bucket).withColumn("pick", F.row_number().over(w)).filter(F.col("pick") <= per_bucket)
