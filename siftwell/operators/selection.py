"""Which inventory rows a scan takes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell import schema as S
from siftwell.functions import paths, rules


def size_floor(files: DataFrame) -> DataFrame:
    return files.filter(F.col("size") >= S.MIN_SIZE)


def eligible(inventory: DataFrame, resolved: DataFrame | None = None, only_keys: DataFrame | None = None, exclude_exts: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Candidates in inventory order.

    Duplicates and generated files never count. Given ``only_keys`` its keys
    count, resolved or not; else those not resolved.
    """
    rows = inventory.filter(F.col("dup_of").isNull() & (F.col("category") != "generated"))
    if exclude_exts:
        rows = rows.filter(~F.lower("ext").isin(*[e.strip().lstrip(".").lower() for e in exclude_exts]))
    if only_keys is not None:
        rows = rows.join(only_keys.select("dedupe_key"), "dedupe_key", "left_semi")
    elif resolved is not None:
        rows = rows.join(resolved.select("dedupe_key"), "dedupe_key", "left_anti")
    return rows if limit is None else rows.orderBy("seq").limit(limit)


def parse_exts(text: str) -> list[str]:
    return [e for x in text.split(",") if (e := x.strip().lstrip(".").lower())]


def last_by_key(inventory: DataFrame) -> DataFrame:
    """The last inventory row of each key, duplicates included."""
    return inventory.groupBy(F.col("dedupe_key").alias("_key")).agg(F.max_by(F.struct(*inventory.columns), "seq").alias("_row")).select("_row.*")


def name_only_keys(latest: DataFrame, inventory: DataFrame) -> DataFrame:
    """Keys judged without content whose file could be read today."""
    judged = latest.filter(rules.no_error() & rules.was_name_only(F.col("extraction_status"), F.col("category"))).select("dedupe_key")
    today = last_by_key(inventory)
    readable = today.filter(rules.is_extractable(rules.categorize(F.col("ext")), F.col("ext"), F.col("size")))
    return judged.join(readable.select("dedupe_key"), "dedupe_key", "left_semi").distinct()


def outdated_keys(latest: DataFrame, version: int = S.RUBRIC_VERSION) -> DataFrame:
    """Keys judged under another rubric; a missing version is another."""
    return latest.filter(rules.no_error() & ~F.col("rubric_version").eqNullSafe(version)).select("dedupe_key")


def ocr_classified_keys(latest: DataFrame) -> DataFrame:
    return latest.filter(rules.no_error() & (F.col("extraction_status") == "ocr")).select("dedupe_key")


def fresh_ocr_keys(excerpts: DataFrame, latest: DataFrame) -> DataFrame:
    """Keys with a recognised text that no judgment used yet."""
    return excerpts.select("dedupe_key").join(ocr_classified_keys(latest), "dedupe_key", "left_anti").distinct()


def all_of(*key_sets: DataFrame) -> DataFrame:
    """Keys in every one of the sets."""
    found = key_sets[0].select("dedupe_key").distinct()
    for other in key_sets[1:]:
        found = found.join(other.select("dedupe_key"), "dedupe_key", "left_semi")
    return found


def with_excerpts(candidates: DataFrame, excerpts: DataFrame) -> DataFrame:
    """Candidates with a recognised text instead of an extracted one where there is one."""
    texts = excerpts.select("dedupe_key", F.col("excerpt").alias("_text"))
    joined = candidates.join(texts, "dedupe_key", "left")
    taken = F.col("_text").isNotNull()
    return (
        joined.withColumn("excerpt", F.coalesce("_text", "excerpt"))
        .withColumn("extraction_status", F.when(taken, "ocr").otherwise(F.col("extraction_status")))
        .withColumn("metadata_only", F.when(taken, False).otherwise(F.col("metadata_only")))
        .drop("_text")
    )


def apply_decisions(candidates: DataFrame, listings: DataFrame, decisions: DataFrame, skip_below: float = S.SKIP_BELOW) -> DataFrame:
    """Candidates outside the listed directories that were judged not worth scanning.

    Directories without a successful decision keep all their files.
    """
    skipped = skipped_directories(listings, decisions, skip_below)
    return candidates.withColumn("_dir", paths.parent(F.col("path"))).join(skipped.select(F.col("path").alias("_dir")), "_dir", "left_anti").drop("_dir")


def skipped_directories(listings: DataFrame, decisions: DataFrame, skip_below: float = S.SKIP_BELOW) -> DataFrame:
    return decisions.filter(F.col("worth_scanning") < skip_below).join(listings.select("path"), "path", "left_semi").select("path")


def undecided(listings: DataFrame, decisions: DataFrame) -> DataFrame:
    return listings.join(decisions.select("path"), "path", "left_anti")


def in_repositories(files: DataFrame) -> DataFrame:
    """``files`` with in_repository: some directory above holds a ``.git`` entry of the table.

    ``files`` lists directories too, or files below ``.git``.
    """
    roots = files.select(F.explode(paths.ancestors(F.col("path"))).alias("dir")).union(files.select(F.col("path").alias("dir"))).filter(paths.name(F.col("dir")) == ".git").select(paths.parent(F.col("dir")).alias("_up")).distinct()
    above = files.select("path", F.explode(paths.ancestors(F.col("path"))).alias("_up")).join(roots, "_up", "left_semi").select("path").distinct().withColumn("_in", F.lit(True))
    return files.join(above, "path", "left").withColumn("in_repository", F.coalesce("_in", F.lit(False))).drop("_in")


def is_synced(path: Column) -> Column:
    """Whether a path lies in a synchronised cloud folder."""
    return F.exists(paths.parts(path), lambda p: F.lower(p).startswith("onedrive"))
