"""Directory listings: what a directory holds, for the directory prefilter."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwell import schema as S
from siftwell.functions import paths


#: Rows of a directory from which it is ordered by ranges, and how many ranges it gets.
RANGE_ROWS, RANGES = 50_000, 256


def ext_histogram(files: DataFrame, top: int = S.LISTING_EXTS) -> DataFrame:
    """Rows (path, extensions): the commonest extensions of each directory, ties by first appearance."""
    counts = files.groupBy("dir", F.when(F.col("ext") == "", "(none)").otherwise(F.col("ext")).alias("ext")).agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first"))
    best = Window.partitionBy("dir").orderBy(F.desc("n"), "first")
    kept = counts.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
    return kept.groupBy(F.col("dir").alias("path")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("ext", "n")))).alias("extensions"))


def _ranged(files: DataFrame, range_rows: int) -> DataFrame:
    """``files`` (dir, low, seq, ...) with ``_range``, by which large directories are sorted in parts.

    It is 0 in a directory of up to ``range_rows`` rows. In a larger one it is
    the number of cut points at or before the row; those are the rows of least
    hash there, so each range is a small share of the directory. One count is
    run at once: without a large directory no cut points are sought.
    """
    large = files.groupBy("dir").count().filter(F.col("count") > range_rows)
    if large.isEmpty():
        return files.withColumn("_range", F.lit(0))
    spread = Window.partitionBy("dir").orderBy(F.xxhash64("low", "seq"), "seq")
    key = F.struct("low", "seq")
    cuts = files.select("dir", key.alias("_cut"), F.row_number().over(spread).alias("_pick")).filter(F.col("_pick") < RANGES)
    edges = cuts.join(large, "dir", "left_semi").groupBy("dir").agg(F.array_sort(F.collect_list("_cut")).alias("_edges"))
    placed = files.join(edges, "dir", "left")
    return placed.withColumn("_range", F.when(F.col("_edges").isNull(), 0).otherwise(F.size(F.filter("_edges", lambda e: e <= key)))).drop("_edges")


def name_sample(files: DataFrame, most: int = S.LISTING_NAMES, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Rows (path, pos, name): evenly spaced names of each directory in the order of their lower case.

    No task sorts a directory of more than ``range_rows`` rows whole.
    """
    # one column for both keys: rows of a directory would else stay together where the join put them
    ranged = _ranged(files.select("dir", "name", F.lower("name").alias("low"), "seq"), range_rows).withColumn("_place", F.struct("dir", "_range"))
    before = Window.partitionBy("dir").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    counts = ranged.groupBy("dir", "_range").agg(F.count(F.lit(1)).alias("_n"))
    shifts = counts.select(F.struct("dir", "_range").alias("_place"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"), F.sum("_n").over(Window.partitionBy("dir")).alias("n"))
    own = F.row_number().over(Window.partitionBy("_place").orderBy("low", "seq")) - 1
    numbered = ranged.withColumn("_own", own).join(shifts, "_place").withColumn("i", F.col("_own") + F.col("_shift"))
    # the k-th pick is floor(k * n / most): i is picked if some k < most maps to it
    step = F.col("n") / F.lit(float(most))
    k = F.ceil(F.col("i") / step)
    picks = [F.floor((k + d) * step) == F.col("i") for d in (-1, 0, 1)]
    valid = [(k + d >= 0) & (k + d < most) for d in (-1, 0, 1)]
    chosen = (picks[0] & valid[0]) | (picks[1] & valid[1]) | (picks[2] & valid[2])
    sampled = numbered.filter((F.col("n") <= most) | chosen)
    return sampled.select(F.col("dir").alias("path"), (F.row_number().over(Window.partitionBy("dir").orderBy("i")) - 1).alias("pos"), "name")


def child_dirs(files: DataFrame) -> DataFrame:
    """Rows (path, children): the directories right below, those without files of their own included."""
    above = files.select("dir").distinct().select(F.explode(paths.ancestors(paths.join(F.col("dir"), F.lit("x")))).alias("path")).distinct()
    pairs = above.select(paths.parent(F.col("path")).alias("up"), F.col("path").alias("down"), paths.name(F.col("path")).alias("child")).filter("up <> down and child <> ''")
    return pairs.groupBy(F.col("up").alias("path")).agg(F.sort_array(F.collect_set("child")).alias("children"))


def listings(inventory: DataFrame, candidates: DataFrame, floor: int = S.LISTING_FLOOR) -> DataFrame:
    """One row per directory with ``floor`` inventory rows or more and a candidate.

    Duplicates and generated files count as files.
    """
    files = inventory.withColumn("dir", paths.parent(F.col("path"))).withColumn("name", paths.name(F.col("path")))
    asked = candidates.select(paths.parent(F.col("path")).alias("dir")).distinct()
    sizes = files.groupBy("dir").agg(F.count(F.lit(1)).alias("file_count"), F.sum("size").alias("total_bytes")).filter(F.col("file_count") >= floor).join(asked, "dir", "left_semi")
    own = files.join(sizes.select("dir"), "dir", "left_semi")
    names = name_sample(own).groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"]).alias("names_sample"))
    return (
        sizes.withColumnRenamed("dir", "path")
        .join(ext_histogram(own), "path", "left")
        .join(names, "path", "left")
        .join(child_dirs(files), "path", "left")
        .withColumn("subdirectories", F.coalesce("children", F.array().cast("array<string>")))
        .drop("children")
    )


def state(listing: DataFrame) -> DataFrame:
    """Rows (path, state): the JSON a directory judge is asked with."""
    body = F.struct(
        "path", "file_count", "total_bytes", "extensions", F.col("names_sample").alias("file_names_sample"),
        F.slice("subdirectories", 1, S.LISTING_DIRS).alias("subdirectory_names"), F.size("subdirectories").alias("subdirectory_count"),
    )
    return listing.select("path", F.to_json(body).alias("state"))
