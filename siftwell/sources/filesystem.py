"""A filesystem as a Spark data source.

Built-in file sources hide names that begin with a dot or an underscore; this
one lists every file. Directories that are never wanted are pruned while
listing, so their subtrees cost nothing. Folders are opened breadth first until
there are enough subtrees for all tasks; each of those is a partition of its own.
"""

from __future__ import annotations

import json
import os
import stat
from collections import deque
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from siftwell.functions import paths, rules
from siftwell.operators import dedupe, selection

#: Partitions a walk is dealt to, at least where there are as many folders.
SUBTREES = 16
LISTED = "path string, name string, size bigint, mtime double, root string, error string"


def is_link(entry: os.DirEntry) -> bool:
    """Symbolic links, and reparse points where the system has them."""
    if entry.is_symlink():
        return True
    attributes = getattr(entry.stat(follow_symlinks=False), "st_file_attributes", 0)
    return bool(attributes & getattr(stat, "FILE_ATTRIBUTE_REPARSE_POINT", 0x400))


def identity(path: str) -> tuple[int, int] | None:
    """What a directory is, whatever its name; null if that can't be told."""
    try:
        found = os.stat(path)
    except OSError:
        return None
    return (found.st_dev, found.st_ino) if found.st_ino else None


class Subtree(InputPartition):
    def __init__(self, root: str, folder: str, deep: bool) -> None:
        self.root, self.folder, self.deep = root, folder, deep


def _is_folder(entry: os.DirEntry) -> bool:
    """Whether to descend: not into links, nor into what vanished; that is told as an entry."""
    try:
        return entry.is_dir(follow_symlinks=False) and not is_link(entry)
    except OSError:
        return False


def _kept_dirs(root: str, folder: str, entries: list[os.DirEntry]) -> list[os.DirEntry]:
    below = [p for p in os.path.relpath(folder, root).split(os.sep) if p != "."]
    above = below or [os.path.basename(os.path.normpath(root))]
    siblings = {e.name.lower() for e in entries}
    return [e for e in entries if _is_folder(e) and not rules.skips_dir(e.name, above) and not rules.skips_beside(e.name, siblings)]


class FilesReader(DataSourceReader):
    def __init__(self, roots: list[str], subtrees: int = SUBTREES) -> None:
        self.roots, self.subtrees = roots, subtrees

    def partitions(self) -> list[InputPartition]:
        """Roots, and folders below them until there are ``subtrees`` parts, are listed one by one; what is left is walked.

        No more than ``subtrees`` folders are opened here beside the roots.
        """
        flat: list[InputPartition] = []
        waiting = deque((root, root) for root in self.roots)
        seen: set[tuple[int, int]] = set()
        while waiting and (len(flat) < len(self.roots) or len(flat) + len(waiting) < self.subtrees):
            root, folder = waiting.popleft()
            flat.append(Subtree(root, folder, deep=False))
            try:
                with os.scandir(folder) as listing:
                    entries = sorted(listing, key=lambda e: e.name)
            except OSError:
                continue  # told by the partition that lists the folder
            for entry in _kept_dirs(root, folder, entries):
                who = identity(entry.path)
                if who is None or who not in seen:
                    seen.add(who)
                    waiting.append((root, entry.path))
        return flat + [Subtree(root, folder, deep=True) for root, folder in waiting]

    def read(self, partition: Subtree) -> Iterator[tuple]:
        waiting, visited = [partition.folder], set()
        while waiting:
            folder = waiting.pop()
            who = identity(folder)
            if who is not None and who in visited:
                continue
            visited.add(who)
            try:
                with os.scandir(folder) as listing:
                    entries = sorted(listing, key=lambda e: e.name)
            except OSError as error:
                yield (_text(folder), None, None, None, partition.root, str(error))
                continue
            for entry in entries:
                try:
                    if is_link(entry) or not entry.is_file(follow_symlinks=False):
                        continue
                    found = entry.stat(follow_symlinks=False)
                except OSError as error:
                    yield (_text(entry.path), _text(entry.name), None, None, partition.root, str(error))
                    continue
                yield (_text(entry.path), _text(entry.name), found.st_size, found.st_mtime, partition.root, None)
            if partition.deep:
                waiting += [e.path for e in reversed(_kept_dirs(partition.root, folder, entries))]


def _text(name: str) -> str:
    return name.encode("utf-8", "replace").decode("utf-8")


class FilesDataSource(DataSource):
    """``spark.read.format("siftwell_files").option("roots", '["a", "b"]')``: the roots as a JSON list."""

    @classmethod
    def name(cls) -> str:
        return "siftwell_files"

    def schema(self) -> str:
        return LISTED

    def reader(self, schema: object) -> DataSourceReader:
        return FilesReader(json.loads(self.options.get("roots", "[]")), int(self.options.get("subtrees", SUBTREES)))


def listed(spark: SparkSession, roots: list[str]) -> DataFrame:
    """All files below the roots, and a row with an error for what could not be read."""
    spark.dataSource.register(FilesDataSource)
    subtrees = max(SUBTREES, 2 * spark.sparkContext.defaultParallelism)
    return spark.read.format("siftwell_files").option("roots", json.dumps(roots)).option("subtrees", subtrees).load()


def inventory(spark: SparkSession, roots: list[str], written: Callable[[DataFrame, str], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """(inventory, errors) of the roots, which share one key space.

    ``written`` makes a table of a DataFrame under a name. With it the roots
    are walked and files are hashed once; without it each use does so anew.

    ``seq`` numbers rows by root, then path, so that a rerun gives the same.
    It is made of a count per directory and a number within, not of one sort.
    """
    kept = written or (lambda df, _: df)
    rows = kept(listed(spark, roots), "walk-work/listing")
    errors = rows.filter("error is not null").select("path", "root", "error")
    order = F.array_position(F.array(*map(F.lit, roots)), F.col("root"))
    files = selection.size_floor(rows.filter("error is null")).drop("error").withColumn("ext", paths.extension(F.col("name"))).withColumn("category", rules.categorize(F.col("ext")))
    files = files.withColumn("_root", order).withColumn("_dir", paths.parent(F.col("path")))
    sizes = files.groupBy("_root", "_dir").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_root", "_dir").rowsBetween(Window.unboundedPreceding, -1)  # a row per directory
    shifts = sizes.select("_root", "_dir", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    own = F.row_number().over(Window.partitionBy("_root", "_dir").orderBy("path")) - 1
    numbered = files.withColumn("_own", own).join(shifts, ["_root", "_dir"]).withColumn("seq", F.col("_own") + F.col("_shift")).drop("_own", "_shift", "_root", "_dir")
    keyed = dedupe.mark_duplicates(kept(dedupe.with_keys(numbered), "walk-work/keyed"))
    return keyed.select("path", "size", "mtime", "ext", "category", "dedupe_key", "dup_of", "seq", "root"), errors
