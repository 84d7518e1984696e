"""Keys of files and their duplicates."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell import schema as S
from siftwell.functions import rules


def metadata_key(size: Column, name: Column) -> Column:
    return F.concat_ws(":", F.lit("meta"), size, F.lower(name))


def text_key(text: Column, size: Column) -> Column:
    """A content key of texts at hand, made by the JVM."""
    return F.md5(F.concat(text, size.cast("string")))


def content_key(path: str, size: int) -> str | None:
    """blake2b-128 of the first 256 KiB and the size; null if the file can't be read."""
    try:
        with open(path, "rb") as file:
            head = file.read(S.KEY_BYTES)
    except OSError:
        return None
    return hashlib.blake2b(head + str(size).encode(), digest_size=16).hexdigest()


def with_keys(files: DataFrame, name: str = "name") -> DataFrame:
    """``files`` (path, size, category, ...) with dedupe_key.

    Only readable kinds are hashed; they go through Python on their own branch,
    the others never leave the JVM. A file that can't be read falls back to its
    metadata.
    """
    hashed = rules.is_hashed(F.col("category"), F.col("size"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema)

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(dedupe_key=[content_key(p, s) for p, s in zip(batch["path"], batch["size"], strict=True)])

    fallback = metadata_key(F.col("size"), F.col(name))
    read = files.filter(F.coalesce(hashed, F.lit(False))).mapInPandas(keys, f"{kinds}, dedupe_key string").withColumn("dedupe_key", F.coalesce("dedupe_key", fallback))
    return read.unionByName(files.filter(~F.coalesce(hashed, F.lit(False))).withColumn("dedupe_key", fallback))


def mark_duplicates(inventory: DataFrame) -> DataFrame:
    """``inventory`` with dup_of: the first path (by seq) of the key, null for that row itself."""
    first = inventory.groupBy("dedupe_key").agg(F.min_by("path", "seq").alias("_first"), F.min("seq").alias("_seq"))
    joined = inventory.drop("dup_of").join(first, "dedupe_key", "left")
    return joined.withColumn("dup_of", F.when(F.col("seq") > F.col("_seq"), F.col("_first"))).drop("_first", "_seq")


def first_in_key(inventory: DataFrame) -> DataFrame:
    """The same by a window, for inventories whose keys are all small."""
    w = Window.partitionBy("dedupe_key").orderBy("seq")
    return inventory.withColumn("dup_of", F.when(F.row_number().over(w) > 1, F.first("path").over(w)))


def savings(inventory: DataFrame) -> DataFrame:
    return inventory.agg(F.count_if(F.col("dup_of").isNotNull()).alias("duplicates"), F.coalesce(F.sum(F.when(F.col("dup_of").isNotNull(), F.col("size"))), F.lit(0)).alias("duplicate_bytes"))
