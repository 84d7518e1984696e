"""JSON-lines tables: readers that declare their schema, and writers.

The order of a log is that of appending. Rows of ours carry it as ``seq``: the
number of the append and the row's place in it. Rows read from outside have no
``seq``; they are numbered by file, block and line, and come before ours. A log
has one writer at a time.
"""

from __future__ import annotations

from collections.abc import Iterable
from itertools import batched

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwell import schema as S


#: Bits of ``seq`` that hold a row's place in its append.
PLACES = 40


def read(spark: SparkSession, path: str, schema: T.StructType, strict: bool = True) -> DataFrame:
    """The rows of a JSON-lines file or folder with ``seq``.

    Strict reading fails on a malformed line; else such lines are left out.
    Blank lines never count, absent fields are null. A path that does not exist
    is an error.
    """
    fields = T.StructType([f for f in schema if f.name != "seq"] + [T.StructField("_stored", T.LongType())])
    if strict:
        rows = spark.read.schema(_renamed(fields)).json(path, mode="FAILFAST")
    else:
        with_bad = _renamed(fields).add("_bad", "string")
        rows = spark.read.schema(with_bad).json(path, mode="PERMISSIVE", columnNameOfCorruptRecord="_bad").filter("_bad is null").drop("_bad")
    meta = F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"))
    placed = rows.withColumn("_file", meta).withColumn("_line", F.monotonically_increasing_id())
    if not strict:
        placed = placed.filter("coalesce(path, dedupe_key) is not null" if "dedupe_key" in schema.names else "path is not null")
    return _numbered(placed).select(*schema.names)


def _renamed(fields: T.StructType) -> T.StructType:
    return T.StructType([T.StructField("seq", f.dataType) if f.name == "_stored" else f for f in fields])


def _numbered(placed: DataFrame) -> DataFrame:
    """``seq`` from blocks and lines: a shift per block, the line's number within it."""
    blocks = placed.groupBy("_file").agg(F.count(F.lit(1)).alias("_n"), F.min("_line").alias("_first"))
    before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)  # a row per block
    shifts = blocks.select(F.col("_file").alias("_f"), "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    joined = placed.join(shifts, F.col("_file") == F.col("_f"))
    return joined.withColumn("seq", F.coalesce("seq", F.col("_shift") + F.col("_line") - F.col("_first")))


def inventory(spark: SparkSession, path: str) -> DataFrame:
    return read(spark, path, S.INVENTORY)


def results(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    return read(spark, path, S.RESULTS, strict)


def decisions(spark: SparkSession, path: str) -> DataFrame:
    """The prefilter's log; an empty one if there is none yet."""
    if not exists(spark, path):
        return spark.createDataFrame([], S.DECISIONS)
    return read(spark, path, S.DECISIONS)


def ocr(spark: SparkSession, path: str) -> DataFrame:
    return read(spark, path, S.OCR_LOG, strict=False)


def overwrite(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def next_append(spark: SparkSession, path: str) -> int:
    """The number of the next append to a log of ours: one more than the greatest in it."""
    if not exists(spark, path):
        return 1
    last = spark.read.schema("seq long").json(path).agg(F.max("seq")).first()[0]
    return ((last or 0) >> PLACES) + 1


def numbered(df: DataFrame, number: int, key: str) -> DataFrame:
    """``df`` with the ``seq`` of append ``number``: its own place (column seq, if it has one), else one by hash of ``key``."""
    spread = F.pmod(F.xxhash64(key), F.lit(1 << PLACES))
    place = F.coalesce(F.col("seq").cast("long"), spread) if "seq" in df.columns else spread
    return df.withColumn("seq", place + F.lit(number << PLACES))


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("ignoreNullFields", "false").json(path)


def write_errors(errors: DataFrame, path: str) -> None:
    errors.select(F.concat_ws(": ", "path", "error").alias("value")).write.mode("overwrite").text(path)


def write_text(spark: SparkSession, path: str, lines: Iterable[str]) -> None:
    """Write ``lines`` as one file where Spark would write it; some thousand are held at a time."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    try:
        for part in batched(lines, 10_000):
            out.write(bytearray("".join(f"{line}\n" for line in part), "utf-8"))
    finally:
        out.close()


def write_scripts(df: DataFrame, path: str, rows: int) -> list[str]:
    """Write a column of text as a folder of files of at most ``rows`` lines; return their names, in the order of ``df``."""
    spark, hadoop = df.sparkSession, df.sparkSession._jvm.org.apache.hadoop
    df.write.mode("overwrite").option("maxRecordsPerFile", rows).text(path)
    system = hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    parts = [s.getPath().getName() for s in system.listStatus(hadoop.fs.Path(path)) if s.getLen() and s.getPath().getName().startswith("part-")]
    names = []
    for k, part in enumerate(sorted(parts, key=_place)):
        names.append(f"{k:06}.js")
        system.rename(hadoop.fs.Path(f"{path}/{part}"), hadoop.fs.Path(f"{path}/{names[-1]}"))
    return names


def _place(part: str) -> tuple[int, int]:
    """The task's number and the file's number within it, of a name such as ``part-00001-<uuid>-c002.txt``."""
    return int(part.split("-")[1]), int(part.rsplit("-c", 1)[1].split(".")[0])


def write_lines(df: DataFrame, path: str) -> None:
    """Write a column of text as one file in the order of ``df``.

    Parts are written side by side and then put behind one another; no row
    comes to Python.
    """
    spark, hadoop = df.sparkSession, df.sparkSession._jvm.org.apache.hadoop
    folder, conf = f"{path}.parts", spark._jsc.hadoopConfiguration()
    df.write.mode("overwrite").text(folder)
    system = hadoop.fs.Path(folder).getFileSystem(conf)
    parts = [s.getPath() for s in system.listStatus(hadoop.fs.Path(folder)) if s.getPath().getName().startswith("part-")]
    out = system.create(hadoop.fs.Path(path), True)
    try:
        for part in sorted(parts, key=lambda p: int(p.getName().split("-")[1])):
            source = system.open(part)
            try:
                hadoop.io.IOUtils.copyBytes(source, out, conf, False)
            finally:
                source.close()
    finally:
        out.close()
    remove(spark, folder)
