"""Tables in the shared folder, and small helpers that several operators use.

A plan is cut by writing a Parquet table into the folder that the cluster
names in ``spark.checkpoint.dir``. Such a table outlives the executors that
wrote it, is compressed, and unlike ``DataFrame.checkpoint()`` is computed
once. Where the setting is absent a local master uses ``/tmp/checkpoints``; any
other fails, as its executors would not see such a folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LOCAL_FOLDER = "file:///tmp/checkpoints"


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.sparkContext.getCheckpointDir()
    if not named:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} see")
        named = LOCAL_FOLDER
    return named.rstrip("/")


def new_path(spark: SparkSession, kind: str) -> str:
    """A path of its own below the shared folder; removed when Spark ends."""
    path = f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Table:
    """A DataFrame written to the shared folder, and its path."""

    def __init__(self, df: DataFrame, kind: str) -> None:
        self.spark = df.sparkSession
        self.path = new_path(self.spark, kind)
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(T.StructType([T.StructField(f.name, f.dataType) for f in df.schema])).parquet(self.path)

    def drop(self) -> None:
        remove(self.spark, self.path)


def kept(df: DataFrame, kind: str) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, then read."""
    return Table(df, kind).df


def spread(table: DataFrame) -> DataFrame:
    """A table that is read in fewer partitions than the cluster has cores, dealt to all of them.

    For tables of one or two files before work in Python; larger ones are
    returned as they are. Only for plain reads, whose partitions are known
    without running anything.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table if table.rdd.getNumPartitions() >= cores else table.repartition(cores)


def row_mark(df: DataFrame) -> Column:
    """A 64-bit hash of a whole row: the same in every evaluation, so narrow decisions find their row again.

    Rows of one mark are repeated rows. Maps, which have no hash, count as their JSON.
    """
    from pyspark.sql.types import MapType

    def part(field: T.StructField) -> Column:
        column = F.col(f"`{field.name}`")
        return F.to_json(F.struct(column)) if isinstance(field.dataType, MapType) else column

    # a null hashes as nothing, so its place is hashed too
    return F.xxhash64(*[x for f in df.schema for x in (part(f), F.col(f"`{f.name}`").isNull())])


def free_name(columns: list[str], wish: str) -> str:
    """``wish``, lengthened until no column has that name."""
    taken = {c.lower() for c in columns}
    while wish.lower() in taken:
        wish += "_"
    return wish


def salted_rank(df: DataFrame, key: str, tie: list[str], rows_per_salt: int = 2_000, name: str = "rank") -> DataFrame:
    """``df`` with ``name``: 0, 1, 2, ... within each value of ``key``.

    A key may hold most rows, so no task sorts a whole key: rows are dealt by
    (key, salt), numbered there, and shifted by the rows that smaller salts of
    the key hold. The salt hashes ``tie``, so that a task run again gives the
    same numbers. ``df`` is read twice; pass a table.
    """
    from pyspark.sql import Window

    salt, place, shift = (free_name(df.columns, n) for n in ("_salt", "_own", "_shift"))
    salts = max(1, -(-df.count() // rows_per_salt))
    dealt = df.withColumn(salt, F.pmod(F.xxhash64(*tie), F.lit(salts)))
    sizes = dealt.groupBy(key, salt).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(key).orderBy(salt).rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(key, salt, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias(shift))
    own = Window.partitionBy(key, salt).orderBy(*tie)
    return dealt.withColumn(place, F.row_number().over(own) - 1).join(shifts, [key, salt]).withColumn(name, F.col(place) + F.col(shift)).drop(place, shift, salt)


def sampled_ids(rows: DataFrame, id_col: str, class_col: str, wanted: dict) -> DataFrame:
    """Rows (id, class, mark): of each class in ``wanted`` up to so many distinct ids, those with the least hash.

    Only the two columns are read. The counts of the classes give each a hash
    limit that lets about four times the wanted ids through; they are ranked
    then, so no task sorts a whole class.
    """
    from pyspark.sql import Window

    good = rows.select(F.col(id_col).alias("id"), F.col(class_col).alias("class")).filter(F.col("id").isNotNull() & F.col("class").isin(*wanted))
    counts = {r["class"]: r["count"] for r in good.groupBy("class").count().collect()}  # a row per class
    limit = F.lit(0)
    for value, n in wanted.items():
        share = min(1.0, (4 * n + 100) / max(1, counts.get(value, 0)))
        limit = F.when(F.col("class") == value, F.lit(int(share * (1 << 40)))).otherwise(limit)
    marked = good.withColumn("mark", F.pmod(F.xxhash64("id"), F.lit(1 << 40))).filter(F.col("mark") < limit).distinct()
    rank = F.row_number().over(Window.partitionBy("class").orderBy("mark", "id"))
    most = F.lit(0)
    for value, n in wanted.items():
        most = F.when(F.col("class") == value, F.lit(n)).otherwise(most)
    return marked.withColumn("rank", rank).filter(F.col("rank") <= most).select("id", "class", "mark")
