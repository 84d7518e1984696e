"""The test tables in the shapes of the triage: inventory, logs, judged rows.

Numbers are made of ids by whole-number arithmetic, so that any engine gives
the same doubles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell import schema as S
from siftwell.functions import paths, rules
from siftwell.operators import dedupe

EXTS = ("txt", "md", "py", "pdf", "png", "meta")
KINDS = ("text", "image", "generated", "doc", "binary")
STATUSES = ("ok", "no_text", "ocr", "unsupported")
PRIMES = dict(zip(S.CATEGORIES, (31, 37, 41, 43, 47), strict=True))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _pick(values: tuple[str, ...], number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (number % len(values) + 1).cast("int"))


def _hundredth(number: Column, modulus: int) -> Column:
    return (number % modulus).cast("double") / F.lit(100.0)


def _probabilities(number: Column) -> Column:
    parts = [_hundredth(number * p, 101).alias(c) for c, p in PRIMES.items()]
    return F.struct(*parts, F.lit(None).cast("map<string,double>").alias("value"))


def files(spark: SparkSession, folder: str) -> DataFrame:
    """``documents`` as listed files."""
    docs = table(spark, folder, "documents")
    name = F.concat(F.lit("d"), F.col("doc_id"), F.lit("."), _pick(EXTS, F.col("doc_id")))
    rows = docs.select(
        F.col("doc_id").alias("seq"), F.concat(F.lit("/"), "source", F.lit("/"), "lang", F.lit("/"), name).alias("path"), name.alias("name"),
        F.octet_length("text").cast("long").alias("size"), F.col("doc_id").cast("double").alias("mtime"), F.lit("/").alias("root"), "text",
    )
    return rows.withColumn("ext", paths.extension(F.col("name"))).withColumn("category", rules.categorize(F.col("ext")))


def inventory(spark: SparkSession, folder: str) -> DataFrame:
    rows = files(spark, folder)
    key = F.when(rules.is_hashed(F.col("category"), F.col("size")), dedupe.text_key(F.col("text"), F.col("size"))).otherwise(dedupe.metadata_key(F.col("size"), F.col("name")))
    return dedupe.mark_duplicates(rows.withColumn("dedupe_key", key))


def log(spark: SparkSession, folder: str) -> DataFrame:
    """``events`` as a results log: users are keys, events their judgments in order."""
    n, key = F.col("event_id"), F.col("user_id")
    k = F.get_json_object("props", "$.k").cast("long")
    failed = F.col("event_type") == "error"
    status = F.when(F.col("event_type") == "view", "ok").when(F.col("event_type") == "click", "no_text").when(F.col("event_type") == "purchase", "ocr")
    return table(spark, folder, "events").select(
        F.concat(F.lit("k"), key).alias("dedupe_key"),
        F.concat(F.lit("/u"), key % 7, F.lit("/d"), key % 13, F.lit("/f"), key, F.lit("."), _pick(EXTS, key)).alias("path"),
        (n * 17 % 5000 + 32).alias("size"), _pick(KINDS, key).alias("category"), _probabilities(n).alias("probabilities"),
        F.when(~failed, _hundredth(n * 73, 301)).alias("value_score"), F.lit(0.5).alias("value_confidence"),
        F.when(~failed, n % 500 + S.CALL_TOKENS).alias("input_tokens"), (F.coalesce(status, F.lit("")) != "ok").alias("metadata_only"),
        status.alias("extraction_status"), F.when(k % 3 != 0, k % 2 + 1).cast("int").alias("rubric_version"), F.when(failed, "boom").alias("error"),
        n.alias("seq"), F.when(failed, F.element_at(F.array(*map(F.lit, (401, 500, 402, 403))), (n % 4 + 1).cast("int"))).alias("http_status"),
    )


def judged(spark: SparkSession, folder: str) -> DataFrame:
    """``documents`` as latest results, one per file."""
    n = F.col("seq")
    failed = n % 17 == 0
    return files(spark, folder).select(
        F.concat(F.lit("d"), n).alias("dedupe_key"), "path", "size", "category", _probabilities(n).alias("probabilities"),
        F.when(~failed, _hundredth(n * 73, 301)).alias("value_score"), F.lit(0.5).alias("value_confidence"), (n % 500 + S.CALL_TOKENS).alias("input_tokens"),
        (n % 5 != 0).alias("metadata_only"), F.when(n % 7 != 0, _pick(STATUSES, n)).alias("extraction_status"),
        F.when(n % 3 != 0, n % 2 + 1).cast("int").alias("rubric_version"), F.when(failed, "bad").alias("error"), n.alias("seq"), n.alias("first_seq"), "ext",
    )


def keyed_log(spark: SparkSession, folder: str) -> DataFrame:
    """A results log over the keys of ``inventory``: ``judged``, of which duplicates share their key."""
    keys = inventory(spark, folder).select("seq", F.col("dedupe_key").alias("_key"))
    return judged(spark, folder).drop("first_seq").join(keys, "seq").withColumn("dedupe_key", F.col("_key")).drop("_key")


def stored(spark: SparkSession, folder: str) -> str:
    """``documents`` written as files below a new folder of the shared one; returns it."""
    import os
    import uuid
    from collections.abc import Iterator

    import pyarrow as pa

    shared = spark.conf.get("spark.checkpoint.dir", None) or "file:///tmp/checkpoints"
    base = f"/{shared.removeprefix('file:').strip('/')}/stored-{uuid.uuid4().hex}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                os.makedirs(os.path.dirname(base + path), exist_ok=True)
                with open(base + path, "wb") as file:
                    file.write(text.encode())
            yield batch.slice(0, 0).select(["path"])

    files(spark, folder).filter("text is not null").select("path", "text").mapInArrow(write, "path string").count()
    at = spark._jvm.org.apache.hadoop.fs.Path(f"file://{base}")
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return base


def decisions(spark: SparkSession, folder: str) -> DataFrame:
    """A prefilter log over the directories of ``files``, three asked rounds of which some fail."""
    dirs = files(spark, folder).groupBy(paths.parent(F.col("path")).alias("path")).agg(F.count(F.lit(1)).alias("file_count"), F.min("seq").alias("n"))
    rows = dirs.withColumn("turn", F.explode(F.array(*map(F.lit, range(3)))))
    failed = (F.col("n") + F.col("turn")) % 3 == 0
    return rows.select(
        "path", "file_count", F.when(~failed, _hundredth(F.col("n") * 29 + F.col("turn") * 53, 30)).alias("worth_scanning"),
        F.when(~failed, "owner_code").alias("kind"), F.lit(100).cast("long").alias("input_tokens"), F.when(failed, "late").alias("error"), (F.col("n") * 3 + F.col("turn")).alias("seq"),
    )


def ocr_log(spark: SparkSession, folder: str) -> DataFrame:
    """``events`` as a recognition log: a click fails, a view finds text, a signup finds none."""
    n = F.col("event_id")
    status = F.when(F.col("event_type") == "view", "ok").when(F.col("event_type") == "click", "error").when(F.col("event_type") == "signup", "no_text")
    text = F.when(F.col("event_type") == "view", F.when(n % 5 == 0, "").otherwise(F.concat(F.lit("text "), n)))
    rows = table(spark, folder, "events").select(F.concat(F.lit("k"), "user_id").alias("dedupe_key"), F.concat(F.lit("/f"), "user_id").alias("path"), status.alias("ocr_status"), text.alias("excerpt"), n.alias("seq"))
    return rows.filter("ocr_status is not null").withColumn("excerpt_chars", F.length(F.coalesce("excerpt", F.lit(""))))
