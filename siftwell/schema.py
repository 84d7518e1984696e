"""Declared schemas of all tables, and the engine's constants."""

from __future__ import annotations

from pyspark.sql import types as T

# Names, thresholds and limits that outside tables and reports rely on.
CATEGORIES = ("credentials", "personal", "financial_legal", "original_work", "irreplaceable")
FILE_CATEGORIES = ("text", "code", "doc", "image", "archive", "av", "generated", "binary")
EXTRACTION_STATUSES = ("ok", "no_text", "timeout", "unsupported", "error", "ocr")
OCR_STATUSES = ("ok", "no_text", "timeout", "error", "unavailable")
VERIFIED_LABELS = ("content", "ocr", "name-only", "unknown")
PRICE_PER_MILLION, CALL_TOKENS, CHARS_PER_TOKEN, WORST_FACTOR = 0.042, 850, 4, 2.0
DEFAULT_CAP, DEFAULT_CONCURRENCY = 5.0, 8
EXCERPT_CHARS, READ_BYTES, SNIFF_BYTES, KEY_BYTES = 3000, 16 << 10, 4 << 10, 256 << 10
MIN_SIZE, HASH_CEILING, SNIFF_CEILING, MEMBER_CEILING = 32, 50 << 20, 1 << 20, 64 << 20
EXTRACT_SECONDS, EXTRACT_THREADS, NUL_RATIO = 20, 4, 0.01
RUBRIC_VERSION = 2
REPORT_TOP, CATEGORY_TOP, REPORT_MIN_PROB, MIN_VALUE, MAX_PER_DIR = 25, 20, 0.6, 2.0, 3
MANIFEST_MIN_PROB, CREDENTIAL_WARNING, ROLLUP_TOP, PAGE_TOP_DIRS = 0.7, 0.6, 30, 15
PAGE_ROWS, SCRIPT_ROWS = 100, 20_000
LISTING_FLOOR, SKIP_BELOW, LISTING_NAMES, LISTING_DIRS, LISTING_EXTS = 10, 0.05, 40, 30, 15
OCR_IMAGE_SECONDS, OCR_PDF_SECONDS, OCR_PAGES, OCR_DPI, OCR_WORKERS, OCR_TOP = 30, 60, 3, 150, 4, 200
BREAKER_STATUSES, BREAKER_LIMIT = (401, 402, 403), 5
RETRIES, RETRY_FIRST_SECONDS, RETRY_MOST_SECONDS = 6, 1.0, 20.0
SAMPLE_SEED = 20260920


_KINDS = {"string": T.StringType(), "bigint": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "boolean": T.BooleanType()}


def _struct(text: str) -> T.StructType:
    """A struct of plain fields; made without a session, since executors import this module too."""
    pairs = (field.split() for field in text.split(","))
    return T.StructType([T.StructField(name, PROBABILITY_STRUCT if kind == "probabilities" else _KINDS[kind]) for name, kind in pairs])


PROBABILITY_STRUCT = T.StructType([*(T.StructField(c, T.DoubleType()) for c in CATEGORIES), T.StructField("value", T.MapType(T.StringType(), T.DoubleType()))])
PROBABILITIES = PROBABILITY_STRUCT.simpleString()
INVENTORY = _struct("path string, size bigint, mtime double, ext string, category string, dedupe_key string, dup_of string, seq bigint, root string")
RESULTS = _struct(
    "dedupe_key string, path string, size bigint, category string, probabilities probabilities, value_score double, value_confidence double, "
    "input_tokens bigint, metadata_only boolean, extraction_status string, rubric_version int, error string, seq bigint"
)
DECISIONS = _struct("path string, file_count bigint, worth_scanning double, kind string, input_tokens bigint, error string, seq bigint")
OCR_LOG = _struct("dedupe_key string, path string, ocr_status string, excerpt_chars int, excerpt string, seq bigint")
CANDIDATE = "path string, size bigint, mtime double, ext string, category string, dedupe_key string, seq bigint, excerpt string, metadata_only boolean, extraction_status string"
ANSWER = f"probabilities {PROBABILITIES}, value_score double, value_confidence double, input_tokens bigint, error string"
