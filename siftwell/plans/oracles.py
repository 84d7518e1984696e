"""SQL for DuckDB: the test tables in the shapes of ``sources.adapters``, and the queries over them."""

from __future__ import annotations

from siftwell import schema as S
from siftwell.functions import rules
from siftwell.sources.adapters import EXTS, KINDS, PRIMES, STATUSES


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _pick(values, number: str) -> str:
    return f"({_list(values)})[({number}) % {len(values)} + 1]"


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


_P = ", ".join(f"((N * {p}) % 101)::DOUBLE / 100.0::DOUBLE AS {c}" for c, p in PRIMES.items())
_CATEGORY = "CASE " + " ".join(f"WHEN ext IN {_in(names.split())} THEN '{c}'" for c, names in rules.EXTENSIONS.items()) + " ELSE 'binary' END"

FILES = f"""
files AS (
    SELECT *, {_CATEGORY} AS category FROM (
        SELECT doc_id AS seq, '/' || source || '/' || lang || '/d' || doc_id || '.' || {_pick(EXTS, "doc_id")} AS path, '/' || source || '/' || lang AS dir,
               'd' || doc_id || '.' || {_pick(EXTS, "doc_id")} AS name, {_pick(EXTS, "doc_id")} AS ext, strlen(text)::BIGINT AS size, text, source, lang
        FROM documents)
)"""
INVENTORY = (
    FILES
    + f""", keyed AS (
    SELECT *, CASE WHEN category IN {_in(rules.HASHED_CATEGORIES)} AND size <= {S.HASH_CEILING} THEN md5(text || size::VARCHAR)
                   ELSE 'meta:' || size || ':' || lower(name) END AS dedupe_key FROM files
), inventory AS (
    SELECT *, CASE WHEN row_number() OVER w > 1 THEN first_value(path) OVER w END AS dup_of FROM keyed WINDOW w AS (PARTITION BY dedupe_key ORDER BY seq)
)"""
)
LOG = f"""
log AS (
    SELECT 'k' || user_id AS dedupe_key, '/u' || (user_id % 7) || '/d' || (user_id % 13) || '/f' || user_id || '.' || {_pick(EXTS, "user_id")} AS path,
           '/u' || (user_id % 7) || '/d' || (user_id % 13) AS dir, {_pick(EXTS, "user_id")} AS ext,
           event_id * 17 % 5000 + 32 AS size, {_pick(KINDS, "user_id")} AS category, {_P.replace("N", "event_id")},
           CASE WHEN event_type <> 'error' THEN ((event_id * 73) % 301)::DOUBLE / 100.0::DOUBLE END AS value_score,
           CASE WHEN event_type <> 'error' THEN event_id % 500 + {S.CALL_TOKENS} END AS input_tokens,
           CASE event_type WHEN 'view' THEN 'ok' WHEN 'click' THEN 'no_text' WHEN 'purchase' THEN 'ocr' END AS extraction_status,
           CASE WHEN k % 3 <> 0 THEN (k % 2 + 1)::INTEGER END AS rubric_version,
           CASE WHEN event_type = 'error' THEN 'boom' END AS error, event_id AS seq,
           CASE WHEN event_type = 'error' THEN ([401, 500, 402, 403])[event_id % 4 + 1] END AS http_status
    FROM (SELECT *, json_extract_string(props, '$.k')::BIGINT AS k FROM events)
)"""
LATEST = (
    LOG
    + """, latest AS (
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dedupe_key ORDER BY (error IS NULL)::INT DESC, seq DESC) AS place,
                          min(seq) OVER (PARTITION BY dedupe_key) AS first_seq FROM log) WHERE place = 1
)"""
)
JUDGED = (
    FILES
    + f""", latest AS (
    SELECT 'd' || seq AS dedupe_key, path, dir, size, category, {_P.replace("N", "seq")},
           CASE WHEN seq % 17 <> 0 THEN ((seq * 73) % 301)::DOUBLE / 100.0::DOUBLE END AS value_score, seq % 500 + {S.CALL_TOKENS} AS input_tokens,
           CASE WHEN seq % 7 <> 0 THEN {_pick(STATUSES, "seq")} END AS extraction_status,
           CASE WHEN seq % 3 <> 0 THEN (seq % 2 + 1)::INTEGER END AS rubric_version, CASE WHEN seq % 17 = 0 THEN 'bad' END AS error,
           seq, seq AS first_seq, ext, source, lang
    FROM files
)"""
)
DECISIONS = (
    FILES
    + """, decision_log AS (
    SELECT dir AS path, file_count, CASE WHEN (n + turn) % 3 <> 0 THEN ((n * 29 + turn * 53) % 30)::DOUBLE / 100.0::DOUBLE END AS worth_scanning,
           CASE WHEN (n + turn) % 3 = 0 THEN 'late' END AS error, n * 3 + turn AS seq
    FROM (SELECT dir, count(*) AS file_count, min(seq) AS n FROM files GROUP BY dir), (SELECT unnest([0, 1, 2]) AS turn)
), decisions AS (
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY seq DESC) AS place FROM decision_log WHERE error IS NULL) WHERE place = 1
)"""
)
OCR_LOG = """
ocr_log AS (
    SELECT 'k' || user_id AS dedupe_key, CASE event_type WHEN 'view' THEN 'ok' WHEN 'click' THEN 'error' WHEN 'signup' THEN 'no_text' END AS ocr_status,
           CASE WHEN event_type = 'view' THEN CASE WHEN event_id % 5 = 0 THEN '' ELSE 'text ' || event_id END END AS excerpt, event_id AS seq
    FROM events WHERE event_type IN ('view', 'click', 'signup')
), excerpts AS (
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dedupe_key ORDER BY seq DESC) AS place FROM ocr_log) WHERE place = 1 AND ocr_status = 'ok' AND excerpt <> ''
)"""

KEYED = (
    INVENTORY
    + f""", keyed_log AS (
    SELECT dedupe_key, category, ext, CASE WHEN seq % 7 <> 0 THEN {_pick(STATUSES, "seq")} END AS extraction_status,
           CASE WHEN seq % 3 <> 0 THEN (seq % 2 + 1)::INTEGER END AS rubric_version, CASE WHEN seq % 17 = 0 THEN 'bad' END AS error, seq
    FROM inventory
), keyed_latest AS (
    SELECT * FROM keyed_log QUALIFY row_number() OVER (PARTITION BY dedupe_key ORDER BY (error IS NULL)::INT DESC, seq DESC) = 1
)"""
)

LABEL = "CASE WHEN extraction_status IS NULL THEN 'unknown' WHEN extraction_status = 'ocr' THEN 'ocr' WHEN extraction_status = 'ok' THEN 'content' ELSE 'name-only' END"
VALID = "(error IS NULL AND value_score IS NOT NULL)"
VERIFIED = "coalesce(extraction_status IN ('ok', 'ocr'), false)"


def included(min_value: float = S.MIN_VALUE, min_prob: float = S.MANIFEST_MIN_PROB) -> str:
    return (
        f"(error IS NULL AND category <> 'generated' AND (credentials >= {min_prob} OR financial_legal >= {min_prob} OR personal >= {min_prob} "
        f"OR ({VERIFIED} AND (coalesce(value_score >= {min_value}, false) OR irreplaceable >= {min_prob}))))"
    )


def by_category(min_prob: float) -> str:
    """A FROM item: one row per valid latest row and category at or over ``min_prob``."""
    return "(" + " UNION ALL ".join(f"SELECT *, '{c}' AS category_name, {c} AS probability FROM latest WHERE {VALID} AND {c} >= {min_prob}" for c in S.CATEGORIES) + ")"


def spent(tokens: str) -> str:
    return f"({tokens})::DOUBLE * {S.PRICE_PER_MILLION}::DOUBLE / 1e6::DOUBLE"
