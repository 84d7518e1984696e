"""Judges of files and directories.

A judge is any object with ``files`` and ``directories``, each from a list of
state dictionaries to a list of answers; it runs on executors, one call a
batch. ``LocalJudge`` answers by word rules, always the same for the same
state; a remote model plugs in by the same two methods.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell import schema as S
from siftwell.functions import money, paths
from siftwell.operators import budget


#: Most calls that one task has in flight; more are dealt to several tasks.
MOST_THREADS = 16
#: Rows whose states and answers a worker holds at once as Python objects; Spark sends it 10,000.
BLOCK_ROWS = 512

_ANSWER = {
    "probabilities": pa.struct([*((c, pa.float64()) for c in S.CATEGORIES), ("value", pa.map_(pa.string(), pa.float64()))]),
    "value_score": pa.float64(), "value_confidence": pa.float64(), "input_tokens": pa.int64(), "error": pa.string(), "http_status": pa.int32(),
}
_DECISION = {"path": pa.string(), "file_count": pa.int64(), "worth_scanning": pa.float64(), "kind": pa.string(), "input_tokens": pa.int64(), "error": pa.string()}


class Judge(Protocol):
    def files(self, states: list[dict]) -> list[dict]: ...

    def directories(self, states: list[dict]) -> list[dict]: ...


class CallError(Exception):
    """A failed call and its HTTP status, if it had one."""

    def __init__(self, message: str, http_status: int | None = None) -> None:
        super().__init__(message)
        self.http_status = http_status


_SIGNS = {
    "credentials": re.compile(r"passw|secret|api[_-]?key|private key|token|credential|id_rsa|\.pem|\.kdbx"),
    "personal": re.compile(r"diary|journal|family|letter|birth|address|phone|photo|cv\b|resume"),
    "financial_legal": re.compile(r"invoice|tax|bank|contract|iban|salary|insurance|agreement|licen[cs]e"),
    "original_work": re.compile(r"draft|chapter|thesis|\bdef |\bclass |function|novel|song"),
    "irreplaceable": re.compile(r"original|backup|archive|scan|wedding|memoir"),
}
_WORTH = re.compile(r"documents|desktop|pictures|projects?|src|notes|home")
_NOISE = re.compile(r"cache|vendor|dist|build|logs?|assets|locale")


class LocalJudge:
    """Word rules over the path and the excerpt."""

    def files(self, states: list[dict]) -> list[dict]:
        answers = []
        for state in states:
            text = f"{state['path']} {state.get('excerpt') or ''}".lower()
            p = {c: min(0.95, 0.1 + 0.25 * len(sign.findall(text))) for c, sign in _SIGNS.items()}
            value = round(3 * max(p["irreplaceable"], p["personal"], p["financial_legal"], p["original_work"] / 2), 2)
            confidence = 0.4 if state.get("metadata_only") else 0.8
            answers.append({"probabilities": p | {"value": {str(min(3, int(value))): confidence}}, "value_score": value, "value_confidence": confidence, "input_tokens": None, "error": None})
        return answers

    def directories(self, states: list[dict]) -> list[dict]:
        answers = []
        for state in states:
            path = state["path"].lower()
            good, bad = len(_WORTH.findall(path)), len(_NOISE.findall(path))
            worth = min(0.99, max(0.01, 0.5 + 0.3 * good - 0.48 * bad))
            answers.append({"worth_scanning": worth, "kind": "user_content" if good > bad else "app_state" if bad else "owner_code", "input_tokens": None, "error": None})
        return answers


def file_state(note: str = "The content could not be read; judge by name and place.") -> Column:
    """JSON that a judge is asked with."""
    only = F.coalesce(F.col("metadata_only"), F.lit(False))
    return F.to_json(F.struct("path", paths.name(F.col("path")).alias("name"), "ext", "size", F.col("mtime").alias("modified"), F.when(only, note).otherwise(F.col("excerpt")).alias("excerpt"), only.alias("metadata_only"), (~only).alias("content_readable")))


def with_retries(call: Callable[[], list[dict]], sleep: Callable[[float], None] = time.sleep) -> list[dict]:
    """Retry calls that fail for a while; systemic failures are raised at once."""
    wait = S.RETRY_FIRST_SECONDS
    for attempt in range(S.RETRIES + 1):
        try:
            return call()
        except CallError as error:
            if error.http_status in S.BREAKER_STATUSES or attempt == S.RETRIES:
                raise
            sleep(wait)
            wait = min(2 * wait, S.RETRY_MOST_SECONDS)
    raise AssertionError("unreachable")


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches``, ``BLOCK_ROWS`` at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK_ROWS):
            yield batch.slice(at, BLOCK_ROWS)


def _columns(rows: list[dict], kinds: dict[str, pa.DataType]) -> list[pa.Array]:
    """Columns of ``rows``; what is missing or NaN is null."""
    return [pa.array([x.get(c) for x in rows], kind, from_pandas=True) for c, kind in kinds.items()]


def judge_files(candidates: DataFrame, judge: Judge, per_minute: float | None = None, threads: int = 1) -> DataFrame:
    """Result rows of ``candidates``: one per row; a failed call is a row with an error.

    Tokens are billed as ``money.billed_tokens`` says. Each partition has
    ``threads`` calls in flight, and the rate is for each: give it the whole
    rate divided by their number. Once a partition sees ``S.BREAKER_LIMIT``
    systemic errors in a row it asks no more; rows not asked give no row.
    """
    states = candidates.withColumn("_state", file_state()).withColumn("_estimate", money.call_tokens(F.col("excerpt")))
    kept = ["dedupe_key", "path", "size", "category", "metadata_only", "extraction_status", "seq", "_estimate"]
    kinds = {f.name: f.dataType.simpleString() for f in states.schema}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in kept) + f", {S.ANSWER}, http_status int"

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import json

        pacer, breaker = budget.Pacer(per_minute), budget.Breaker()

        def ask(text: str) -> dict | None:
            if breaker.streak >= breaker.limit:
                return None
            pacer.wait()
            try:
                found = with_retries(lambda: judge.files([json.loads(text)]))[0] | {"http_status": None}
            except CallError as error:
                found = {"error": str(error) or type(error).__name__, "http_status": error.http_status}
            breaker.record(found["http_status"])
            return found

        def judged(part: pa.RecordBatch, pool: ThreadPoolExecutor) -> pa.RecordBatch:
            texts = part.column("_state").to_pylist()
            out = list(pool.map(ask, texts) if threads > 1 else map(ask, texts))
            rows = part.select(kept).filter(pa.array([x is not None for x in out], pa.bool_()))
            return pa.RecordBatch.from_arrays([*rows.columns, *_columns([x for x in out if x is not None], _ANSWER)], [*kept, *_ANSWER])

        with ThreadPoolExecutor(threads) as pool:
            for part in blocks(batches):
                yield judged(part, pool)

    judged = states.select(*kept, "_state").mapInArrow(answer, schema)
    billed = money.billed_tokens(F.col("error"), F.col("input_tokens"), F.col("_estimate"))
    return judged.withColumn("input_tokens", billed).withColumn("rubric_version", F.when(F.col("error").isNull(), S.RUBRIC_VERSION)).drop("_estimate")


def judge_directories(states: DataFrame, judge: Judge) -> DataFrame:
    """Decision rows of (path, state, file_count); a failed call is a row with an error, which skips nothing."""

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import json

        for part in blocks(batches):
            rows = []
            for path, text, count in zip(*(part.column(c).to_pylist() for c in ("path", "state", "file_count")), strict=True):
                try:
                    found = with_retries(lambda text=text: judge.directories([json.loads(text)]))[0]
                except CallError as error:
                    found = {"error": str(error) or type(error).__name__}
                tokens = None if found.get("error") else found.get("input_tokens") or S.CALL_TOKENS + len(text) // S.CHARS_PER_TOKEN
                rows.append({"path": path, "file_count": count, "worth_scanning": found.get("worth_scanning"), "kind": found.get("kind"), "input_tokens": tokens, "error": found.get("error")})
            yield pa.RecordBatch.from_arrays(_columns(rows, _DECISION), list(_DECISION))

    return states.select("path", "state", "file_count").mapInArrow(answer, "path string, file_count bigint, worth_scanning double, kind string, input_tokens bigint, error string")


def canary(judge: Judge) -> CallError | None:
    """One call before a run: a systemic failure is returned, any other is no reason to stop."""
    try:
        judge.files([{"path": "/canary.txt", "name": "canary.txt", "excerpt": "hello", "metadata_only": False}])
    except CallError as error:
        return error if error.http_status in S.BREAKER_STATUSES else None
    return None
