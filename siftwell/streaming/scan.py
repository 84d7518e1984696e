"""The scan as a loop of waves, and as a stream.

A paid judge's spend is known only after its answers, so candidates go in waves
that are started one by one from the driver. A wave is as many batches, in
order, as fit the cap if every one came to its worst case; the first has one
batch, and each one after a wave without systemic errors has twice as many, up
to ``WAVE_ROWS`` rows. Answers are written once, then appended to the log: no
call is repeated because an executor that held its answer is lost, and a run
that is stopped anywhere goes on by its log.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siftwell import schema as S
from siftwell.functions import money
from siftwell.operators import budget, extract, folds, scoring, selection
from siftwell.sources import logs

WAVE_ROWS = 4096
#: Rows of one range while candidates are numbered.
SALT_ROWS = 10_000


class Stopped(RuntimeError):
    """Why a stream ended before it had judged its rows; they are read again by the next run."""


@dataclass
class Outcome:
    """What a run did, and why it stopped (empty: it came to its end)."""

    judged: int = 0
    errors: int = 0
    tokens: int = 0
    stopped: str = ""

    @property
    def spent(self) -> float:
        return self.tokens * S.PRICE_PER_MILLION / 1e6


def _batched(candidates: DataFrame, size: int) -> DataFrame:
    """``candidates`` with ``batch``: 0, 1, ... in order of seq, ``size`` rows each."""
    salted = candidates.withColumn("_salt", F.floor(F.col("seq") / SALT_ROWS))
    before = Window.orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)  # a row per range of candidates
    shifts = salted.groupBy("_salt").agg(F.count(F.lit(1)).alias("_n")).withColumn("_shift", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    placed = salted.withColumn("_own", F.row_number().over(Window.partitionBy("_salt").orderBy("seq")) - 1).join(shifts, "_salt")
    return placed.withColumn("batch", F.floor((F.col("_own") + F.col("_shift")) / size)).drop("_salt", "_own", "_n", "_shift")


def _settle(spark: SparkSession, staged: str, log_path: str, number: int) -> None:
    """Append what a run before wrote but did not log."""
    if not logs.exists(spark, staged):
        return
    if logs.exists(spark, f"{staged}/_SUCCESS"):
        rows = spark.read.parquet(staged)
        if logs.exists(spark, log_path):
            rows = rows.join(logs.results(spark, log_path, strict=False).select("seq"), "seq", "left_anti")
        logs.append(logs.numbered(rows.withColumn("seq", F.col("seq") % (1 << logs.PLACES)), number, "dedupe_key").drop("http_status"), log_path)
    logs.remove(spark, staged)


def run(
    candidates: DataFrame, judge: scoring.Judge, log_path: str, work_path: str, cap: float = S.DEFAULT_CAP, batch_size: int = S.DEFAULT_CONCURRENCY,
    per_minute: float | None = None, concurrency: int | None = None, live: budget.Budget | None = None, ask_canary: bool = True,
) -> Outcome:
    """Judge ``candidates`` (with excerpts) and append the results to ``log_path``.

    ``concurrency`` calls are in flight at once, a batch's rows unless given.
    ``live`` is a budget that was spent from before; without it ``cap`` is for
    this run alone.
    """
    spark, outcome = candidates.sparkSession, Outcome()
    live = budget.Budget(cap) if live is None else live
    concurrency = concurrency or batch_size
    if ask_canary:
        failed = scoring.canary(judge)
        if failed is not None:
            return Outcome(stopped=f"canary: {failed}")
        live.record(S.CALL_TOKENS)
    number, staged = logs.next_append(spark, log_path), f"{work_path}/answers"
    _settle(spark, staged, log_path, number)
    placed = _batched(candidates, batch_size)
    placed.repartitionByRange("batch").sortWithinPartitions("batch").write.mode("overwrite").parquet(f"{work_path}/candidates")
    kept = spark.read.schema(placed.schema).parquet(f"{work_path}/candidates")  # named: there may be no rows
    breaker, wave, most = budget.Breaker(), 1, max(1, WAVE_ROWS // batch_size)
    rows = kept.groupBy("batch").agg(F.sum(money.worst_call_tokens(F.col("excerpt"))).alias("worst")).orderBy("batch").toLocalIterator()
    following = next(rows, None)
    while following is not None and not outcome.stopped:
        first, last, worst = following["batch"], None, 0
        while following is not None and following["batch"] < first + wave and not live.would_exceed(worst + following["worst"]):
            last, worst = following["batch"], worst + following["worst"]
            following = next(rows, None)
        if last is None:
            outcome.stopped = "cap"
            break
        tasks = -(-concurrency // scoring.MOST_THREADS)
        part = kept.filter(F.col("batch").between(first, last)).repartition(tasks)
        number += 1
        answers = scoring.judge_files(part, judge, per_minute and per_minute / tasks, -(-concurrency // tasks))
        logs.numbered(answers, number, "dedupe_key").write.mode("overwrite").parquet(staged)
        results = spark.read.parquet(staged)
        logs.append(results.drop("http_status"), log_path)
        done = results.select("seq", "error", "http_status", "input_tokens").orderBy("seq").collect()  # one wave
        logs.remove(spark, staged)
        outcome.judged += len(done)
        outcome.errors += sum(r["error"] is not None for r in done)
        live.record(sum(r["input_tokens"] or 0 for r in done))
        if any([breaker.record(r["http_status"]) for r in done]):
            outcome.stopped = "systemic errors"
        wave = min(most, 2 * wave) if not breaker.streak else 1
    outcome.tokens = live.tokens
    return outcome


def start_stream(spark: SparkSession, inventory_path: str, judge: scoring.Judge, log_path: str, checkpoint_path: str, cap: float = S.DEFAULT_CAP) -> StreamingQuery:
    """Judge inventory files as they arrive; ends when all that is there has been read.

    Each micro-batch drops what the log has resolved, so a batch that is run
    again after a failure judges nothing twice that was written. When the cap,
    the canary or systemic errors stop the judging the query fails with
    ``Stopped``: the micro-batch is not committed, and the next run takes it up
    where the log ends.
    """
    live, asked = budget.Budget(cap), []

    def judge_batch(rows: DataFrame, _: int) -> None:
        session = rows.sparkSession
        known = folds.resolved_keys(logs.results(session, log_path, strict=False)) if logs.exists(session, log_path) else None
        found = extract.with_excerpts(selection.eligible(rows, known))
        outcome = run(found, judge, log_path, f"{checkpoint_path}-work", cap, live=live, ask_canary=not asked)
        if outcome.stopped:
            raise Stopped(outcome.stopped)
        asked.append(True)

    stream = spark.readStream.schema(S.INVENTORY).json(inventory_path)
    return stream.writeStream.foreachBatch(judge_batch).option("checkpointLocation", checkpoint_path).trigger(availableNow=True).start()
