"""Spend: estimates, the cap, billing, and streaks of errors."""

from __future__ import annotations

import threading
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwell import schema as S
from siftwell.functions import money, rules


#: Rows of a log that are counted together.
BLOCK = 100_000


def estimate(candidates: DataFrame) -> DataFrame:
    """One row: files, expected and worst tokens and cost of judging all candidates."""
    expected, worst = money.call_tokens(F.col("excerpt")), money.worst_call_tokens(F.col("excerpt"))
    sums = candidates.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum(expected), F.lit(0)).alias("tokens"), F.coalesce(F.sum(worst), F.lit(0)).alias("worst_tokens"))
    return sums.withColumn("cost", money.cost(F.col("tokens").cast("double"))).withColumn("worst_cost", money.cost(F.col("worst_tokens").cast("double")))


def spend(latest: DataFrame) -> DataFrame:
    return latest.agg(money.cost(F.coalesce(F.sum("input_tokens"), F.lit(0)).cast("double")).alias("spend"))


def batch_costs(candidates: DataFrame, size: int) -> DataFrame:
    """Rows (batch, files, worst_tokens): candidates in order of ``pos`` (0, 1, ...), ``size`` a batch."""
    return candidates.groupBy(F.floor(F.col("pos") / size).alias("batch")).agg(F.count(F.lit(1)).alias("files"), F.sum(money.worst_call_tokens(F.col("excerpt"))).alias("worst_tokens"))


def cut_at_cap(batches: DataFrame, cap: float = S.DEFAULT_CAP) -> DataFrame:
    """``batches`` (batch, tokens, worst_tokens) before the first that might pass the cap.

    A batch goes if what was spent before and its worst case stay at or under
    the cap; the first that doesn't ends the run, even if a later one would
    fit. The window runs over batches, not rows.
    """
    order = Window.orderBy("batch")
    before = F.coalesce(F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    over = money.cost((before + F.col("worst_tokens")).cast("double")) > cap
    marked = batches.withColumn("spent_before", money.cost(before.cast("double"))).withColumn("_over", over.cast("int"))
    return marked.withColumn("_stop", F.sum("_over").over(order)).filter("_stop = 0").drop("_over", "_stop")


def error_streaks(log: DataFrame, key: str | None = None) -> DataFrame:
    """Rows (start_seq, end_seq, length) of each run of systemic errors in log order.

    Any other row, a success or an error of one file, ends a run. With ``key``
    runs are counted within each of its values. The log has ``http_status``.
    """
    keys = [key] if key else []
    marked = log.withColumn("_bad", rules.systemic(F.col("http_status")))
    good = F.when(F.col("_bad"), 0).otherwise(1)
    if key:
        runs = marked.withColumn("_run", F.sum(good).over(Window.partitionBy(key).orderBy("seq")))
    else:  # counted by blocks of the log, so that no task sorts it all
        marked = marked.withColumn("_block", F.floor(F.col("seq") / BLOCK))
        before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # a row per block
        shifts = marked.groupBy("_block").agg(F.sum(good).alias("_n")).select("_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
        runs = marked.withColumn("_own", F.sum(good).over(Window.partitionBy("_block").orderBy("seq"))).join(shifts, "_block").withColumn("_run", F.col("_own") + F.col("_shift"))
    runs = runs.filter("_bad")
    return runs.groupBy(*keys, "_run").agg(F.min("seq").alias("start_seq"), F.max("seq").alias("end_seq"), F.count(F.lit(1)).alias("length")).drop("_run")


@dataclass
class Budget:
    """Live spend against a cap."""

    cap: float = S.DEFAULT_CAP
    tokens: int = 0

    @property
    def spent(self) -> float:
        return self.tokens * S.PRICE_PER_MILLION / 1e6

    def record(self, tokens: int) -> None:
        self.tokens += tokens

    def would_exceed(self, worst_tokens: int) -> bool:
        return (self.tokens + worst_tokens) * S.PRICE_PER_MILLION / 1e6 > self.cap


@dataclass
class Breaker:
    """Opens after ``limit`` systemic errors in a row; any other outcome starts anew."""

    limit: int = S.BREAKER_LIMIT
    streak: int = 0

    def record(self, http_status: int | None) -> bool:
        self.streak = self.streak + 1 if http_status in S.BREAKER_STATUSES else 0
        return self.streak >= self.limit


@dataclass
class Pacer:
    """Starts at most ``per_minute`` calls a minute; a share of the whole rate for each partition."""

    per_minute: float | None
    clock: object = field(default=time)
    following: float = 0.0
    lock: threading.Lock = field(default_factory=threading.Lock)

    def wait(self) -> None:
        if not self.per_minute:
            return
        with self.lock:
            now = self.clock.monotonic()
            start = max(now, self.following)
            self.following = start + 60.0 / self.per_minute
        if start > now:
            self.clock.sleep(start - now)
