"""The commands: each reads and writes the tables of a run folder."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell import schema as S
from siftwell.functions import money
from siftwell.operators import annotate as annotation
from siftwell.operators import budget, extract, folds, listings, ocr, outputs, ranking, rollups, scoring, selection
from siftwell.sources import filesystem, logs
from siftwell.streaming import scan as scanning


@dataclass(frozen=True)
class Run:
    """A run folder's tables."""

    spark: SparkSession
    folder: str

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def inventory(self) -> DataFrame:
        return logs.inventory(self.spark, self.path("inventory"))

    def has(self, name: str) -> bool:
        return logs.exists(self.spark, self.path(name))

    def written(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` as a table of the run folder: made once, then read, whatever executors are lost."""
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def add(self, df: DataFrame, name: str, key: str) -> None:
        """Append ``df`` to one of the run's logs."""
        logs.append(logs.numbered(df, logs.next_append(self.spark, self.path(name)), key), self.path(name))

    def log(self) -> DataFrame:
        return logs.results(self.spark, self.path("results"), strict=False) if self.has("results") else self.spark.createDataFrame([], S.RESULTS)

    def latest(self) -> DataFrame:
        return folds.results_latest(self.log())

    def decisions(self) -> DataFrame:
        return folds.decisions_latest(logs.decisions(self.spark, self.path("prefilter")))

    def excerpts(self) -> DataFrame:
        log = logs.ocr(self.spark, self.path("ocr")) if self.has("ocr") else self.spark.createDataFrame([], S.OCR_LOG)
        return folds.ocr_excerpts(log)


def walk(run: Run, roots: list[str]) -> DataFrame:
    """List the roots, write inventory and errors, and return the counts by category."""
    inventory, errors = filesystem.inventory(run.spark, roots, run.written)
    logs.overwrite(inventory, run.path("inventory"))
    logs.write_errors(errors, run.path("walk-errors"))
    return rollups.category_counts(run.inventory())


def plan_scan(run: Run, only_name_only: bool = False, outdated_rubric: bool = False, from_ocr: bool = False, exclude_exts: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Inventory rows that a scan takes; the rescan modes narrow each other."""
    inventory = run.inventory()
    sets = []
    if only_name_only:
        sets.append(selection.name_only_keys(run.latest(), inventory))
    if outdated_rubric:
        sets.append(selection.outdated_keys(run.latest()))
    if from_ocr:
        sets.append(selection.fresh_ocr_keys(run.excerpts(), run.latest()))
    only = selection.all_of(*sets) if sets else None
    return selection.eligible(inventory, folds.resolved_keys(run.log()), only, exclude_exts, limit)


def extracted(run: Run, rows: DataFrame, skip_unreadable: bool = False) -> DataFrame:
    """Candidates with excerpts, recognised texts taking the place of extracted ones."""
    found = selection.with_excerpts(extract.with_excerpts(rows), run.excerpts())
    return found.filter(~F.col("metadata_only")) if skip_unreadable else found


def estimate(run: Run, **choice) -> DataFrame:
    return budget.estimate(extracted(run, plan_scan(run, **choice)))


def prefilter(run: Run, rows: DataFrame, judge: scoring.Judge, live: budget.Budget | None = None) -> DataFrame:
    """``rows`` outside directories that are not worth scanning; directories without an answer are asked first.

    What is asked is spent from ``live``. Over its cap nothing is asked and
    earlier answers alone count.
    """
    live = budget.Budget() if live is None else live
    asked = run.written(listings.listings(run.inventory(), rows), "prefilter-work/listings")
    states = listings.state(selection.undecided(asked, run.decisions())).join(asked.select("path", "file_count"), "path")
    size = states.agg(F.coalesce(F.sum(F.lit(S.CALL_TOKENS) + money.worst_tokens(F.length("state"))), F.lit(0))).first()[0]
    if size and not live.would_exceed(size):
        answers = run.written(scoring.judge_directories(states, judge), "prefilter-work/answers")
        run.add(answers, "prefilter", "path")
        live.record(answers.agg(F.coalesce(F.sum("input_tokens"), F.lit(0))).first()[0])
    return selection.apply_decisions(rows, asked, run.decisions())


def scan(run: Run, judge: scoring.Judge, cap: float = S.DEFAULT_CAP, batch_size: int = S.DEFAULT_CONCURRENCY, use_prefilter: bool = False, per_minute: float | None = None, **choice) -> scanning.Outcome:
    """Select, prefilter, extract, judge. Directories are judged before files are read; one budget serves both."""
    rows, live = plan_scan(run, **choice), budget.Budget(cap)
    if use_prefilter:
        rows = prefilter(run, rows, judge, live)
    targeted = choice.get("only_name_only") or choice.get("from_ocr")
    found = extracted(run, rows, skip_unreadable=bool(targeted) and not choice.get("outdated_rubric"))
    return scanning.run(found, judge, run.path("results"), run.path("work"), cap, batch_size, per_minute, live=live)


def annotate(run: Run, take_all: bool = False, top: int = S.REPORT_TOP, min_prob: float = S.REPORT_MIN_PROB) -> DataFrame:
    """Append missing extraction states; return the keys to scan anew."""
    targets = run.written(annotation.annotation_targets(run.latest(), run.inventory(), take_all, top, min_prob), "annotate-work/targets")
    files = targets.select("dedupe_key", F.col("file_path").alias("path"), F.col("file_category").alias("category"), F.col("file_ext").alias("ext"), F.col("file_size").alias("size"))
    states = run.written(extract.with_excerpts(files).select("dedupe_key", "metadata_only", "extraction_status"), "annotate-work/states")
    appended, again = annotation.backfill(targets, states)
    run.add(appended.withColumn("seq", F.lit(None).cast("long")), "results", "dedupe_key")
    return again


def recognise(run: Run, recogniser: ocr.Recogniser = ocr.recognise, top: int = S.OCR_TOP, min_value: float = S.MIN_VALUE, take_all: bool = False, limit: int | None = None) -> DataFrame:
    """Recognise the best candidates, append to the OCR log and count by status."""
    rows = ranking.ocr_candidates(run.latest(), top, min_value, take_all, limit)
    log = run.written(ocr.run(rows, recogniser), "ocr-work")
    run.add(log, "ocr", "dedupe_key")
    return ocr.status_counts(log)


def report(run: Run, top: int = S.REPORT_TOP, min_prob: float = S.REPORT_MIN_PROB, min_value: float = S.MIN_VALUE) -> str:
    """report.md, report.html with its scripts, and a CSV folder; returns the text."""
    latest = run.latest().persist()
    text = outputs.report_markdown(latest, top, min_prob, min_value)
    logs.write_text(run.spark, run.path("report.md"), [text])
    outputs.write_page(latest, run.folder, min_value, min_prob)
    outputs.write_csv(latest, run.path("report-csv"))
    latest.unpersist()
    return text


def manifest(run: Run, min_value: float = S.MIN_VALUE, min_prob: float = S.MANIFEST_MIN_PROB, out: str | None = None) -> None:
    outputs.write_manifest(run.latest(), out or run.path("manifest"), min_value, min_prob)
