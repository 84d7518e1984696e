"""Command line: ``python -m siftwell.cli COMMAND --run FOLDER``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from siftwell import schema as S
from siftwell.operators import scoring, selection
from siftwell.plans import stages
from siftwell.session import ready


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="siftwell")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str) -> argparse.ArgumentParser:
        own = commands.add_parser(name)
        own.add_argument("--run", required=True)
        return own

    walk = command("walk")
    walk.add_argument("root")
    walk.add_argument("--include", action="append", default=[])
    command("estimate")
    scan = command("scan")
    scan.add_argument("--cap", type=float, default=S.DEFAULT_CAP)
    scan.add_argument("--limit", type=int)
    scan.add_argument("--concurrency", type=int, default=S.DEFAULT_CONCURRENCY)
    scan.add_argument("--rpm", type=float)
    scan.add_argument("--exclude-ext", type=selection.parse_exts, default=[])
    for flag in ("yes", "dry-run", "only-name-only", "prefilter", "outdated-rubric", "from-ocr"):
        scan.add_argument(f"--{flag}", action="store_true")
    annotate = command("annotate")
    annotate.add_argument("--all", action="store_true")
    annotate.add_argument("--top", type=int, default=S.REPORT_TOP)
    annotate.add_argument("--min-prob", type=float, default=S.REPORT_MIN_PROB)
    ocr = command("ocr")
    ocr.add_argument("--top", type=int, default=S.OCR_TOP)
    ocr.add_argument("--all", action="store_true")
    ocr.add_argument("--min-value", type=float, default=S.MIN_VALUE)
    ocr.add_argument("--limit", type=int)
    report = command("report")
    report.add_argument("--top", type=int, default=S.REPORT_TOP)
    report.add_argument("--min-prob", type=float, default=S.REPORT_MIN_PROB)
    report.add_argument("--min-value", type=float, default=S.MIN_VALUE)
    manifest = command("manifest")
    manifest.add_argument("--min-value", type=float, default=S.MIN_VALUE)
    manifest.add_argument("--min-prob", type=float, default=S.MANIFEST_MIN_PROB)
    manifest.add_argument("--out")
    return top


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(arguments)
    spark = spark or SparkSession.builder.appName("siftwell").getOrCreate()
    run = stages.Run(ready(spark), a.run)
    if a.command == "walk":
        stages.walk(run, [a.root, *a.include]).show(truncate=False)
    elif a.command == "estimate":
        stages.estimate(run).show()
    elif a.command == "scan":
        choice = {"only_name_only": a.only_name_only, "outdated_rubric": a.outdated_rubric, "from_ocr": a.from_ocr, "exclude_exts": a.exclude_ext, "limit": a.limit}
        stages.estimate(run, **choice).show()
        if a.dry_run or not a.yes and input("Go on? [y/N] ").lower() != "y":
            return 0
        print(stages.scan(run, scoring.LocalJudge(), a.cap, a.concurrency, a.prefilter, a.rpm, **choice))
    elif a.command == "annotate":
        stages.annotate(run, a.all, a.top, a.min_prob).show(truncate=False)
    elif a.command == "ocr":
        stages.recognise(run, top=a.top, min_value=a.min_value, take_all=a.all, limit=a.limit).show()
    elif a.command == "report":
        print(stages.report(run, a.top, a.min_prob, a.min_value))
    else:
        stages.manifest(run, a.min_value, a.min_prob, a.out)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
