"""Recognition of images and scanned documents through an outside program."""

from __future__ import annotations

import shutil
import subprocess
import tempfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell import schema as S

Recogniser = Callable[[str], tuple[str, str]]


def find_program(named: str | None = None) -> str | None:
    """The recogniser's path: the one named, else the one on PATH."""
    return shutil.which(named) if named else shutil.which("tesseract")


def recognise(path: str, program: str | None = None) -> tuple[str, str]:
    """(status, text) of one file, in processes of their own with a time limit."""
    program = program or find_program()
    if program is None:
        return "unavailable", ""
    try:
        if path.lower().endswith(".pdf"):
            text = _pages(path, program)
        else:
            text = _image(path, program, S.OCR_IMAGE_SECONDS)
    except subprocess.TimeoutExpired:
        return "timeout", ""
    except (OSError, subprocess.CalledProcessError, ImportError):
        return "error", ""
    text = " ".join(text.split())[: S.EXCERPT_CHARS]
    return ("ok", text) if text else ("no_text", "")


def _image(path: str, program: str, seconds: float) -> str:
    return subprocess.run([program, path, "stdout"], capture_output=True, timeout=seconds, check=True).stdout.decode("utf-8", "replace")


def _pages(path: str, program: str) -> str:
    import pypdfium2

    with tempfile.TemporaryDirectory() as folder:
        texts = []
        for k, page in enumerate(pypdfium2.PdfDocument(path)):
            if k == S.OCR_PAGES:
                break
            image = Path(folder) / f"{k}.png"
            page.render(scale=S.OCR_DPI / 72).to_pil().save(image)
            texts.append(_image(str(image), program, S.OCR_PDF_SECONDS))
        return "\n".join(texts)


def run(rows: DataFrame, recogniser: Recogniser = recognise, tasks: int | None = None) -> DataFrame:
    """OCR log rows of ``rows`` (dedupe_key, path), spread over ``tasks`` partitions: by default one for each core of the cluster."""
    tasks = tasks or max(S.OCR_WORKERS, rows.sparkSession.sparkContext.defaultParallelism)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [recogniser(p) for p in batch["path"]]
            texts = [t if s == "ok" else None for s, t in found]
            yield batch.assign(ocr_status=[s for s, _ in found], excerpt_chars=[len(t or "") for t in texts], excerpt=texts)

    return rows.select("dedupe_key", "path").repartition(tasks, "dedupe_key").mapInPandas(read, "dedupe_key string, path string, ocr_status string, excerpt_chars int, excerpt string")


def status_counts(log: DataFrame) -> DataFrame:
    """Rows (ocr_status, files), every status listed."""
    spark = log.sparkSession
    known = spark.createDataFrame([(s,) for s in S.OCR_STATUSES], "ocr_status string")
    counts = log.groupBy("ocr_status").agg(F.count(F.lit(1)).alias("files"))
    return known.join(counts, "ocr_status", "left").select("ocr_status", F.coalesce("files", F.lit(0)).alias("files"))
