"""Language identification by Bayesian fusion of evidence.

Four sources are combined into one posterior per row: the likelihood of the
text under character-trigram models, the declared markup language, the suffix
of the address, and a prior of the host. Priors are smoothed along the
hierarchy all rows, address suffix, domain, host: each level adds ``WEIGHT``
pseudo-rows of the level above. Counts come from grouped aggregates over all
rows; a row's own part is taken out of its prior, so that no text counts twice.

The trigram models are fitted on a bounded sample of rows per language
(``SAMPLE``, ``SAMPLE_CHARS``); everything else covers all rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.llm.shared import free_name, kept, row_mark, sampled_ids

#: Rows of each language that the trigram models are fitted on, and their longest texts.
SAMPLE, SAMPLE_CHARS = 400, 8000
BUCKETS, SMOOTHING = 1 << 15, 0.5
#: A text's evidence counts as that of this many independent trigrams at most.
TRIGRAMS = 60.0
#: Pseudo-rows that a level's prior takes from the level above, and for a value declared.
WEIGHT, DECLARED_WEIGHT = 5.0, 2.0
#: Rows whose best language is less likely than this are rejected.
CONFIDENCE = 0.5


def _trigrams(text: str) -> np.ndarray:
    """Hashes of the trigrams of the letters of a whole text; other signs become one space."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4").astype(np.int64)
    letters = (codes >= 97) & (codes <= 122) | (codes >= 192) & (codes != 215) & (codes != 247) & ~((codes >= 0x2000) & (codes < 0x2C00))
    codes = np.where(letters, codes, 32)
    codes = codes[letters | np.append(True, letters[:-1])] if len(codes) else codes
    if not letters.any():
        return np.zeros(0, np.int64)
    codes = np.concatenate(([32], codes, [32]))
    return (codes[:-2] * 961 + codes[1:-1] * 31 + codes[2:] + (codes[:-2] >> 3) * 7919) % BUCKETS


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # (BUCKETS, languages) log-likelihoods

    def likelihoods(self, text: str | None) -> np.ndarray:
        """Log-likelihoods of the whole text per language, 0 for all if it has no letters."""
        at = _trigrams(text or "")
        if not len(at):
            return np.zeros(len(self.languages))
        return self.table[at].sum(0, dtype=np.float64) * min(1.0, TRIGRAMS / len(at))


def train(texts: Iterable[tuple[str, str]]) -> Model:
    """Trigram models of (text, language) rows, which are read once."""
    counts: dict[str, np.ndarray] = {}
    for text, lang in texts:
        if lang not in counts:
            counts[lang] = np.full(BUCKETS, SMOOTHING)
        counts[lang] += np.bincount(_trigrams(text), minlength=BUCKETS)
    languages = sorted(counts)
    table = np.stack([counts[n] for n in languages] or [np.full(BUCKETS, SMOOTHING)], 1)
    return Model(languages or ["und"], np.log(table / table.sum(0)).astype(np.float32))


def fit(docs: DataFrame) -> Model:
    """Fit on ``docs`` (doc_id, text, lang): of each language the ids of least hash.

    Every language found gets a model; tags are reduced to their primary part,
    other names are lower-cased. Rows with a null id, or a null or empty
    language or text, are not learned from. Without any the one language is
    ``und``.
    """
    tag = normal_tag(F.col("lang"))
    good = docs.select(F.col("doc_id").alias("id"), F.when(tag != "", tag).otherwise(F.lower("lang")).alias("lang"), "text").filter("lang is not null and lang <> ''")
    names = [r["lang"] for r in good.select("lang").distinct().collect()]
    ids = kept(sampled_ids(good, "id", "lang", dict.fromkeys(names, 2 * SAMPLE)), "sample")  # bounded: twice the sample a language
    own = good.filter("text is not null").filter(F.length("text") <= SAMPLE_CHARS).select("id", "text")
    first = Window.partitionBy("class").orderBy("mark", "id", "text")
    rows = own.join(F.broadcast(ids), "id").withColumn("place", F.row_number().over(first)).filter(F.col("place") <= SAMPLE)
    return train((r["text"], r["class"]) for r in rows.select("text", "class").toLocalIterator())


def normal_tag(tag: Column) -> Column:
    """The primary part of a declared language: ``EN-us`` and ``en_US`` are ``en``; empty if there is none."""
    return F.coalesce(F.lower(F.regexp_extract(F.trim(tag), "^([A-Za-z]{2,3})(?![A-Za-z])", 1)), F.lit(""))


def evidence(rows: DataFrame, model: Model) -> DataFrame:
    """``rows`` (id, text, declared, host) with the text replaced by letters (boolean) and likelihoods (array)."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            found = [model.likelihoods(x.as_py()) for x in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("declared"), batch.column("host"), pa.array([bool(f.any()) for f in found]), pa.array(found, pa.list_(pa.float64()))],
                ["id", "declared", "host", "letters", "likelihoods"],
            )

    return rows.select("id", "text", "declared", "host").mapInArrow(compute, "id long, declared string, host string, letters boolean, likelihoods array<double>")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, b: a + b)


def _posterior(logs: Column) -> Column:
    def scaled(x: Column) -> Column:
        return _let(F.array_max(x), lambda most: F.transform(x, lambda v: F.exp(v - most)))

    return _let(_let(logs, scaled), lambda parts: _let(_total(parts), lambda whole: F.transform(parts, lambda v: v / whole)))


def fuse(found: DataFrame, languages: list[str]) -> DataFrame:
    """``found`` (a table of ``evidence`` rows) with lang, confidence and accepted.

    ``accepted`` is false for rows without letters and for those whose best
    language is less likely than ``CONFIDENCE``. A missing host or declaration
    is a value of its own that tells nothing new about its rows.
    """
    n = len(languages)
    rows = found.withColumn("p", _posterior(F.col("likelihoods")))
    rows = rows.withColumn("domain", F.regexp_extract("host", r"([^.]*\.)?[^.]*$", 0)).withColumn("suffix", F.regexp_extract("host", r"[^.]*$", 0))
    sums = [F.sum(F.when(F.col("letters"), F.col("p")[i]).otherwise(0.0)).alias(f"n{i}") for i in range(n)]
    again = [F.sum(f"n{i}").alias(f"n{i}") for i in range(n)]
    hosts = rows.groupBy("host", "domain", "suffix").agg(*sums)
    domains = hosts.groupBy("domain", "suffix").agg(*again)
    suffixes = domains.groupBy("suffix").agg(*again)
    whole = suffixes.agg(*again).first()  # one row
    total = [float(whole[f"n{i}"] or 0.0) for i in range(n)]

    def smoothed(level: DataFrame, above: list[Column]) -> list[Column]:
        size = sum((F.col(f"n{i}") for i in range(n)), F.lit(0.0))
        return [(F.col(f"n{i}") + WEIGHT * above[i]) / (size + WEIGHT) for i in range(n)]

    top = [F.lit((t + 1.0) / (sum(total) + n)) for t in total]
    s = suffixes.select("suffix", F.array(*smoothed(suffixes, top)).alias("s"))
    d = domains.join(s, "suffix")
    d = d.select("domain", F.array(*smoothed(d, [F.col("s")[i] for i in range(n)])).alias("d"))
    h = hosts.join(d, "domain").select("host", "d", F.array(*[F.col(f"n{i}") for i in range(n)]).alias("n"))
    declared = rows.groupBy("declared").agg(*sums).select("declared", F.array(*[F.col(f"n{i}") for i in range(n)]).alias("c"))
    joined = rows.join(h, "host").join(declared, "declared")
    # columns of their own, so that none is computed twice
    own = F.when(F.col("letters"), F.col("p")).otherwise(F.array(*[F.lit(0.0)] * n))
    left = lambda counts: F.zip_with(counts, "own", lambda a, b: F.greatest(a - b, F.lit(0.0)))
    parts = joined.withColumn("own", own).withColumn("others", left("n")).withColumn("seen", left("c"))
    prior = _let(_total(F.col("others")), lambda size: F.zip_with("others", "d", lambda a, b: F.log((a + WEIGHT * b) / (size + WEIGHT))))
    base = F.array(*[F.lit((t + 1.0) / (sum(total) + n)) for t in total])
    # P(declared | language) up to a factor common to all languages
    said = _let(_total(F.col("seen")), lambda size: F.zip_with("seen", base, lambda k, t: F.log((k + DECLARED_WEIGHT * t) / (size + DECLARED_WEIGHT) / t)))
    said = F.when(F.col("declared") == "", F.array(*[F.lit(0.0)] * n)).otherwise(said)
    logs = F.zip_with(F.zip_with("likelihoods", prior, lambda a, b: a + b), said, lambda a, b: a + b)
    final = parts.select("id", "declared", "host", "letters", _posterior(logs).alias("posterior"), "p")
    best = F.array_position("posterior", F.array_max("posterior")).cast("int")
    text_best = F.array_position("p", F.array_max("p")).cast("int")
    names = F.array(*map(F.lit, languages))
    return final.select(
        "id", "declared", "host", F.when(F.col("letters"), F.element_at(names, text_best)).alias("text_lang"), F.element_at(names, best).alias("lang"),
        F.array_max("posterior").alias("confidence"), (F.col("letters") & (F.array_max("posterior") >= CONFIDENCE)).alias("accepted"),
    )


def identify_pages(pages: DataFrame, model: Model) -> DataFrame:
    """Rows (page_id, host, declared, text_lang, lang, confidence, accepted), one per row of ``pages``.

    Null pages have no text and no declaration, null urls an empty host; both
    are judged by what is left. Repeated rows are each returned.
    """
    rest = F.regexp_extract(F.coalesce("url", F.lit("")), "://([^/?#]*)", 1)
    host = F.lower(F.regexp_replace(F.regexp_replace(rest, "^.*@", ""), ":[0-9]*$", ""))
    page = F.coalesce("html", F.lit(""))
    text = F.regexp_replace(F.regexp_replace(page, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " "), "<[^>]*>", " ")
    declared = normal_tag(F.regexp_extract(page, r"""(?is)<html\b[^>]*?\slang\s*=\s*["']?([^"'\s>]*)""", 1))
    rows = pages.select(F.col("page_id").cast("long").alias("id"), F.regexp_replace(text, "&[#A-Za-z0-9]+;", " ").alias("text"), declared.alias("declared"), host.alias("host"))
    return fuse(kept(evidence(rows, model), "evidence"), model.languages).withColumnRenamed("id", "page_id")


def identify_documents(docs: DataFrame, model: Model) -> DataFrame:
    """Rows (doc_id, lang, confidence, accepted, ...) of documents: ``lang`` is the declaration, ``source`` the host."""
    return _identified(docs, F.col("doc_id").cast("long"), model).withColumnRenamed("id", "doc_id")


def _identified(docs: DataFrame, key: Column, model: Model) -> DataFrame:
    rows = docs.select(key.alias("id"), "text", normal_tag(F.col("lang")).alias("declared"), F.coalesce(F.lower("source"), F.lit("")).alias("host"))
    return fuse(kept(evidence(rows, model), "evidence"), model.languages)


def keep_identified(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` without the rows that ``identify_documents`` rejects.

    Each row is judged by itself, whatever rows share its id; only rows alike
    in every column go together. Rows with a null id stay as they are. The
    table of rejected rows is written first, so that the join knows its size.
    """
    mark = free_name(docs.columns, "_mark")
    key = F.when(F.col("doc_id").isNotNull(), row_mark(docs))
    rejected = kept(_identified(docs, key, model).filter("not accepted and id is not null").select(F.col("id").alias(mark)).distinct(), "rejected")
    return docs.withColumn(mark, row_mark(docs)).join(rejected, mark, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
