"""SimHash near-duplicates by a segment-popcount embedding.

Fingerprints are 64 bits wide. Each is mapped to the bit counts of its 32
two-bit segments; the Manhattan distance of two such vectors never exceeds the
Hamming distance of the fingerprints. If that distance is 3 or less, then in
at least one half (16 segments) it is 1 or less, so the range join asks, half
by half, for the same grid cell or one that differs by one in one segment. A
step of one turns an even bit count into an odd one: only fingerprints with an
even count in that half look into the next cells. Every pair met this way is
verified on the exact bits.

Equal fingerprints are joined before, so copies never make pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.llm.components import components
from siftwell.llm.shared import free_name, kept, row_mark

SEED = 42
WORDS = 3
RADIUS = 3
SEGMENTS = 16
BLOCK = 65_536


def fingerprint(text: str | None, words: int = WORDS, seed: int = SEED) -> int:
    """The 64-bit SimHash of one text; 0 if it is null or has no words.

    Bytes are handled, so lower-casing touches A-Z alone and words end at the
    six ASCII spaces. A text of fewer than ``words`` words is one shingle.
    """
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    n = max(1, len(parts) - words + 1)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    first, last = starts[:n].tolist(), ends[min(words, len(parts)) - 1 :].tolist()
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):  # a very long text is counted in blocks
        hashes = np.array([digest(joined[a:b], seed) for a, b in zip(first[at : at + BLOCK], last[at : at + BLOCK], strict=True)], ">u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, mark: Column | None = None) -> DataFrame:
    """Rows (doc_id, mark, fp): ``fp`` holds the fingerprint's bits as a signed long, ``mark`` the column given, a long."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = np.array([fingerprint(x.as_py(), words) for x in batch.column(2)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(marks, pa.int64())], ["doc_id", "mark", "fp"])

    mark = F.lit(None).cast("long") if mark is None else mark
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), mark.alias("mark"), F.col(text_col).alias("text"))
    return picked.mapInArrow(compute, "doc_id long, mark long, fp long")


def _counts(half: Column) -> Column:
    """The 16 two-bit counts of a 32-bit half, packed two bits each."""
    return half - F.shiftright(half, 1).bitwiseAND(F.lit(0x55555555))


def _next_cells(cell: Column) -> Column:
    """Cells one step away from ``cell`` in one segment, if its bit count is even."""
    steps = []
    for i in range(SEGMENTS):
        count = F.shiftright(cell, 2 * i).bitwiseAND(F.lit(3))
        steps += [F.when(count > 0, cell - F.lit(1 << 2 * i)), F.when(count < 2, cell + F.lit(1 << 2 * i))]
    return F.array_compact(F.array(*steps))


def links(marks: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Pairs (u, v), u <> v, of distinct fingerprints that differ in 1 to ``radius`` (at most 3) bits.

    ``marks`` has one row per distinct fingerprint, in the long column fp.
    """
    if not 0 <= radius <= RADIUS:
        raise ValueError("the two halves prove a distance of at most 3")
    low = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    high = F.shiftrightunsigned(F.col("fp"), 32)
    halves = marks.select(
        "fp", F.explode(F.array(F.struct(F.lit(0).alias("half"), low.alias("bits")), F.struct(F.lit(1).alias("half"), high.alias("bits")))).alias("h")
    ).select("fp", "h.half", _counts(F.col("h.bits")).alias("cell"), (F.bit_count("h.bits") % 2 == 0).alias("even"))
    own = halves.select("half", "cell", "fp")
    same = halves.select("half", "cell", F.col("fp").alias("other"), F.lit(True).alias("same"))
    near = halves.filter("even").select("half", F.explode(_next_cells(F.col("cell"))).alias("cell"), F.col("fp").alias("other"), F.lit(False).alias("same"))
    met = own.join(same.union(near), ["half", "cell"]).filter(
        (F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= radius) & ((F.col("fp") > F.col("other")) | ~F.col("same"))
    )
    return met.select(F.greatest("fp", "other").alias("u"), F.least("fp", "other").alias("v")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, words: int = WORDS) -> DataFrame:
    """Rows (doc_id, fp, component_id), one per input row.

    ``component_id`` is the least doc_id among the documents reached over links
    of ``radius`` bits or fewer, the own one included. Rows without words carry
    fingerprint 0 and link like any other. A null id stays in its component but
    never names it; a component of nulls alone has a null id. Repeated rows are
    returned as often as they come. No column but the two named is read.
    """
    return _classes(kept(fingerprints(docs, id_col, text_col, words), "fingerprints"), radius).select("doc_id", "fp", "component_id")


def _classes(rows: DataFrame, radius: int) -> DataFrame:
    """``rows`` (a table of doc_id, mark, fp) with component_id and ``component``, which is never null."""
    marks = kept(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "marks")
    roots = kept(components(links(marks, radius)), "roots")
    rooted = marks.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least_id", F.coalesce("root", "fp").alias("component"))
    named = rooted.groupBy("component").agg(F.min("least_id").alias("component_id"))
    return rows.join(rooted.join(named, "component").select("fp", "component", "component_id"), "fp")


def keep_one(docs: DataFrame, radius: int = RADIUS, words: int = WORDS) -> DataFrame:
    """``docs`` with one row of each near-duplicate component: that of the least doc_id, then of the least row mark.

    Rows that share an id are told apart by all their columns; of rows alike in
    every column one stays. Rows with a null id stay as they are. The choice is
    made on narrow rows and joined to the texts once.
    """
    mark, named = free_name(docs.columns, "_mark"), docs.filter("doc_id is not null")
    rows = kept(fingerprints(named, words=words, mark=row_mark(docs)), "fingerprints")
    chosen = _classes(rows, radius).groupBy("component").agg(F.min_by("mark", F.struct("doc_id", "mark")).alias(mark)).select(mark)
    found = named.withColumn(mark, row_mark(docs)).join(chosen, mark, "left_semi").dropDuplicates([mark])
    return found.select(*[F.col(f"`{c}`") for c in docs.columns]).unionByName(docs.filter("doc_id is null"))
