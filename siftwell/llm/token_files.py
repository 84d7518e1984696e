"""Token files of directly addressable codes.

Ids are split into chunks of ``bits`` bits (Brisaboa, Ladra and Navarro,
"DACs", 2013). Level 0 holds the lowest chunk of every id; an id that needs
more has its continuation bit set and its next chunk in level 1, at the rank of
that bit; and so on. A rank directory counts the set bits before each block of
512, so any token is found by one lookup and one popcount a level; no block is
decoded. In the last level nothing continues, so it is chunks alone.

File: a 32-byte header (magic, version, chunk bits, levels, documents, ids),
the doc ids, the documents' starts, then for each level its chunks and, but for
the last, its continuation bitmap and its rank directory, all little-endian.
"""

from __future__ import annotations

import bisect
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftwell.llm.files import fetch, save
from siftwell.llm.shared import new_path
from siftwell.llm.tokens import blocks, small_batches, vocabulary_path

MAGIC, VERSION, BITS, BLOCK = b"DACTOKEN", 2, 8, 512
HEADER = struct.Struct("<8sHBBiqq")
#: Ids after which a task begins its next file; a file takes about 2 bytes an id in memory.
FILE_IDS = 4_000_000
#: Ids that are split into levels at a time.
PIECE = 1 << 18
#: Text bytes that one range of doc ids holds about, and the most ranges.
RANGE_BYTES, MOST_RANGES = 32 << 20, 20_000
#: Fixed value of the contract: the id that ends each document.
END_ID = 1
#: A null doc_id in a file.
NO_ID = -(1 << 63)


@dataclass
class Level:
    chunks: np.ndarray
    bitmap: np.ndarray  # bits, packed, lowest first; empty in the last level
    ranks: np.ndarray  # set bits before each block

    def more(self, i: int) -> bool:
        return bool(len(self.bitmap) and self.bitmap[i >> 3] >> (i & 7) & 1)

    def rank(self, i: int) -> int:
        """Set bits before bit ``i``."""
        start = i // BLOCK * BLOCK
        if i // BLOCK == len(self.ranks):  # just past the last block
            start -= BLOCK
        count = int(self.ranks[start // BLOCK]) + int(np.bitwise_count(self.bitmap[start >> 3 : i >> 3]).sum())
        return count + int(self.bitmap[i >> 3] & (1 << (i & 7)) - 1).bit_count() if i & 7 else count

    def flags(self, first: int, last: int) -> np.ndarray:
        """The continuation bits of [first, last)."""
        bits = np.unpackbits(self.bitmap[first >> 3 : -(-last // 8)], bitorder="little")
        return bits[first & 7 : (first & 7) + last - first].astype(bool)


class _Growing:
    """A level under construction: chunks, and bits packed as far as whole bytes go."""

    def __init__(self) -> None:
        self.chunks: list[np.ndarray] = []
        self.packed: list[np.ndarray] = []
        self.loose = np.zeros(0, bool)

    def add(self, chunks: np.ndarray, more: np.ndarray) -> None:
        self.chunks.append(chunks)
        more = np.concatenate((self.loose, more))
        whole = len(more) & ~7
        self.packed.append(np.packbits(more[:whole], bitorder="little"))
        self.loose = more[whole:]

    def done(self, last: bool) -> Level:
        chunks = np.concatenate(self.chunks)
        if last:
            return Level(chunks, np.zeros(0, np.uint8), np.zeros(0, "<u4"))
        bitmap = np.concatenate([*self.packed, np.packbits(self.loose, bitorder="little")])
        padded = np.zeros(-(-len(chunks) // BLOCK) * (BLOCK // 8), np.uint8)
        padded[: len(bitmap)] = bitmap
        counts = np.bitwise_count(padded).reshape(-1, BLOCK // 8).sum(1, dtype=np.int64)
        return Level(chunks, bitmap, np.concatenate(([0], np.cumsum(counts)))[:-1].astype("<u4"))


def split(arrays: list[np.ndarray], bits: int = BITS) -> list[Level]:
    """The levels of the ids (non-negative, under 2**32) of ``arrays`` in a row, made piece by piece."""
    growing: list[_Growing] = []
    kind, low = "<u1" if bits <= 8 else "<u2", np.uint32((1 << bits) - 1)
    for rest in _pieces(arrays):
        at = 0
        while len(rest):
            if at == len(growing):
                growing.append(_Growing())
            left = rest >> np.uint32(bits)
            more = left > 0
            growing[at].add((rest & low).astype(kind), more)
            rest, at = left[more], at + 1
    return [g.done(i + 1 == len(growing)) for i, g in enumerate(growing)]


def _pieces(arrays: list[np.ndarray]) -> Iterator[np.ndarray]:
    """The same ids in arrays of at least some and at most ``PIECE`` ids."""
    waiting, size = [], 0
    for array in arrays:
        for at in range(0, len(array), PIECE):
            waiting.append(array[at : at + PIECE])
            size += len(waiting[-1])
            if size >= PIECE:
                yield np.concatenate(waiting).astype(np.uint32)
                waiting, size = [], 0
    if size:
        yield np.concatenate(waiting).astype(np.uint32)


def dump(doc_ids: list[int | None], arrays: list[np.ndarray], bits: int = BITS) -> bytes:
    """One file's bytes: documents in the order given."""
    starts = np.concatenate(([0], np.cumsum([len(a) for a in arrays]))).astype("<i8")
    levels = split(arrays, bits)
    names = np.array([NO_ID if d is None else d for d in doc_ids], "<i8")
    out = [HEADER.pack(MAGIC, VERSION, bits, len(levels), 0, len(doc_ids), int(starts[-1])), names.tobytes(), starts.tobytes()]
    for level in levels:
        out += [struct.pack("<q", len(level.chunks)), level.chunks.tobytes(), level.bitmap.tobytes(), level.ranks.tobytes()]
    return b"".join(out)


class TokenFile:
    """A file's documents and ids: random access by position or by a range of positions."""

    def __init__(self, data: bytes) -> None:
        magic, version, self.bits, n_levels, _, n_docs, self.n_ids = HEADER.unpack_from(data)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a token file of this version")
        at = HEADER.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            part = np.frombuffer(data, kind, n, at)
            at += part.nbytes
            return part

        self.doc_ids, self.starts = take("<i8", n_docs), take("<i8", n_docs + 1)
        self.levels = []
        for i in range(n_levels):
            n = int(take("<i8", 1)[0])
            chunks, bits = take("<u1" if self.bits <= 8 else "<u2", n), 0 if i + 1 == n_levels else n
            self.levels.append(Level(chunks, take("<u1", -(-bits // 8)), take("<u4", -(-bits // BLOCK))))
        if at != len(data):
            raise ValueError("the token file is cut short or has trailing bytes")

    def __len__(self) -> int:
        return self.n_ids

    def __getitem__(self, i: int) -> int:
        """The i-th id of the file."""
        if not 0 <= i < self.n_ids:
            raise IndexError(i)
        value = 0
        for k, level in enumerate(self.levels):
            value |= int(level.chunks[i]) << k * self.bits
            if not level.more(i):
                break
            i = level.rank(i)
        return value

    def between(self, first: int, last: int) -> np.ndarray:
        """Ids [first, last): each level gives one run of chunks, found through the rank directory."""
        ids = np.zeros(last - first, "<u4")
        at = np.arange(last - first)
        for k, level in enumerate(self.levels):
            if first == last:
                break
            ids[at] |= level.chunks[first:last].astype("<u4") << np.uint32(k * self.bits)
            if not len(level.bitmap):
                break
            at = at[level.flags(first, last)]
            first, last = level.rank(first), level.rank(last)
        return ids

    def document(self, k: int) -> np.ndarray:
        """Ids of the file's k-th document, found without decoding others."""
        return self.between(int(self.starts[k]), int(self.starts[k + 1]))


def load(uri: str) -> TokenFile:
    return TokenFile(fetch(uri))


def _ranges(docs: DataFrame) -> int:
    """How many ranges of doc ids a table is written in, by its size as planned.

    Of the whole table: a plan that picks columns takes a text for 20 bytes.
    """
    spark = docs.sparkSession
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size >= 1 << 60:  # not known
        return int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(spark.sparkContext.defaultParallelism, min(MOST_RANGES, -(-size // RANGE_BYTES)))


def write(docs: DataFrame, folder: str, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode whole texts, end each with ``END_ID`` and write them in ascending id order; return the manifest.

    Texts are encoded where they are read; what is shuffled by ranges of doc
    ids are ids of 2 bytes (4 where a text has one over 65535). An id so
    frequent that it spans several ranges is dealt to all of them.

    Rows of the manifest, kept as a table beside the files: part, seq (the
    files' order), file, n_docs, n_ids. Null texts are empty; null ids come
    first; rows of one id come in an order that hangs on their place in the
    input. Other columns are not read. An empty table gives an empty manifest.
    """
    path = path or vocabulary_path()
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    n = _ranges(docs)
    cuts = picked.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id")).approxQuantile("doc_id", [i / n for i in range(1, n)], 1 / (4 * n))
    bounds = [int(c) for c in cuts]  # n - 1 numbers, ascending

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 40
        end = np.array([END_ID], "<u4")
        for doc_ids, texts in blocks(batches, path):
            names = [NO_ID if d is None else d for d in doc_ids.to_pylist()]
            parts, out = [], []
            for name, ids in zip(names, texts, strict=True):
                first, after = bisect.bisect_left(bounds, name), bisect.bisect_right(bounds, name)
                parts.append(first + (row + len(out)) * 0x9E3779B1 % 65_521 % (after - first + 1))
                ids = np.append(np.frombuffer(ids, "<u4"), end)
                out.append((ids.astype("<u2") if ids.max() < 1 << 16 else ids).tobytes())
            wide = [len(x) != 2 * (len(t) // 4 + 1) for x, t in zip(out, texts, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(parts, pa.int32()), pa.array(names, pa.int64()), pa.array(range(row, row + len(out)), pa.int64()), pa.array(wide, pa.bool_()), pa.array(out, pa.binary())],
                ["part", "doc_id", "row", "wide", "ids"],
            )
            row += len(out)

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, size = TaskContext.get().partitionId(), 0, 0
        names: list[int] = []
        arrays: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            nonlocal names, arrays, size, seq
            uri = f"{folder}/part-{part:06d}-{seq:05d}.dac"
            save(uri, dump(names, arrays))
            row = [[part], [seq], [uri], [len(names)], [size]]
            names, arrays, size, seq = [], [], 0, seq + 1
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["part", "seq", "file", "n_docs", "n_ids"])

        for batch in batches:
            for name, wide, ids in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "wide", "ids")), strict=True):
                names.append(name)
                arrays.append(np.frombuffer(ids, "<u4" if wide else "<u2"))
                size += len(arrays[-1])
                if size >= FILE_IDS:
                    yield flush()
        if names:
            yield flush()

    encoded = picked.mapInArrow(spread, "part int, doc_id long, row long, wide boolean, ids binary")
    ordered = encoded.repartitionById(n, "part").sortWithinPartitions("doc_id", "row")
    manifest = ordered.select("doc_id", "wide", "ids").mapInArrow(store, "part int, seq int, file string, n_docs long, n_ids long")
    with small_batches(docs.sparkSession):
        manifest.write.parquet(f"{folder}/manifest")
    return docs.sparkSession.read.schema(manifest.schema).parquet(f"{folder}/manifest")


def read(manifest: DataFrame) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids_crc32) of the files in a manifest.

    ``start`` counts the ids of all documents before, over all files. Each
    document is read on its own, through the rank directories.
    """
    n = manifest.count()
    parts = manifest.groupBy("part").agg(F.sum("n_ids").alias("_n"))  # a row per range
    shifts = parts.select("part", F.coalesce(F.sum("_n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_shift"))
    before = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("_own", F.coalesce(F.sum("n_ids").over(before), F.lit(0))).join(shifts, "part").select("file", (F.col("_own") + F.col("_shift")).alias("base"))

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                file = load(uri)
                marks = [zlib.crc32(file.document(k).tobytes()) for k in range(len(file.doc_ids))]
                names = pa.array(file.doc_ids, pa.int64(), mask=file.doc_ids == NO_ID)
                yield pa.RecordBatch.from_arrays([names, pa.array(file.starts[:-1] + base), pa.array(np.diff(file.starts)), pa.array(marks, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return placed.repartition(max(1, min(n, MOST_RANGES)), "file").mapInArrow(compute, "doc_id long, start long, n_tokens long, ids_crc32 long")


def write_and_read(spark: SparkSession, docs: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``docs`` to a folder of its own below the shared one and read the files back."""
    return read(write(docs, new_path(spark, "tokens"), path))
