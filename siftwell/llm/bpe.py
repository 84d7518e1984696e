"""Byte-pair encoding and decoding with contiguous rank arrays.

A short word is held as the list of its parts and, beside it, the list of the
ranks of each part with its right neighbour. The least rank is found by a scan
of that list, the boundary after it is deleted, and the ranks on either side
are looked up anew, until no neighbours merge. For words of a few dozen parts
the scan over one contiguous list is cheaper than any heap. Words of more than
``SHORT`` parts use a heap over linked parts, which gives the same merges.

Vocabulary, merges and the split pattern come from the tokenizer's file.
Common Latin text is folded and split here. What folds or splits by Unicode's
tables (other scripts, uncommon signs and spaces) goes through the library's
normaliser and splitter, whose Unicode version no other table here shares.
Merging and decoding are always done here.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from siftwell.llm.tokens import Chunks, byte_letters, cut, piece_pattern, vocabulary_path

SHORT = 128
NONE = 1 << 60


class Bpe(Chunks):
    """Encoder and decoder of a BPE vocabulary whose pieces end with a suffix."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            config = json.load(file)
        model = config["model"]
        pattern = piece_pattern(config)
        if pattern is None or model["type"] != "BPE" or config.get("decoder") is not None:
            raise ValueError(f"{path}: not a BPE that folds case, splits by a pattern and has no decoder")
        self.added = {t["content"]: t["id"] for t in config["added_tokens"]}
        super().__init__(pattern, list(self.added))
        vocabulary, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        letters = byte_letters()
        self.bytes = {c: i for i, c in enumerate(letters)}
        library = Tokenizer.from_file(path)
        self.fold, self.split = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.inner = [vocabulary.get(c) for c in letters]
        self.last = [vocabulary.get(c + suffix) for c in letters]
        self.merges: dict[int, tuple[int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ", 1)
            self.merges.setdefault(vocabulary[a] << 32 | vocabulary[b], (rank, vocabulary[a + b]))
        names = {i: t for t, i in vocabulary.items()} | {i: t for t, i in self.added.items()}
        self.names = [names.get(i, "") for i in range(max(names) + 1)]
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None

    def merged(self, word: bytes) -> list[int]:
        """Ids of one piece."""
        parts = [i for i in (*map(self.inner.__getitem__, word[:-1]), self.last[word[-1]]) if i is not None]
        if len(parts) > SHORT:
            return self._merged_long(parts)
        merges = self.merges
        none = (NONE, 0)
        ranks = [merges.get(a << 32 | b, none)[0] for a, b in zip(parts, parts[1:], strict=False)]
        while ranks:
            least = min(ranks)
            if least == NONE:
                break
            i = ranks.index(least)
            parts[i] = merges[parts[i] << 32 | parts[i + 1]][1]
            del parts[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = merges.get(parts[i] << 32 | parts[i + 1], none)[0]
            if i:
                ranks[i - 1] = merges.get(parts[i - 1] << 32 | parts[i], none)[0]
        return parts

    def _merged_long(self, parts: list[int]) -> list[int]:
        merges, n = self.merges, len(parts)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(m[0], i, m[1], a, b) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if (m := merges.get(a << 32 | b))]
        heapq.heapify(heap)
        while heap:
            _, i, new, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j < 0 or parts[j] != b:
                continue
            parts[i], parts[j] = new, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right >= 0 and (m := merges.get(parts[left] << 32 | parts[right])):
                    heapq.heappush(heap, (m[0], left, m[1], parts[left], parts[right]))
        return [p for p in parts if p >= 0]

    def piece_ids(self, piece: str) -> list[int]:
        return self.merged(piece.encode("utf-8", "replace"))

    def whole_ids(self, text: str) -> list[int]:
        out: list[int] = []
        at = 0
        for found in self.cut.finditer(text) if self.cut is not None else ():
            out += [*self._folded_ids(text[at : found.start()]), self.added[found[0]]]
            at = found.end()
        return out + self._folded_ids(text[at:])

    def _folded_ids(self, text: str) -> list[int]:
        return [i for letters, _ in self.split(self.fold(text)) for i in self.merged(bytes(map(self.bytes.__getitem__, letters)))] if text else []

    def decode(self, ids: list[int]) -> str:
        """Token strings joined by spaces, special ones too: what a tokenizer without a decoder gives."""
        return " ".join(map(self.names.__getitem__, ids))


_bpes: dict[str, Bpe] = {}


def bpe(path: str) -> Bpe:
    """The worker's encoder of ``path``."""
    if path not in _bpes:
        _bpes[path] = Bpe(path)
    return _bpes[path]


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, ids array<long>) of whole texts; a null text has no ids."""
    path = path or vocabulary_path()

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_ids, ids in _blocks(batches, path):
            arrays = [np.frombuffer(x, "<u4").astype(np.int64) for x in ids]
            yield pa.RecordBatch.from_arrays([doc_ids, pa.array(arrays, pa.list_(pa.int64()))], ["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(compute, "doc_id long, ids array<long>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """Rows (doc_id, text) of rows (doc_id, ids)."""
    path = path or vocabulary_path()

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [bpe(path).decode(x.as_py() or []) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(compute, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_tokens, ids_sha256, decoded_sha256): each whole text encoded, and its ids decoded.

    Null and empty texts have no ids and decode to the empty text; repeated
    rows are each returned.
    """
    path = path or vocabulary_path()

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = bpe(path)
        decimal = list(map(str, range(len(own.names)))).__getitem__
        for doc_ids, texts in _blocks(batches, path):
            counts, marks, decoded = [], [], []
            for ids in (np.frombuffer(x, "<u4").tolist() for x in texts):
                counts.append(len(ids))
                marks.append(hashlib.sha256(" ".join(map(decimal, ids)).encode()).hexdigest())
                decoded.append(hashlib.sha256(own.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([doc_ids, pa.array(counts, pa.int64()), pa.array(marks), pa.array(decoded)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(compute, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _blocks(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[tuple[pa.Array, list[bytes]]]:
    for ids, texts in cut(batches):
        yield ids, bpe(path).encode(texts)
