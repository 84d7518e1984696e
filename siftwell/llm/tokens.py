"""Token ids by the tokenizers library, with each chunk of text encoded once.

The tokenizers here split texts at white space before any merge, so a text's
ids are those of its chunks in order. A chunk is encoded by the library when a
worker first meets it; later ones come from a dictionary of bounded size. Texts
in which this could differ from whole-text encoding (special-token strings,
letters beyond Latin, uncommon spaces) go to the library whole.
"""

from __future__ import annotations

import json
import os
import re
import struct
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value of the contracts: the vocabulary file that queries name.
VOCABULARY = "word_bpe_49k.json"
#: Chunks that a worker remembers, and twice its pieces; about 250 bytes each, as longer ones than ``LONG`` are not.
REMEMBERED, LONG = 400_000, 48
#: Most rows, and characters about, that are encoded at a time.
BLOCK_ROWS, BLOCK_BYTES = 512, 4 << 20
#: Fixed value: the pattern of vocabularies that keep contractions, letters, single digits and signs apart.
LETTERS_NUMBERS_SIGNS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Anything but common Latin letters, digits, signs and the six ASCII spaces.
_UNUSUAL = re.compile("[^\t-\r -~¡-ɏ‐-‧‰-⁞₠-₿]")


def vocabulary_path(name: str = VOCABULARY) -> str:
    return public_tokenizers.path(name)


class Remembered(dict):
    """What ``make`` gives for a key, made once while there is room for ``most`` keys; long keys are not kept."""

    def __init__(self, make: Callable[[str], bytes], most: int) -> None:
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key: str) -> bytes:
        value = self.make(key)
        if len(key) <= LONG:
            if len(self) >= self.most:
                self.clear()
            self[key] = value
        return value


class Chunks:
    """Encodes texts chunk by chunk and remembers chunks and their pieces.

    ``pattern`` finds the pieces that are encoded on their own; ``None`` sends
    every text to ``whole_ids``. Subclasses say how pieces and whole texts are
    encoded.
    """

    def __init__(self, pattern: regex.Pattern | None, special: list[str], remembered: int = REMEMBERED) -> None:
        self.pattern, self.special = pattern, special
        self.pieces = Remembered(self._piece, remembered // 2)
        self.chunks = Remembered(self._letters_first if pattern is not None and pattern.pattern == LETTERS_NUMBERS_SIGNS else self._chunk, remembered)

    def piece_ids(self, piece: str) -> list[int]:
        raise NotImplementedError

    def whole_ids(self, text: str) -> list[int]:
        raise NotImplementedError

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """One bytes object per text, its ids as little-endian unsigned 32-bit integers; a null text is empty."""
        out, chunk = [], self.chunks.__getitem__
        for text in texts:
            if not text:
                out.append(b"")
            elif self.pattern is None or unusual(text) or any(t in text for t in self.special):
                out.append(_packed(self.whole_ids(text)))
            else:
                out.append(b"".join(map(chunk, text.lower().split())))
        return out

    def _piece(self, piece: str) -> bytes:
        return _packed(self.piece_ids(piece))

    def _chunk(self, chunk: str) -> bytes:
        return b"".join([self.pieces[p] for p in self.pattern.findall(chunk)])

    def _letters_first(self, chunk: str) -> bytes:
        """``_chunk``, with words and words before one sign told without the pattern."""
        if chunk.isalpha():
            return self.pieces[chunk]
        if chunk[:-1].isalpha() and chunk[-1] in ".,;:!?":
            return self.pieces[chunk[:-1]] + self.pieces[chunk[-1]]
        return self._chunk(chunk)


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Encoder(Chunks):
    """Ids by the tokenizers library, as its ``encode(text, add_special_tokens=False)`` gives them."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.model = self.library.model
        self.letters = byte_letters()
        special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        super().__init__(piece_pattern(json.loads(self.library.to_str())), special)

    def piece_ids(self, piece: str) -> list[int]:
        shown = piece if piece.isascii() and piece.isprintable() else "".join(map(self.letters.__getitem__, piece.encode()))
        return [t.id for t in self.model.tokenize(shown)]

    def whole_ids(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where printable, else the next from U+0100 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder of ``path``; what it remembers serves the tasks that follow."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def unusual(text: str) -> bool:
    """Whether folding or splitting ``text`` takes more than ``str.lower()`` and ``str.split()``."""
    if text.isascii():
        return any(x in text for x in "\x1c\x1d\x1e\x1f")
    return _UNUSUAL.search(text) is not None


def piece_pattern(config: dict) -> regex.Pattern | None:
    """The pattern whose matches are encoded on their own, if the file folds case, drops spaces and splits by such a pattern; else None."""
    folds = (config.get("normalizer") or {}).get("normalizers", [])
    splits = (config.get("pre_tokenizer") or {}).get("pretokenizers", [])
    plain = [x["type"] for x in folds] == ["NFC", "Replace", "Lowercase"] and folds[1]["pattern"] == {"Regex": r"\s+"} and folds[1]["content"] == " "
    first = splits[0] if [x["type"] for x in splits] == ["Split", "ByteLevel"] else {}
    plain &= first.get("behavior") == "Removed" and first.get("invert", False) and not splits[1]["add_prefix_space"] and not splits[1]["use_regex"]
    found = regex.compile(first["pattern"]["Regex"]) if plain and config.get("post_processor") is None else None
    return found if found is not None and not found.search(" \t\n\r\x0b\x0c") else None


def encoded(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, ids binary): each whole text's ids, little-endian unsigned 32-bit; a null text has none."""
    path = path or vocabulary_path()

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_ids, ids in blocks(batches, path):
            yield pa.RecordBatch.from_arrays([doc_ids, pa.array(ids, pa.binary())], ["doc_id", "ids"])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(compute, "doc_id long, ids binary")


def blocks(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[tuple[pa.Array, list[bytes]]]:
    """Ids of (id, text) batches, some rows at a time."""
    for ids, texts in cut(batches):
        yield ids, encoder(path).encode(texts)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What runs meanwhile gets ``BLOCK_BYTES`` and a row at a time from Spark, not 64 MB.

    A batch is held by the JVM, outside its heap and in buffers that grow by
    doubling, and by the worker, both for each task.
    """
    key, before = "spark.sql.execution.arrow.maxBytesPerBatch", int(spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch())
    spark.conf.set(key, min(before, BLOCK_BYTES) if before > 0 else BLOCK_BYTES)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str | None]]]:
    """(ids, texts) of (id, text) batches: few rows at a time, and fewer where texts are long, so that they don't add up."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            rows = max(1, min(BLOCK_ROWS, int(np.searchsorted(ends, before + BLOCK_BYTES, "right")) - at))
            part = batch.slice(at, rows)
            yield part.column(0), part.column(1).to_pylist()
            at += rows
