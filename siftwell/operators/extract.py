"""Text excerpts of files, read on the executors.

Only prefixes are read. Charsets are told by byte-order mark, then UTF-8, then
Windows-1252; PDF text needs the optional ``pypdf``.
"""

from __future__ import annotations

import codecs
import email
import email.message
import email.policy
import re
import zipfile
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as Late

import pandas as pd
from pyspark.sql import DataFrame

from siftwell import schema as S
from siftwell.functions import rules

# How binary formats begin.
MAGIC = (
    b"MZ", b"\x7fELF", b"PK\x03\x04", b"PK\x05\x06", b"Rar!", b"7z\xbc\xaf\x27\x1c", b"\x1f\x8b", b"RIFF", b"\x89PNG", b"\xff\xd8\xff",
    b"GIF87a", b"GIF89a", b"OggS", b"fLaC", b"ID3", b"BM", b"\xca\xfe\xba\xbe", b"SQLite format 3\x00",
)
_BOMS = ((codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF32_LE, "utf-32"), (codecs.BOM_UTF32_BE, "utf-32"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16"))
_TAG, _RUN = re.compile(r"<[^>]+>"), re.compile(rb"[\x20-\x7e]{4,}")
_RTF_WORD, _RTF_BRACE = re.compile(r"\\'[0-9a-fA-F]{2}|\\[a-zA-Z]+-?\d* ?"), re.compile(r"[{}]")
_OFFICE = {"docx": ("word/document.xml",), "xlsx": ("xl/sharedStrings.xml",)}


def decoded(data: bytes) -> str:
    for mark, name in _BOMS:
        if data.startswith(mark):
            return data.decode(name, "replace")
    for cut in range(4):  # a prefix may end within a character
        try:
            return data[: len(data) - cut].decode("utf-8")
        except UnicodeDecodeError:
            continue
    return data.decode("cp1252", "replace")


def sanitized(data: bytes) -> str | None:
    """A clean excerpt; null if over a hundredth of the bytes are NULs."""
    if not data:
        return ""
    wide = data.startswith((codecs.BOM_UTF16_LE, codecs.BOM_UTF16_BE, codecs.BOM_UTF32_LE, codecs.BOM_UTF32_BE))
    if not wide and data.count(0) > S.NUL_RATIO * len(data):
        return None
    return decoded(data).replace("\x00", "")[: S.EXCERPT_CHARS]


def has_magic(data: bytes) -> bool:
    return data.startswith(MAGIC) or data[4:8] == b"ftyp"


def _head(path: str, size: int = S.READ_BYTES) -> bytes:
    with open(path, "rb") as file:
        return file.read(size)


def _told(text: str | None) -> tuple[str | None, str]:
    return (text, "ok") if text else (text or "", "no_text")


def _plain(path: str) -> tuple[str | None, str]:
    return _told(sanitized(_head(path)))


def _sniffed(path: str) -> tuple[str | None, str]:
    data = _head(path, S.SNIFF_BYTES)
    text = None if has_magic(data) else sanitized(data)
    return (None, "unsupported") if text is None else _told(text)


def _rtf(path: str) -> tuple[str | None, str]:
    text = _RTF_BRACE.sub("", _RTF_WORD.sub(" ", _head(path).decode("latin-1")))
    return _told(" ".join(text.split())[: S.EXCERPT_CHARS])


def _legacy_doc(path: str) -> tuple[str | None, str]:
    return _told(b" ".join(_RUN.findall(_head(path))).decode("ascii")[: S.EXCERPT_CHARS])


def _message(data: bytes) -> tuple[str | None, str]:
    """Headers, an empty line, and the first plain part, attached ones too, or else the first of HTML."""
    message = email.message_from_bytes(data, policy=email.policy.default)
    headers = "\n".join(f"{name}: {message[name]}" for name in ("From", "To", "Date", "Subject") if message[name])
    body = _part(message, "text/plain")
    if body is None:
        body = _TAG.sub(" ", _part(message, "text/html") or "")
    text = "\n\n".join(filter(None, (headers, body))).strip()
    return (text[: S.EXCERPT_CHARS], "ok") if text else (None, "no_text")


def _part(message: email.message.Message, kind: str) -> str | None:
    """The text of the first part of a kind that can be read."""
    for part in message.walk():
        if part.get_content_type() == kind:
            try:
                return str(part.get_content())
            except (LookupError, ValueError):  # an unknown charset
                continue
    return None


def _emlx(path: str) -> tuple[str | None, str]:
    first, line, rest = _head(path, S.READ_BYTES + 64).partition(b"\n")
    try:
        data = rest[: int(first.strip())] if line else b""
    except ValueError:
        data = b""
    return _message(data) if data else (None, "no_text")


def _office(path: str, ext: str) -> tuple[str | None, str]:
    with zipfile.ZipFile(path) as archive:
        for member in _OFFICE[ext]:
            info = archive.NameToInfo.get(member)
            if info is not None and info.file_size <= S.MEMBER_CEILING:
                with archive.open(info) as file:
                    text = _TAG.sub(" ", file.read(S.READ_BYTES).decode("utf-8", "replace"))
                return (text[: S.EXCERPT_CHARS], "ok") if text.strip() else (None, "no_text")
    return None, "no_text"


def _pdf(path: str) -> tuple[str | None, str]:
    from pypdf import PdfReader

    return _told("\n".join(p.extract_text() or "" for p in PdfReader(path).pages[:3])[: S.EXCERPT_CHARS])


def extract(path: str, category: str, ext: str, size: int) -> tuple[str | None, str]:
    """(excerpt, status) of one file."""
    try:
        if ext in ("emlx", "emlxpart"):
            return _emlx(path)
        if ext == "eml":
            return _message(_head(path))
        if ext == "rtf":
            return _rtf(path)
        if category in ("text", "code"):
            return _plain(path)
        if category == "binary" and ext not in rules.NEVER_SNIFFED and size <= S.SNIFF_CEILING:
            return _sniffed(path)
        if ext == "pdf":
            return _pdf(path)
        if ext in _OFFICE:
            return _office(path, ext)
        if ext == "doc":
            return _legacy_doc(path)
        return None, "unsupported"
    except Exception:  # one bad file never ends a scan
        return None, "error"


def with_excerpts(candidates: DataFrame, seconds: float = S.EXTRACT_SECONDS, threads: int = S.EXTRACT_THREADS) -> DataFrame:
    """``candidates`` (path, category, ext, size, ...) with excerpt, metadata_only and extraction_status.

    Each file has ``seconds`` from when its reading starts; a null size or
    extension is read as unsupported.
    """
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in candidates.schema)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pool = ThreadPoolExecutor(threads)
        for batch in batches:
            found = []
            rows = list(zip(batch["path"], batch["category"], batch["ext"], batch["size"], strict=True))
            for at in range(0, len(rows), threads):
                waiting = [pool.submit(extract, p, c or "", e or "", int(s) if s == s and s is not None else 0) for p, c, e, s in rows[at : at + threads]]
                for future in waiting:
                    try:
                        found.append(future.result(seconds))
                    except Late:
                        found.append((None, "timeout"))
                        pool = ThreadPoolExecutor(threads)  # the late thread keeps its place in the old pool
            yield batch.assign(excerpt=[x for x, _ in found], metadata_only=[s != "ok" for _, s in found], extraction_status=[s for _, s in found])
        pool.shutdown(wait=False, cancel_futures=True)

    return candidates.mapInPandas(read, f"{kinds}, excerpt string, metadata_only boolean, extraction_status string")
