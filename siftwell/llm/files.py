"""Whole files in the shared folder, written and read by tasks."""

from __future__ import annotations

import uuid

from pyarrow import fs as files


def _store(uri: str) -> tuple[files.FileSystem, str]:
    scheme, _, rest = uri.partition(":")
    if not rest or scheme == "file":  # Hadoop also writes file:/path
        return files.LocalFileSystem(), "/" + (rest or uri).lstrip("/")
    return files.FileSystem.from_uri(uri)


def save(uri: str, data: bytes) -> None:
    """Write a file whole or not at all: a second attempt of a task gives the same bytes under the same name."""
    store, path = _store(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with store.open_output_stream(part) as out:
        out.write(data)
    store.move(part, path)


def fetch(uri: str) -> bytes:
    store, path = _store(uri)
    with store.open_input_stream(path) as file:
        return file.read()
