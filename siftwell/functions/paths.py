"""Paths of either flavour as Column expressions.

A path is Windows by its own form (a drive or a UNC start), whatever the host;
else POSIX. It is taken apart once into an anchor (``C:\\``,
``\\\\server\\share\\``, ``/`` or nothing) and its parts.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WINDOWS = r"^(?:[A-Za-z]:[\\/]|\\\\)"
_ANCHOR = r"^(?:[A-Za-z]:\\+|\\\\[^\\]+\\[^\\]+(?:\\|$))"


def is_windows(path: Column) -> Column:
    return path.rlike(WINDOWS)


def normal(path: Column) -> Column:
    """One kind of separator."""
    return F.when(is_windows(path), F.translate(path, "/", "\\")).otherwise(path)


def anchor(path: Column) -> Column:
    """The root of the path with its separator; empty if it is relative."""
    found = F.regexp_extract(normal(path), _ANCHOR, 0)
    windows = F.concat(F.regexp_replace(found, r"\\+$", ""), F.lit("\\"))
    return F.when(is_windows(path), F.when(found == "", F.lit("\\\\")).otherwise(windows)).when(path.startswith("/"), F.lit("/")).otherwise(F.lit(""))


def separator(path: Column) -> Column:
    return F.when(is_windows(path), F.lit("\\")).otherwise(F.lit("/"))


def parts(path: Column) -> Column:
    """Names below the anchor, without empty ones and dots."""
    windows = F.split(F.regexp_replace(normal(path), _ANCHOR, ""), r"\\")
    pieces = F.when(is_windows(path), windows).otherwise(F.split(path, "/"))
    return F.filter(pieces, lambda x: (x != "") & (x != "."))


def _joined(path: Column, names: Column) -> Column:
    text = F.concat(anchor(path), F.when(is_windows(path), F.array_join(names, "\\")).otherwise(F.array_join(names, "/")))
    return F.when(text == "", F.lit(".")).otherwise(text)


def parent(path: Column) -> Column:
    """The directory of a path; ``.`` for a bare name, the anchor for itself."""
    names = parts(path)
    return _joined(path, F.slice(names, F.lit(1), F.greatest(F.size(names) - 1, F.lit(0))))


def name(path: Column) -> Column:
    """The last part; empty for an anchor."""
    return F.coalesce(F.try_element_at(parts(path), F.lit(-1)), F.lit(""))


def ancestors(path: Column) -> Column:
    """All directories above a path, from its anchor (``.`` if relative) to its parent."""
    names = parts(path)
    return F.transform(F.sequence(F.lit(0), F.greatest(F.size(names) - 1, F.lit(0))), lambda n: _joined(path, F.slice(names, F.lit(1), n)))


def extension(file_name: Column) -> Column:
    """The last suffix without its dot, in lower case; empty for dotfiles and names without one."""
    return F.lower(F.regexp_extract(file_name, r"^.+\.([^.]+)$", 1))


def join(directory: Column, child: Column) -> Column:
    sep = separator(directory)
    return F.when(directory == ".", child).when(directory.endswith(sep), F.concat(directory, child)).otherwise(F.concat(directory, sep, child))


def is_under(path: Column, directory: Column) -> Column:
    """Whether a path is a directory or below it; ``/ab`` is not under ``/a``."""
    sep = separator(directory)
    start = F.when(directory.endswith(sep), directory).otherwise(F.concat(directory, sep))
    return (path == directory) | path.startswith(start)


def relative(path: Column, directory: Column) -> Column:
    """The part of a path below a directory; the path itself if it is not under it."""
    sep = separator(directory)
    start = F.when(directory.endswith(sep), directory).otherwise(F.concat(directory, sep))
    return F.when(path.startswith(start), path.substr(F.length(start) + 1, F.length(path))).otherwise(path)


def top_level(path: Column, root: Column) -> Column:
    """The first part below ``root``; ``(root)`` for files in it."""
    below = F.split(relative(path, root), r"[\\/]")
    return F.when(F.size(below) > 1, below[0]).otherwise(F.lit("(root)"))


def strip_extended(path: Column) -> Column:
    """A path without the ``\\\\?\\`` prefix of long Windows paths."""
    unc = F.regexp_replace(path, r"^\\\\\?\\UNC\\", r"\\\\\\\\")
    return F.when(path.rlike(r"^\\\\\?\\UNC\\"), unc).otherwise(F.regexp_replace(path, r"^\\\\\?\\", ""))
