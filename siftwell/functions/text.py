"""Text clean-up as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftwell import schema as S


def two_places(value: Column) -> Column:
    """A number that is not negative, rounded to two decimal places by its exact value, ties to even.

    The double nearest to the midpoint decides; where the number equals it, the
    midpoint's own rounding error does, which is got without loss.
    """
    low = F.floor(value * 100)
    odd = low * 2 + F.lit(1.0)
    middle = odd / 200
    error = odd - middle * 128 - middle * 64 - middle * 8
    tie = F.when(error > 0, 0).when(error < 0, 1).otherwise(low % 2)
    return (low + F.when(value > middle, 1).when(value < middle, 0).otherwise(tie)) / F.lit(100.0)


def strip_tags(text: Column) -> Column:
    return F.regexp_replace(text, "<[^>]+>", " ")


def salvage_rtf(text: Column) -> Column:
    """Control words become spaces, braces go."""
    return F.regexp_replace(F.regexp_replace(text, r"\\[a-zA-Z]+-?[0-9]* ?|\\'[0-9a-fA-F]{2}", " "), "[{}]", "")


def printable_runs(text: Column, least: int = 4) -> Column:
    """Runs of printable ASCII, joined by spaces."""
    return F.array_join(F.regexp_extract_all(text, F.lit(f"[\\x20-\\x7e]{{{least},}}"), F.lit(0)), " ")


def excerpt(text: Column, chars: int = S.EXCERPT_CHARS) -> Column:
    return F.substring(text, 1, chars)


def nul_heavy(text: Column) -> Column:
    """Whether NULs make up over a hundredth."""
    size = F.length(text)
    return (size > 0) & ((size - F.length(F.replace(text, F.lit("\x00"), F.lit("")))) > size * S.NUL_RATIO)
