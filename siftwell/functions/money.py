"""Tokens and cost."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftwell import schema as S


def tokens(chars: Column) -> Column:
    """Tokens of a text of so many characters, 1 at least."""
    return F.greatest(F.lit(1).cast("long"), F.floor(chars / S.CHARS_PER_TOKEN))


def worst_tokens(chars: Column) -> Column:
    return F.greatest(F.lit(1).cast("long"), F.floor(tokens(chars) * S.WORST_FACTOR))


def call_tokens(excerpt: Column) -> Column:
    """Expected tokens of one call: its overhead and the excerpt's."""
    return F.lit(S.CALL_TOKENS).cast("long") + tokens(F.length(F.coalesce(excerpt, F.lit(""))))


def worst_call_tokens(excerpt: Column) -> Column:
    return F.lit(S.CALL_TOKENS).cast("long") + worst_tokens(F.length(F.coalesce(excerpt, F.lit(""))))


def cost(number: Column) -> Column:
    return number * F.lit(S.PRICE_PER_MILLION) / F.lit(1e6)


def billed_tokens(error: Column, reported: Column, estimated: Column) -> Column:
    """Errors are free; else the reported tokens, or the estimate where none are."""
    return F.when(error.isNotNull(), F.lit(0).cast("long")).otherwise(F.coalesce(reported, estimated))
