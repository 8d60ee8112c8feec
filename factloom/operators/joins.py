"""Joins of tables that grow with the documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def merged(left: DataFrame, right: DataFrame, keys: str | Sequence[str], how: str = "inner") -> DataFrame:
    """A join that sorts and merges. Sizes that Spark guesses from a small file can send a whole table through the driver; sides
    that are dealt out by ``keys`` already meet without another shuffle."""
    return left.join(right.hint("merge"), [keys] if isinstance(keys, str) else list(keys), how)


def streamed(left: DataFrame, right: DataFrame, keys: str | Sequence[str], how: str = "inner") -> DataFrame:
    """A join in which rows of ``left``, which hold whole pages, are not sorted: a partition of the narrow ``right`` is hashed."""
    return left.join(right.hint("shuffle_hash"), [keys] if isinstance(keys, str) else list(keys), how)
