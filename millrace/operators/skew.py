"""Joins that stay balanced when one key holds a large part of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A table of hot keys has at most this many rows, so that it may be broadcast.
MOST_HOT = 10_000


def hot_limit(rows: int, least: int = 10_000) -> int:
    """Rows from which a key counts as hot: fewer than MOST_HOT keys can reach it."""
    return max(least, -(-rows // MOST_HOT))


def join_groups(left: DataFrame, groups: DataFrame, keys: list[str], size: str, rows: int) -> DataFrame:
    """Inner join of ``left`` with one row per group, safe for groups of any size.

    ``groups`` holds in ``size`` how many rows of ``left`` have its key and
    ``rows`` is the number of rows of ``left``. Groups of at least
    ``hot_limit(rows)`` rows number fewer than MOST_HOT by counting, so they are
    broadcast and their rows of ``left`` never move; all others are shuffled by key.
    """
    hot = hot_limit(rows)
    cold = left.join(groups.filter(F.col(size) < hot), keys)
    return cold.unionByName(left.join(F.broadcast(groups.filter(F.col(size) >= hot)), keys))
