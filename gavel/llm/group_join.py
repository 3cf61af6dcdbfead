"""Joining rows to the one row of their group where a few groups hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A group is large when it holds more than this part of all rows; fewer than this many
# groups can, which bounds what is broadcast.
LARGE_PART = 1000


def with_group(rows: DataFrame, groups: DataFrame, keys: list[str], size: str) -> DataFrame:
    """``rows`` with the columns of their row of ``groups``; rows without one go.

    ``groups`` has one row per key and in ``size`` how many rows it has. Rows of large
    groups meet a broadcast table of fewer than ``LARGE_PART`` rows and do not move; the
    others are shuffled, and no task then gets more than a thousandth of all rows for
    one key. Keys must not be null. Both inputs are read more than once.
    """
    total = groups.agg(F.coalesce(F.sum(size), F.lit(0)).alias("n")).first()["n"]
    is_large = F.col(size) * LARGE_PART > F.lit(total)
    large = F.broadcast(groups.where(is_large))
    in_place = rows.join(large, keys)
    others = rows.join(F.broadcast(groups.where(is_large).select(*keys)), keys, "left_anti")
    return in_place.unionByName(others.join(groups.where(~is_large).hint("merge"), keys))
