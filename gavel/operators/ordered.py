"""Running sums in a global order, without a window over a whole table or a whole group.

Rows are dealt by ranges of the order, of about equal size whatever the values are: a
hot key spreads over as many ranges as it fills. Inside a range a sum runs over the rows
of one range only; what lies before a range is one number per range and group.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gavel.session import cut_lineage

PART = "_part"


def known_key(column: Column) -> Column:
    """A key that is never null, sorts nulls first and can be joined on."""
    return F.struct(column.isNotNull().alias("known"), column.alias("value"))


def in_ranges(df: DataFrame, order: Sequence[str], ranges: int | None = None) -> DataFrame:
    """``df`` with ``_part``, the number of its range in ``order``.

    Where the ranges lie depends on a sample, so the dealt rows are checkpointed:
    everything built on them sees the same ranges, also after a lost executor.
    """
    size = [] if ranges is None else [ranges]
    return cut_lineage(df.repartitionByRange(*size, *order).withColumn(PART, F.spark_partition_id()))


def running_sums(
    df: DataFrame, order: Sequence[str], sums: Mapping[str, str], group: Sequence[str] = (), ranges: int | None = None
) -> DataFrame:
    """Adds for every ``new: column`` of ``sums`` the sum of ``column`` over the rows before
    this one in ``order``, among those with the same ``group``.

    Groups must not be null. Rows that are equal in ``order`` must not differ in what
    is added up, or their order is not defined.
    """
    group = list(group)
    dealt = in_ranges(df, [*group, *order], ranges)
    inside = Window.partitionBy(PART, *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    zero = {new: F.lit(0).cast(dict(df.dtypes)[column]) for new, column in sums.items()}
    totals = dealt.groupBy(PART, *group).agg(
        *[F.coalesce(F.sum(column), zero[new]).alias(f"_{new}") for new, column in sums.items()]
    )
    if group:  # a group has as many rows here as it has ranges
        earlier = Window.partitionBy(*group).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
        before = totals.withColumns({f"_{new}": F.coalesce(F.sum(f"_{new}").over(earlier), zero[new]) for new in sums})
    else:  # one row per range
        rows, so_far = [], None
        for part, *sizes in sorted(map(tuple, totals.collect())):
            so_far = so_far or [size - size for size in sizes]
            rows.append((part, *so_far))
            so_far = [total + size for total, size in zip(so_far, sizes)]
        before = F.broadcast(df.sparkSession.createDataFrame(rows, totals.schema))
    local = dealt.withColumns({new: F.coalesce(F.sum(c).over(inside), zero[new]) for new, c in sums.items()})
    return (
        local.join(before, [PART, *group])
        .withColumns({new: F.col(new) + F.col(f"_{new}") for new in sums})
        .drop(PART, *[f"_{new}" for new in sums])
    )
