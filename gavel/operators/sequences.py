"""Per-user sliding windows over the access stream.

The window of an event is its user's last eight events, itself included, in the
order of the ``occurred_at`` text and then the event id. A single window
partitioned by user would put all rows of a busy user into one task, so the rows are
dealt by ranges of (user, time, id) of about equal size, and a user who fills many
ranges is spread over them, even within one hour. Windows are built inside a range; the
first seven events of a user in a range borrow from a carry, the user's last seven
events before it, which is assembled from one small row per user and range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gavel import constants as K
from gavel.functions.features import vector_of_code
from gavel.operators.ordered import PART, in_ranges

PAD = -1


def user_windows(
    df: DataFrame,
    *,
    value: str = "code",
    user: str = "user_id",
    moment: str = "occurred_at",
    tie: str = "event_id",
    within: tuple[str, ...] = (),
    size: int = K.WINDOW,
    earlier: DataFrame | None = None,
    ranges: int | None = None,
) -> DataFrame:
    """Adds ``window``: the last ``size`` values of the user up to this row, oldest
    first and not padded.

    ``within`` restarts histories per value of more columns (a data split).
    ``earlier`` (``user, carried``: array of values) is history from before
    ``df``, as a stream keeps it. ``ranges`` fixes the number of ranges.
    """
    if earlier is not None and within:
        raise ValueError("earlier history belongs to users, not to splits of them")
    # Keys that cannot be null keep both uses of the windowed rows below the same
    # plan (no inferred null filter on one side), so Spark shuffles them once.
    named = {f"_key{i}": F.coalesce(F.col(c).cast("string"), F.lit("")) for i, c in enumerate((user, *within))}
    keys = list(named)
    dealt = in_ranges(df.withColumns(named), [*keys, moment, tie], ranges)
    in_range = Window.partitionBy(*keys, PART).orderBy(moment, tie)
    local = dealt.withColumn("_local", F.collect_list(value).over(in_range.rowsBetween(1 - size, 0)))
    # The last window of a user in a range holds the tail. The grouping is the
    # partitioning the window already has, so it moves nothing.
    tails = (
        local.groupBy(*keys, PART)
        .agg(F.max_by("_local", F.struct(moment, tie)).alias("_tail"))
        .withColumn("_tail", F.slice("_tail", F.greatest(F.size("_tail") - size + 2, F.lit(1)), size - 1))
    )
    if earlier is not None:  # the range before all ranges
        oldest = F.coalesce(F.col(user).cast("string"), F.lit(""))
        tails = tails.unionByName(
            earlier.select(oldest.alias(keys[0]), F.lit(-1).alias(PART), F.col("carried").alias("_tail"))
        )
    # size - 1 ranges back always hold size - 1 events, if the user has that many.
    before = Window.partitionBy(*keys).orderBy(PART).rowsBetween(1 - size, -1)
    carry = tails.withColumn("_carry", F.flatten(F.collect_list("_tail").over(before))).drop("_tail")
    carry = carry.filter(F.size("_carry") > 0)
    if earlier is None:  # at most one user goes on from one range to the next
        carry = F.broadcast(carry)
    joined = local.join(carry, [*keys, PART], "left")
    past = F.coalesce("_carry", F.array().cast(carry.schema["_carry"].dataType))
    both = F.concat(past, F.col("_local"))
    start = F.greatest(F.size(both) - size + 1, F.lit(1))
    window = F.when(F.size("_local") == size, F.col("_local")).otherwise(F.slice(both, start, size))
    return joined.withColumn("window", window).drop(*keys, "_local", "_carry", PART)


def last_values(windows: DataFrame, size: int = K.WINDOW, user: str = "user_id") -> DataFrame:
    """``user, carried``: the last ``size - 1`` values of every user in ``windows``, which
    is what later events borrow."""
    last = windows.groupBy(user).agg(F.max_by("window", F.struct("occurred_at", "event_id")).alias("window"))
    start = F.greatest(F.size("window") - size + 2, F.lit(1))
    return last.select(user, F.slice("window", start, size - 1).alias("carried"))


def left_padded(window: Column, size: int = K.WINDOW, pad: int = PAD) -> Column:
    return F.concat(F.array_repeat(F.lit(pad).cast("int"), size - F.size(window)), window)


def sequence_tensor(window: Column, size: int = K.WINDOW) -> Column:
    """``size`` feature vectors, zero vectors first, from a window of feature codes."""
    return F.transform(left_padded(window, size), vector_of_code)
