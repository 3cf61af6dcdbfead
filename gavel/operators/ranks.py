"""Positions, cuts and keep-first without an unpartitioned or hot window.

Order columns are integers, unique within the table (an input position or id).
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavel.operators.ordered import known_key, running_sums
from gavel.session import BROADCAST_ROWS, cut_lineage

_FAN = 4096


def not_first(df: DataFrame, key: Column, order: str, *, after: Column | None = None) -> DataFrame:
    """``order`` of every row that is not the first of its key by (``after``, ``order``).

    Works on (key, order) alone. A key is reduced map-side, so any number of copies of
    one key is one row per task; the rest is told apart by ``order``, which no two rows share.
    """
    lead = [] if after is None else [after.alias("lead")]
    keyed = cut_lineage(df.select(key.alias("key"), *lead, F.col(order).alias("order")))
    if after is None:
        first = keyed.groupBy("key").agg(F.min("order").alias("order"))
    else:
        ranked = keyed.groupBy("key").agg(F.min(F.struct("lead", "order")).alias("first"))
        first = ranked.select(F.col("first.order").alias("order"))
    return keyed.join(first.select("order"), "order", "left_anti").select(F.col("order").alias(order))


def without(df: DataFrame, losers: DataFrame, order: str) -> DataFrame:
    """The rows of ``df`` whose ``order`` is not among ``losers``.

    A list of at most ``BROADCAST_ROWS`` (counted) goes to every task and the rows stay
    where they are; a longer one meets them by a shuffle on ``order``.
    """
    listed = cut_lineage(losers)
    small = listed.count() <= BROADCAST_ROWS
    return df.join(F.broadcast(listed) if small else listed.hint("merge"), order, "left_anti")


def keep_first(df: DataFrame, key: Column, order: str, *, after: Column | None = None) -> DataFrame:
    """The row with the smallest (``after``, ``order``) of every key; see ``not_first``."""
    return without(df, not_first(df, key, order, after=after), order)


def positions(
    df: DataFrame, order: str, *, after: Column | None = None, each: bool = False, ranges: int | None = None
) -> DataFrame:
    """``order, position``: zero-based place in the order of (``after``, ``order``); null is
    a value of ``after`` and comes first. With ``each``, places start anew for every value.

    Only the two columns move. Ranges of equal size are numbered by themselves, however
    sparse or crowded the order values are.
    """
    lead = F.lit(0) if after is None else after
    keys = df.select(F.col(order).alias("order"), known_key(lead).alias("lead"), F.lit(1).cast("bigint").alias("one"))
    by = ["order"] if each else ["lead", "order"]
    placed = running_sums(keys, by, {"position": "one"}, group=["lead"] if each else [], ranges=ranges)
    return placed.select(F.col("order").alias(order), "position")


def with_position(
    df: DataFrame, order: str, *, after: Column | None = None, each: bool = False, ranges: int | None = None
) -> DataFrame:
    """``df`` with ``position``; see ``positions``."""
    return df.join(positions(df, order, after=after, each=each, ranges=ranges), order)


def kth_values(df: DataFrame, order: str, ranks: Mapping, group: Column | None = None) -> dict:
    """For every group the order value with ``ranks[group]`` rows before it.

    Each pass counts rows in at most 4096 equal slices of the range that still
    holds the answer and descends into one slice, so a pass returns a few
    thousand counts and the last ones read a sliver of the data.
    """
    name = F.lit(None).cast("string") if group is None else group.cast("string")
    rows = df.select(name.alias("g"), F.col(order).cast("bigint").alias("o"))
    spans = {
        r["g"]: [r["lo"], r["hi"] + 1]
        for r in rows.groupBy("g").agg(F.min("o").alias("lo"), F.max("o").alias("hi")).collect()
    }
    left = {g: k for g, k in ranks.items() if g in spans}
    answers: dict = {}
    while left:
        slices: Column = F.lit(None)
        wanted = F.lit(False)
        for g in left:
            lo, hi = spans[g]
            width = -(-(hi - lo) // _FAN)
            here = F.col("g").eqNullSafe(F.lit(g)) & (F.col("o") >= lo) & (F.col("o") < hi)
            slices = F.when(here, F.floor((F.col("o") - lo) / width)).otherwise(slices)
            wanted = wanted | here
        counted = (
            rows.filter(wanted).groupBy("g", slices.cast("bigint").alias("s")).agg(F.count("*").alias("n"))
        )
        per_group: dict = {}
        for r in counted.collect():
            per_group.setdefault(r["g"], []).append((r["s"], r["n"]))
        for g in list(left):
            lo, hi = spans[g]
            width = -(-(hi - lo) // _FAN)
            for s, n in sorted(per_group.get(g, [])):
                if left[g] < n:
                    spans[g] = [lo + s * width, min(hi, lo + (s + 1) * width)]
                    break
                left[g] -= n
            else:
                raise ValueError(f"rank beyond the rows of group {g!r}")
            if spans[g][1] - spans[g][0] <= 1:
                answers[g] = spans[g][0]
                del left[g]
    return answers


def balance(df: DataFrame, label: str, order: str) -> DataFrame:
    """The first ``min(class size)`` rows of every class, in ``order``.

    Any number of classes of any type. Rows without a label belong to no class and are
    left out, as the classes are what is balanced.
    """
    known = df.filter(F.col(label).isNotNull())
    smallest = known.groupBy(label).agg(F.count("*").alias("n")).agg(F.min("n")).first()[0]
    if smallest is None:
        return known
    kept = positions(known, order, after=F.col(label), each=True).filter(F.col("position") < smallest)
    return known.join(kept.select(order), order, "left_semi")


def validation_start(df: DataFrame, order: str, share: float) -> int:
    """Order value at which the last ``int(n * share)`` rows begin."""
    n = df.count()
    n_validation = int(n * share)
    if n_validation == 0:
        raise ValueError(f"{n} rows leave nothing to validate on at share {share}")
    return kth_values(df, order, {None: n - n_validation})[None]


def split_by_position(df: DataFrame, order: str, share: float) -> DataFrame:
    """Adds ``split`` = fit | validation; validation is the tail in ``order``."""
    start = validation_start(df, order, share)
    return df.withColumn(
        "split", F.when(F.col(order) >= start, F.lit("validation")).otherwise(F.lit("fit"))
    )
