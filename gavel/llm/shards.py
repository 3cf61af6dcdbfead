"""Contiguous shards with the smallest possible largest shard.

Equal texts form atomic groups, ordered by their first document. The smallest shard
capacity for which the ordered groups can be cut into ``n`` contiguous shards is found
by binary search; a capacity is checked greedily, each shard taking groups until the
next would not fit. The groups are then cut under that capacity, each cut as near to
an equal share as the capacity and the shards after it allow (a greedy cut alone would
leave the last shards empty beside a large group).

Running totals of the ordered groups come from a distributed sort. The driver holds a
skeleton, the totals at the ends of at most ``SKELETON`` blocks of groups; where a
check needs the groups inside a block, it reads that block alone.

Defined cases: a null text is the empty text, of size 1. Null ids come before others.
Rows that repeat an id and a text are placed like others. Fewer groups than shards
leave shards empty; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gavel.llm.common import text_hash, with_global_index, with_running_sums
from gavel.session import cut_lineage

SHARDS = 16
SKELETON = 1 << 18
FIRST = -(1 << 63)


class Totals:
    """Running byte totals at group ends: the skeleton, and single blocks when asked for."""

    def __init__(self, groups: DataFrame, n_groups: int, skeleton: int):
        self.step = max(1, -(-n_groups // skeleton))
        self.groups = groups.withColumn("block", F.expr(f"group_no div {self.step}"))
        rows = self.groups.groupBy("block").agg(F.max("end_bytes").alias("e")).select("e")
        self.ends = np.sort(rows.toPandas()["e"].to_numpy(np.int64))
        self.inside: dict[int, np.ndarray] = {}

    def block(self, at: int) -> np.ndarray:
        if self.step == 1:
            return self.ends[at : at + 1]
        if at not in self.inside:
            rows = self.groups.where(F.col("block") == at).select("end_bytes").toPandas()
            self.inside[at] = np.sort(rows["end_bytes"].to_numpy(np.int64))
        return self.inside[at]

    def last_up_to(self, limit: int) -> int:
        """The largest group end that is at most ``limit`` (0 if none)."""
        at = int(np.searchsorted(self.ends, limit, "right"))
        before = int(self.ends[at - 1]) if at else 0
        if at == len(self.ends) or self.step == 1:
            return before
        block = self.block(at)
        place = int(np.searchsorted(block, limit, "right"))
        return int(block[place - 1]) if place else before

    def first_from(self, limit: int) -> int:
        """The smallest group end that is at least ``limit`` (0 counts as an end)."""
        if limit <= 0:
            return 0
        at = int(np.searchsorted(self.ends, limit, "left"))
        block = self.block(at)
        return int(block[np.searchsorted(block, limit, "left")])


def fits(totals: Totals, capacity: int, shards: int) -> bool:
    total, at = int(totals.ends[-1]), 0
    for _ in range(shards):
        if total - at <= capacity:
            return True
        at = totals.last_up_to(at + capacity)
    return False


def smallest_capacity(totals: Totals, largest: int, shards: int) -> int:
    total = int(totals.ends[-1])
    low = max(largest, -(-total // shards))
    high = low + largest  # a shard of at least an equal share closes within one more group
    while low < high:
        middle = (low + high) // 2
        if fits(totals, middle, shards):
            high = middle
        else:
            low = middle + 1
    return low


def cuts(totals: Totals, capacity: int, shards: int) -> list[int]:
    """Ends (running bytes) of all shards but the last."""
    total = int(totals.ends[-1])
    earliest = [total]  # where each shard has to have ended for the rest to fit
    for _ in range(shards - 1):
        earliest.append(totals.first_from(earliest[-1] - capacity))
    earliest = earliest[::-1]
    at, out = 0, []
    for shard in range(shards - 1):
        ideal = at + (total - at) // (shards - shard)
        below, above = totals.last_up_to(ideal), totals.first_from(ideal)
        near = below if below > at and ideal - below <= above - ideal else above  # a group at least
        near = max(near, earliest[shard], at)
        if near > at + capacity:
            near = totals.last_up_to(at + capacity)
        at = near
        out.append(at)
    return out


def shard_documents(docs: DataFrame, shards: int = SHARDS, skeleton: int = SKELETON) -> DataFrame:
    """Per row: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = cut_lineage(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            *text_hash(text),
        )
    )
    key = ["first_doc", "text_h1", "text_h2"]
    grouped = rows.groupBy("text_h1", "text_h2").agg(
        F.coalesce(F.min("doc_id"), F.lit(FIRST)).alias("first_doc"),
        F.sum("size").alias("bytes"),
        F.count("*").alias("n_rows"),
        F.lit(1).cast("long").alias("one"),
    )
    groups = with_running_sums(
        cut_lineage(grouped), key, {"end_bytes": "bytes", "end_rows": "n_rows", "end_groups": "one"}
    ).withColumn("group_no", F.col("end_groups") - 1)
    size = groups.agg(F.count("*").alias("n"), F.max("bytes").alias("largest")).first()
    ends: list[int] = []
    if size["n"]:
        totals = Totals(groups, size["n"], skeleton)
        ends = cuts(totals, smallest_capacity(totals, size["largest"], shards), shards)
    shard = sum(((F.col("end_bytes") > end).cast("int") for end in ends), F.lit(0))
    placed = groups.select(*key, shard.alias("shard"), (F.col("end_rows") - F.col("n_rows")).alias("before"))
    starts = {r["shard"]: r["s"] for r in placed.groupBy("shard").agg(F.min("before").alias("s")).collect()}
    ordered = with_global_index(
        rows.join(placed.drop("before"), ["text_h1", "text_h2"]), [*key, "doc_id"], "row_index"
    )
    start = F.coalesce(*[F.when(F.col("shard") == s, F.lit(n)) for s, n in starts.items()], F.lit(0))
    return ordered.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        (F.col("row_index") - start).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
