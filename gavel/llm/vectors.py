"""Integer vectors, stored once, and exact Lloyd rounds over them.

Shared by centroid clustering and code compression. Components become integers by
rounding down, all distances are squared and exact, and means are exact floors, so a
result does not depend on how rows are dealt to tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavel.session import checkpoint_dir

# Rows worked on together in a task.
CHUNK = 4096
# Roots of squared distances are held as whole sixteenths.
UNIT = 16
# How far such a root may be off: it is rounded, and so is the root it comes from.
SLACK = 2


def is_finite_vector(vector: Column) -> Column:
    """True if the vector and all its components are there and finite; never null."""
    inf = F.lit(float("inf"))
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != inf))
    return F.coalesce(vector.isNotNull() & sound, F.lit(False))


def component_limit(dims: int) -> int:
    """Largest size of a component for which squared distances fit in 63 bits."""
    return min(isqrt((1 << 62) // max(dims, 1)) // 2, (1 << 31) - 1)


def integers(vector: Column, scale: int, dims: int) -> Column:
    """floor(scale * x) of every component, held to ``component_limit``."""
    limit = component_limit(dims)

    def whole(x: Column) -> Column:
        scaled = F.greatest(F.lit(float(-limit)), F.least(F.lit(float(limit)), x.cast("double") * scale))
        return F.floor(scaled).cast("int")

    return F.transform(vector, whole)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df``, written once to the shared checkpoint folder."""
    path = f"{checkpoint_dir(df.sparkSession)}/{name}-{uuid4()}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column without nulls, all lists of one length, as rows of int64."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def in_chunks(batches: Iterator[pa.RecordBatch], rows: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``rows``, whatever the session's batch size is."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            held.append(batch.slice(at, rows))
            if sum(b.num_rows for b in held) >= rows:
                yield pa.concat_batches(held)
                held = []
    if held:
        yield pa.concat_batches(held)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances between the rows of ``a`` and the rows of ``b``, pair by pair."""
    gap = a - b
    return np.einsum("ij,ij->i", gap, gap)


def squared_to(a: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Squared distances of every row of ``a`` to every one of ``points``."""
    return np.stack([squared(a, p) for p in points], axis=1) if len(points) else np.zeros((len(a), 0), np.int64)


def rooted(squares: np.ndarray) -> np.ndarray:
    """Roots in sixteenths, rounded: within ``SLACK`` of 16 * sqrt(square)."""
    return np.rint(UNIT * np.sqrt(squares.astype(np.float64))).astype(np.int64)


class Sums:
    """Counts and component sums of the rows given to each of ``n`` centres."""

    def __init__(self, n: int, width: int):
        self.counts = np.zeros(n, np.int64)
        self.totals = np.zeros((n, width), np.int64)

    def add(self, rows: np.ndarray, centre: np.ndarray) -> None:
        order = np.argsort(centre, kind="stable")
        found, starts, counts = np.unique(centre[order], return_index=True, return_counts=True)
        if len(found):
            self.counts[found] += counts
            self.totals[found] += np.add.reduceat(rows[order], starts, axis=0)

    def moved(self, centres: np.ndarray) -> np.ndarray:
        """Exact floors of the means; a centre without rows stays."""
        means = self.totals // np.maximum(self.counts, 1)[:, None]
        return np.where(self.counts[:, None] > 0, means, centres)


def added_up(sums: DataFrame, key: str, width: int) -> list:
    """One row per value of ``key``: counts and sums of all tasks, added by Spark.

    There are as many keys as centres, so few rows come to the driver.
    """
    parts = [F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(width)]
    return sums.groupBy(key).agg(F.sum("n").alias("n"), *parts).collect()
