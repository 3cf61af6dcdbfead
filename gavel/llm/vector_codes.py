"""Vector codes: each part of a vector is named by its nearest codebook entry.

Vectors are cut into equal parts, every part position has a codebook of its own, and
codebooks are improved by exact Lloyd rounds. The nearest entry is found through a
geometric near-neighbour access tree over the entries: a node has a few split points,
each with the entries nearest to it, and for every split point and child the range of
distances from the point to the child's entries. A part is measured against the split
points; a child whose range, seen from any split point, lies farther away than the best
entry so far is left out with its whole subtree. Ranges are whole numbers widened by
their rounding and the comparison is strict, so nothing that could win or tie is left
out; entries that are measured are compared as exact integers, ties by lower index.

The driver holds the codebooks (parts x entries x components) and nothing that grows with
the table. A round reads the stored table once; each task adds up its parts by entry.

Defined cases: rows whose vector is null or has a null or non-finite component have no
code. The length is that of the kept vector of smallest id whose length is a positive
multiple of the number of parts (a null id comes last, equal ids are ordered by their
components); vectors of another length have no such parts and no code. A repeated
``vec_id`` is a vector of its own in every row. With fewer vectors than entries, the
codebooks have as many entries as there are vectors. Equal entries: the lower index wins.
A null label is a label. Components beyond ``component_limit`` (134,217,728 at 64
components, values beyond 32,768 at scale 4096) count as that limit. An empty table gives
an empty result. Other columns decide nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gavel.llm.group_join import with_group
from gavel.llm.vectors import (
    SLACK, Sums, added_up, in_chunks, integers, is_finite_vector, matrix, rooted, squared_to, stored,
)

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
# Split points of a node; a node of no more entries than this has no children.
SPLITS = 4


@dataclass
class Node:
    """``points``: indices of the entries measured here. For each child: ``low[i, j]`` and
    ``high[i, j]`` bound the distances from point i to the entries below child j."""

    points: np.ndarray
    children: list[Node] = field(default_factory=list)
    low: np.ndarray | None = None
    high: np.ndarray | None = None


def build(entries: np.ndarray, among: np.ndarray, splits: int = SPLITS) -> Node:
    """The tree over the entries ``among``: split points far apart, others by nearest point."""
    if len(among) <= splits:
        return Node(among)
    taken = [0]
    apart = squared_to(entries[among], entries[among[:1]])[:, 0]
    while len(taken) < splits:
        apart[taken] = -1  # equal entries are far from nothing, yet a point is taken once
        taken.append(int(apart.argmax()))
        apart = np.minimum(apart, squared_to(entries[among], entries[among[taken[-1:]]])[:, 0])
    points = among[taken]
    others = np.delete(among, taken)
    home = squared_to(entries[others], entries[points]).argmin(axis=1)
    below = [others[home == i] for i in range(splits)]
    below = [b for b in below if len(b)]
    ranges = [rooted(squared_to(entries[b], entries[points])) for b in below]
    return Node(
        points,
        [build(entries, b, splits) for b in below],
        np.stack([r.min(axis=0) for r in ranges], axis=1) - SLACK,
        np.stack([r.max(axis=0) for r in ranges], axis=1) + SLACK,
    )


class Search:
    """Nearest entries of many parts at once; ``measured`` counts the distances taken."""

    def __init__(self, entries: np.ndarray, splits: int = SPLITS):
        self.entries = entries
        self.root = build(entries, np.arange(len(entries)), splits)
        self.measured = 0

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the nearest entry, squared distance) of every row of ``parts``."""
        best = np.full(len(parts), np.iinfo(np.int64).max)
        entry = np.zeros(len(parts), np.int64)
        self._visit(self.root, parts, np.arange(len(parts)), best, entry)
        return entry, best

    def _visit(self, node: Node, parts, rows, best, entry) -> None:
        squares = squared_to(parts[rows], self.entries[node.points])
        self.measured += squares.size
        for i, point in enumerate(node.points):
            now, at = squares[:, i], best[rows]
            better = (now < at) | ((now == at) & (point < entry[rows]))
            best[rows[better]], entry[rows[better]] = now[better], point
        if not node.children:
            return
        roots = rooted(squares)
        for j, child in enumerate(node.children):
            reach = rooted(best[rows]) + SLACK
            near, far = roots - SLACK - reach[:, None], roots + SLACK + reach[:, None]
            inside = ((near <= node.high[:, j]) & (far >= node.low[:, j])).all(axis=1)
            if inside.any():
                self._visit(child, parts, rows[inside], best, entry)


@dataclass(frozen=True)
class Codes:
    """``coded`` (vec_id, label, code, error) and the final ``codebooks``
    (parts x entries x components)."""

    coded: DataFrame
    codebooks: np.ndarray


def encode(
    embeddings: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE
) -> Codes:
    raw = embeddings.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), F.col("embedding").alias("e")
    )
    size = F.size("e")
    kept = raw.where(is_finite_vector(F.col("e")) & (size > 0) & (F.pmod(size, F.lit(parts)) == 0))
    smallest = [F.col("vec_id").asc_nulls_last(), F.col("e")]
    found = kept.orderBy(*smallest).limit(1).collect()
    if not found:
        empty = kept.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
        return Codes(empty.limit(0), np.zeros((parts, 0, 0), np.int64))
    dims = len(found[0]["e"])
    width = dims // parts
    whole = kept.where(size == dims).withColumn("v", integers(F.col("e"), scale, dims))
    start = whole.orderBy(*smallest).limit(entries).select("v").collect()
    books = np.array([r["v"] for r in start], np.int64).reshape(-1, parts, width).transpose(1, 0, 2)
    n_entries = books.shape[1]
    table = stored(whole.select("vec_id", "label", "v"), "whole-vectors")

    def round_sums(now: np.ndarray) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            searches = [Search(book) for book in now]
            sums = [Sums(n_entries, width) for _ in now]
            for batch in in_chunks(batches):
                rows = matrix(batch.column("v"), dims)
                for p, search in enumerate(searches):
                    part = rows[:, p * width : (p + 1) * width]
                    sums[p].add(part, search.nearest(part)[0])
            counts, totals = np.concatenate([s.counts for s in sums]), np.concatenate([s.totals for s in sums])
            used = np.flatnonzero(counts)
            columns = [
                pa.array(used, pa.int32()), pa.array(counts[used], pa.int64()),
                pa.array(totals[used].tolist(), pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["centre", "n", "sums"])

        return table.select("v").mapInArrow(run, "centre int, n long, sums array<long>")

    for _ in range(rounds):
        total = Sums(parts * n_entries, width)
        for r in added_up(round_sums(books), "centre", width):
            total.counts[r["centre"]] = r["n"]
            total.totals[r["centre"]] = [r[f"s{i}"] for i in range(width)]
        books = total.moved(books.reshape(-1, width)).reshape(books.shape)

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches = [Search(book) for book in books]
        for batch in in_chunks(batches):
            rows = matrix(batch.column("v"), dims)
            named = [s.nearest(rows[:, p * width : (p + 1) * width]) for p, s in enumerate(searches)]
            index = np.stack([entry for entry, _ in named], axis=1).astype(np.uint8)
            error = np.sum([distance for _, distance in named], axis=0)
            code = pa.array([row.tobytes().hex() for row in index], pa.string())
            columns = [batch.column("vec_id"), batch.column("label"), code, pa.array(error, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "label", "code", "error"])

    return Codes(stored(table.mapInArrow(last, "vec_id long, label int, code string, error long"), "codes"), books)


def code_report(embeddings: DataFrame, **settings) -> DataFrame:
    """Per vector: vec_id, code, error, label_error, codebooks_sha256."""
    done = encode(embeddings, **settings)
    numbers = ",".join(map(str, done.codebooks.ravel().tolist()))
    unlabelled = F.col("label").isNull()
    rows = done.coded.select(
        "vec_id", "code", "error", unlabelled.alias("unlabelled"), F.coalesce("label", F.lit(0)).alias("label")
    )
    keys = ["unlabelled", "label"]
    sums = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("error").alias("label_error"))
    joined = with_group(rows, stored(sums, "label-errors"), keys, "n")
    return joined.select(
        "vec_id", "code", "error", "label_error",
        F.lit(hashlib.sha256(numbers.encode()).hexdigest()).alias("codebooks_sha256"),
    )
