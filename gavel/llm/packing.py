"""Best-fit packing by linear grouping.

Documents become pieces of at most ``CAPACITY`` tokens; the pieces are packed into as
few sequences as possible. Only the number of pieces of each length matters for the
plan, so the driver works on at most ``CAPACITY`` counts, whatever the input:

1. Lengths above a share of a sequence are large. Sorted, they are cut into groups of
   equal cardinality, and each length is rounded up to the largest of its group.
2. The configurations of these few sizes (multisets that fit one sequence) are
   optimised: a linear program over all configurations, solved by column generation,
   whose whole parts say how often each configuration is used.
3. The actual pieces are substituted for the rounded ones, longest first in each
   group, which leaves every sequence at least the room its configuration left.
4. The large pieces not covered by whole configurations, and then the small ones, go
   longest first to the sequence with the least room that takes them (best fit);
   where none does, to a new one.

The plan is a table of runs: pieces of one length, ranks from r on, go to consecutive
sequences. A run ends where a length or a configuration ends, so the number of runs is
bounded by the lengths and configurations, not by the pieces. Pieces get their rank
within their length from a distributed sort and look their place up.

Defined cases: a null text is empty and packs as its end id alone. Rows that repeat an
id, and null ids, are pieces like others. An empty table packs into nothing.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gavel.llm.common import small_batches, with_global_index
from gavel.llm.word_tokens import word_ids
from gavel.session import cut_lineage

CAPACITY = 4096
END_ID = 1
# Settings tried; the plan with the fewest sequences counts. (share of a sequence up to
# which a length is small and only best-fitted, number of groups)
SETTINGS = [(8, 40), (4, 100), (2, 60)]
# Pivots after which the linear program is taken as it stands (any basis is feasible).
PIVOTS = 600

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces_of(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: its place in its document and the checksum of its ids."""
    small_batches(docs.sparkSession)
    end = END_ID.to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = word_ids(vocabulary).ids
        for batch in batches:
            out: list[list[int]] = [[], [], [], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = ids_of(text) + end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    row = (doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part))
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(out, types, strict=True)],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"),
    )
    return rows.mapInArrow(cut, PIECES)


def linear_groups(counts: dict[int, int], groups: int, small: int) -> list[tuple[int, int]]:
    """(rounded size, number of pieces) of groups of equal cardinality, largest first."""
    large = [(length, n) for length, n in sorted(counts.items(), reverse=True) if length > small]
    total = sum(n for _, n in large)
    out: list[tuple[int, int]] = []
    if not total:
        return out
    size = -(-total // groups)
    taken, rounded, filled = 0, large[0][0], 0
    for length, n in large:
        while n:
            if filled == size:
                out.append((rounded, filled))
                filled = 0
            if not filled:
                rounded = length
            take = min(n, size - filled)
            filled, n, taken = filled + take, n - take, taken + take
    out.append((rounded, filled))
    return out


def best_configuration(sizes: list[int], worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The multiset of sizes of greatest worth that fits (unbounded knapsack)."""
    value, picks = np.zeros(capacity + 1), []
    for _ in range(capacity // min(sizes)):  # one more piece each time
        gains = np.full((len(sizes), capacity + 1), -1.0)
        for g, size in enumerate(sizes):
            gains[g, size:] = worth[g] + value[:-size]
        best = gains.max(axis=0)
        better = best > value + 1e-12
        if not better.any():
            break
        picks.append(np.where(better, gains.argmax(axis=0), -1))
        value = np.where(better, best, value)
    pattern, room = np.zeros(len(sizes)), capacity
    for pick in reversed(picks):
        if (g := pick[room]) >= 0:
            pattern[g] += 1
            room -= sizes[g]
    return float(value[capacity]), pattern


def configurations(groups: list[tuple[int, int]], capacity: int) -> list[tuple[list[int], int]]:
    """(how many of each group, times used): whole parts of the fractional optimum.

    Simplex by columns: start from sequences of one size each; price the sizes with the
    basis' duals; bring in the best-priced configuration; stop when none improves.
    """
    if not groups:
        return []
    sizes, need = [g[0] for g in groups], np.array([g[1] for g in groups], float)
    basis = np.diag([float(capacity // s) for s in sizes])
    amount = need / np.diag(basis)
    for _ in range(PIVOTS):
        worth = np.linalg.solve(basis.T, np.ones(len(sizes)))
        best, pattern = best_configuration(sizes, np.maximum(worth, 0), capacity)
        if best <= 1 + 1e-9:
            break
        direction = np.linalg.solve(basis, pattern)
        with np.errstate(divide="ignore", invalid="ignore"):
            ratios = np.where(direction > 1e-9, amount / direction, np.inf)
        leaving = int(np.argmin(ratios))
        if not np.isfinite(ratios[leaving]):
            break
        basis[:, leaving] = pattern
        amount = np.maximum(np.linalg.solve(basis, need), 0)
    used: dict[tuple, int] = defaultdict(int)
    for column, times in zip(basis.T, amount, strict=True):
        if whole := int(np.floor(times + 1e-9)):
            used[tuple(int(x) for x in column)] += whole
    left = [g[1] for g in groups]
    out = []
    for pattern, times in used.items():  # rounding errors must not ask for more than there is
        times = min([times, *(left[g] // k for g, k in enumerate(pattern) if k)])
        if times:
            left = [n - times * k for n, k in zip(left, pattern, strict=True)]
            out.append((list(pattern), times))
    return out


class Plan:
    """Runs of pieces: (length, first rank, pieces, first sequence, per sequence, offset)."""

    def __init__(self) -> None:
        self.runs: list[tuple[int, int, int, int, int, int]] = []
        self.next_rank: dict[int, int] = defaultdict(int)
        self.sequences = 0

    def place(self, length: int, n: int, sequence: int, per: int, offset: int) -> None:
        self.runs.append((length, self.next_rank[length], n, sequence, per, offset))
        self.next_rank[length] += n


def plan_packing(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """The best packing found of ``counts[length]`` pieces of each length (1 to ``capacity``)."""
    plans = (grouped_packing(counts, capacity, capacity // share, groups) for share, groups in SETTINGS)
    return min(plans, key=lambda plan: plan.sequences)


def grouped_packing(counts: dict[int, int], capacity: int, small: int, groups: int) -> Plan:
    """One packing by linear grouping: lengths above ``small`` in ``groups`` groups."""
    plan = Plan()
    left = dict(counts)
    if full := left.pop(capacity, 0):
        plan.place(capacity, full, 0, 1, 0)
        plan.sequences = full
    rooms: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room -> (first sequence, number)
    grouped = linear_groups(left, groups, small)
    used = configurations(grouped, capacity)
    # every group's actual lengths, longest first
    members: list[list[list[int]]] = []
    order = iter(sorted(((length, n) for length, n in left.items() if length > small), reverse=True))
    length, n = next(order, (0, 0))
    for _, size in grouped:
        mine: list[list[int]] = []
        while size:
            take = min(n, size)
            mine.append([length, take])
            size, n = size - take, n - take
            if not n:
                length, n = next(order, (0, 0))
        members.append(mine)
    for pattern, times in used:
        # each slot of the configuration takes the next ``times`` pieces of its group
        slots = []
        for group, copies in enumerate(pattern):
            for _ in range(copies):
                slot, want = [], times
                while want:
                    head = members[group][0]
                    take = min(want, head[1])
                    slot.append((head[0], take))
                    want -= take
                    head[1] -= take
                    if not head[1]:
                        members[group].pop(0)
                slots.append(slot)
        # runs of sequences in which no slot changes its length
        at = 0
        places = [0] * len(slots)
        within = [0] * len(slots)
        while at < times:
            step = min(slot[p][1] - w for slot, p, w in zip(slots, places, within, strict=True))
            offset = 0
            for i, slot in enumerate(slots):
                length = slot[places[i]][0]
                plan.place(length, step, plan.sequences, 1, offset)
                left[length] -= step
                offset += length
                within[i] += step
                if within[i] == slot[places[i]][1]:
                    places[i], within[i] = places[i] + 1, 0
            rooms[capacity - offset].append((plan.sequences, step))
            plan.sequences += step
            at += step
    _best_fit(plan, left, rooms, capacity)
    return plan


def _best_fit(plan: Plan, left: dict[int, int], rooms: dict[int, list[tuple[int, int]]], capacity: int) -> None:
    """Longest first, to the least room that suffices; equal sequences are filled together."""
    open_rooms = sorted(room for room, found in rooms.items() if room and found)
    for length in sorted((length for length, n in left.items() if n > 0), reverse=True):
        n = left[length]
        while n:
            where = bisect_left(open_rooms, length)
            if where == len(open_rooms):
                per = capacity // length
                whole, rest = divmod(n, per)
                for number, each in ((whole, per), (min(rest, 1), rest)):
                    if number:
                        plan.place(length, number * each, plan.sequences, each, 0)
                        _give(rooms, open_rooms, capacity - each * length, (plan.sequences, number))
                        plan.sequences += number
                break
            room = open_rooms[where]
            first, number = rooms[room].pop()
            if not rooms[room]:
                open_rooms.pop(where)
            per = room // length
            if n >= number * per:
                use, each = number, per
            else:
                use, each = (n // per, per) if n >= per else (1, n)
            plan.place(length, use * each, first, each, capacity - room)
            n -= use * each
            _give(rooms, open_rooms, room - each * length, (first, use))
            if use < number:
                _give(rooms, open_rooms, room, (first + use, number - use))


def _give(rooms: dict, open_rooms: list[int], room: int, found: tuple[int, int]) -> None:
    if not room:
        return
    if not rooms[room]:
        insort(open_rooms, room)
    rooms[room].append(found)


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    # written out first: ordering reads the pieces twice, and tokenizing is the dear part
    pieces = cut_lineage(pieces_of(docs, vocabulary, capacity))
    cut = with_global_index(pieces, ["length", "doc_id", "piece", "ids_crc32"], "row_index")
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = plan_packing(counts, capacity)
    starts, before = {}, 0
    for length in sorted(counts):
        starts[length] = before
        before += counts[length]
    # a run's pieces are rows from..from+n-1 of the order by length
    runs = sorted((starts[length] + rank, first, per, offset, length) for length, rank, _, first, per, offset in plan.runs)
    table = spark.sparkContext.broadcast(np.array(runs, np.int64).reshape(-1, 5))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = table.value
        for batch in batches:
            row = batch.column("row_index").to_numpy()
            start, first, per, offset, length = run[np.searchsorted(run[:, 0], row, "right") - 1].T
            sequence = first + (row - start) // per
            at = offset + (row - start) % per * length
            columns = {n: batch.column(n) for n in ("doc_id", "piece", "start", "length", "ids_crc32")}
            columns |= {"sequence_id": pa.array(sequence), "offset": pa.array(at)}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return cut.mapInArrow(place, f"{PIECES}, sequence_id long, offset long")


def packed_length(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """Per sequence: how many pieces and tokens it holds."""
    return pack(docs, vocabulary, capacity).groupBy("sequence_id").agg(
        F.count("*").alias("n_pieces"), F.sum("length").alias("n_tokens")
    )
