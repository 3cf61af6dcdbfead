"""Removal of long repeated strings, found with suffix arrays.

A byte is removed if it lies in a string of ``LENGTH`` bytes that starts anywhere else
too. Equal strings hold the same least ``GRAM``-gram (by a hash; the leftmost of equals)
at the same place, so it suffices to compare strings that share this *anchor*:

1. Every text is cut into stretches: the bytes of consecutive strings with the same
   anchor. An anchor that occurs once settles its strings as unique.
2. Of the others, stretches equal in full (same anchor and digest, 128 bits) are
   counted; where there are two or more, all their strings are repeated.
3. Different stretches of one anchor are laid side by side in blocks of bounded size,
   and a suffix array is built of each block in two stages: suffixes smaller than
   their successor are sorted directly, all others are induced by scanning the buckets
   of first bytes in order. Strings whose common prefix with a neighbour in the array
   is ``LENGTH`` or more are repeated.

An anchor with more than ``STRETCHES`` different stretches is not laid side by side: its
strings are known by a 128-bit digest each, dealt by it, and counted one by one, so neither
a block nor what a task holds grows with the number of stretches or of equal strings.
Texts are shuffled once (both joins with them read the same exchange).

Defined cases: a null text is empty; texts shorter than ``LENGTH`` have no such string.
Rows that repeat an id and a text are two places, so each repeats the other; rows that
share only the id are told apart by their text's hash. A null id is an id like others.
An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gavel.llm.common import small_batches
from gavel.session import checkpoint_dir

LENGTH = 200
GRAM = 40  # long enough that different strings seldom share one; a multiple of 8
PLACES = LENGTH - GRAM + 1  # where in a string its anchor can be
# Long texts are scanned in pieces of so many string starts (positions take 20 bits).
PIECE = 1 << 19
# Different stretches of one anchor in one block, at most.
STRETCHES = 4000
BLOCK_BYTES = 1 << 20
FIRST = -(1 << 63)

_STRETCH = "anchor long, digest long, doc_key long, text_key long, start long, n long, place long"
_FRAGMENT = "anchor long, part long, doc_key long, text_key long, start long, copies int, bytes binary"


def least_grams(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every string start: position of its anchor; and the hash of every gram."""
    words = np.ndarray((len(data) - 7,), "<u8", data.tobytes(), strides=(1,)).copy()
    size = len(data) - GRAM + 1
    h = np.zeros(size, np.uint64)
    for k in range(0, GRAM, 8):
        h = (h ^ words[k : k + size]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    key = (h & ~np.uint64((1 << 20) - 1)) | np.arange(len(h), dtype=np.uint64)
    # least of every PLACES neighbours, from running minima within blocks
    n = len(key) - PLACES + 1
    padded = np.full(-(-len(key) // PLACES) * PLACES, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(key)] = key
    blocks = padded.reshape(-1, PLACES)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[:n], ahead[PLACES - 1 : PLACES - 1 + n])
    return (least & np.uint64((1 << 20) - 1)).astype(np.int64), h


def anchored(text: bytes) -> Iterator[tuple[int, bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per piece: where it begins, its bytes, and of its stretches the anchors, the first strings,
    their numbers and the anchors' places in the first strings."""
    for base in range(0, max(0, len(text) - LENGTH + 1), PIECE):
        piece = text[base : base + PIECE + LENGTH - 1]
        at, h = least_grams(np.frombuffer(piece, np.uint8))
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        number = np.diff(np.concatenate([first, [len(at)]]))
        yield base, piece, h[at[first]].view(np.int64), first, number, at[first] - first


def stretches(text: bytes) -> Iterator[tuple[int, int, int, int, int]]:
    """(anchor, digest, start, number of strings, anchor's place in the first string)."""
    for base, piece, *found in anchored(text):
        for anchor, start, n, place in zip(*(column.tolist() for column in found), strict=True):
            digest = hashlib.blake2b(piece[start : start + n + LENGTH - 1], digest_size=8, salt=bytes([place]))
            yield anchor, int.from_bytes(digest.digest(), "little", signed=True), base + start, n, place


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Starts of all suffixes in order of their first ``depth`` bytes (ties in any order).

    Directly sorted are only the suffixes smaller than their successor; in a scan over
    the buckets of first bytes every suffix then puts its predecessor in place.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    step = text[1:].astype(np.int16) - text[:-1]
    turns = np.where(step != 0, np.arange(n - 1), n - 1)
    turn = np.minimum.accumulate(turns[::-1])[::-1]  # where the run of equal bytes ends
    smaller = np.zeros(n, bool)
    inner = turn < n - 1
    smaller[:-1][inner] = step[turn[inner]] > 0
    raw = text.tobytes()
    direct = np.flatnonzero(smaller).tolist()
    direct.sort(key=lambda i: raw[i : i + depth])
    sorted_direct = np.array(direct, np.int64)
    heads = text[sorted_direct]
    bounds = np.searchsorted(heads, np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[text[-1]].append(np.array([n - 1]))
    out = []
    for byte in range(256):
        induced = waiting[byte]
        more = np.concatenate(induced) if induced else np.zeros(0, np.int64)
        while len(more):  # predecessors in the same bucket follow at once
            more = more[more > 0] - 1
            more = more[text[more] == byte]
            if len(more):
                induced.append(more)
        bucket = np.concatenate([*induced, sorted_direct[bounds[byte] : bounds[byte + 1]]])
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        head = text[before]
        larger = head > byte
        before, head = before[larger], head[larger]
        order = np.argsort(head, kind="stable")
        before, head = before[order], head[order]
        for piece in np.split(before, np.flatnonzero(np.diff(head)) + 1):
            if len(piece):
                waiting[text[piece[0]]].append(piece)
    return np.concatenate(out)


def common_prefixes(text: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Common prefix of each suffix with the one before it in ``order``, up to ``length``
    (in whole eight-byte steps; suffixes that end earlier count the bytes after as zero)."""
    padded = np.concatenate([text, np.zeros(length + 8, np.uint8)])
    words = np.ndarray((len(padded) - 7,), "<u8", padded.tobytes(), strides=(1,)).copy()
    shared = np.zeros(len(order), np.int64)
    pairs = np.arange(1, len(order))
    for at in range(0, length, 8):
        same = words[order[pairs] + at] == words[order[pairs - 1] + at]
        pairs = pairs[same]
        shared[pairs] = at + 8
        if not len(pairs):
            break
    return shared


def repeated_strings(fragments: list[tuple[bytes, int]]) -> list[np.ndarray]:
    """Per fragment: is the string at each start repeated, within or among the fragments?

    A fragment comes with the number of its copies elsewhere (2 for "two or more").
    """
    text = np.frombuffer(b"".join(f for f, _ in fragments), np.uint8)
    weight = np.concatenate(
        [np.concatenate([np.full(len(f) - LENGTH + 1, copies), np.zeros(LENGTH - 1, int)]) for f, copies in fragments]
    )
    order = suffix_array(text, LENGTH)
    run = np.cumsum(common_prefixes(text, order, LENGTH) < LENGTH)
    places = np.bincount(run, weights=weight[order])
    repeated = np.zeros(len(text), bool)
    repeated[order] = (places[run] >= 2) & (weight[order] > 0)
    ends = np.cumsum([len(f) for f, _ in fragments])
    return [repeated[end - len(f) : end - LENGTH + 1] for end, (f, _) in zip(ends, fragments, strict=True)]


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def _find_stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in _STRETCH.split(", ")]
    for batch in batches:
        columns: list[list[int]] = [[] for _ in names]
        for doc, key, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            for anchor, digest, start, n, place in stretches(text):
                for column, value in zip(columns, (anchor, digest, doc, key, start, n, place), strict=True):
                    column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)


def _find_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The anchors of all stretches alone: what counts them needs no digests."""
    for batch in batches:
        found = [anchors for text in batch.column(0).to_pylist() for _, _, anchors, *_ in anchored(text)]
        column = np.concatenate([np.zeros(0, np.int64), *found])
        yield pa.RecordBatch.from_arrays([pa.array(column, pa.int64())], names=["anchor"])


def _cut_fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in _FRAGMENT.split(", ")]
    kinds = [pa.int64()] * 5 + [pa.int32(), pa.binary()]

    def emit(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names
        )

    for batch in batches:
        rows, held = [], 0
        for doc, key, text, needs in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            for need in needs:
                start, n, copies = need["start"], need["n"], min(2, need["copies"])
                if need["n_different"] <= STRETCHES:
                    data = text[start : start + n + LENGTH - 1]
                    rows.append((need["anchor"], 0, doc, key, start, copies, data))
                    held += len(data)
                else:
                    for at in range(start, start + n):
                        data = hashlib.blake2b(text[at : at + LENGTH], digest_size=16).digest()
                        part = -1 - (int.from_bytes(data[:8], "little") >> 1)  # below zero: digests
                        rows.append((need["anchor"], part, doc, key, at, copies, data))
                        held += 64
                if held > 1 << 22:
                    yield emit(rows)
                    rows, held = [], 0
        if rows:
            yield emit(rows)


def _search_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of repeated strings; the rows of one (anchor, part) come one after another."""
    held: list[tuple[int, int, int, int, bytes]] = []
    size, last = 0, None

    # of digests only the first place of each in this part is kept, and none once it is told
    spans: list[tuple[int, int, int, int]] = []
    firsts: dict[bytes, tuple[int, int, int] | None] = {}

    def table(spans: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*spans, strict=True)) if spans else [[], [], [], []]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int64()) for c in columns], names=["doc_key", "text_key", "start", "stop"]
        )

    def search() -> pa.RecordBatch:
        spans = []
        for (doc, key, start, _, _), flags in zip(
            held, repeated_strings([(data, copies) for *_, copies, data in held]), strict=True
        ):
            spans.extend((doc, key, start + a, start + b + LENGTH - 1) for a, b in _runs(flags))
        return table(spans)

    for batch in batches:
        for anchor, part, *row in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
            if (anchor, part) != last:
                firsts = {}
                if size >= BLOCK_BYTES:
                    yield search()
                    held, size = [], 0
            last = (anchor, part)
            if part >= 0:
                held.append(tuple(row))
                size += len(row[-1])
                continue
            *place, copies, digest = row
            if digest not in firsts and copies < 2:
                firsts[digest] = tuple(place)
                continue
            for told in filter(None, (firsts.get(digest), place)):
                spans.append((*told, told[2] + LENGTH))
            firsts[digest] = None
            if len(spans) >= 1 << 14:
                yield table(spans)
                spans = []
    if held:
        yield search()
    if spans:
        yield table(spans)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc_id, text, spans in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            removed, kept, at, n_spans = 0, hashlib.sha256(), 0, 0
            for start, stop in merged_spans(spans or []):
                kept.update(text[at:start])
                removed, at, n_spans = removed + stop - start, stop, n_spans + 1
            kept.update(text[at:])
            rows.append((doc_id, len(text), removed, n_spans, kept.hexdigest()))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int64()) for c in columns[:4]] + [pa.array(columns[4], pa.string())],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        )


def merged_spans(spans: list[dict]) -> list[tuple[int, int]]:
    """Spans in order; touching ones become one."""
    out: list[tuple[int, int]] = []
    for start, stop in sorted((s["start"], s["stop"]) for s in spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(stop, out[-1][1]))
        else:
            out.append((start, stop))
    return out


def keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST)).alias("doc_key"),
        F.xxhash64(text).alias("text_key"),
        text.cast("binary").alias("text"),
    )


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_key, text_key, start, stop): byte spans of ``keyed`` rows that are repeated."""
    spark = docs.sparkSession
    raw = docs.select("doc_key", "text_key", "text").mapInArrow(_find_stretches, _STRETCH)
    every = docs.select("text").mapInArrow(_find_anchors, "anchor long")
    shared = every.groupBy("anchor").agg(F.count("*").alias("places")).where("places > 1").select("anchor")
    path = f"{checkpoint_dir(spark)}/stretches-{uuid4()}"
    raw.join(shared, "anchor").write.parquet(path)
    found = spark.read.schema(_STRETCH).parquet(path)
    different = found.groupBy("anchor", "digest").agg(
        F.count("*").alias("copies"), F.min(F.struct("doc_key", "text_key", "start")).alias("first")
    )
    anchors = different.groupBy("anchor").agg(F.count("*").alias("n_different"))
    known = found.join(different, ["anchor", "digest"]).join(anchors, "anchor")
    whole = known.where("copies > 1").select(
        "doc_key", "text_key", "start", (F.col("start") + F.col("n") + (LENGTH - 1)).alias("stop")
    )
    needs = (
        known.where("n_different > 1")
        .where((F.col("copies") == 1) | (F.col("first") == F.struct("doc_key", "text_key", "start")))
        .groupBy("doc_key", "text_key")
        .agg(F.collect_list(F.struct("anchor", "n_different", "copies", "start", "n")).alias("needs"))
    )
    fragments = (
        docs.join(needs, ["doc_key", "text_key"])
        .select("doc_key", "text_key", "text", "needs")
        .mapInArrow(_cut_fragments, _FRAGMENT)
    )
    partial = (
        fragments.repartition("anchor", "part")
        .sortWithinPartitions("anchor", "part")
        .mapInArrow(_search_blocks, "doc_key long, text_key long, start long, stop long")
    )
    return whole.union(partial)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    small_batches(docs.sparkSession)
    rows = keyed(docs)
    spans = (
        repeated_spans(rows)
        .groupBy("doc_key", "text_key")
        .agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    )
    return (
        rows.join(spans, ["doc_key", "text_key"], "left")
        .select("doc_id", "text", "spans")
        .mapInArrow(_digests, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    )
