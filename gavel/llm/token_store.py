"""Token ids in directly addressable codes.

An id is cut into chunks of eight bits, low chunk first. Level 0 holds the first chunk
of every id, level j the j-th chunk of those ids that need one. Beside each level lies
a bitmap, one bit per entry: does this id continue on the next level? Where it does,
the entry's place there is the number of set bits before it, which the rank directory
gives in one look-up (counts at every 512 bits) and the popcount of at most 64 bytes.
So any token of a file is read from a few bytes, without decoding its neighbours.

A store is a table of blocks in ascending document order. A block holds the
documents of one stretch of ids, about ``BLOCK_TOKENS`` tokens of them; a document is
never cut, so a very long one is a block of its own. Layout of a block (little-endian):

    b"DAC1" | levels u32 | tokens u64 | per level: entries u64, chunk bytes, bitmap
    (entries bits, padded to bytes), directory (u64 at every 512 bits)

and the block's row carries the documents' ids and their token starts in the block.

Defined cases: a null text is empty and holds just the end id. Null ids come first in
the order, rows that repeat an id follow each other (ties by text hash). An empty
table gives an empty store.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gavel.llm.common import small_batches
from gavel.llm.word_tokens import word_ids
from gavel.session import checkpoint_dir

END_ID = 2
BLOCK_TOKENS = 1 << 19
RANK_BITS = 512
MAGIC = b"DAC1"

BLOCK_SCHEMA = "part long, block_start long, n_tokens long, doc_ids array<long>, starts array<long>, payload binary"


def encode_block(ids: np.ndarray) -> bytes:
    """Directly addressable codes of unsigned 32-bit ids."""
    levels, rest = [], ids.astype(np.uint32)
    while True:
        more = rest >> 8
        goes_on = more > 0
        bits = np.packbits(goes_on, bitorder="little")
        per_step = np.add.reduceat(goes_on, np.arange(0, len(rest), RANK_BITS)) if len(rest) else np.zeros(0, np.int64)
        ranks = np.concatenate([[0], np.cumsum(per_step, dtype=np.uint64)])[:-1] if len(rest) else per_step
        levels.append(
            len(rest).to_bytes(8, "little")
            + (rest & 0xFF).astype(np.uint8).tobytes()
            + bits.tobytes()
            + ranks.astype("<u8").tobytes()
        )
        rest = more[goes_on]
        if not len(rest):
            break
    head = MAGIC + len(levels).to_bytes(4, "little") + len(ids).to_bytes(8, "little")
    return head + b"".join(levels)


class Block:
    """Reads an encoded block: one token, a range, or all."""

    def __init__(self, payload: bytes):
        if payload[:4] != MAGIC:
            raise ValueError("not a block of directly addressable codes")
        n_levels = int.from_bytes(payload[4:8], "little")
        self.n_tokens = int.from_bytes(payload[8:16], "little")
        self.levels, at = [], 16
        for _ in range(n_levels):
            n = int.from_bytes(payload[at : at + 8], "little")
            at += 8
            n_bits, n_ranks = (n + 7) // 8, (n + RANK_BITS - 1) // RANK_BITS
            chunks = np.frombuffer(payload, np.uint8, n, at)
            bits = np.frombuffer(payload, np.uint8, n_bits, at + n)
            ranks = np.frombuffer(payload, "<u8", n_ranks, at + n + n_bits)
            at += n + n_bits + 8 * n_ranks
            self.levels.append((chunks, bits, ranks))

    def token(self, place: int) -> int:
        """The token at ``place``: one byte per level and one rank per step up."""
        if not 0 <= place < self.n_tokens:
            raise IndexError(place)
        value = 0
        for level, (chunks, bits, ranks) in enumerate(self.levels):
            value |= int(chunks[place]) << (8 * level)
            if not bits[place >> 3] >> (place & 7) & 1:
                break
            place = self._rank(bits, ranks, place)
        return value

    @staticmethod
    def _rank(bits: np.ndarray, ranks: np.ndarray, place: int) -> int:
        step = place // RANK_BITS
        before = bits[step * RANK_BITS // 8 : place >> 3].tobytes()
        partial = int(bits[place >> 3]) & ((1 << (place & 7)) - 1)
        return int(ranks[step]) + int.from_bytes(before, "little").bit_count() + partial.bit_count()

    def tokens(self, start: int, stop: int) -> np.ndarray:
        """The tokens of [start, stop): a contiguous piece of every level."""
        values, shift = np.zeros(max(0, stop - start), np.uint32), 0
        at = np.arange(len(values))
        for chunks, bits, ranks in self.levels:
            if stop <= start:
                break
            values[at] |= chunks[start:stop].astype(np.uint32) << shift
            first = start & ~7
            goes_on = np.unpackbits(bits[first >> 3 : (stop + 7) >> 3], bitorder="little")
            goes_on = goes_on[start - first : stop - first].astype(bool)
            start = self._rank(bits, ranks, start)
            stop = start + int(goes_on.sum())
            at, shift = at[goes_on], shift + 8
        return values


def write_store(docs: DataFrame, path: str, vocabulary: str) -> None:
    """Encode ``docs`` (doc_id, text) into a store at ``path``."""
    small_batches(docs.sparkSession)
    ordered = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"),
    ).withColumn("tie", F.xxhash64("text"))
    ranged = ordered.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    ranged.drop("tie").mapInArrow(_encoder(vocabulary), BLOCK_SCHEMA).write.parquet(path)


def _encoder(vocabulary: str):
    end = END_ID.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = word_ids(vocabulary).ids
        part, before = TaskContext.get().partitionId(), 0
        held, doc_ids, starts, n = [], [], [], 0

        def flush() -> pa.RecordBatch:
            payload = encode_block(np.frombuffer(b"".join(held), "<u4"))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int64()),
                    pa.array([before], pa.int64()),
                    pa.array([n], pa.int64()),
                    pa.array([doc_ids], pa.list_(pa.int64())),
                    pa.array([starts], pa.list_(pa.int64())),
                    pa.array([payload], pa.binary()),
                ],
                names=["part", "block_start", "n_tokens", "doc_ids", "starts", "payload"],
            )

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = ids_of(text) + end
                if n and n + len(ids) // 4 > BLOCK_TOKENS:
                    yield flush()
                    before, held, doc_ids, starts, n = before + n, [], [], [], 0
                doc_ids.append(doc_id)
                starts.append(n)
                held.append(ids)
                n += len(ids) // 4
        if n:
            yield flush()

    return run


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """The store's blocks with ``first_token``, the tokens of all blocks before.

    Only a token count per range of documents goes through the driver.
    """
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(path)
    sizes = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()
    starts, total = [], 0
    for part, n in sorted((r["part"], r["n"]) for r in sizes):
        starts.append((part, total))
        total += n
    table = spark.createDataFrame(starts, "part long, part_start long")
    return (
        blocks.join(F.broadcast(table), "part")  # one row per range
        .withColumn("first_token", F.col("part_start") + F.col("block_start"))
        .drop("part_start", "block_start")
    )


def document_digests(store: DataFrame) -> DataFrame:
    """Per document of a store: doc_id, start, n_tokens, ids_crc32, all read back from its codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, doc_ids, starts, payload in zip(
                *(batch.column(c).to_pylist() for c in ("first_token", "doc_ids", "starts", "payload")), strict=True
            ):
                block = Block(payload)
                ends = [*starts[1:], block.n_tokens]
                # each document by itself, through the rank directories
                ids = [block.tokens(s, e).astype("<u4").tobytes() for s, e in zip(starts, ends, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(doc_ids, pa.int64()),
                        pa.array([first + s for s in starts], pa.int64()),
                        pa.array([e - s for s, e in zip(starts, ends, strict=True)], pa.int64()),
                        pa.array([zlib.crc32(i) for i in ids], pa.int64()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    small = store.select("first_token", "doc_ids", "starts", "payload")
    return small.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def store_round_trip(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Write a store in the shared folder and read every document back from it."""
    spark = docs.sparkSession
    path = f"{checkpoint_dir(spark)}/token-store-{uuid4()}"
    write_store(docs, path, vocabulary)
    return document_digests(read_store(spark, path))
