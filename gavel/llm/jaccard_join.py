"""Near-duplicate documents by the Jaccard similarity of their five-word shingles.

The overlaps of documents are the entries of the product of the document by shingle
incidence matrix with its transpose. It is computed only where it can reach the bound:

* Documents with equal shingle sets are one row of the matrix.
* Shingles are ordered from rare to frequent (by counts in ``BUCKETS`` hash buckets over
  all documents; any one order is right, this one is fast). Two sets with similarity
  80 % share a shingle among the first fifth of both, and at their first common shingle
  the sizes and what is left of either set bound the overlap they can still reach.
* Of the sets that share such a shingle, each first meets the one in which it comes
  earliest. What the product confirms is joined into components; only pairs that could
  still connect different components are multiplied next, and that is all of them.
* The product runs in blocks: one set's row against the rows of up to ``BLOCK`` others,
  adding up the overlap of each, and pairs below the bound of their sizes are dropped.

Shingles are compared by 64-bit hashes, sets by a 64-bit digest of their sorted hashes.

Defined cases: texts of one to four words have their whole sequence as one shingle; null
texts and texts without words have none and are linked with nothing. A null id takes
part; a component's id is its least id that is not null. Rows that repeat an id are
documents of their own. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gavel.llm.common import shuffles_dropped, small_batches
from gavel.llm.components import connected_components
from gavel.session import checkpoint_dir, cut_lineage

WORDS = 5
BUCKET_BITS = 18
BUCKETS = 1 << BUCKET_BITS
# A shingle whose bucket counts this many times the mean, and at least HOT_LEAST more, is dealt apart.
HOT = 2
HOT_LEAST = 1000
HOT_SALTS = 32
BLOCK = 256
FIRST = -(1 << 63)

_DOC = "doc_id long, text_key long, n long, set_key long, bucket int, seen long"
_PREFIX = "token long, set_key long, n int, at int, hot boolean"
_ROW = "a long, salt long, role int, set_key long, shingles binary"


def shingle_set(text: bytes | None) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    words = text.lower().split() if text else []  # both only touch ASCII in bytes
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    span = min(WORDS, len(words))
    mixed = np.full(len(words) - span + 1, span, np.uint64)
    for k in range(span):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - span + 1 + k]
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def set_digest(shingles: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def buckets_of(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def prefix_length(n: int) -> int:
    """How many of the first shingles a similar set must share one of."""
    return n - -(-8 * n // 10) + 1


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per document, and at the end one per bucket with its count."""
    names = [f.split()[0] for f in _DOC.split(", ")]
    kinds = [pa.int64()] * 4 + [pa.int32(), pa.int64()]
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        rows = []
        for doc_id, key, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            shingles = shingle_set(text)
            np.add.at(total, buckets_of(shingles), 1)
            digest = set_digest(shingles) if len(shingles) else None
            rows.append((doc_id, key, len(shingles), digest, None, None))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)
    seen = np.flatnonzero(total)
    empty = pa.nulls(len(seen), pa.int64())
    yield pa.RecordBatch.from_arrays(
        [empty] * 4 + [pa.array(seen, pa.int32()), pa.array(total[seen], pa.int64())], names=names
    )


def _prefixes(counts):
    names = [f.split()[0] for f in _PREFIX.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counts.value
        limit = HOT * count.mean() + HOT_LEAST
        met: set[int] = set()  # equal sets of this task's rows go out once
        for batch in batches:
            parts = []
            for text in batch.column(0).to_pylist():
                shingles = shingle_set(text)
                if not len(shingles) or (key := set_digest(shingles)) in met:
                    continue
                met.add(key)
                often = count[buckets_of(shingles)]
                first = np.lexsort((shingles, often))[: prefix_length(len(shingles))]
                parts.append((shingles[first].view(np.int64), key, len(shingles), often[first] > limit))
            if not parts:
                continue
            sizes = [len(p[0]) for p in parts]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([p[0] for p in parts])),
                    pa.array(np.repeat([p[1] for p in parts], sizes)),
                    pa.array(np.repeat([p[2] for p in parts], sizes).astype(np.int32)),
                    pa.array(np.concatenate([np.arange(s, dtype=np.int32) for s in sizes])),
                    pa.array(np.concatenate([p[3] for p in parts])),
                ],
                names=names,
            )

    return run


def _can_reach(n: Column, at: Column, m: Column, at_m: Column) -> Column:
    """Could sets of n and m shingles, whose first common one is at these places, be similar?"""
    left = F.least(n - at, m - at_m)
    return (9 * left >= 4 * (n + m)) & (10 * F.least(n, m) >= 8 * F.greatest(n, m))


def _memberships(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the blocks a needed set belongs to."""
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
    names = [f.split()[0] for f in _ROW.split(", ")]
    for batch in batches:
        rows, held = [], 0
        for text, key, blocks in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            shingles = shingle_set(text)
            if not len(shingles) or set_digest(shingles) != key:
                continue  # another text under the same id
            data = shingles.tobytes()
            for block in blocks:
                rows.append((block["a"], block["salt"], block["role"], key, data))
                held += len(data)
                if held > 1 << 23:
                    yield _rows(rows, kinds, names)
                    rows, held = [], 0
        if rows:
            yield _rows(rows, kinds, names)


def _rows(rows: list[tuple], kinds: list, names: list[str]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Overlaps of each block's first row with its others; the rows of a block follow each other."""
    block, row, others, size = None, np.zeros(0, np.uint64), [], 0

    def product() -> pa.RecordBatch:
        columns = np.concatenate([s for _, s in others])
        starts = np.cumsum([0, *(len(s) for _, s in others)])[:-1]
        at = np.minimum(np.searchsorted(row, columns), len(row) - 1)
        overlap = np.add.reduceat(row[at] == columns, starts, dtype=np.int64)
        sizes = np.array([len(s) for _, s in others])
        linked = 9 * overlap >= 4 * (sizes + len(row))
        found = [key for (key, _), yes in zip(others, linked, strict=True) if yes]
        return pa.RecordBatch.from_arrays(
            [pa.array([block[0]] * len(found), pa.int64()), pa.array(found, pa.int64())], names=["a", "b"]
        )

    for batch in batches:
        for a, salt, role, key, data in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            shingles = np.frombuffer(data, np.uint64)
            if (a, salt) != block or size > 1 << 22:
                if others:
                    yield product()
                others, size = [], 0
            if (a, salt) != block or role == 0:
                block, row = (a, salt), shingles
            else:
                others.append((key, shingles))
                size += len(shingles)
    if others:
        yield product()


def confirmed(pairs: DataFrame, docs: DataFrame, places: DataFrame) -> DataFrame:
    """The ``pairs`` (a, b) of set keys that are similar: their rows multiplied in blocks.

    Texts meet the list of those needed by a sorted merge, at every size.
    """
    number = pairs.groupBy("a").agg(F.count("*").alias("number"))
    salted = pairs.join(number.hint("merge"), "a").select(
        "a", "b", F.pmod(F.xxhash64("b"), 1 + F.expr(f"number div {BLOCK}")).alias("salt")
    )
    members = salted.select(F.col("b").alias("set_key"), "a", "salt", F.lit(1).alias("role"))
    heads = salted.select(F.col("a").alias("set_key"), "a", "salt", F.lit(0).alias("role")).distinct()
    needs = (
        members.union(heads)
        .groupBy("set_key")
        .agg(F.collect_list(F.struct("a", "salt", "role")).alias("blocks"))
        .join(places.hint("merge"), "set_key")
    )
    rows = docs.join(needs.hint("merge"), "doc_key").select("text", "set_key", "blocks").mapInArrow(_memberships, _ROW)
    return (
        rows.repartition("a", "salt")
        .sortWithinPartitions("a", "salt", "role")
        .mapInArrow(_multiply, "a long, b long")
        .distinct()
    )


def similar_sets(docs: DataFrame, described: DataFrame, counts: np.ndarray) -> DataFrame:
    """(node, root): components of the set keys that are linked with another set."""
    spark = docs.sparkSession
    places = described.groupBy("set_key").agg(F.min("doc_key").alias("doc_key")).where("set_key IS NOT NULL")
    rows = docs.select("text").mapInArrow(_prefixes(spark.sparkContext.broadcast(counts)), _PREFIX)
    salt = F.when(F.col("hot"), F.pmod("set_key", F.lit(HOT_SALTS))).otherwise(0)
    # a shingle that is not hot is bounded by its bucket's count; the sets that hold it in
    # order of size show whether any other is of a size that can be similar
    alike = Window.partitionBy("token", "salt").orderBy("n", "set_key")
    shared = (
        rows.withColumn("salt", salt)
        .withColumn("smaller", F.lag("n").over(alike))
        .withColumn("larger", F.lead("n").over(alike))
        # a larger set can only be similar if enough is left from this place on
        .where("hot OR 10 * smaller >= 8 * n OR (10 * n >= 8 * larger AND 9 * (n - at) >= 4 * (n + larger))")
        .select("token", "set_key", "n", "at")
    )
    path = f"{checkpoint_dir(spark)}/prefixes-{uuid4()}"
    shared.write.parquet(path)
    prefixes = spark.read.schema("token long, set_key long, n int, at int").parquet(path)
    lead = prefixes.groupBy("token").agg(F.min(F.struct("at", "set_key", "n")).alias("lead"))
    # what grows with the documents is joined by sorted merges at every size
    first = (
        prefixes.join(lead.hint("merge"), "token")
        .where(F.col("lead.set_key") != F.col("set_key"))
        .where(_can_reach(F.col("n"), F.col("at"), F.col("lead.n"), F.col("lead.at")))
        .select(F.col("lead.set_key").alias("a"), F.col("set_key").alias("b"))
        .distinct()
    )
    first = cut_lineage(first)
    links = cut_lineage(confirmed(first, docs, places))
    known = connected_components(links)
    # what could still connect two components: one of the pair is not with its shingle's lead
    root = F.coalesce("root", "set_key")
    rooted = prefixes.join(known.hint("merge"), F.col("set_key") == F.col("node"), "left").select(
        "token", "set_key", "n", "at", root.alias("root")
    )
    led = lead.select("token", F.col("lead.set_key").alias("set_key")).join(
        known.hint("merge"), F.col("set_key") == F.col("node"), "left"
    ).select("token", root.alias("lead_root"))
    apart = rooted.join(led.hint("merge"), "token").where("root != lead_root").select(
        "token", *[F.col(c).alias(f"x_{c}") for c in ("set_key", "n", "at", "root")]
    )
    rest = (
        apart.join(
            rooted,
            (apart["token"] == rooted["token"])
            & (F.col("x_root") != F.col("root"))
            & _can_reach(F.col("x_n"), F.col("x_at"), F.col("n"), F.col("at")),
        )
        .select(F.least("x_set_key", "set_key").alias("a"), F.greatest("x_set_key", "set_key").alias("b"))
        .distinct()
        .join(first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
    )
    more = confirmed(cut_lineage(rest), docs, places)
    return connected_components(links.union(more))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id, and the row's ``text_key`` and
    its component's ``root`` (a key of one of its shingle sets)."""
    spark = docs.sparkSession
    small_batches(spark)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST)).alias("doc_key"), text.cast("binary").alias("text")
    )
    path = f"{checkpoint_dir(spark)}/sets-{uuid4()}"
    docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.cast("binary").alias("text")
    ).mapInArrow(_describe, _DOC).write.parquet(path)
    table = spark.read.schema(_DOC).parquet(path)
    counts = np.zeros(BUCKETS, np.int64)
    # one sum per bucket: BUCKETS rows at most
    sums = table.where("bucket IS NOT NULL").groupBy("bucket").agg(F.sum("seen").alias("seen")).toPandas()
    counts[sums["bucket"].to_numpy(np.int64)] = sums["seen"].to_numpy(np.int64)
    described = table.where("bucket IS NULL").select(
        "doc_id", "text_key", "n", "set_key", F.coalesce("doc_id", F.lit(FIRST)).alias("doc_key")
    )
    with shuffles_dropped(spark):
        roots = similar_sets(rows, described, counts)
    of_set = described.where("set_key IS NOT NULL").groupBy("set_key").agg(F.min("doc_id").alias("least"))
    rooted = of_set.join(roots, F.col("set_key") == F.col("node"), "left").select(
        "set_key", "least", F.coalesce("root", "set_key").alias("root")
    )
    components = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_set = rooted.join(components, "root").select("set_key", "component_id", "root")
    return (
        described.join(of_set, "set_key", "left")
        .select(
            "doc_id",
            F.col("n").alias("n_shingles"),
            F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
            "text_key",
            "root",
        )
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are first in their component, with all their columns.

    The first is the row of the least id (null last); of rows that repeat an id the one
    with the least text hash, and of equal rows one. Rows without shingles all stay.
    """
    found = near_duplicates(docs).select(
        F.coalesce("doc_id", F.lit(FIRST)).alias("doc_key"), "text_key", "n_shingles", "root", "doc_id"
    )
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_key", "text_key")).alias("least")
    winners = found.where("n_shingles > 0").groupBy("root").agg(least).select("least.doc_key", "least.text_key")
    stay = winners.withColumn("once", F.lit(True)).union(
        found.where("n_shingles = 0").select("doc_key", "text_key").distinct().withColumn("once", F.lit(False))
    )
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    packed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST)).alias("doc_key"),
        F.xxhash64(text).alias("text_key"),
    )
    equal = Window.partitionBy("doc_key", "text_key").orderBy("doc_key")
    numbered = packed.join(stay, ["doc_key", "text_key"]).withColumn("number", F.row_number().over(equal))
    return numbered.where("number = 1 OR NOT once").select("_row.*")
