"""Exact copies of documents, by content hash and confirmed byte by byte.

Texts are grouped by a 128-bit hash of their bytes and, inside a hash, by the bytes
themselves, so two texts of one hash are two groups. Grouping starts in the task that
reads a text: of a text held by a third of all rows, each task hands on one row. Only
ids and hashes are then joined back to the groups; texts are shuffled once at most, and
once more only for hashes that different texts share (none, as a rule).

All work is DataFrame functions; no Python runs on the executors.

Defined cases: a null text is the empty text, and all empty texts are copies of each
other. Texts differ if any byte differs (letter case, spaces and line ends included).
Of each group the row with the largest id stays (``keep="smallest"``: the smallest). A
null id ranks behind every id; it is the ``keep_id`` of a group without ids only. Rows
that repeat an id and its text are rows of their own, of which one stays; an id with two
texts is in two groups. Texts of any length are hashed and compared whole. Other
columns, whatever their names, decide nothing. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavel.llm.group_join import with_group
from gavel.session import cut_lineage

# Copies of one id and text are written out from counts in blocks of so many.
BLOCK = 10_000

ID_OF = {"largest": F.max, "smallest": F.min}


def content_hash(text: Column) -> Column:
    """128 bits of a text's bytes."""
    return F.unhex(F.md5(text))


def hashed(docs: DataFrame, hash_of: Callable[[Column], Column], *keep: Column) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), *keep)
    return rows.withColumn("hash", hash_of(F.col("text")))


def text_groups(rows: DataFrame, keep: str) -> DataFrame:
    """One row per different text: ``hash, text, group_size, keep_id``."""
    return rows.groupBy("hash", "text").agg(
        F.count("*").alias("group_size"), ID_OF[keep]("doc_id").alias("keep_id")
    )


def counted_ids(docs: DataFrame, keep: str, hash_of: Callable[[Column], Column]) -> DataFrame:
    """One row per id and text: ``hash, doc_id, n_rows`` and the columns of its group."""
    rows = hashed(docs, hash_of)
    group = ["group_size", "keep_id", F.sha2("text", 256).alias("text_sha256")]
    groups = cut_lineage(text_groups(rows, keep).select("hash", *group))
    shared = cut_lineage(groups.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash"))
    copies = F.count("*").alias("n_rows")
    if shared.isEmpty():
        ids = cut_lineage(rows.groupBy("hash", "doc_id").agg(copies))
        return with_group(ids, groups, ["hash"], "group_size")
    sound = cut_lineage(rows.join(shared, "hash", "left_anti").groupBy("hash", "doc_id").agg(copies))
    found = with_group(sound, groups.join(shared, "hash", "left_anti"), ["hash"], "group_size")
    # texts that share a hash meet their groups by hash and bytes
    mixed = cut_lineage(rows.join(shared, "hash", "left_semi"))
    ids = cut_lineage(mixed.groupBy("hash", "text", "doc_id").agg(copies))
    told_apart = cut_lineage(text_groups(mixed, keep).select("text", "hash", *group))
    return found.unionByName(with_group(ids, told_apart, ["hash", "text"], "group_size").drop("text"))


def exact_copies(
    docs: DataFrame, keep: str = "largest", hash_of: Callable[[Column], Column] = content_hash
) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256."""
    ids = counted_ids(docs, keep, hash_of)
    # n_rows copies, a block of them at a time: a count may be as large as the table
    blocks = ids.withColumn("block", F.explode(F.expr(f"sequence(0L, (n_rows - 1) div {BLOCK})")))
    first = F.col("block") * BLOCK
    rows = blocks.withColumn(
        "copy", F.explode(F.sequence(first, F.least(first + BLOCK, F.col("n_rows")) - 1))
    )
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 0)
    return rows.select("doc_id", "keep_id", "group_size", stays.alias("kept"), "text_sha256")


def without_copies(
    docs: DataFrame, keep: str = "largest", hash_of: Callable[[Column], Column] = content_hash
) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Of rows that repeat the id and the text that stay, the one whose columns hash lowest.
    """
    ids = counted_ids(docs, keep, hash_of).where(F.col("doc_id").eqNullSafe(F.col("keep_id")))
    stay = cut_lineage(ids.select("doc_id", "text_sha256", "n_rows"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = hashed(docs, hash_of, row).withColumn("text_sha256", F.sha2("text", 256))
    key = F.struct(F.coalesce("doc_id", F.lit(0)), F.col("doc_id").isNull(), "text_sha256")
    keyed, wanted = rows.select(key.alias("key"), "row"), stay.select(key.alias("key"), "n_rows")
    single = keyed.join(wanted.where("n_rows = 1"), "key", "left_semi")
    repeated = keyed.join(wanted.where("n_rows > 1").select("key"), "key", "left_semi")
    chosen = repeated.groupBy("key").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return single.unionByName(chosen).select("row.*")
