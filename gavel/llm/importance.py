"""Quality selection by importance resampling.

Two generative models give a text's probability as a bag of hashed one- and two-word
grams: one is fitted to target texts (those labelled good), one to all raw texts. The
log of their ratio is a document's importance weight. Adding Gumbel noise to the log
weights and taking the ``k`` largest draws ``k`` documents without replacement in
proportion to their weights.

Counting and scoring run in place on all texts; per task and per model one row for each
bucket is shuffled, and the driver sees ``BUCKETS`` sums. The cut is exact: documents
are ranked by a distributed sort.

Defined cases: a null or empty text has no grams and log weight 0. A null id is never
labelled. Rows that repeat an id are judged each; with the same text they get the same
noise. Contradicting labels of one id count as the lowest. Without good labels both
models agree, all weights are 0 and the draw is uniform. An empty table gives an empty
result.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gavel.llm.common import small_batches, with_global_index
from gavel.session import cut_lineage

BUCKETS = 1 << 14
SMOOTHING = 1.0
SEED = 20_261_201
# Good labelled rows that the target model is fitted to, at most (smallest hashes of ids).
TARGET_ROWS = 20_000

_UNIT = re.compile(rb"[0-9a-z\x80-\xff]+|[^\x00-\x20\x7f0-9a-z\x80-\xff]+")


def gram_buckets(text: bytes | None) -> np.ndarray:
    """Bucket of every one- and two-word gram; runs of marks count as words."""
    units = _UNIT.findall(text.lower()) if text else []
    one = np.fromiter(map(zlib.crc32, units), np.uint64, len(units))
    two = one[:-1] * np.uint64(0x9E3779B97F4A7C15) + one[1:]
    grams = np.concatenate([one, two]) * np.uint64(0xD6E8FEB86659FD93)
    return (grams >> np.uint64(64 - 14)).astype(np.int64)


def gram_counts(docs: DataFrame) -> np.ndarray:
    """Occurrences of every bucket in all texts of ``docs``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                total += np.bincount(gram_buckets(text), minlength=BUCKETS)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["bucket", "n"])

    counted = docs.select(F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(
        count, "bucket long, n long"
    )
    out = np.zeros(BUCKETS, np.int64)
    for row in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # BUCKETS rows at most
        out[row["bucket"]] = row["n"]
    return out


def log_ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Per bucket: log of its probability in the target over that in the raw texts."""
    if not target.sum():
        return np.zeros(BUCKETS)
    p = (target + SMOOTHING) / (target.sum() + SMOOTHING * BUCKETS)
    q = (raw + SMOOTHING) / (raw.sum() + SMOOTHING * BUCKETS)
    return np.log(p) - np.log(q)


def importance_weights(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row: doc_id, log_weight, and ``noise`` (a Gumbel variate drawn from id and text)."""
    spark = docs.sparkSession
    small_batches(spark)
    good = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
        .where("quality = 1 AND doc_id IS NOT NULL")
        .select("doc_id")
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(TARGET_ROWS)
    )
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    target = rows.join(F.broadcast(good), "doc_id", "left_semi")  # at most TARGET_ROWS ids
    weights = spark.sparkContext.broadcast(log_ratio(gram_counts(target), gram_counts(rows)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = weights.value
        for batch in batches:
            scores = [float(table[gram_buckets(t)].sum()) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(scores, pa.float64())],
                names=["doc_id", "noise", "log_weight"],
            )

    draw = F.xxhash64(F.lit(SEED), F.col("doc_id"), F.coalesce("text", F.lit("")))
    uniform = (F.shiftrightunsigned(draw, 11) + 0.5) / float(1 << 53)
    return rows.select("doc_id", (-F.log(-F.log(uniform))).alias("noise"), F.col("text").cast("binary").alias("text")).mapInArrow(
        score, "doc_id long, noise double, log_weight double"
    )


def resample(docs: DataFrame, labels: DataFrame, share: float | None = None) -> DataFrame:
    """Per row: doc_id, log_weight, noise, draw_rank (from 0) and ``kept``.

    ``share`` of all rows is drawn; if it is not given, as large a share as the labels
    call good.
    """
    scored = cut_lineage(importance_weights(docs, labels))
    if share is None:
        counts = labels.where("quality IS NOT NULL").agg(F.avg(F.col("quality").cast("double")).alias("share")).first()
        share = 1.0 if counts["share"] is None else counts["share"]
    k = math.ceil(share * scored.count())
    ranked = with_global_index(
        scored.withColumn("order_key", -(F.col("log_weight") + F.col("noise"))),
        ["order_key", "doc_id"],
        "draw_rank",
    )
    return ranked.select("doc_id", "log_weight", "noise", "draw_rank", (F.col("draw_rank") < k).alias("kept"))
