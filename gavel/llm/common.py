"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gavel.session import cut_lineage

# Rows in one Arrow batch: texts can be long, so a batch is kept small.
BATCH_ROWS = 256


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_and_text(docs: DataFrame) -> DataFrame:
    """Only ``doc_id`` and ``text``: other columns cannot clash with an operator's own."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def small_batches(spark: SparkSession) -> None:
    """Keep the Arrow batches of texts small (10,000 long texts would not fit a worker)."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of queries made and run inside go when each query ends, so that the disk in
    use is that of one query, not of all. What a lost executor takes with it is worked out anew."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def text_hash(text: Column) -> list[Column]:
    """Two 64-bit hashes, together the identity of a text (null is the empty text)."""
    text = F.coalesce(text, F.lit(""))
    return [F.xxhash64(text).alias("text_h1"), F.xxhash64(F.lit(1), text).alias("text_h2")]


def rows_by_column(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    return zip(*(batch.column(n).to_pylist() for n in names), strict=True)


def with_global_index(df: DataFrame, order: list[str], name: str = "row_index") -> DataFrame:
    """Number the rows 0, 1, ... in the given order, without gathering them.

    The rows are dealt by ranges of ``order`` and sorted in each range. Only one
    count per range (not per row) goes through the driver.
    """
    ranged = cut_lineage(
        df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_mid", F.monotonically_increasing_id())
    )
    part, local = F.shiftright("_mid", 33), F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))
    counts = sorted((r["part"], r["n"]) for r in ranged.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    starts, total = [], 0
    for part_id, n in counts:
        starts.append((part_id, total))
        total += n
    table = df.sparkSession.createDataFrame(starts, "_part long, _start long")
    return (
        ranged.withColumn("_part", part.cast("long"))
        .join(F.broadcast(table), "_part")  # one row per range
        .withColumn(name, F.col("_start") + local)
        .drop("_mid", "_part", "_start")
    )


def with_running_sums(df: DataFrame, order: list[str], sums: dict[str, str]) -> DataFrame:
    """Add running totals (this row included) of long columns in the given order.

    ``sums`` maps a new column to the column it adds up. As in
    :func:`with_global_index`, only one total per range goes through the driver.
    """
    fields = [f"{name} {kind}" for name, kind in df.dtypes] + [f"{name} long" for name in sums] + ["_part long"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, carried = TaskContext.get().partitionId(), dict.fromkeys(sums, 0)
        for batch in batches:
            columns = {name: batch.column(name) for name in batch.schema.names}
            for name, source in sums.items():
                total = np.cumsum(batch.column(source).to_numpy(zero_copy_only=False)) + carried[name]
                carried[name] = int(total[-1]) if len(total) else carried[name]
                columns[name] = pa.array(total, pa.int64())
            columns["_part"] = pa.array([part] * batch.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    local = cut_lineage(ranged.mapInArrow(run, ", ".join(fields)))
    ends = local.groupBy("_part").agg(*[F.max(name).alias(name) for name in sums]).collect()
    rows, before = [], dict.fromkeys(sums, 0)
    for end in sorted(ends, key=lambda r: r["_part"]):
        rows.append((end["_part"], *before.values()))
        before = {name: before[name] + end[name] for name in sums}
    table = df.sparkSession.createDataFrame(rows, ", ".join(["_part long", *(f"_{name} long" for name in sums)]))
    shifted = local.join(F.broadcast(table), "_part")  # one row per range
    return shifted.withColumns({name: F.col(name) + F.col(f"_{name}") for name in sums}).drop(
        "_part", *(f"_{name}" for name in sums)
    )
