"""What a stream remembers of every user between micro-batches, on shared storage.

A batch writes one small row for each user it saw: the last seven codes. Every
``MERGE_EVERY`` batches a version takes in all users, which bounds the versions a batch
has to read. Versions lie in a ring of twice that many folders, so a version is overwritten
when it can no longer be needed, and a replayed batch overwrites its own.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CARRY = T.StructType(
    [
        T.StructField("user_id", T.StringType()),
        T.StructField("carried", T.ArrayType(T.IntegerType())),
        T.StructField("version", T.LongType()),
        T.StructField("slot", T.IntegerType()),
    ]
)
MERGE_EVERY = 50


def _slot(version: int) -> int:
    return version % (2 * MERGE_EVERY)


def carried_before(spark: SparkSession, state: str, batch_id: int) -> DataFrame:
    """``user_id, carried``: the latest carry of every user from batches before ``batch_id``."""
    try:
        rows = spark.read.schema(CARRY).parquet(state)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], CARRY).select("user_id", "carried")
    merged = (batch_id - 1) // MERGE_EVERY * MERGE_EVERY  # holds every user known by then
    versions = range(max(merged, 0), batch_id)
    recent = rows.filter(F.col("slot").isin([_slot(v) for v in versions]))  # folders
    recent = recent.filter((F.col("version") < batch_id) & (F.col("version") >= merged))
    return recent.groupBy("user_id").agg(F.max_by("carried", "version").alias("carried"))


def save_carry(seen: DataFrame, state: str, batch_id: int) -> None:
    """Write the carry of the users of this batch (``user_id, carried``), and on every
    ``MERGE_EVERY``-th batch that of all others too."""
    rows = seen.select("user_id", "carried")
    if batch_id and batch_id % MERGE_EVERY == 0:
        before = carried_before(seen.sparkSession, state, batch_id)
        rows = rows.unionByName(before.join(rows.select("user_id"), "user_id", "left_anti"))
    rows.withColumn("version", F.lit(batch_id).cast("bigint")).write.mode("overwrite").parquet(
        f"{state}/slot={_slot(batch_id)}"
    )
