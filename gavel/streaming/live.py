"""Live counters over a growing decision store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gavel import schemas as S


def decision_stream(spark: SparkSession, path: str, kind: str = "json", max_files: int = 1000) -> DataFrame:
    reader = spark.readStream.schema(S.DECISION).option("recursiveFileLookup", "true")
    if kind == "json":  # a malformed line is an error, not a decision without fields
        reader = reader.option("mode", "FAILFAST")
    return reader.option("maxFilesPerTrigger", max_files).format(kind).load(path)


def live_actions(decisions: DataFrame) -> DataFrame:
    """Running count per action; write it in ``complete`` mode."""
    return decisions.groupBy("action").agg(F.count("*").alias("n"))
