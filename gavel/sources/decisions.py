"""Decision and run stores: reading and writing."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gavel import schemas as S


def _read_or_empty(spark: SparkSession, path: str, schema, kind: str) -> DataFrame:
    try:
        reader = spark.read.schema(schema).format(kind)
        # a malformed line is an error, not a decision without fields
        if kind == "json":
            reader = reader.option("mode", "FAILFAST").option("recursiveFileLookup", "true")
        return reader.load(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)


def load_decisions(spark: SparkSession, path: str, kind: str = "json") -> DataFrame:
    """The decision store with all its parts; a store that does not exist yet is an empty table."""
    return _read_or_empty(spark, path, S.DECISION, kind)


# Fields whose text is itself JSON and becomes a nested value.
JSON_TEXTS = ("metadata",)


def canonical(column: Column, kind: T.DataType, name: str = "") -> Column:
    """``column`` with struct fields and map keys in alphabetical order, at every level;
    texts of ``JSON_TEXTS`` fields become the value they spell (a broken one is null)."""
    if isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        inner = [canonical(column[f.name], f.dataType, f.name).alias(f.name) for f in fields]
        return F.when(column.isNotNull(), F.struct(*inner)) if inner else column
    if isinstance(kind, T.ArrayType):
        plain = not isinstance(kind.elementType, (T.StructType, T.ArrayType, T.MapType))
        return column if plain else F.transform(column, lambda x: canonical(x, kind.elementType))
    if isinstance(kind, T.MapType):
        keys = F.array_sort(F.map_keys(column))
        values = F.transform(keys, lambda k: canonical(F.element_at(column, k), kind.valueType))
        return F.map_from_arrays(keys, values)
    if name in JSON_TEXTS and isinstance(kind, T.StringType):
        return F.try_parse_json(column)
    return column


def canonical_json(column: Column, kind: T.DataType) -> Column:
    """One compact JSON text: sorted keys, and no null members, at every level."""
    return F.to_json(canonical(column, kind), {"ignoreNullFields": "true"})


def row_json(df: DataFrame, names: list[str] | None = None) -> Column:
    """``canonical_json`` of the columns ``names`` (default: all) as one object."""
    fields = [f for f in df.schema.fields if names is None or f.name in names]
    parts = {f.name: canonical(F.col(f"`{f.name}`"), f.dataType, f.name) for f in fields}
    return F.to_json(F.struct(*[parts[n].alias(n) for n in sorted(parts)]), {"ignoreNullFields": "true"})


def sorted_columns(df: DataFrame) -> DataFrame:
    """Columns in canonical form and order, which is the order JSON writers keep."""
    fields = sorted(df.schema.fields, key=lambda f: f.name)
    return df.select(*[canonical(F.col(f"`{f.name}`"), f.dataType, f.name).alias(f.name) for f in fields])


def append_json(df: DataFrame, path: str) -> None:
    """Append rows as compact, key-sorted JSON lines; null members are left out."""
    sorted_columns(df).write.mode("append").option("ignoreNullFields", "true").json(path)


def put_json(df: DataFrame, path: str, part: str) -> None:
    """The same lines as one named part of a store; putting a part again replaces it."""
    sorted_columns(df).write.mode("overwrite").option("ignoreNullFields", "true").json(f"{path}/part={part}")


def append_parquet(decisions: DataFrame, path: str) -> None:
    """Append to a decision store laid out for pruning by plane and day."""
    from gavel.operators.decide import plane_of

    day = F.substring("decided_at", 1, 10)
    decisions.withColumns({"data_plane": plane_of(), "decided_date": day}).write.mode("append").partitionBy(
        "data_plane", "decided_date"
    ).parquet(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """A labelled table as JSON lines."""
    sorted_columns(df).write.mode("overwrite").json(path)


def write_text(lines: DataFrame, path: str) -> None:
    """One text column to a folder on any file system Spark reaches."""
    lines.write.mode("overwrite").text(path)


# --- runs ----------------------------------------------------------------------------------


def save_run(results: DataFrame, path: str, run_id: str, created_at: str, decisions_path: str | None = None) -> None:
    """Write one run: its results, its part of the decision store, then its manifest.

    Each is a folder of the run's own, which a retry replaces, so a run that is repeated
    adds nothing. The manifest comes last: a run counts when it has one, an empty run
    included. ``results`` are worked out once; all else is read back.
    """
    from gavel.operators.metrics import run_summary

    spark = results.sparkSession
    names = [n for n in S.RUN_RESULT.fieldNames() if n != "run_id"]
    schema = T.StructType([S.RUN_RESULT[n] for n in names])
    folder = f"{path}/results/run_id={run_id}"
    results.select(*names).write.mode("overwrite").parquet(folder)
    stored = spark.read.schema(schema).parquet(folder)
    if decisions_path:
        put_json(stored.filter(F.col("decision").isNotNull()).select("decision.*"), decisions_path, run_id)
    counted = run_summary(stored.withColumn("run_id", F.lit(run_id)))
    counts = counted.first()  # one row, or none for an empty run
    done, failed = (counts["processed"], counts["errors"]) if counts else (0, 0)
    manifest = spark.range(1).select(
        F.lit(created_at).alias("created_at"), F.lit(done).cast("bigint").alias("processed"), F.lit(failed).cast("bigint").alias("errors")
    )
    manifest.write.mode("overwrite").parquet(f"{path}/runs/run_id={run_id}")


# run ids are text, also where they look like numbers
def _of_runs(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    ordered = T.StructType([*[f for f in schema.fields if f.name != "run_id"], schema["run_id"]])
    return _read_or_empty(spark, path, ordered, "parquet").select(*schema.fieldNames())


def load_runs(spark: SparkSession, path: str) -> DataFrame:
    return _of_runs(spark, f"{path}/runs", S.RUN)


def load_run(spark: SparkSession, path: str, run_id: str | None = None) -> DataFrame | None:
    """Results of a run (default: the latest); None when there is no such run."""
    runs = load_runs(spark, path)
    if run_id in (None, "latest"):
        run_id = runs.agg(F.max("run_id")).first()[0]
    if run_id is None or not runs.filter(F.col("run_id") == run_id).limit(1).count():
        return None
    return _of_runs(spark, f"{path}/results", S.RUN_RESULT).filter(F.col("run_id") == run_id)
