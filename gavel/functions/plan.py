"""Plan shaping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def pin(df: DataFrame, *names: str) -> DataFrame:
    """Compute the columns ``names`` once, here.

    A filter on a derived column is normally pushed below the projection that
    derives it, with the whole definition substituted; for definitions as large
    as a contract or a rule set that means evaluating them twice and generating
    methods too big to compile. Passing the values through a one-element
    generator keeps later filters above it. Unused columns are still pruned, and
    filters on other columns still reach the scan.
    """
    packed = F.inline(F.array(F.struct(*names)))
    return df.select(*[c for c in df.columns if c not in names], packed)


def quoted(values) -> str:
    """SQL list of text literals."""
    return ", ".join("'" + v.replace("'", "\\'") + "'" for v in values)


def first_of(tests: list[tuple[str, str]]) -> str:
    """SQL for the array of the names whose test is true, in order."""
    cases = ", ".join(f"CASE WHEN {test} THEN '{name}' END" for name, test in tests)
    return f"array_except(array({cases}), array(CAST(NULL AS STRING)))"


def local_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small driver-side table whose size the planner knows exactly."""
    if not rows or len(rows) > 1000:
        return spark.createDataFrame(rows, schema)
    fields = [f.strip().split(" ") for f in schema.split(",")]
    width = range(len(fields))
    marks = ", ".join("(" + ", ".join(f":r{i}c{j}" for j in width) + ")" for i in range(len(rows)))
    columns = ", ".join(f"CAST(c{j} AS {kind}) AS {name}" for j, (name, kind) in enumerate(fields))
    names = ", ".join(f"c{j}" for j in width)
    args = {f"r{i}c{j}": v for i, row in enumerate(rows) for j, v in enumerate(row)}
    return spark.sql(f"SELECT {columns} FROM VALUES {marks} AS t({names})", args=args)
