"""Reporting over the decision table.

Every count shown (totals, rates, breakdowns, indicators) is a sum over one
small cube, so the decision table is scanned once, with map-side aggregation,
whatever the number of panels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavel import constants as K
from gavel.functions.clock import display_time
from gavel.functions.keys import framework_of
from gavel.functions.scores import ratio
from gavel.operators.decide import is_recorded, plane_of


def cube(decisions: DataFrame) -> DataFrame:
    """``action, plane, recorded, n``: at most a few dozen rows."""
    return (
        decisions.select("action", plane_of().alias("plane"), is_recorded().alias("recorded"))
        .groupBy("action", "plane", "recorded")
        .agg(F.count("*").alias("n"))
    )


def _sum_if(test: Column) -> Column:
    return F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0)).cast("bigint")


def totals(counted: DataFrame) -> DataFrame:
    """One row of totals, rates and open alerts; all zero over no decisions."""
    sums = counted.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("decisions"),
        _sum_if(F.col("action").isin(*K.ENFORCING)).alias("enforced"),
        _sum_if(F.col("recorded")).alias("ledger_recorded"),
        _sum_if(F.col("action") == "allow").alias("allowed"),
        _sum_if(F.col("action").isin(*K.CRITICAL)).alias("open_alerts"),
    )
    n = F.col("decisions")
    return sums.select(
        "decisions", "enforced", "ledger_recorded", "open_alerts",
        ratio(F.col("enforced"), n).alias("enforcement_rate"),
        ratio(F.col("ledger_recorded"), n).alias("ledger_coverage"),
        ratio(F.col("allowed"), n).alias("allow_rate"),
    )


def by_action(counted: DataFrame) -> DataFrame:
    """Count per known action, zero-filled; other actions are left out."""
    sums = counted.agg(*[_sum_if(F.col("action") == a).alias(a) for a in K.DECISION_ACTIONS])
    return sums.unpivot([], list(K.DECISION_ACTIONS), "action", "n")


def by_plane(counted: DataFrame) -> DataFrame:
    return counted.groupBy("plane").agg(F.sum("n").alias("n"))


def breakdown(counted: DataFrame) -> DataFrame:
    """Totals, actions and planes as one table: ``panel, name, n``."""
    both = (
        counted.select(
            F.inline(
                F.array(
                    F.struct(F.lit("total").alias("panel"), F.lit("all").alias("name")),
                    F.struct(F.lit("action").alias("panel"), F.col("action").alias("name")),
                    F.struct(F.lit("plane").alias("panel"), F.col("plane").alias("name")),
                )
            ),
            "n",
        )
    )
    return both.groupBy("panel", "name").agg(F.sum("n").alias("n"))


def grouping_sets(decisions: DataFrame) -> DataFrame:
    """The same table by GROUPING SETS, over rows already reduced to the cube."""
    view = cube(decisions)
    return view.groupingSets([["action"], ["plane"], []], "action", "plane").agg(
        F.sum("n").alias("n"), F.grouping_id().alias("level")
    )


def indicators(total_row: DataFrame) -> DataFrame:
    """Four transparent proxy scores with their labels."""
    n = F.col("decisions")
    scores = {
        "SDG9_infrastructure": F.when(n > 0, F.lit(1.0)).otherwise(F.lit(0.0)),
        "SDG13_digital_sustainability": ratio(F.col("enforced"), n),
        "SDG16_accountability": ratio(F.col("ledger_recorded") + F.col("enforced"), n * 2),
        "SDG17_verifiable_sharing": ratio(F.col("ledger_recorded"), n),
    }
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("indicator"), score.alias("score"), F.lit(K.SDG_LABELS[name]).alias("label")
            )
            for name, score in scores.items()
        ]
    )
    return total_row.select(F.inline(rows))


def rule_frequency(decisions: DataFrame) -> DataFrame:
    """Firings per rule id, the default included."""
    return (
        decisions.select(F.explode("rule_ids").alias("rule_id")).groupBy("rule_id").agg(F.count("*").alias("n"))
    )


def top_rules(frequency: DataFrame, limit: int = 10) -> DataFrame:
    """Most frequent rules; ties by id, because arrival order means nothing here."""
    return frequency.orderBy(F.desc("n"), "rule_id").limit(limit)


def compliance_hits(frequency: DataFrame, references: DataFrame) -> DataFrame:
    """Firings per framework: a rule counts once for each reference it has.

    References join the per-rule counts (one row per rule), never the decisions.
    Rules without references contribute nothing.
    """
    return (
        frequency.join(references, "rule_id")
        .groupBy(framework_of(F.col("reference")).alias("framework"))
        .agg(F.sum("n").alias("n"))
    )


def _latest_first() -> list[Column]:
    return [F.coalesce(F.col("decided_at"), F.lit("")).desc(), F.col("decision_id").asc()]


def recent(decisions: DataFrame, limit: int = 50) -> DataFrame:
    """Latest decisions; one bounded heap per task, nothing is sorted whole."""
    return decisions.orderBy(*_latest_first()).limit(max(0, limit))


def alerts(decisions: DataFrame) -> DataFrame:
    return decisions.filter(F.col("action").isin(*K.CRITICAL)).select(
        "decision_id", "action", "rule_ids", "decided_at", "explanation", is_recorded().alias("recorded")
    )


def latest_alerts(decisions: DataFrame, limit: int = 20) -> DataFrame:
    return alerts(decisions).orderBy(*_latest_first()).limit(limit)


def alert_view(latest: DataFrame) -> DataFrame:
    """Blocks before alerts, else by time, as shown to people."""
    return latest.orderBy((F.col("action") == "block").desc(), *_latest_first()).select(
        "decision_id", "action", F.array_join("rule_ids", ", ").alias("rules"),
        F.coalesce("explanation", F.lit("")).alias("explanation"),
        display_time(F.col("decided_at")).alias("shown_at"),
        F.when(F.col("recorded"), F.lit("✓ recorded on ledger")).otherwise(F.lit("not recorded")).alias("audit"),
    )


def run_summary(results: DataFrame) -> DataFrame:
    """Per run: rows with a decision and rows with an error."""
    return results.groupBy("run_id").agg(
        F.count_if(F.col("decision").isNotNull()).alias("processed"),
        F.count_if(F.col("error").isNotNull()).alias("errors"),
    )


def batch_summary(governed: DataFrame, file: str = "source") -> DataFrame:
    """Records per source object and plane."""
    return governed.groupBy(F.col(file).alias("key"), F.col("data_plane").alias("plane")).agg(
        F.count("*").alias("records")
    )


def object_summary(governed: DataFrame, dead: DataFrame, file: str = "source") -> DataFrame:
    """Per source object and plane: records that got a decision, and records set aside."""
    plane = F.col("data_plane").alias("plane")
    sides = governed.select(F.col(file).alias("key"), plane, F.lit(1).alias("good"), F.lit(0).alias("bad")).unionByName(
        dead.select(F.col(file).alias("key"), plane, F.lit(0).alias("good"), F.lit(1).alias("bad"))
    )
    return sides.groupBy("key", "plane").agg(F.sum("good").alias("records"), F.sum("bad").alias("dead"))


def latest_runs(runs: DataFrame, limit: int = 20) -> DataFrame:
    return runs.orderBy(F.desc("run_id")).limit(limit)


def class_counts(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count("*").alias("n"))
