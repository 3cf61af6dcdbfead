"""Rule engines over scored events.

``fire`` compiles a rule set into columns: one projection, no shuffle, no
Python. ``fire_from_tables`` takes rules held as rows, for rule sets that are data or too
large to compile. ``first_match`` is the small built-in fallback set. All
three return the event columns plus ``action``, ``rule_ids``, ``explanation``.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavel import constants as K
from gavel.functions.plan import pin
from gavel.sources.rules import AT_LEAST, AT_LEAST_OP, EQUALS_OP, SCORE_KEYS, Rule, by_severity, rule_rows


def context() -> dict[str, Column]:
    """What a condition may look at, by condition key."""
    access = F.col("data_plane") == "access"

    def field(name: str) -> Column:
        return F.when(access, F.col(f"access.{name}"))

    return {
        "data_plane": F.col("data_plane"),
        "content_class": F.col("signals.content_class"),
        "content_confidence": F.col("signals.content_confidence"),
        "fused_anomaly_score": F.col("signals.fused_anomaly_score"),
        "isolation_forest_score": F.col("signals.isolation_forest_score"),
        "lstm_score": F.col("signals.lstm_score"),
        "access_action": field("action"),
        "resource_class": field("resource_class"),
        "role": field("role"),
        "department": field("department"),
    }


def _equals(key: str, actual: Column, expected: Any) -> Column:
    if expected is None:
        return actual.isNull()
    is_number = isinstance(expected, (bool, int, float))
    if is_number != (key in SCORE_KEYS):  # a text never equals a number
        return F.lit(False)
    return actual.eqNullSafe(F.lit(float(expected) if is_number else expected))


def condition(key: str, expected: Any, ctx: dict[str, Column]) -> Column:
    missing = F.lit(None)
    if key.endswith(AT_LEAST):
        actual = ctx.get(key.removesuffix(AT_LEAST), missing)
        return F.coalesce(actual.try_cast("double") >= float(expected), F.lit(False))
    actual = ctx.get(key, missing)
    if isinstance(expected, list):
        return reduce(lambda a, b: a | b, [_equals(key, actual, v) for v in expected], F.lit(False))
    return _equals(key, actual, expected)


def matches(rule: Rule, ctx: dict[str, Column]) -> Column:
    """All conditions hold; a rule without conditions always matches."""
    return reduce(lambda a, b: a & b, [condition(k, v, ctx) for k, v in rule.when.items()], F.lit(True))


def fire(events: DataFrame, rules: Iterable[Rule]) -> DataFrame:
    """Every matching rule contributes; the most restrictive action wins.

    The order of rules is known when the plan is built, so nothing is sorted per
    row. ``array_except`` drops the rules that did not fire, keeps the order and
    stays inside generated code.
    """
    ordered, ctx = by_severity(rules), context()
    hits = [matches(r, ctx) for r in ordered]
    nothing = F.array(F.lit(None).cast("string"))
    fired = (
        F.array_except(F.array(*[F.when(h, F.lit(r.id)) for h, r in zip(hits, ordered)]), nothing)
        if ordered
        else F.array().cast("array<string>")
    )
    action = F.coalesce(*[F.when(h, F.lit(r.action)) for h, r in zip(hits, ordered)], F.lit("allow"))
    said = F.concat_ws(
        " ", *[F.when(h, F.lit(r.explanation)) for h, r in zip(hits, ordered) if r.explanation]
    )
    none = F.size("_fired") == 0
    return (
        events.withColumns({"_fired": fired, "action": action, "_said": said})
        .withColumns(
            {
                "rule_ids": F.when(none, F.array(F.lit(K.DEFAULT_RULE_ID))).otherwise(F.col("_fired")),
                "explanation": F.when(none, F.lit(K.DEFAULT_EXPLANATION)).otherwise(
                    F.when(F.col("_said") != "", F.col("_said"))
                ),
            }
        )
        .drop("_fired", "_said")
    )


def first_match(events: DataFrame) -> DataFrame:
    """Fallback set: the first rule that applies decides alone."""
    ctx, r = context(), K.FALLBACK_RULES
    fused, cls = ctx["fused_anomaly_score"], ctx["content_class"]
    access = (ctx["data_plane"] == "access") & fused.isNotNull()
    content = (ctx["data_plane"] == "content") & cls.isNotNull()
    cases = [
        (access & (ctx["access_action"] == "privilege_change"), r["priv"]),
        (access & (fused >= K.FALLBACK_HIGH), r["high"]),
        (access & (fused >= K.FALLBACK_MED), r["med"]),
        (access, r["access"]),
        (content & (cls == "PII"), r["pii"]),
        (content & (cls == "financial"), r["financial"]),
        (content, r["content"]),
    ]

    def pick(i: int) -> Column:
        chain = F.when(cases[0][0], F.lit(cases[0][1][i]))
        for test, outcome in cases[1:]:
            chain = chain.when(test, F.lit(outcome[i]))
        return chain.otherwise(F.lit(r["none"][i]))

    return events.withColumns(
        {"action": pick(0), "rule_ids": F.array(pick(1)), "explanation": pick(2)}
    )


# --- rules as rows ------------------------------------------------------------------------

# All rules of a table travel as one value, so their number is checked.
MAX_RULES = 10_000


def rule_index(rules: DataFrame, conditions: DataFrame) -> DataFrame:
    """One row, ``rules``: every rule with its conditions, most restrictive first.

    ``rules`` has ``rule_key, rule_id, action, explanation, position`` (keys and positions
    unique), ``conditions`` has ``rule_key, key, op, value_str, value_num`` as in
    ``sources.rules.rule_rows``. An unknown action or more than ``MAX_RULES`` rules
    fail the query that uses the index.
    """
    keys = F.array(*map(F.lit, context()))
    token = F.coalesce(
        F.concat(F.lit("text:"), F.col("value_str")),
        F.concat(F.lit("number:"), F.col("value_num").cast("string")),
        F.lit("null"),
    )
    is_floor = F.col("op") == AT_LEAST_OP
    tests = conditions.groupBy("rule_key", "key", is_floor.alias("is_floor")).agg(
        F.max(F.when(is_floor, F.coalesce("value_num", F.lit(float("inf"))))).alias("floor"),
        F.collect_set(F.when(F.col("op") == EQUALS_OP, token)).alias("tokens"),
    )
    at = (F.array_position(keys, F.col("key")) - 1).cast("int").alias("at")  # -1: no event has it
    grouped = tests.groupBy("rule_key").agg(F.collect_list(F.struct(at, "floor", "tokens")).alias("tests"))
    severity = F.lit(None).cast("int")
    for action, rank in K.SEVERITY.items():
        severity = F.when(F.col("action") == action, F.lit(rank)).otherwise(severity)
    wrong = F.raise_error(F.format_string("rule %s has invalid action %s", "rule_id", "action")).cast("int")
    ordered = F.struct(
        (-F.coalesce(severity, wrong)).alias("order"), "position", "rule_id", "action", "explanation",
        F.coalesce("tests", F.array().cast(grouped.schema["tests"].dataType)).alias("tests"),
    )
    many = F.raise_error(F.lit(f"more than {MAX_RULES} rules")).cast("boolean")
    all_rules = F.array_sort(F.collect_list(ordered))
    few = F.when(F.count("*") <= MAX_RULES, F.lit(True)).otherwise(many)
    return rules.join(grouped, "rule_key", "left").agg(F.when(few, all_rules).alias("rules"))


def _meets(tokens: Column, test: Column) -> Column:
    """Does an event's context meet one condition?"""
    token = F.coalesce(F.get(tokens, test["at"]), F.lit("null"))
    # a number prints so that it reads back as itself
    number = F.substr(token, F.instr(token, ":") + 1).try_cast("double")
    reaches = F.coalesce(number >= test["floor"], F.lit(False))
    return F.when(test["floor"].isNull(), F.array_contains(test["tokens"], token)).otherwise(reaches)


def fire_from_tables(events: DataFrame, rules: Iterable[Rule] | tuple[DataFrame, DataFrame]) -> DataFrame:
    """The event columns with ``action, rule_ids, explanation`` from rules held as rows: a
    list of rules, or the two tables ``rule_index`` takes.

    The rules reach every task as one array and each event filters it: nothing is
    exploded, joined or shuffled, and every event is kept, repeated ids included.
    """
    tables = rules if isinstance(rules, tuple) else rule_rows(events.sparkSession, rules)
    index = rule_index(*tables)
    ctx = context()
    tokens = [
        F.coalesce(F.concat(F.lit("number:" if name in SCORE_KEYS else "text:"), c.cast("string")), F.lit("null"))
        for name, c in ctx.items()
    ]
    # pinned: a lambda would work out what it refers to for every rule, and every column
    # that refers to the hits would look for them again
    seen = pin(events.withColumn("_tokens", F.array(*tokens)), "_tokens")
    hits = F.filter("_rules", lambda r: F.forall(r["tests"], lambda t: _meets(F.col("_tokens"), t)))
    fired = seen.withColumn("_rules", index.scalar()).withColumn("_hits", hits)
    found = pin(fired.drop("_tokens", "_rules"), "_hits")
    said = F.array_join(F.filter(F.col("_hits.explanation"), lambda e: e != ""), " ")
    none = F.size("_hits") == 0
    return found.withColumns(
        {
            "action": F.when(none, F.lit("allow")).otherwise(F.get(F.col("_hits.action"), 0)),
            "rule_ids": F.when(none, F.array(F.lit(K.DEFAULT_RULE_ID))).otherwise(F.array_distinct("_hits.rule_id")),
            "explanation": F.when(none, F.lit(K.DEFAULT_EXPLANATION)).otherwise(F.when(said != "", said)),
        }
    ).drop("_hits")
