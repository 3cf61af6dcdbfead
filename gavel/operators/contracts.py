"""Data contracts as named predicates; a violation is data, not an exception."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavel import constants as K
from gavel.functions.clock import iso_hour
from gavel.functions.keys import UUID
from gavel.functions.plan import first_of, pin, quoted

Check = tuple[str, str]  # (name, SQL that is true when violated)


def _empty(column: str) -> str:
    return f"coalesce({column}, '') = ''"


def _not_in(column: str, values, *, optional: bool = False) -> str:
    return f"coalesce({column} NOT IN ({quoted(values)}), {str(not optional).lower()})"


def _not_uuid(column: str) -> str:
    return f"NOT coalesce({column} RLIKE '{UUID}', false)"


def event_checks() -> list[Check]:
    """Canonical event contract. Date-times are free text here; see ``with_errors``."""
    fits = " OR ".join(
        f"({one} IS NOT NULL AND {other} IS NULL AND event_type = '{one}' AND data_plane = '{one}')"
        for one, other in (K.PLANES, K.PLANES[::-1])
    )
    content, access = "content IS NOT NULL AND ", "access IS NOT NULL AND "
    return [
        ("event_id", _not_uuid("event_id")),
        ("event_type", _not_in("event_type", K.PLANES)),
        ("data_plane", _not_in("data_plane", K.PLANES)),
        ("occurred_at", "occurred_at IS NULL"),
        ("source", _empty("source")),
        ("one_of", f"NOT coalesce({fits}, false)"),
        *[(f"content.{n}", content + _empty(f"content.{n}")) for n in K.CONTENT_REQUIRED],
        ("content.label", content + _not_in("content.label", K.CLASSES, optional=True)),
        *[
            (f"access.{n}", access + _empty(f"access.{n}"))
            for n in ("user_id", "role", "department", "resource_id")
        ],
        ("access.resource_class", access + _not_in("access.resource_class", K.CLASSES)),
        ("access.action", access + _not_in("access.action", K.ACTIONS)),
    ]


def decision_checks() -> list[Check]:
    """Governance decision contract."""
    s = "signals."
    return [
        ("decision_id", _not_uuid("decision_id")),
        ("event_id", _not_uuid("event_id")),
        ("decided_at", "decided_at IS NULL"),
        ("action", _not_in("action", K.DECISION_ACTIONS)),
        ("rule_ids.empty", "coalesce(size(rule_ids) < 1, true)"),
        ("rule_ids.blank", "coalesce(array_contains(rule_ids, ''), false)"),
        ("rule_ids.repeated", "coalesce(size(array_distinct(rule_ids)) < size(rule_ids), false)"),
        ("signals", "signals IS NULL"),
        ("signals.content_class", _not_in(s + "content_class", K.CLASSES, optional=True)),
        *[
            (s + n, f"coalesce({s}{n} NOT BETWEEN 0 AND 1, false)")
            for n in ("content_confidence", "fused_anomaly_score")
        ],
    ]


def violations(checks: list[Check]) -> Column:
    """Names of the violated checks, in contract order."""
    return F.expr(first_of(checks))


def with_errors(events: DataFrame, *, strict_datetime: bool = False) -> DataFrame:
    """``errors``: normalisation problems first; a record that has none is checked
    against the event contract. ``strict_datetime`` also asks for ISO date-times."""
    contract = violations(event_checks())
    if strict_datetime:
        late = F.when(iso_hour(F.col("occurred_at")).isNull(), F.array(F.lit("occurred_at")))
        contract = F.array_union(contract, F.coalesce(late, F.array().cast("array<string>")))
    found = F.when(F.size("problems") > 0, F.col("problems")).otherwise(contract)
    return pin(events.withColumn("errors", found).drop("problems"), "errors")


def split_valid(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid events, dead letters)."""
    return checked.filter(F.size("errors") == 0).drop("errors"), checked.filter(F.size("errors") > 0)


def fail_on_error(checked: DataFrame) -> DataFrame:
    """Abort the job on the first invalid record instead of setting it aside."""
    message = F.concat(F.lit("invalid record: "), F.array_join("errors", ", "))
    ok = F.when(F.size("errors") > 0, F.raise_error(message).cast("boolean")).otherwise(F.lit(True))
    return checked.filter(ok).drop("errors")
