"""The governance plan: events in, decisions out, as one shuffle-free projection."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame

from gavel.functions.plan import pin
from gavel.operators.contracts import decision_checks, split_valid, violations, with_errors
from gavel.operators.decide import (
    heuristic_scorer, keyword_classifier, with_decision, with_signals,
)
from gavel.operators.rules import fire, first_match
from gavel.sources.rules import Rule, shipped_rules

Transform = Callable[[DataFrame], DataFrame]


def rule_engine(rules: Iterable[Rule] | None = None) -> Transform:
    """Rule port for ``rules`` (default: the shipped set)."""
    chosen = list(shipped_rules() if rules is None else rules)
    return lambda events: fire(events, chosen)


def fallback_engine() -> Transform:
    return first_match


def govern(
    events: DataFrame,
    *,
    decided_at: Column | str,
    classifier: Transform | None = None,
    scorer: Transform | None = None,
    rules: Transform | None = None,
) -> DataFrame:
    """Valid canonical events -> the same rows with ``signals`` and a decision.

    Each port is any ``DataFrame -> DataFrame`` function: a classifier adds
    ``content_class, content_confidence``, a scorer the three anomaly scores, a
    rule engine ``action, rule_ids, explanation``. Left out, the heuristics and
    the shipped rules apply. Both planes pass through one projection, so the
    source is scanned once.
    """
    scored = (scorer or heuristic_scorer())((classifier or keyword_classifier())(events))
    fired = (rules or rule_engine())(with_signals(scored))
    return with_decision(pin(fired, "action", "rule_ids"), decided_at)


def govern_checked(normalized: DataFrame, **ports) -> tuple[DataFrame, DataFrame]:
    """Normalised records -> (governed events, dead letters)."""
    valid, dead = split_valid(with_errors(normalized))
    return govern(valid, **ports), dead


def with_decision_errors(governed: DataFrame) -> DataFrame:
    """``errors``: decision-contract violations, to re-check decisions of custom ports."""
    return governed.withColumn("errors", violations(decision_checks()))
