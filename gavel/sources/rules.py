"""Rule configuration: loading, checking and the rules as tables."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gavel import constants as K
from gavel.functions.plan import local_table

SCORE_KEYS = (
    "content_confidence",
    "fused_anomaly_score",
    "isolation_forest_score",
    "lstm_score",
)
AT_LEAST = "_gte"


class RuleError(ValueError):
    """A rule the engine cannot run."""


@dataclass(frozen=True)
class Rule:
    id: str
    action: str
    when: Mapping[str, Any] = field(default_factory=dict)
    explanation: str | None = None
    references: tuple[str, ...] = ()

    @property
    def severity(self) -> int:
        return K.SEVERITY[self.action]


def parse_rules(raw: Iterable[Mapping[str, Any]]) -> list[Rule]:
    rules = []
    for item in raw:
        if item.get("action") not in K.SEVERITY:
            raise RuleError(f"rule {item.get('id')!r} has invalid action {item.get('action')!r}")
        rules.append(
            Rule(
                id=item["id"],
                action=item["action"],
                when=dict(item.get("when") or {}),
                explanation=item.get("explanation"),
                references=tuple(item.get("references") or ()),
            )
        )
    return rules


def shipped_rules() -> list[Rule]:
    return parse_rules(K.RULES)


def load_rules(path: str | Path) -> list[Rule]:
    """Rules of a JSON or YAML file with a top-level ``rules`` list (none: no rules)."""
    text = Path(path).read_text(encoding="utf-8")
    if str(path).endswith(".json"):
        data = json.loads(text)
    else:
        try:
            import yaml
        except ImportError as missing:
            raise RuleError("reading YAML rules needs PyYAML; a .json file works without") from missing
        data = yaml.safe_load(text)
    return parse_rules((data or {}).get("rules") or [])


def by_severity(rules: Iterable[Rule]) -> list[Rule]:
    """Most restrictive first; configuration order among equals."""
    return sorted(rules, key=lambda r: -r.severity)


def references_table(spark: SparkSession, rules: Iterable[Rule]) -> DataFrame:
    """``rule_id, reference``, one row per reference."""
    rows = [(r.id, ref) for r in rules for ref in r.references]
    return local_table(spark, rows, "rule_id string, reference string")


# How a condition row is met: the value is one of the rows' values; it is at least the
# number; never.
EQUALS_OP, AT_LEAST_OP, NEVER_OP = "eq", "gte", "never"


def _is_number(value: Any) -> bool:
    return isinstance(value, (bool, int, float))


def rule_rows(spark: SparkSession, rules: Iterable[Rule]) -> tuple[DataFrame, DataFrame]:
    """Rules as two tables: ``rule_key, rule_id, action, explanation, position`` and
    ``rule_key, key, op, value_str, value_num``.

    A list gives a row per value, an event being able to match one of them; a row without
    either value stands for null. A rule without condition rows always matches.
    """
    heads, tests = [], []
    for position, rule in enumerate(rules):
        name = str(position)
        heads.append((name, rule.id, rule.action, rule.explanation, position))
        for key, expected in rule.when.items():
            if key.endswith(AT_LEAST):
                tests.append((name, key.removesuffix(AT_LEAST), AT_LEAST_OP, None, float(expected)))
                continue
            values = expected if isinstance(expected, list) else [expected]
            if not values:
                tests.append((name, key, NEVER_OP, None, None))
            for v in values:
                text = None if v is None or _is_number(v) else str(v)
                tests.append((name, key, EQUALS_OP, text, float(v) if _is_number(v) else None))
    return (
        local_table(spark, heads, "rule_key string, rule_id string, action string, explanation string, position int"),
        local_table(spark, tests, "rule_key string, key string, op string, value_str string, value_num double"),
    )
