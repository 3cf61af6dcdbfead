"""Access-event features.

The 25 features of an event depend on eight small attributes only, so one event
is one integer *feature code* below ``CODES``. Windows, shuffles and lookups
carry the 4-byte code and expand it to floats where a model needs them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from gavel import constants as K
from gavel.functions.clock import feature_hour, is_off_hours
from gavel.functions.scores import is_unmanaged

FEATURE_NAMES = (
    *(f"action={a}" for a in K.ACTIONS),
    *(f"role={r}" for r in K.ROLES),
    *(f"dept={d}" for d in K.DEPARTMENTS),
    *(f"resclass={c}" for c in K.CLASSES),
    "hour_norm",
    "off_hours",
    "unmanaged_device",
    "external_ip",
    "cross_department",
)

# (vocabulary, slot count); slot 0 of a vocabulary is "not in it".
_VOCABULARIES = (K.ACTIONS, K.ROLES, K.DEPARTMENTS, K.CLASSES)
_RADIX = tuple(len(v) + 1 for v in _VOCABULARIES) + (24, 2, 2, 2)
CODES = 1
for _r in _RADIX:
    CODES *= _r  # 193,536 different events at most


def one_hot(value: Column, vocabulary: Sequence[str]) -> list[Column]:
    return [F.coalesce(value == v, F.lit(False)).cast("float") for v in vocabulary]


def resource_department(resource_id: Column) -> Column:
    """Text before the first dash; empty when there is none."""
    return F.when(resource_id.contains("-"), F.substring_index(resource_id, "-", 1)).otherwise(F.lit(""))


def is_external(source_ip: Column) -> Column:
    return ~F.coalesce(source_ip, F.lit("")).startswith(K.OFFICE_IP_PREFIX)


def is_cross_department(resource_id: Column, department: Column) -> Column:
    return ~resource_department(resource_id).eqNullSafe(department)


def _attributes(get) -> tuple[list[Column], Column, list[Column]]:
    vocabulary_columns = [get("action"), get("role"), get("department"), get("resource_class")]
    flags = [
        is_unmanaged(get("device_id")),
        is_external(get("source_ip")),
        is_cross_department(get("resource_id"), get("department")),
    ]
    return vocabulary_columns, feature_hour(get("occurred_at")), flags


def feature_vector(get) -> Column:
    """``array<float>`` in ``FEATURE_NAMES`` order; ``get`` maps a field name to its Column."""
    columns, hour, flags = _attributes(get)
    slots: list[Column] = []
    for column, vocabulary in zip(columns, _VOCABULARIES):
        slots += one_hot(column, vocabulary)
    slots.append((hour / F.lit(23.0)).cast("float"))
    slots.append(is_off_hours(hour).cast("float"))
    slots += [f.cast("float") for f in flags]
    return F.array(*slots)


def feature_code(get) -> Column:
    """The event's features packed into one integer."""
    columns, hour, flags = _attributes(get)
    digits: list[Column] = []
    for column, vocabulary in zip(columns, _VOCABULARIES):
        slot = F.when(column == vocabulary[0], F.lit(1))
        for i, value in enumerate(vocabulary[1:], 2):
            slot = slot.when(column == value, F.lit(i))
        digits.append(slot.otherwise(F.lit(0)))
    digits.append(hour)
    digits += [f.cast("int") for f in flags]
    code = digits[0]
    for digit, radix in zip(digits[1:], _RADIX[1:]):
        code = code * F.lit(radix) + digit
    return code.cast("int")


def code_digits(code: Column) -> list[Column]:
    """Attribute slots of a feature code, in packing order."""
    digits, rest = [], code
    for radix in reversed(_RADIX):
        digits.append(F.pmod(rest, F.lit(radix)))
        rest = F.floor(rest / F.lit(radix)).cast("int")
    return digits[::-1]


def vector_of_code(code: Column) -> Column:
    """Feature vector of a code; a negative code (padding) is the zero vector."""
    *slots, hour, unmanaged, external, cross = code_digits(code)
    values: list[Column] = []
    for slot, vocabulary in zip(slots, _VOCABULARIES):
        values += [(slot == i).cast("float") for i in range(1, len(vocabulary) + 1)]
    values.append((hour / F.lit(23.0)).cast("float"))
    values.append(is_off_hours(hour).cast("float"))
    values += [v.cast("float") for v in (unmanaged, external, cross)]
    zero = F.array(*[F.lit(0.0).cast("float")] * len(values))
    return F.when(code < 0, zero).otherwise(F.array(*values))
