"""Raw records -> canonical events, one row each, with the problems found.

Both planes come out of a single projection: no branch rescans the source.
Labels such as ``is_anomaly`` and unknown fields are never selected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavel import constants as K
from gavel import schemas as S
from gavel.functions.keys import uuid_text
from gavel.functions.plan import first_of
from gavel.sources.records import ColumnFields, JsonFields


def _struct(fields, names, schema) -> Column:
    parts = ", ".join(f"'{n}', {fields.text(n)}" for n in names)
    return F.expr(f"CAST(named_struct({parts}) AS {schema.simpleString()})")


def _access_checks(fields) -> list[tuple[str, str]]:
    missing = [(f"missing {n}", f"NOT ({fields.present(n)})") for n in K.ACCESS_REQUIRED]
    return missing + [(f"access.{n}", fields.wrong_type(n)) for n in K.ACCESS_REQUIRED + K.ACCESS_OPTIONAL]


def _content_checks(fields) -> list[tuple[str, str]]:
    missing = [(f"missing {n}", f"coalesce({fields.text(n)}, '') = ''") for n in K.CONTENT_REQUIRED]
    typed = [(f"content.{n}", fields.wrong_type(n)) for n in ("document_id", "text", "label")]
    return missing + typed + [("content.metadata", fields.wrong_type("metadata", "OBJECT"))]


def normalize(
    df: DataFrame,
    fields: JsonFields | ColumnFields,
    *,
    plane: Column | str,
    source: Column | str,
    ingested_at: str,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Canonical events plus ``problems`` (why a record cannot be normalised).

    ``ingested_at`` stands in for a missing ``occurred_at``; a missing event id
    is derived from the record, so a retry repeats it. ``keep`` passes columns of
    ``df`` through beside the event.
    """
    plane = F.lit(plane) if isinstance(plane, str) else plane
    source = F.lit(source) if isinstance(source, str) else source
    is_access, is_content = plane == "access", plane == "content"

    access = _struct(fields, K.ACCESS_REQUIRED + K.ACCESS_OPTIONAL, S.ACCESS)
    content = _struct(fields, K.CONTENT_REQUIRED + K.CONTENT_OPTIONAL, S.CONTENT)
    derived_id = uuid_text(
        F.lit("event"), source, plane,
        *[F.expr(fields.text(n)) for n in ("occurred_at", *K.ACCESS_REQUIRED, *K.ACCESS_OPTIONAL, *K.CONTENT_REQUIRED)],
    )
    shared = [(n, fields.wrong_type(n)) for n in ("event_id", "occurred_at")]
    problems = (
        F.when(is_access, F.expr(first_of(_access_checks(fields) + shared)))
        .when(is_content, F.expr(first_of(_content_checks(fields) + shared)))
        .otherwise(F.array(F.lit("unknown data_plane")))
    )

    def filled(name: str) -> Column:
        return F.expr(f"nullif({fields.text(name)}, '')")

    return df.select(
        F.coalesce(filled("event_id"), derived_id).alias("event_id"),
        plane.alias("event_type"),
        plane.alias("data_plane"),
        F.coalesce(filled("occurred_at"), F.lit(ingested_at)).alias("occurred_at"),
        source.alias("source"),
        F.when(is_content, content).alias("content"),
        F.when(is_access, access).alias("access"),
        problems.alias("problems"),
        *keep,
    )


def normalize_table(df: DataFrame, plane: str, *, source: Column | str, ingested_at: str, keep=()) -> DataFrame:
    """``normalize`` for a typed table of one plane."""
    return normalize(
        df, ColumnFields(df), plane=plane, source=source, ingested_at=ingested_at, keep=keep
    )


def union_planes(*events: DataFrame) -> DataFrame:
    """One canonical event stream out of several."""
    out = events[0]
    for more in events[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out
