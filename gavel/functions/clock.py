"""Time scalars on ISO-8601 text.

The hour is read in the text's *own* offset, so no timestamp is ever parsed:
``hour(to_timestamp(...))`` would shift it to the session time zone.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

from gavel import constants as K

# Formats fixed by ISO 8601.
_ZONE = r"(?:Z|[+-]\d{2}(?::?[0-5]\d(?::?[0-5]\d(?:\.\d+)?)?)?)?"
_TIME = r"(?:[01]\d|2[0-3])(?::[0-5]\d(?::[0-5]\d(?:[.,]\d+)?)?|[0-5]\d(?:[0-5]\d(?:[.,]\d+)?)?)?" + _ZONE
_DAY = r"\d{4}-\d{2}-\d{2}"
_OTHER_DAY = r"(?:\d{8}|\d{4}-?W(?:0[1-9]|[1-4]\d|5[0-3])(?:-?[1-7])?)"


def iso_hour(occurred_at: Column) -> Column:
    """Hour 0-23 of an ISO-8601 date-time text; null when it does not parse."""
    usual = occurred_at.rlike(f"^{_DAY}(?:.{_TIME})?\\z") & F.substring(occurred_at, 1, 10).try_cast(
        "date"
    ).isNotNull()
    compact = F.regexp_replace(occurred_at, r"^(\d{4})(\d{2})(\d{2})", "$1-$2-$3")
    other = occurred_at.rlike(f"^{_OTHER_DAY}(?:.{_TIME})?\\z") & (
        occurred_at.contains("W") | F.substring(compact, 1, 10).try_cast("date").isNotNull()
    )
    late = F.regexp_extract(occurred_at, f"^{_OTHER_DAY}.(\\d{{2}})", 1)
    return F.when(
        usual, F.coalesce(F.substring(occurred_at, 12, 2).try_cast("int"), F.lit(0))
    ).when(other, F.coalesce(late.try_cast("int"), F.lit(0)))


def feature_hour(occurred_at: Column) -> Column:
    """Hour used by the feature vector: noon when the text does not parse."""
    return F.coalesce(iso_hour(occurred_at), F.lit(K.FALLBACK_HOUR))


def is_off_hours(hour: Column) -> Column:
    return (hour < K.DAY_START) | (hour >= K.DAY_END)


def iso_text(moment: Column) -> Column:
    """``YYYY-MM-DDTHH:MM:SS.ffffff+00:00`` of a UTC (or zone-less) timestamp."""
    text = moment.cast("timestamp_ntz").cast("string")
    return F.concat(
        F.translate(F.substring(text, 1, 19), " ", "T"),
        F.lit("."),
        F.rpad(F.substring(text, 21, 6), 6, "0"),
        F.lit("+00:00"),
    )


def now_iso() -> str:
    """Driver clock as ISO text; passed in once per batch so retries agree."""
    return datetime.now(timezone.utc).isoformat()


def display_time(occurred_at: Column) -> Column:
    """First 19 characters with the ``T`` shown as a space; a dash when absent."""
    shown = F.substring(F.regexp_replace(occurred_at, "^([^T]*)T", "$1 "), 1, 19)
    return F.when(F.coalesce(occurred_at, F.lit("")) == "", F.lit("—")).otherwise(shown)
