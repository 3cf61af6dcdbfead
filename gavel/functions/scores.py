"""Score arithmetic: clip, round, fuse, normalise and the heuristic access risk."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gavel import constants as K
from gavel.functions.clock import iso_hour, is_off_hours


def clip01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def round4(x: Column) -> Column:
    return F.round(x, 4)


def fuse(iso: Column, sequence: Column, weight: float = K.FUSION_WEIGHT) -> Column:
    return clip01(F.lit(weight) * sequence + F.lit(1.0 - weight) * iso)


def min_max(raw: Column, low: Column | float, high: Column | float) -> Column:
    """Scaled to [0, 1] by the fitted range; a zero range counts as one."""
    low, high = (v if isinstance(v, Column) else F.lit(float(v)) for v in (low, high))
    span = F.when(high - low == 0, F.lit(1.0)).otherwise(high - low)
    return clip01((raw - low) / span)


def ratio(part: Column, whole: Column) -> Column:
    """Rounded to 4 places; 0.0 over an empty whole."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(round4(F.try_divide(part.cast("double"), whole)))


def is_unmanaged(device_id: Column) -> Column:
    device = F.coalesce(device_id, F.lit(""))
    return device.startswith(K.UNMANAGED_PREFIX) | (device == "")


def access_risk(action: Column, device_id: Column, occurred_at: Column) -> Column:
    """Additive risk in the fixed order base, action, device, hour."""
    off_hours = F.coalesce(is_off_hours(iso_hour(occurred_at)), F.lit(False))
    zero = F.lit(0.0)
    risk = (
        F.lit(K.RISK_BASE)
        + F.when(action.isin(*K.RISKY_ACTIONS), F.lit(K.RISK_ACTION)).otherwise(zero)
        + F.when(is_unmanaged(device_id), F.lit(K.RISK_DEVICE)).otherwise(zero)
        + F.when(off_hours, F.lit(K.RISK_OFF_HOURS)).otherwise(zero)
    )
    return clip01(risk)
