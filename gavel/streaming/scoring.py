"""Scoring access events inside a micro-batch, with what came before it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gavel.operators.models import AnomalyModel, on_plane, with_code
from gavel.streaming.windows import windows_with_history


def history_scorer(model: AnomalyModel, state: str, batch_id: int) -> Callable[[DataFrame], DataFrame]:
    """Anomaly scorer port of one micro-batch: an event is scored on its user's last events,
    those of earlier batches included. ``window`` stays beside the scores, because the next
    batches borrow from it (``carry.save_carry``).

    If events arrive in the order of their times, scores equal those of the whole table
    scored at once; a late event joins its user's history where it arrives.
    """

    def score(access: DataFrame) -> DataFrame:
        rows = with_code(access).withColumn("_user", F.col("access.user_id"))
        windows = windows_with_history(rows, batch_id, state, user="_user")
        return model.scores(windows).drop("_user", "code")

    return lambda events: on_plane(events, "access", score)
