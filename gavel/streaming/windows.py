"""User windows over a stream without a hot task.

``streaming_windows`` keeps state by user, so one very busy user is one task.
Here each micro-batch is windowed like a batch table, dealt by ranges that
spread over all tasks, and only a user's last seven codes travel between
batches, through a small table of versions on shared storage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gavel import constants as K
from gavel.operators.sequences import last_values, user_windows
from gavel.session import stage
from gavel.streaming.carry import carried_before, save_carry


def windows_with_history(rows: DataFrame, batch_id: int, state: str, *, user: str = "user_id", size: int = K.WINDOW) -> DataFrame:
    """``user_windows`` of one micro-batch that go on from the batches before it."""
    before = carried_before(rows.sparkSession, state, batch_id)
    touched = rows.select(F.col(user).alias("user_id")).distinct()
    earlier = before.join(touched, "user_id", "left_semi").withColumnRenamed("user_id", user)
    return user_windows(rows, user=user, size=size, earlier=earlier)


def window_batch(
    batch: DataFrame, batch_id: int, state: str, *, size: int = K.WINDOW, sink: Callable[[DataFrame, int], None]
) -> None:
    """Window one micro-batch (``user_id, event_id, occurred_at, code``) and hand it to ``sink``.

    Batches follow each other in arrival order; inside one, events are ordered
    by time and id. A replay reads the same earlier versions and overwrites its
    own, so it repeats the same result. The batch is read once and windowed once.
    """
    turn = f"{state}.staged/{batch_id % 2}"  # two batches are kept, for a replay of the last one
    rows = stage(batch, f"{turn}/batch")
    windows = stage(windows_with_history(rows, batch_id, state, size=size), f"{turn}/windows")
    sink(windows, batch_id)
    save_carry(last_values(windows, size), state, batch_id)


def window_stream(events: DataFrame, state: str, checkpoint: str, sink: Callable[[DataFrame, int], None]):
    """Window a stream of coded events until all that has arrived is done."""
    return (
        events.writeStream.foreachBatch(lambda batch, i: window_batch(batch, i, state, sink=sink))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
