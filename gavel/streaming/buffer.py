"""Keyed streaming state: each user's last eight feature codes, in arrival order."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from gavel import constants as K

STATE = T.StructType([T.StructField("code", T.IntegerType())])
OUTPUT = T.StructType(
    [
        T.StructField("user_id", T.StringType()),
        T.StructField("event_id", T.StringType()),
        T.StructField("occurred_at", T.StringType()),
        T.StructField("code", T.IntegerType()),
        T.StructField("window", T.ArrayType(T.IntegerType())),
    ]
)


class RecentEvents(StatefulProcessor):
    """Rolling buffer of one user. Rows stream through in batches; only ``size``
    codes are ever held, however many events the user has."""

    def __init__(self, size: int = K.WINDOW, ttl_ms: int | None = None):
        self.size, self.ttl_ms = size, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.codes = handle.getListState("codes", STATE, ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        recent = [code for (code,) in self.codes.get()]
        for batch in rows:
            windows = []
            for code in batch["code"]:
                recent = [*recent, int(code)][-self.size:]
                windows.append(recent)
            yield pd.DataFrame(
                {
                    "user_id": key[0],
                    "event_id": batch["event_id"],
                    "occurred_at": batch["occurred_at"],
                    "code": batch["code"].astype("int32"),
                    "window": windows,
                }
            )
        self.codes.put([(c,) for c in recent])

    def close(self) -> None:
        pass


def streaming_windows(events: DataFrame, *, size: int = K.WINDOW, ttl_ms: int | None = None) -> DataFrame:
    """``user_id, event_id, occurred_at, code, window`` for a stream of coded events.

    State is kept by user in the RocksDB provider. It never expires unless
    ``ttl_ms`` is given.
    """
    return events.select("user_id", "event_id", "occurred_at", "code").groupBy("user_id").transformWithStateInPandas(
        statefulProcessor=RecentEvents(size, ttl_ms),
        outputStructType=OUTPUT,
        outputMode="Append",
        timeMode="ProcessingTime" if ttl_ms else "None",
    )
