"""Table shapes shared by every source, sink and operator."""

from __future__ import annotations

from pyspark.sql import types as T


def _strings(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names]


ACCESS = T.StructType(
    _strings(
        "user_id", "role", "department", "resource_id", "resource_class", "action",
        "source_ip", "device_id", "session_id",
    )
)
# ``metadata`` is a free-form object; it is kept as its JSON text.
CONTENT = T.StructType(_strings("document_id", "text", "label", "metadata"))

EVENT = T.StructType(
    _strings("event_id", "event_type", "data_plane", "occurred_at", "source")
    + [T.StructField("content", CONTENT), T.StructField("access", ACCESS)]
)

SIGNALS = T.StructType(
    [
        T.StructField("content_class", T.StringType()),
        T.StructField("content_confidence", T.DoubleType()),
        T.StructField("isolation_forest_score", T.DoubleType()),
        T.StructField("lstm_score", T.DoubleType()),
        T.StructField("fused_anomaly_score", T.DoubleType()),
    ]
)
LEDGER = T.StructType(_strings("channel", "chaincode", "transaction_id"))

DECISION = T.StructType(
    _strings("decision_id", "event_id", "decided_at", "action")
    + [
        T.StructField("rule_ids", T.ArrayType(T.StringType())),
        T.StructField("signals", SIGNALS),
        T.StructField("ledger", LEDGER),
        T.StructField("explanation", T.StringType()),
    ]
)
# What the write-once table stores: the decision plus its transaction.
LEDGER_ROW = T.StructType(
    DECISION.fields + _strings("ledger_tx_id", "recorded_at", "id_prefix")
)

RUN = T.StructType(
    _strings("run_id", "created_at")
    + [T.StructField("processed", T.LongType()), T.StructField("errors", T.LongType())]
)
RUN_RESULT = T.StructType(
    _strings("run_id", "filename")
    + [
        T.StructField("event", EVENT),
        T.StructField("decision", DECISION),
        T.StructField("error", T.StringType()),
    ]
)

# Flat raw access log as a typed table, labels included.
RAW_ACCESS = T.StructType(
    _strings(
        "event_id", "event_type", "occurred_at", "user_id", "role", "department",
        "resource_id", "resource_class", "action", "source_ip", "device_id", "session_id",
    )
    + [T.StructField("is_anomaly", T.BooleanType()), T.StructField("anomaly_reason", T.StringType())]
)
RAW_CONTENT = T.StructType(_strings("event_id", "occurred_at", "document_id", "text", "label", "metadata"))
