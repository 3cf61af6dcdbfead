"""Signals, decisions and the small decision-level projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavel import constants as K
from gavel import schemas as S
from gavel.functions.clock import display_time
from gavel.functions.keys import uuid_text
from gavel.functions.scores import access_risk, clip01, round4
from gavel.functions.text import keyword_class, keyword_confidence


def keyword_classifier(keywords=K.KEYWORDS, *, whole_words: bool = False):
    """Content classifier port: adds ``content_class`` and ``content_confidence``."""

    def classify(events: DataFrame) -> DataFrame:
        on_content = F.col("data_plane") == "content"
        found = keyword_class(F.col("content.text"), keywords, whole_words=whole_words)
        return events.withColumn("content_class", F.when(on_content, found)).withColumn(
            "content_confidence", F.when(on_content, keyword_confidence(F.col("content_class")))
        )

    return classify


def heuristic_scorer():
    """Anomaly scorer port: adds the three access scores."""

    def score(events: DataFrame) -> DataFrame:
        on_access = F.col("data_plane") == "access"
        risk = access_risk(F.col("access.action"), F.col("access.device_id"), F.col("occurred_at"))
        fused = F.col("_risk")
        return (
            events.withColumn("_risk", F.when(on_access, risk))
            .withColumns(
                {
                    # least() skips nulls, so the plane test comes first
                    "isolation_forest_score": F.when(on_access, round4(clip01(fused + K.RISK_SPREAD))),
                    "lstm_score": F.when(on_access, round4(clip01(fused - K.RISK_SPREAD))),
                    "fused_anomaly_score": F.when(on_access, round4(fused)),
                }
            )
            .drop("_risk")
        )

    return score


def with_signals(scored: DataFrame) -> DataFrame:
    """Fold the signal columns into ``signals``; those of the other plane are null."""
    names = S.SIGNALS.fieldNames()
    return scored.withColumn("signals", F.struct(*names)).drop(*names)


def decision_id_of() -> Column:
    """Derived from the event's fields, ``content.metadata`` apart: a replayed event
    repeats its decision id, and events that differ in any of them never share one."""
    return uuid_text(
        F.lit("decision"), F.col("event_id"), F.col("source"), F.col("occurred_at"),
        *[F.col(f"access.{n}") for n in K.ACCESS_REQUIRED + K.ACCESS_OPTIONAL],
        F.col("content.document_id"), F.md5(F.col("content.text")), F.col("content.label"),
    )


def with_decision(fired: DataFrame, decided_at: Column | str) -> DataFrame:
    """Complete the decision columns; ``decided_at`` is a column or one batch time."""
    moment = F.lit(decided_at) if isinstance(decided_at, str) else decided_at
    return fired.withColumns(
        {
            "decision_id": decision_id_of(),
            "decided_at": moment,
            "rule_ids": F.array_distinct("rule_ids"),
            "explanation": F.when(F.col("explanation") != "", F.col("explanation")),
        }
    )


def with_own_decision(events: DataFrame, decisions: DataFrame) -> DataFrame:
    """Events with the stored decision made of them, as the struct ``decision``.

    An event's decision id is derived from the event, so events that share an ``event_id``
    but differ are not mixed up, and copies of a stored decision do not multiply rows.
    Events without a stored decision are left out.
    """
    names = [f.name for f in S.DECISION.fields if f.name in decisions.columns]
    stored = decisions.select("decision_id", F.struct(*names).alias("decision")).dropDuplicates(["decision_id"])
    return events.withColumn("decision_id", decision_id_of()).join(stored, "decision_id").drop("decision_id")


def decisions_of(governed: DataFrame, *keep: str) -> DataFrame:
    """The decision table of a governed event table (ledger still empty), with the
    columns ``keep`` beside it."""
    columns = [
        F.col(f.name) if f.name in governed.columns else F.lit(None).cast(f.dataType).alias(f.name)
        for f in S.DECISION.fields
    ]
    return governed.select(*columns, *keep)


def plane_of(signals: str = "signals") -> Column:
    """Plane told by the signals a decision carries."""
    return (
        F.when(F.col(f"{signals}.content_class").isNotNull(), F.lit("content"))
        .when(F.col(f"{signals}.fused_anomaly_score").isNotNull(), F.lit("access"))
        .otherwise(F.lit("unknown"))
    )


def is_recorded() -> Column:
    return F.length(F.coalesce(F.col("ledger.transaction_id"), F.lit(""))) > 0


def with_ledger(
    decisions: DataFrame,
    transaction_id: Column,
    channel: str = K.LEDGER_CHANNEL,
    chaincode: str = K.LEDGER_CHAINCODE,
) -> DataFrame:
    """Attach ledger coordinates; see ``recorded_as`` for rows that may have none."""
    where = F.struct(
        F.lit(channel).alias("channel"),
        F.lit(chaincode).alias("chaincode"),
        F.coalesce(transaction_id, F.lit("")).alias("transaction_id"),
    )
    return decisions.withColumn("ledger", where)


def recorded_as(decisions: DataFrame, transaction_id: Column) -> DataFrame:
    """Ledger coordinates for decisions that have a transaction; others have no ``ledger``."""
    placed = with_ledger(decisions, transaction_id)
    return placed.withColumn("ledger", F.when(transaction_id.isNotNull(), F.col("ledger")).cast(S.LEDGER))


def from_ledger_rows(rows: DataFrame) -> DataFrame:
    """Stored rows back to decisions: a flat ``ledger_tx_id`` becomes the nested
    coordinates unless they are there already."""
    flat = F.length(F.coalesce(F.col("ledger_tx_id"), F.lit(""))) > 0
    nested = F.struct(
        F.lit(K.LEDGER_CHANNEL).alias("channel"),
        F.lit(K.LEDGER_CHAINCODE).alias("chaincode"),
        F.col("ledger_tx_id").alias("transaction_id"),
    )
    ledger = F.when(flat & F.col("ledger").isNull(), nested).otherwise(F.col("ledger"))
    return rows.withColumn("ledger", ledger).select(*S.DECISION.fieldNames())


def signal_text() -> Column:
    """``class (confidence)`` or ``anomaly score``, as shown to people."""
    cls, conf = F.col("signals.content_class"), F.col("signals.content_confidence")
    fused = F.col("signals.fused_anomaly_score")

    def shown(x: Column) -> Column:  # whole numbers print without a fraction
        return F.regexp_replace(x.cast("string"), r"\.0$", "")

    bracketed = F.coalesce(F.concat(F.lit("("), shown(conf), F.lit(")")), F.lit(""))
    return (
        F.when(cls.isNotNull(), F.concat(cls, F.lit(" "), bracketed))
        .when(fused.isNotNull(), F.concat(F.lit("anomaly "), shown(fused)))
        .otherwise(F.lit(""))
    )


def display_rows(decisions: DataFrame) -> DataFrame:
    """The decision list as shown to people."""
    tx = F.col("ledger.transaction_id")
    return decisions.select(
        "decision_id",
        display_time(F.col("decided_at")).alias("shown_at"),
        "action",
        F.array_join("rule_ids", ", ").alias("rules"),
        signal_text().alias("signal"),
        F.when(is_recorded(), F.concat(F.substring(tx, 1, 12), F.lit("…"))).otherwise(F.lit("—")).alias("tx"),
    )
