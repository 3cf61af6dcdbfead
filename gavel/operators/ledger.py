"""Write-once decision ledger on Parquet.

A decision id is accepted once, ever: the first row of a batch wins and ids
already stored are refused. Rows are partitioned by the first two characters of
the id, so point reads touch one directory of 256 (and one more for ids that do not
start with two hex digits).
"""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gavel import schemas as S
from gavel.functions.plan import pin
from gavel.sources.decisions import row_json

MISSING_ID = "decision is missing decision_id"
DUPLICATE = "decision already exists"


OTHER_IDS = "__"


def id_prefix(decision_id: Column) -> Column:
    """One of 257 values: two lower-case hex digits, or ``__`` for ids that do not start so."""
    start = F.substring(decision_id, 1, 2)
    return F.when(start.rlike("^[0-9a-f]{2}$"), start).otherwise(F.lit(OTHER_IDS))


def prefix_of(decision_id: str) -> str:
    return decision_id[:2] if re.fullmatch("[0-9a-f]{2}", decision_id[:2]) else OTHER_IDS


def stored_of(ledger: DataFrame, ids: DataFrame) -> DataFrame:
    """The stored rows with an id among ``ids`` (``decision_id``).

    First come the directories that ``ids`` fall into: a list of 257 values at most, which
    is broadcast and lets Spark leave the other directories unread (dynamic pruning). What
    is read of these is then streamed past the ids; nothing of the ledger moves where the
    ids are few enough for Spark to broadcast them.
    """
    prefixes = ids.filter(F.length("decision_id") > 0).select(id_prefix(F.col("decision_id")).alias("id_prefix"))
    near = ledger.join(F.broadcast(prefixes.distinct()), "id_prefix", "left_semi")
    return near.join(ids.select("decision_id"), "decision_id", "left_semi")


def transaction_id() -> Column:
    """Digest of the decision: the same decision always has the same transaction."""
    return F.sha2(
        F.concat_ws(
            "|", "decision_id", "event_id", "decided_at", "action", F.array_join("rule_ids", ",")
        ),
        256,
    )


def record(batch: DataFrame, stored: DataFrame, order: Column) -> tuple[DataFrame, DataFrame]:
    """(accepted rows with ``ledger_tx_id``, rejected rows with ``reason``).

    ``order`` ranks the rows of the batch and must differ between rows that
    share an id. Copies of one id are reduced by a map-side minimum; the winners
    join back on (id, order), a key no two rows share, so a heavily repeated id
    stays spread over all tasks. Of the ledger (``id_prefix, decision_id``) only the
    directories of the batch are read, and reduced to its ids first.
    """
    marked = pin(batch.withColumn("_order", order), "decision_id", "_order")
    has_id = F.length(F.coalesce("decision_id", F.lit(""))) > 0
    valid = marked.filter(has_id)
    winners = valid.groupBy("decision_id").agg(F.min("_order").alias("_order"))
    known = stored_of(stored, winners).select("decision_id").distinct()
    fresh = winners.join(known, "decision_id", "left_anti").withColumn("_fresh", F.lit(True))
    judged = valid.join(fresh, ["decision_id", "_order"], "left")
    accepted = judged.filter(F.col("_fresh")).drop("_fresh", "_order")
    refused = judged.filter(F.col("_fresh").isNull()).withColumn("reason", F.lit(DUPLICATE))
    nameless = marked.filter(~has_id).withColumn("reason", F.lit(MISSING_ID))
    rejected = refused.unionByName(nameless, allowMissingColumns=True).drop("_fresh", "_order")
    return accepted.withColumn("ledger_tx_id", transaction_id()), rejected


def open_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The stored rows; a ledger never written to is an empty table."""
    try:
        return spark.read.schema(S.LEDGER_ROW).parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], S.LEDGER_ROW)


def ledger_rows(accepted: DataFrame, recorded_at: Column | str) -> DataFrame:
    moment = F.lit(recorded_at) if isinstance(recorded_at, str) else recorded_at
    return accepted.withColumns(
        {"recorded_at": moment, "id_prefix": id_prefix(F.col("decision_id"))}
    ).select(*S.LEDGER_ROW.fieldNames())


def write_rows(rows: DataFrame, path: str) -> None:
    """Append ledger rows, gathered by directory.

    Spark sizes the writers: a directory with little is written by one task, one that
    holds much by several. A Bloom filter on the id, as large as its file needs, lets
    point reads skip files.
    """
    (
        rows.hint("rebalance", F.col("id_prefix"))
        .write.mode("append")
        .option("parquet.bloom.filter.enabled#decision_id", "true")
        .option("parquet.bloom.filter.adaptive.enabled", "true")
        .partitionBy("id_prefix")
        .parquet(path)
    )


def append(
    batch: DataFrame, path: str, order: Column, recorded_at: str, rejects_path: str | None = None
) -> DataFrame:
    """Append the accepted decisions of ``batch``; returns the rejected rows.

    Replaying a batch appends nothing, because its ids are stored by then. Rejects are
    written (id and reason) before the append, and left alone by a replay. One writer
    at a time: a ledger has no lock.
    """
    accepted, rejected = record(batch, open_ledger(batch.sparkSession, path), order)
    if rejects_path:
        rejected.select("decision_id", "reason").write.mode("ignore").json(rejects_path)
    write_rows(ledger_rows(accepted, recorded_at), path)
    return rejected


def get(ledger: DataFrame, decision_id: str, *, required: bool = False) -> DataFrame:
    """The stored row of one id. ``required`` raises when there is none."""
    here = F.col("id_prefix") == prefix_of(decision_id)
    found = ledger.filter(here & (F.col("decision_id") == decision_id))
    if required and not found.limit(1).count():
        raise KeyError(f"decision {decision_id} does not exist")
    return found


def lookup(ledger: DataFrame, candidates: DataFrame) -> DataFrame:
    """Bulk read: every candidate (``decision_id``) with its stored row, or ``found`` false."""
    stored = stored_of(ledger, candidates).drop("id_prefix").withColumn("found", F.lit(True))
    return candidates.join(stored, "decision_id", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def exists(ledger: DataFrame, candidates: DataFrame) -> DataFrame:
    """The candidates (``decision_id``) that are stored."""
    return candidates.join(stored_of(ledger, candidates).select("decision_id"), "decision_id", "left_semi")


def scan(ledger: DataFrame) -> DataFrame:
    """All rows in key order."""
    return ledger.orderBy("decision_id")


def value_json(row: DataFrame) -> Column:
    """Compact JSON of the stored value, the decision and its transaction, with sorted
    keys; absent fields are left out."""
    return row_json(row, S.DECISION.fieldNames() + ["ledger_tx_id"])


def history(ledger: DataFrame, decision_id: str | None = None) -> DataFrame:
    """Key history. Nothing updates or deletes, so an id has one entry."""
    rows = ledger if decision_id is None else get(ledger, decision_id)
    return rows.select(
        "decision_id",
        F.col("ledger_tx_id").alias("tx_id"),
        F.col("recorded_at").alias("timestamp"),
        F.lit(False).alias("is_delete"),
        value_json(rows).alias("value"),
    )
