"""File-arrival ingestion: raw objects in, events and decisions out, exactly once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gavel import schemas as S
from gavel.functions.clock import now_iso
from gavel.functions.keys import decoded_key, output_key, plane_of_key
from gavel.operators.contracts import fail_on_error, split_valid, with_errors
from gavel.operators.decide import decisions_of, recorded_as
from gavel.operators.ledger import ledger_rows, open_ledger, record, stored_of, write_rows
from gavel.operators.metrics import object_summary
from gavel.operators.models import AnomalyModel
from gavel.operators.normalize import normalize
from gavel.operators.sequences import last_values
from gavel.plans.govern import govern, with_decision_errors
from gavel.session import stage
from gavel.sources.decisions import sorted_columns
from gavel.sources.records import JsonFields, stream_jsonl
from gavel.streaming.carry import save_carry
from gavel.streaming.scoring import history_scorer


def key_under(root: str, path: Column) -> Column:
    """Object key: the decoded path below ``root``."""
    base = root.rstrip("/").split("://")[-1].removeprefix("file:")
    return F.regexp_replace(decoded_key(path), f"^.*?\\Q{base}/\\E", "")


def normalized_stream(lines: DataFrame, root: str, ingested_at: str) -> DataFrame:
    """Canonical events of JSON lines; the object key declares the plane.

    A key that names no plane, or both, makes its records dead letters.
    """
    fields = JsonFields("record")
    keyed = lines.withColumn("key", key_under(root, F.col("source_file")))
    events = normalize(
        keyed, fields, plane=F.coalesce(plane_of_key(F.col("key")), F.lit("ambiguous key")),
        source=decoded_key(F.col("source_file")), ingested_at=ingested_at, keep=("malformed", "key"),
    )
    unreadable = F.array(F.lit("malformed JSON"))
    problems = F.when(F.col("malformed"), unreadable).otherwise(F.col("problems"))
    return events.withColumn("problems", problems).drop("malformed")


class BatchStage:
    """The tables of one micro-batch on shared storage, written once each.

    Two folders take turns, so that the last batch can be replayed and nothing piles up.
    A table counts as written when its ``done`` row names this batch: a replay finds it
    and goes on from there, with the same rows, ids and times as the first time.
    """

    def __init__(self, spark: SparkSession, out: str, batch_id: int):
        self.spark, self.batch_id = spark, batch_id
        self.folder = f"{out}/staged/{batch_id % 2}"

    def _is_done(self, name: str) -> bool:
        try:
            done = self.spark.read.schema("batch_id long").parquet(f"{self.folder}/{name}.done")
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return False
        return done.filter(F.col("batch_id") == self.batch_id).limit(1).count() > 0

    def once(self, name: str, make: Callable[[], DataFrame]) -> tuple[DataFrame, bool]:
        """(the table, whether it was there already); ``make`` is called if it was not."""
        path = f"{self.folder}/{name}"
        if self._is_done(name):
            return self.spark.read.parquet(path), True
        table = stage(make(), path)
        done = self.spark.range(1).select(F.lit(self.batch_id).cast("bigint").alias("batch_id"))
        done.write.mode("overwrite").parquet(f"{path}.done")
        return table, False


EVENT_COLUMNS = ["event_id", "event_type", "data_plane", "occurred_at", "source", "content", "access"]


def govern_batch(
    batch: DataFrame, batch_id: int, *, root: str, out: str, ledger: str | None, ingested_at: str,
    fail_fast: bool = False, model: AnomalyModel | None = None, history: str | None = None, **ports,
) -> None:
    """One micro-batch: normalise, check, score, decide, check again, record, write.

    Three tables are staged, one after the other, each once: the checked records, the
    decisions made of the valid ones (with their contract violations), and which
    decisions the ledger takes. All outputs are written from them, so they agree with each
    other, a lost executor costs no rescoring, and a replay repeats the same rows:
    ``events`` and ``decisions`` (with ledger coordinates where recorded), ``dead`` (records
    and decisions that break a contract), ``rejects`` (decisions the ledger refused) and
    ``summaries`` (records per object).

    ``model`` scores access events with their users' last events, those of earlier batches
    included; ``history`` is the folder that keeps these between batches.
    """
    spark = batch.sparkSession
    staged = BatchStage(spark, out, batch_id)
    folder = f"batch={batch_id:010d}"

    def number(df: DataFrame) -> DataFrame:
        return df.withColumn("seq", F.monotonically_increasing_id())

    checked, _ = staged.once("checked", lambda: number(with_errors(normalized_stream(batch, root, ingested_at))))
    if fail_fast:
        fail_on_error(checked).select("seq").write.format("noop").mode("overwrite").save()
    valid, broken = split_valid(checked)

    def decide() -> DataFrame:
        if model is not None:
            if history is None:
                raise ValueError("scoring with history needs a folder for it")
            ports["scorer"] = history_scorer(model, history, batch_id)
        return with_decision_errors(govern(valid, decided_at=ingested_at, **ports))

    governed, _ = staged.once("governed", decide)
    good, bad = split_valid(governed)
    if fail_fast:
        fail_on_error(governed).select("seq").write.format("noop").mode("overwrite").save()
    if history is not None:
        scored = good.filter(F.col("window").isNotNull()).withColumn("user_id", F.col("access.user_id"))
        save_carry(last_values(scored), history, batch_id)

    decision = [c for c in S.DECISION.fieldNames() if c in good.columns]
    decisions = good.select("seq", "key", "data_plane", *decision)
    refused = None
    if ledger:

        def judge() -> DataFrame:
            accepted, rejected = record(decisions_of(good, "seq"), open_ledger(spark, ledger), F.col("seq"))
            taken = accepted.select("seq", "ledger_tx_id", F.lit(None).cast("string").alias("reason"))
            return taken.unionByName(rejected.select("seq", F.lit(None).cast("string").alias("ledger_tx_id"), "reason"))

        judged, replayed = staged.once("judged", judge)
        taken = judged.filter(F.col("ledger_tx_id").isNotNull()).select("seq", "ledger_tx_id")
        rows = ledger_rows(decisions_of(good, "seq").join(taken, "seq"), ingested_at)
        if replayed:  # the rows may be there already, or some of them
            rows = rows.join(stored_of(open_ledger(spark, ledger), rows).select("decision_id"), "decision_id", "left_anti")
        write_rows(rows.select(*S.LEDGER_ROW.fieldNames()), ledger)
        placed = recorded_as(decisions.join(taken, "seq", "left"), F.col("ledger_tx_id"))
        decisions = placed.drop("ledger_tx_id")
        refused = good.select("seq", "key", "data_plane", "decision_id").join(
            judged.filter(F.col("reason").isNotNull()).select("seq", "reason"), "seq"
        )

    def put(df: DataFrame, name: str) -> None:
        rows = sorted_columns(df.withColumn("source_file", output_key(F.col("key"))).drop("key", "seq"))
        by = ["data_plane", "source_file"]
        # Spark sizes the writers: small objects share a task, a large one gets several
        spread = rows.hint("rebalance", *map(F.col, by))
        spread.write.mode("overwrite").partitionBy(*by).json(f"{out}/{name}/{folder}")

    put(good.select("key", *EVENT_COLUMNS), "events")
    put(decisions, "decisions")
    wrong = bad.select("key", *EVENT_COLUMNS, F.transform("errors", lambda e: F.concat(F.lit("decision "), e)).alias("errors"))
    dead = broken.drop("seq").unionByName(wrong)
    put(dead, "dead")
    if refused is not None:
        put(refused, "rejects")
    object_summary(good, dead).write.mode("overwrite").json(f"{out}/summaries/{folder}")


def start_ingest(
    spark: SparkSession, raw: str, out: str, checkpoint: str, *, root: str | None = None, ledger: str | None = None,
    max_files: int = 1000, fail_fast: bool = False, ingested_at: str | None = None, **options,
) -> StreamingQuery:
    """Start ingesting ``raw`` until everything that has arrived is done.

    Object keys are paths below ``root`` (default: the folder that holds
    ``raw``). Outputs tolerate a replay of a micro-batch: its folders are
    overwritten with the same rows and the ledger refuses ids it has. ``options`` are the
    ports, ``model`` and ``history`` of ``govern_batch``.
    """
    lines = stream_jsonl(spark, raw, max_files=max_files)
    base = root or raw.rstrip("/").rsplit("/", 1)[0]

    def each(batch: DataFrame, batch_id: int) -> None:
        govern_batch(
            batch, batch_id, root=base, out=out, ledger=ledger, ingested_at=ingested_at or now_iso(),
            fail_fast=fail_fast, **options,
        )

    return (
        lines.writeStream.foreachBatch(each)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
