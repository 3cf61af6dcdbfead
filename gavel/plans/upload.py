"""The upload plan: mixed files in, one result row per record or problem out."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gavel import schemas as S
from gavel.functions.clock import now_iso
from gavel.functions.keys import run_id as make_run_id
from gavel.operators.contracts import with_errors
from gavel.operators.decide import decisions_of
from gavel.operators.normalize import normalize
from gavel.operators.ranks import without
from gavel.plans.govern import govern, with_decision_errors
from gavel.session import stage
from gavel.sources.decisions import save_run
from gavel.sources.records import (
    ColumnFields, JsonFields, infer_plane, list_files, read_jsonl, read_text_documents,
)

UNREADABLE = "could not read file"
EMPTY = "no content found in file"
NO_PDF = "could not read file: PDF text extraction is not built in"


JSONL, PDF = ".jsonl", ".pdf"


def _file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def _error_rows(files: DataFrame, message: str) -> DataFrame:
    return files.select("filename", F.lit(message).alias("error"))


def reject_broken_files(lines: DataFrame, file: str = "source_file") -> tuple[DataFrame, DataFrame]:
    """(lines of sound files, one row per file with a malformed line).

    Broken files are found by a map-side maximum, not by a window over each
    file, so one huge file stays spread over its splits.
    """
    broken = lines.groupBy(file).agg(F.max("malformed").alias("bad")).filter("bad").select(file)
    return without(lines, broken, file), broken


def upload_events(spark: SparkSession, path: str, ingested_at: str, source: str = "upload") -> tuple[DataFrame, DataFrame]:
    """(normalised events with ``filename``, file-level error rows) of every file under ``path``.

    JSON lines are read by splits, however large a file is, and parsed once: what is
    known of each line is staged, and broken and empty files are told from that. Only text
    files are read whole. Names and PDFs come from a listing that opens no file.
    """
    fields = JsonFields("record")
    records = read_jsonl(spark, path).drop("value").withColumn("filename", _file_name(F.col("source_file")))
    prefix = F.concat(F.lit(source + ":"), F.col("filename"))
    parsed = normalize(
        records, fields, plane=infer_plane(fields), source=prefix, ingested_at=ingested_at,
        keep=("filename", "source_file", "malformed"),
    )
    lines = stage(parsed)
    sound, broken = reject_broken_files(lines)

    documents = read_text_documents(spark, path, without=(JSONL, PDF)).withColumn("filename", F.col("document_id"))
    texts = stage(documents)
    docs = texts.filter(F.col("text").isNotNull())
    from_texts = normalize(
        docs, ColumnFields(docs), plane="content", source=prefix, ingested_at=ingested_at, keep=("filename",)
    )

    listed = list_files(spark, path)
    lowered = F.lower("filename")
    with_records = lines.select(F.col("source_file").alias("found")).distinct()
    same = F.col("source_file") == F.col("found")
    empty_jsonl = listed.filter(lowered.endswith(JSONL)).join(with_records, same, "left_anti")
    problems = (
        _error_rows(broken.withColumn("filename", _file_name(F.col("source_file"))), UNREADABLE)
        .unionByName(_error_rows(texts.filter(F.col("text").isNull()), EMPTY))
        .unionByName(_error_rows(empty_jsonl, EMPTY))
        .unionByName(_error_rows(listed.filter(lowered.endswith(PDF)), NO_PDF))
    )
    return sound.drop("source_file", "malformed").unionByName(from_texts), problems


def results_of(events: DataFrame, problems: DataFrame, run_id: str, decided_at: str, **ports) -> DataFrame:
    """Result rows of a run: event with decision, or error."""
    checked = with_errors(events)
    ok = F.size("errors") == 0
    governed = with_decision_errors(govern(checked.filter(ok).drop("errors"), decided_at=decided_at, **ports))
    good = F.size("errors") == 0
    event = F.struct(*S.EVENT.fieldNames())
    decided = decisions_of(governed).columns
    decision = F.struct(
        *[F.col(c) if c in governed.columns else F.lit(None).cast(S.DECISION[c].dataType).alias(c) for c in decided]
    )
    message = F.concat_ws("; ", "errors")
    rows = governed.select(
        "filename", F.when(good, event).alias("event"), F.when(good, decision).alias("decision"),
        F.when(~good, message).alias("error"),
    )
    dead = checked.filter(~ok).select("filename", message.alias("error"))
    return (
        rows.unionByName(dead, allowMissingColumns=True)
        .unionByName(problems, allowMissingColumns=True)
        .withColumn("run_id", F.lit(run_id))
        .select(*S.RUN_RESULT.fieldNames())
    )


def run_upload(
    spark: SparkSession, path: str, *, decisions_path: str, runs_path: str, created_at: str | None = None, **ports
) -> str:
    """Process every file under ``path``; store decisions and results; returns the run id.

    The id is made of the path and ``created_at``: a run repeated with the same time
    replaces what its first try left behind.
    """
    created_at = created_at or now_iso()
    run_id = make_run_id(created_at, hashlib.md5(f"{path}|{created_at}".encode()).hexdigest())
    events, problems = upload_events(spark, path, ingested_at=created_at)
    save_run(results_of(events, problems, run_id, created_at, **ports), runs_path, run_id, created_at, decisions_path)
    return run_id
