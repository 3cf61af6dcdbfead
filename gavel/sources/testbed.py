"""Adapters from the benchmark tables to governance records.

The tables hold neither access logs nor labelled documents, so both planes are
derived from ``events`` and ``documents`` by fixed arithmetic on their columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gavel import constants as K
from gavel.functions.clock import iso_text
from gavel.functions.keys import uuid_text
from gavel.functions.plan import pin
from gavel.operators.contracts import split_valid, with_errors
from gavel.operators.normalize import normalize_table, union_planes

# Stand-ins for the batch clock, so that results repeat.
INGESTED_AT = "2024-01-31T00:00:00.000000+00:00"
ACCESS_SOURCE = "events.parquet"
CONTENT_SOURCE = "documents.parquet"
# The shipped dictionary is English; the documents are invented words with marks.
TEST_KEYWORDS = {"PII": ("@", "+1 ("), "financial": ("|",), "policy": ("license",)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values, index: Column) -> Column:
    """``values[index]`` for an in-range zero-based index."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def access_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat access log derived from ``events``, with its label and ``seq`` (input position)."""
    ev = table(spark, sf_dir, "events").select(
        "event_id", "ts", "user_id", "event_type",
        F.regexp_extract("props", r"(\d+)", 1).cast("bigint").alias("k"),
    )
    u, k, kind = F.col("user_id"), F.col("k"), F.col("event_type")
    resource_dept = pick(K.DEPARTMENTS, F.pmod(u + F.when(k % 8 == 0, 1).otherwise(0), F.lit(6)))
    cls = pick(K.CLASSES, F.pmod(k, F.lit(5)))
    slot = F.lpad((F.pmod(k, F.lit(5)) + 1).cast("string"), 3, "0")
    action = (
        F.when(kind == "view", "read").when(kind == "click", "search")
        .when(kind == "purchase", "download").when(kind == "signup", "update")
        .otherwise(pick(K.RISKY_ACTIONS, F.pmod(k, F.lit(3))))
    )
    device = F.when(k % 10 == 0, F.lit(None)).when(
        k % 10 == 1, F.concat(F.lit("unmanaged-"), k.cast("string"))
    ).otherwise(F.concat(F.lit("managed-"), u.cast("string")))
    ip = F.when(k % 7 == 0, F.concat(F.lit("198.51.100."), k.cast("string"))).otherwise(
        F.concat_ws(".", F.lit("10"), (u % 12 + 1).cast("string"), F.lit("0"), k.cast("string"))
    )
    rows = ev.select(
        F.col("event_id").alias("seq"),
        uuid_text(F.col("event_id")).alias("event_id"),
        iso_text(F.col("ts")).alias("occurred_at"),
        u.cast("string").alias("user_id"),
        F.when(u % 4 == 0, "manager").otherwise("analyst").alias("role"),
        pick(K.DEPARTMENTS, F.pmod(u, F.lit(6))).alias("department"),
        F.concat_ws("-", resource_dept, F.lower(cls), slot).alias("resource_id"),
        cls.alias("resource_class"),
        action.alias("action"),
        ip.alias("source_ip"),
        device.alias("device_id"),
        (kind == "error").alias("is_anomaly"),
        k.alias("k"),
    )
    return pin(rows, *rows.columns)  # stands in for a stored log, so it is derived once


def dirty_access_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The access log with every kind of contract violation worked in, by ``k``."""
    r, k = access_records(spark, sf_dir), F.col("k")
    dirty = r.withColumns(
        {
            "event_id": F.when(k == 11, F.lit("")).when(k == 12, F.lit("not-a-uuid")).otherwise(F.col("event_id")),
            "action": F.when(k == 21, F.lit(None)).when(k == 22, F.lit("format_disk")).otherwise(F.col("action")),
            "resource_class": F.when(k == 31, F.lit("secret")).otherwise(F.col("resource_class")),
            "user_id": F.when(k == 41, F.lit("")).otherwise(F.col("user_id")),
            "occurred_at": F.when(k == 51, F.lit("not-a-date")).when(k == 52, F.lit(None)).otherwise(F.col("occurred_at")),
        }
    )
    return pin(dirty, *dirty.columns)


def content_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        uuid_text(F.lit("doc"), F.col("doc_id")).alias("event_id"),
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("document_id"),
        "text",
        F.col("doc_id").alias("seq"),
    )


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that ``labels`` covers, with a class made of its two marks."""
    marks = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    label = F.when(F.col("toxic") == 1, "policy").when(F.col("quality") == 0, "internal").otherwise("public")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").join(marks, "doc_id")
    return docs.select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("document_id"), "text", label.alias("label"),
        F.col("doc_id").alias("row"),
    )


def access_events(spark: SparkSession, sf_dir: str, keep=()) -> DataFrame:
    """Valid canonical access events."""
    raw = access_records(spark, sf_dir)
    norm = normalize_table(raw, "access", source=ACCESS_SOURCE, ingested_at=INGESTED_AT, keep=keep)
    return split_valid(with_errors(norm))[0]


def content_events(spark: SparkSession, sf_dir: str, keep=()) -> DataFrame:
    raw = content_records(spark, sf_dir)
    norm = normalize_table(raw, "content", source=CONTENT_SOURCE, ingested_at=INGESTED_AT, keep=keep)
    return split_valid(with_errors(norm))[0]


def canonical_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return union_planes(access_events(spark, sf_dir), content_events(spark, sf_dir))
