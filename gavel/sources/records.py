"""Raw record sources: JSONL files, whole text files, mixed uploads, typed tables.

Every reader takes any path Spark can open (local, ``s3a://``, ...), lists it
natively and yields one row per record; nothing is read on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamReader

from gavel.functions.keys import plane_of_key
from gavel.functions.text import is_blank, strip


# The parser's own limit on one text, 20,000,000 characters, would make longer ones malformed.
LONGEST = str(2**31 - 1)


class JsonFields:
    """Fields of a parsed JSON object (a variant column), as SQL expressions:
    absent, null and wrongly typed stay apart."""

    def __init__(self, record: str = "record"):
        self.record = record

    def _at(self, name: str) -> str:
        return f"variant_get({self.record}, '$.{name}', 'variant')"

    def present(self, name: str) -> str:
        return f"{self._at(name)} IS NOT NULL"

    def text(self, name: str) -> str:
        return f"try_variant_get({self.record}, '$.{name}', 'string')"

    def wrong_type(self, name: str, expected: str = "STRING") -> str:
        """True for a non-null value of another JSON type."""
        kind = f"schema_of_variant({self._at(name)})"
        return f"coalesce({kind} NOT LIKE '{expected}%' AND {kind} <> 'VOID', false)"


class ColumnFields:
    """Fields of a typed table: presence is a property of its schema."""

    def __init__(self, df: DataFrame):
        self.names = set(df.columns)

    def present(self, name: str) -> str:
        return str(name in self.names).lower()

    def text(self, name: str) -> str:
        return f"CAST(`{name}` AS STRING)" if name in self.names else "CAST(NULL AS STRING)"

    def wrong_type(self, name: str, expected: str = "STRING") -> str:
        return "false"


ANY_JSONL = "*.[jJ][sS][oO][nN][lL]"


def _with_file(df: DataFrame) -> DataFrame:
    return df.withColumn("source_file", F.col("_metadata.file_path"))


def parse_lines(lines: DataFrame, line: str = "value") -> DataFrame:
    """JSON lines -> ``record`` (variant) and ``malformed``; blank lines vanish.

    A record that repeats a key is sound, and its last value counts, in sessions with
    ``spark.sql.variant.allowDuplicateKeys`` (set by ``build_session``); in others it is
    malformed.
    """
    record = F.from_json(F.col(line), "variant", {"maxStringLen": LONGEST})
    parsed = lines.filter(~is_blank(F.col(line))).withColumn("record", record)
    is_object = F.schema_of_variant(F.col("record")).startswith("OBJECT")
    return parsed.withColumn("malformed", ~F.coalesce(is_object, F.lit(False)))


def _jsonl_options(reader, glob: str):
    # Only \n and \r\n end a record: U+2028 and friends are legal inside JSON text.
    return reader.option("pathGlobFilter", glob).option("recursiveFileLookup", "true")


def read_jsonl(spark: SparkSession, path: str | list[str], glob: str = ANY_JSONL) -> DataFrame:
    """``source_file, value, record, malformed`` for every JSON line under ``path``."""
    return parse_lines(_with_file(_jsonl_options(spark.read, glob).text(path)))


def stream_jsonl(
    spark: SparkSession, path: str, glob: str = ANY_JSONL, max_files: int = 1000
) -> DataFrame:
    """The same rows as files arrive; ``max_files`` per micro-batch bounds a backlog."""
    reader: DataStreamReader = _jsonl_options(spark.readStream, glob)
    return parse_lines(_with_file(reader.option("maxFilesPerTrigger", max_files).text(path)))


def read_typed_jsonl(spark: SparkSession, path: str, schema, fail_fast: bool = False) -> DataFrame:
    """JSONL of a known shape straight into columns (training tables, decisions)."""
    reader = spark.read.schema(schema).option("mode", "FAILFAST" if fail_fast else "PERMISSIVE")
    reader = reader.option("maxStringLen", LONGEST)
    return reader.json(path)


def list_files(spark: SparkSession, path: str | list[str], glob: str = "*") -> DataFrame:
    """``source_file, filename, size`` of every file; no content is read."""
    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    )
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(F.col("path").alias("source_file"), name.alias("filename"), F.col("length").alias("size"))


def read_text_documents(
    spark: SparkSession, path: str | list[str], glob: str = "*", without: tuple[str, ...] = ()
) -> DataFrame:
    """One content document per file: its name and its stripped text.

    Bytes that are not UTF-8 become replacement characters. Files left empty
    carry no record and appear with ``text`` null, for the caller to report. Files whose
    name ends like one of ``without``, in any case, are not opened.
    """
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", "true")
        .load(path)
    )
    for suffix in without:  # a filter on the name is met while files are listed
        files = files.filter(~F.lower("_metadata.file_name").endswith(suffix))
    text = strip(F.make_valid_utf8(F.col("content").cast("string")))
    return files.select(
        F.col("path").alias("source_file"),
        F.element_at(F.split("path", "/"), -1).alias("document_id"),
        F.when(F.length(text) > 0, text).alias("text"),
    )


def list_keys(spark: SparkSession, root: str, prefix: str = "") -> DataFrame:
    """Object keys under ``root`` that start with ``prefix``, sorted."""
    base = root.rstrip("/").split("://")[-1].removeprefix("file:")
    key = F.element_at(F.split("source_file", f"\\Q{base}/\\E", 2), -1)
    return list_files(spark, root).select(key.alias("key")).filter(F.col("key").startswith(prefix)).orderBy("key")


def infer_plane(fields: JsonFields | ColumnFields) -> Column:
    """Plane of an upload record, from the keys it has (an explicit null counts)."""
    content = f"{fields.present('text')} OR {fields.present('document_id')}"
    access = f"{fields.present('action')} OR {fields.present('user_id')}"
    return F.expr(f"CASE WHEN {content} THEN 'content' WHEN {access} THEN 'access' ELSE 'content' END")


def with_declared_plane(df: DataFrame, key: str = "source_file") -> DataFrame:
    """Plane declared by the object key; null marks an ambiguous key."""
    return df.withColumn("plane", plane_of_key(F.col(key)))
