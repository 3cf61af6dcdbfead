"""Benchmark decontamination by Wu-Manber search over words.

Patterns are the windows of ten consecutive words of every benchmark item (an item
of fewer words is one window). Patterns of one length share a matcher: a shift
table tells for the two words under the end of the search window how far the
window may move (blocks that no pattern holds let it move past all of them), a
block that ends some pattern selects the bucket of test strings, split by first
word, and a direct comparison confirms the occurrence.

The search runs in place on every document, without a shuffle. Patterns reach the
workers in blocks of at most ``PATTERN_BLOCK`` windows; a larger benchmark is
searched block after block, each adding to what the row already carries.

Defined cases: a null text, or one without words, has no words, no hits and no
items. Items without words give no window. Windows of items with a null id count as
hits, but there is no id to list. Repeated rows are judged each. Empty tables give
empty results, or documents without hits.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gavel.llm.common import small_batches, with_global_index
from gavel.session import cut_lineage

WINDOW = 10
# Most (window, item) rows that are sent to the workers at once.
PATTERN_BLOCK = 100_000
# Searches chained in one stage before the rows are written out.
CHAINED = 4

# Bytes of words: digits, letters (lower-cased) and everything outside ASCII.
_FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


class Matcher:
    """Wu-Manber tables for word patterns of one length."""

    def __init__(self, length: int, patterns: dict[tuple, list]):
        self.length, self.block = length, min(2, length)
        self.far = length - self.block + 1
        self.shift: dict[tuple, int] = {}
        self.buckets: dict[tuple, dict[bytes, dict[tuple, list]]] = {}
        for pattern, items in patterns.items():
            for end in range(self.block, length + 1):
                key, move = pattern[end - self.block : end], length - end
                if move < self.shift.get(key, self.far):
                    self.shift[key] = move
            bucket = self.buckets.setdefault(pattern[-self.block :], {})
            bucket.setdefault(pattern[0], {})[pattern] = items

    def search(self, words: list[bytes]) -> Iterator[tuple[int, list]]:
        """(start, items) of every occurrence, in order."""
        length, far, two, shift = self.length, self.far, self.block == 2, self.shift
        at, n = length - 1, len(words)
        while at < n:
            key = (words[at - 1], words[at]) if two else (words[at],)
            move = shift.get(key, far)
            if move:
                at += move
                continue
            start = at - length + 1
            tests = self.buckets[key].get(words[start])
            if tests and (items := tests.get(tuple(words[start : at + 1]))) is not None:
                yield start, items
            at += 1


def build_matchers(rows: list[tuple[list[bytes], str | None]]) -> list[Matcher]:
    by_length: dict[int, dict[tuple, list]] = {}
    for window, item in rows:
        pattern = tuple(bytes(w) for w in window)
        items = by_length.setdefault(len(pattern), {}).setdefault(pattern, [])
        if item is not None:
            items.append(item)
    return [Matcher(length, patterns) for length, patterns in sorted(by_length.items())]


def search_all(matchers: list[Matcher], words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
    """Hit ranges (start, end) and the items found."""
    ranges, items = [], set()
    for matcher in matchers:
        for start, found in matcher.search(words):
            ranges.append((start, start + matcher.length))
            items.update(found)
    return ranges, items


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(ranges):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """(window array<binary>, item string): one row per window and item."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("window", pa.list_(pa.binary())), ("item", pa.string())])
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(text)
                rows = [words[i : i + WINDOW] for i in range(max(1, len(words) - WINDOW + 1))] if words else []
                for at in range(0, len(rows), 10_000):
                    part = rows[at : at + 10_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(part, schema[0].type), pa.array([item] * len(part), pa.string())], schema=schema
                    )

    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("binary").alias("text"))
    return items.mapInArrow(windows, "window array<binary>, item string").distinct()


def pattern_blocks(benchmark: DataFrame, size: int = PATTERN_BLOCK) -> Iterator[list[tuple]]:
    """The windows, at most ``size`` of them at a time on the driver."""
    numbered = cut_lineage(
        with_global_index(benchmark_windows(benchmark), ["window", "item"], "at")
        .withColumn("block", F.expr(f"at div {size}"))
        .drop("at")
    )
    last = numbered.agg(F.max("block")).first()[0]
    for block in range(0 if last is None else last + 1):
        yield [(r["window"], r["item"]) for r in numbered.where(F.col("block") == block).collect()]


def decontaminate(docs: DataFrame, benchmark: DataFrame, pattern_block: int = PATTERN_BLOCK) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated,
    and the hit word ranges as ``hit_ranges`` (start, end, start, end, ...)."""
    spark = docs.sparkSession
    small_batches(spark)
    fields = "doc_id long, text binary, n_words long, ranges array<long>, items array<string>"
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").cast("binary").alias("text"),
        F.lit(0).cast("long").alias("n_words"),
        F.array().cast("array<long>").alias("ranges"),
        F.array().cast("array<string>").alias("items"),
    )
    blocks = 0
    for patterns in pattern_blocks(benchmark, pattern_block):
        if blocks and blocks % CHAINED == 0:
            rows = cut_lineage(rows)
        rows = rows.mapInArrow(_searcher(spark.sparkContext.broadcast(patterns)), fields)
        blocks += 1
    if not blocks:
        rows = rows.mapInArrow(_searcher(spark.sparkContext.broadcast([])), fields)
    pairs = F.expr("sequence(0, size(ranges) div 2 - 1)")
    hits = F.when(
        F.size("ranges") > 0,
        F.aggregate(pairs, F.lit(0).cast("long"), lambda a, i: a + F.get("ranges", 2 * i + 1) - F.get("ranges", 2 * i)),
    ).otherwise(0)
    return rows.select(
        "doc_id",
        "n_words",
        hits.cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("ranges") > 0).alias("contaminated"),
        F.col("ranges").alias("hit_ranges"),
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame, pattern_block: int = PATTERN_BLOCK) -> DataFrame:
    """The rows of ``docs`` without any benchmark window, with all their columns."""
    spark = docs.sparkSession
    small_batches(spark)
    kept, blocks = docs, 0
    for patterns in pattern_blocks(benchmark, pattern_block):
        if blocks and blocks % CHAINED == 0:
            kept = cut_lineage(kept)
        kept = kept.mapInArrow(_filter(spark.sparkContext.broadcast(patterns)), docs.schema)
        blocks += 1
    return kept


def _searcher(patterns):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matchers = build_matchers(patterns.value)
        for batch in batches:
            counts, all_ranges, all_items = [], [], []
            for text, before, known in zip(
                *(batch.column(n).to_pylist() for n in ("text", "ranges", "items")), strict=True
            ):
                words = words_of(text)
                ranges, items = search_all(matchers, words)
                old = list(zip(before[::2], before[1::2], strict=True))
                counts.append(len(words))
                all_ranges.append([x for pair in merged(ranges + old) for x in pair])
                all_items.append(sorted(items.union(known)))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("text"),
                    pa.array(counts, pa.int64()),
                    pa.array(all_ranges, pa.list_(pa.int64())),
                    pa.array(all_items, pa.list_(pa.string())),
                ],
                names=["doc_id", "text", "n_words", "ranges", "items"],
            )

    return run


def _filter(patterns):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matchers = build_matchers(patterns.value)
        for batch in batches:
            texts = batch.column("text").cast(pa.string()).cast(pa.binary()).to_pylist()
            keep = [not any(next(m.search(w), None) for m in matchers) for w in map(words_of, texts)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return run
