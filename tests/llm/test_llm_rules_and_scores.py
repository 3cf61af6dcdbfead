"""Quality rules, toxicity, importance resampling."""

import math
import zlib

import numpy as np
import pytest
from llm_brute import by_key, quality
from pyspark.sql import functions as F

from gavel.llm import importance, toxicity
from gavel.llm.quality_rules import accepted, binomial_tail, certified_cutoffs, measure, quality_rules

DOCS = "doc_id long, text string, lang string, n_words string"
LABELS = "doc_id long, quality int, toxic int"


def many_words(n, junk=""):
    return " ".join(f"word{i}{junk}" for i in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    again = many_words(9)
    rows = [
        (0, many_words(30), "en", "x"),
        (1, None, "en", None),
        (2, "", None, "x"),
        (3, f"{again} {again} {again}", "en", "x"),
        (3, f"{many_words(40)}\nsame line\nsame line\n \n", "en", "x"),
        (None, many_words(25, "###"), "en", "x"),
        (4, "é ü \x0b#<>\n" * 50, "fr", "x"),
        (5, many_words(60) + " " + many_words(60)[:200], "en", "x"),
        (6, "\U0001f600 " * 19 + "😀😀", None, "x"),
    ]
    return spark.createDataFrame(rows, DOCS)


def test_counts_follow_their_definition(spark, sf, odd):
    labels = spark.createDataFrame([], LABELS)
    whole = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    for docs in (odd, whole):
        got = quality_rules(docs, labels).select(
            "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"
        )
        want = [(r["doc_id"], *quality(r["text"])) for r in docs.collect()]
        assert by_key(got.collect()) == by_key(want)


def test_without_labels_only_the_base_rejects(spark, odd):
    rows = quality_rules(odd, spark.createDataFrame([], LABELS)).collect()
    assert all(r["kept"] != r["base_failed"] for r in rows)
    assert quality_rules(odd.limit(0), spark.createDataFrame([], LABELS)).count() == 0


def test_binomial_tail_is_exact(spark):
    cases = [(0, 50, 0.05), (1, 100, 0.05), (9, 400, 0.05), (0, 5000, 0.05), (150, 4000, 0.05), (60, 1000, 0.05)]
    for k, n, p in cases:
        got = spark.range(1).select(binomial_tail(F.lit(k), F.lit(n), p)).first()[0]
        want = math.fsum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)) if k < n * p else 1.0
        assert got == pytest.approx(want, rel=1e-9, abs=1e-300)


def test_cutoffs_reject_few_good_rows_of_each_stratum(spark):
    # 3000 good rows in "en": 12 of them with many symbols; "de" has too few labels
    rows = [(i, many_words(30, "##" if i < 12 else ""), "en") for i in range(3000)]
    rows += [(10_000 + i, many_words(30), "de") for i in range(50)]
    rows += [(20_000 + i, many_words(30, "####"), "en" if i % 2 else "de") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], int(r[0] < 20_000), 0) for r in rows], LABELS)
    got = quality_rules(docs, labels).groupBy("stratum", F.col("doc_id") < 20_000).agg(F.sum(F.col("kept").cast("int")))
    kept = {(r[0], r[1]): r[2] for r in got.collect()}
    assert kept["en", True] >= 3000 * 0.98 and kept["en", False] == 0
    assert kept["de", True] == 50 and kept["de", False] == 100
    measured = measure(docs, [F.col("doc_id"), F.col("lang").alias("stratum")])
    cut = {r["stratum"]: r.asDict() for r in certified_cutoffs(measured, labels).collect()}
    assert all(v is None for k, v in cut["de"].items() if k != "stratum")
    assert cut["en"]["cut_symbols"] is not None


def test_accepted_rows_keep_all_columns(spark, odd):
    out = accepted(odd.withColumn("kept", F.lit(1)).withColumn("stratum", F.lit("s")), spark.createDataFrame([], LABELS))
    assert out.columns == [*odd.columns, "kept", "stratum"]
    want = [r["doc_id"] for r in odd.collect() if not quality(r["text"])[5]]
    assert by_key([(r["doc_id"],) for r in out.collect()]) == by_key([(w,) for w in want])


def test_kernel_values_equal_the_recursion():
    landmarks = ["loser", "idiot", "disgusting", "vequè"]
    units = ["loser", "lo", "idxiot", "i-d-i-o-t", "disgustingly", "zzz", "a" * 40, "vequ"]
    got = toxicity.likeness(units, landmarks)
    for unit, row in zip(units, got, strict=True):
        for mark, value in zip(landmarks, row, strict=True):

            def k(a, b):
                return toxicity.subsequence_kernel(toxicity.as_codes([a]), toxicity.as_codes([b])[None])[0, 0]

            parts = [p for p in toxicity.windows_of(unit) if len(p) >= toxicity.SUBSEQUENCE]
            want = max((k(p, mark) / math.sqrt(k(p, p) * k(mark, mark)) for p in parts), default=0)
            assert value == pytest.approx(want)
    assert got[2, 1] > 0.4 > got[5].max()  # a gap keeps the likeness


def test_toxicity_on_rows_it_never_learned_from(spark):
    insults = ["grobnik", "zwarfel", "plimpton"]
    rows = []
    for i in range(600):
        text = ". ".join(many_words(12, chr(97 + (i * j) % 26)) for j in range(3))
        if i % 3 == 0:
            word = insults[i // 3 % 3]
            text += " " + (word if i % 2 else ".".join(word)) + " word1."
        rows.append((i, text))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(600)], LABELS)
    got = toxicity.toxicity(docs, labels).collect()
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    held = [r for r in got if r["held_out"]]
    right = sum(r["predicted"] == int(r["doc_id"] % 3 == 0) for r in held)
    assert right >= 0.97 * len(held) and len(held) > 50


def test_toxicity_of_odd_rows(spark, odd):
    labels = spark.createDataFrame([(0, 1, 0)], LABELS)
    rows = toxicity.toxicity(odd, labels).collect()
    assert len(rows) == 9 and {r["score"] for r in rows} == {0.0}
    assert [r["held_out"] for r in rows if r["doc_id"] is None] == [False]
    assert toxicity.toxicity(odd.limit(0), labels).count() == 0


def test_importance_keeps_what_looks_like_the_target(spark):
    rng = np.random.default_rng(4)
    good, bad = [f"alpha{i}" for i in range(50)], [f"$$zeta{i}" for i in range(50)]
    rows = [(i, " ".join(rng.choice(bad if i % 5 == 0 else good, 60))) for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 != 0), 0) for i in range(0, 500, 2)], LABELS)
    out = importance.resample(docs, labels).collect()
    kept = {r["doc_id"] for r in out if r["kept"]}
    assert len(kept) == 400 and all(i % 5 for i in kept)
    assert sorted(r["draw_rank"] for r in out) == list(range(500))
    order = [r["log_weight"] + r["noise"] for r in sorted(out, key=lambda r: r["draw_rank"])]
    assert order == sorted(order, reverse=True)


def test_importance_weights_are_log_ratios_of_gram_counts(spark):
    docs = spark.createDataFrame([(0, "a b a"), (1, "b c"), (2, None), (2, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 0)], LABELS)
    got = {(r["doc_id"], r["log_weight"]) for r in importance.importance_weights(docs, labels).collect()}
    target = np.bincount(importance.gram_buckets(b"a b a"), minlength=importance.BUCKETS)
    raw = target + np.bincount(importance.gram_buckets(b"b c"), minlength=importance.BUCKETS)
    table = importance.log_ratio(target, raw)
    want = {(i, float(table[importance.gram_buckets(t)].sum())) for i, t in ((0, b"a b a"), (1, b"b c"), (2, b""))}
    assert got == want


def test_importance_without_labels_or_rows(spark, odd):
    none = spark.createDataFrame([], LABELS)
    rows = importance.resample(odd, none, share=0.5).collect()
    assert sum(r["kept"] for r in rows) == 5 and {r["log_weight"] for r in rows} == {0.0}
    assert importance.resample(odd.limit(0), none).count() == 0
