"""Rows that earlier versions lost: long texts, odd labels, repeated ids, separators, file names."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from gavel import constants as K
from gavel.functions.keys import uuid_text
from gavel.operators import decide, ledger, models, ranks, rules
from gavel.operators.evaluate import roc_auc
from gavel.operators.forest import tree_samples
from gavel.plans.queries import QUERIES
from gavel.plans.upload import run_upload
from gavel.sources import decisions as D
from gavel.sources.records import read_jsonl
from gavel.sources.rules import shipped_rules

from test_decisions import access
from test_stores import NOW, put


def test_texts_beyond_the_parsers_limit_and_repeated_keys(spark, tmp_path):
    long = json.dumps({"text": "a" * 20_000_001, "document_id": "d"})
    put(tmp_path / "x.jsonl", [long, '{"text":"first","text":"last"}', "{broken", "[1]"])
    rows = read_jsonl(spark, str(tmp_path)).select(
        "malformed", F.expr("try_variant_get(record, '$.text', 'string')").alias("text")
    )
    got = sorted((r["malformed"], len(r["text"] or ""), (r["text"] or "")[:4]) for r in rows.collect())
    assert got == [(False, 4, "last"), (False, 20_000_001, "aaaa"), (True, 0, ""), (True, 0, "")]


def test_upper_case_suffixes_are_read(spark, tmp_path):
    put(tmp_path / "in/UP.JSONL", [access()])
    run = run_upload(
        spark, str(tmp_path / "in"), decisions_path=str(tmp_path / "d"), runs_path=str(tmp_path / "r"), created_at=NOW
    )
    rows = D.load_run(spark, str(tmp_path / "r"), run).collect()
    assert [(r["filename"], r["error"]) for r in rows] == [("UP.JSONL", None)]


def test_malformed_decisions_are_errors(spark, tmp_path):
    put(tmp_path / "d/a.json", ['{"decision_id":"x","action":"allow"}', "{broken"])
    with pytest.raises(Exception, match="(?i)malformed"):
        D.load_decisions(spark, str(tmp_path / "d")).collect()


def test_separators_inside_fields_do_not_merge_ids(spark):
    rows = [("a|b", "c"), ("a", "b|c"), ("a\\", "|c"), ("a\\|", "c"), ("a", "b")]
    ids = spark.createDataFrame(rows, "x string, y string").select(uuid_text(F.col("x"), F.col("y")))
    assert ids.distinct().count() == len(rows)


def test_null_labels_keep_their_place(spark):
    frame = spark.createDataFrame([(0, "x"), (1, None), (2, None), (3, "x")], "id bigint, label string")
    got = {r["id"]: r["position"] for r in ranks.with_position(frame, "id", after=F.col("label")).collect()}
    assert got == {1: 0, 2: 1, 0: 2, 3: 3}


def test_balance_takes_any_kind_and_number_of_labels(spark):
    flags = spark.createDataFrame([(i, i < 10) for i in range(100)], "id bigint, label boolean")
    assert {(r["label"], r["count"]) for r in ranks.balance(flags, "label", "id").groupBy("label").count().collect()} == {
        (True, 10), (False, 10)
    }
    many = spark.range(4000).select(F.col("id"), (F.col("id") % 1500).alias("label"))
    assert ranks.balance(many, "label", "id").count() == 3000
    assert ranks.balance(flags.limit(0), "label", "id").count() == 0


def test_rules_as_rows_keep_repeated_ids_and_serve_as_a_port(spark, sf):
    from gavel.plans.govern import govern
    from gavel.plans.queries import CLASSIFIER
    from gavel.sources import testbed

    events = testbed.canonical_events(spark, sf).limit(60)
    twice = events.union(events).union(events.withColumn("event_id", F.lit("one id")))
    scored = decide.with_signals(decide.heuristic_scorer()(CLASSIFIER(twice)))
    columns = ["event_id", "action", "rule_ids", "explanation"]
    by_rows = rules.fire_from_tables(scored, shipped_rules()).select(columns).collect()
    assert sorted(by_rows) == sorted(rules.fire(scored, shipped_rules()).select(columns).collect())
    port = govern(events, decided_at=NOW, rules=lambda e: rules.fire_from_tables(e, shipped_rules()))
    assert port.count() == 60


def test_area_with_counts_beyond_a_long(spark):
    half = 10_000_000_000
    rows = spark.createDataFrame([(0.2, False), (0.7, True), (0.7, False)], "s double, truth boolean")
    weighted = roc_auc(rows, "s", F.col("truth"))
    assert weighted.first()["roc_auc"] == pytest.approx(0.75)
    big = spark.sql(f"SELECT CAST({half} AS DECIMAL(19,0)) * CAST({half} AS DECIMAL(19,0)) AS pairs").first()["pairs"]
    assert big == half * half


def test_trees_share_no_more_rows_than_chance(spark):
    rows = spark.range(10_000).select(F.col("id").alias("row_id"), F.lit(1).alias("code"))
    picked = tree_samples(rows, "code", "row_id", trees=200, sample=256, seed=7).toPandas()
    sets = [set(g["row_id"]) for _, g in picked.groupby("tree")]
    assert len(sets) == 200 and not picked.duplicated(["tree", "row_id"]).any()
    shared = [len(sets[t] & sets[(t + 1) % 200]) / len(sets[t]) for t in range(200)]
    assert np.mean(shared) < 0.08  # 333 of 10,000 rows: chance is 0.033


def test_external_networks_get_windows(spark):
    from gavel.operators.models import external_sequence_scores
    from gavel.operators.sequences import user_windows  # noqa: F401

    windows = spark.range(3).select("id", F.array_repeat(F.lit(5), K.WINDOW).alias("window"))

    def make():
        def predict(batch):
            assert batch.shape[1:] == (K.WINDOW, K.N_FEATURES)
            return np.full(len(batch), 0.5)

        return predict

    assert {r["lstm_score"] for r in external_sequence_scores(windows, make).collect()} == {0.5}


def test_rejects_are_kept(spark, tmp_path):
    batch = spark.createDataFrame(
        [("a1", 0), ("a1", 1), (None, 2), ("b2", 3)], "decision_id string, seq int"
    )
    from gavel import schemas as S

    names = [f for f in S.DECISION.fields if f.name != "decision_id"]
    full = batch.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in names])
    for _ in range(2):  # a replay leaves the rejects as they are
        ledger.append(full, str(tmp_path / "l"), F.col("seq"), NOW, str(tmp_path / "rejects"))
    got = spark.read.json(str(tmp_path / "rejects")).collect()
    assert sorted((r["decision_id"] or "", r["reason"]) for r in got) == sorted(
        [("a1", ledger.DUPLICATE), ("", ledger.MISSING_ID)]
    )
    assert spark.read.parquet(str(tmp_path / "l")).count() == 2


def test_sequence_fit_deals_rows_by_their_number(spark, monkeypatch):
    windows = spark.createDataFrame([([i % 7], i % 2) for i in range(200)], "window array<int>, y int").coalesce(1)
    sizes = []

    class Fits:
        def __init__(self, stages):
            pass

        def fit(self, rows):
            sizes.extend(rows.rdd.glom().map(len).collect())

    monkeypatch.setattr(models, "Pipeline", Fits)
    monkeypatch.setattr(models, "FIT_ROWS", 10)
    models.fit_sequence_model(windows, "y", 2.0)
    assert sum(sizes) == 200 and max(sizes) <= 15


def test_ledger_reads_share_one_set_of_decisions(spark, sf):
    for name in ("ledger_lookup", "ledger_exists"):
        assert all("/staged-" in file for file in QUERIES[name](spark, sf).inputFiles()), name
