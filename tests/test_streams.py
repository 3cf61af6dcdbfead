"""The stream path: history, contracts, ledger coordinates, summaries and replays."""

import json

import pytest
from pyspark.sql import functions as F

from gavel.operators import decide, forest, ledger, models
from gavel.operators.sequences import last_values, user_windows
from gavel.streaming import carry, ingest
from gavel.streaming.ingest import govern_batch, start_ingest

from labelled import access_log_rows
from test_decisions import access
from test_stores import NOW, put

SCORES = ["isolation_forest_score", "lstm_score", "fused_anomaly_score"]


@pytest.fixture(scope="module")
def model(spark):
    log = models.with_code(access_log_rows(spark, 600, seed=3), prefix="").withColumn("y", F.col("is_anomaly"))
    windows = user_windows(log)
    return models.AnomalyModel(forest.fit_forest(log, trees=10), models.fit_sequence_model(windows, "y", 5.0, rounds=2))


def lines_of(spark, rows, path):
    """The access log as JSON lines below ``path``, as an ingest batch reads them."""
    put(path, [json.dumps({k: v for k, v in r.asDict().items() if v is not None and k != "row"}) for r in rows])
    from gavel.sources.records import read_jsonl

    return read_jsonl(spark, str(path))


def written(spark, out, name, batch=None):
    return spark.read.json(f"{out}/{name}" if batch is None else f"{out}/{name}/batch={batch}")


@pytest.mark.parametrize("merge_every", [1, 50])
def test_stream_scores_equal_batch_scores(spark, tmp_path, monkeypatch, model, merge_every):
    """Events that arrive in time order get the scores of the whole table, over batches,
    a replayed batch and merged versions of the history."""
    monkeypatch.setattr(carry, "MERGE_EVERY", merge_every)
    log = sorted(access_log_rows(spark, 120, seed=4).collect(), key=lambda r: (r["occurred_at"], r["event_id"]))
    cuts = [log[i : i + 40] for i in range(0, 120, 40)]
    out, history = str(tmp_path / "out"), str(tmp_path / "history")
    for i in (0, 1, 1, 2):
        rows = lines_of(spark, cuts[i], tmp_path / f"lake/raw/access/{i}.jsonl")
        govern_batch(rows, i, root=str(tmp_path / "lake"), out=out, ledger=None, ingested_at=NOW, model=model, history=history)
    got = {r["event_id"]: tuple(r["signals"][n] for n in SCORES) for r in written(spark, out, "decisions").collect()}
    table = models.with_code(spark.createDataFrame(log), prefix="")
    want = {r["event_id"]: tuple(r[n] for n in SCORES) for r in model.scores(user_windows(table)).collect()}
    assert got == want and len(got) == 120


def test_old_versions_of_the_history_are_overwritten(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(carry, "MERGE_EVERY", 3)
    state = tmp_path / "state"
    for i in range(14):
        users = [f"u{i}", "always"]
        rows = spark.createDataFrame([(u, [i]) for u in users], "user_id string, carried array<int>")
        carry.save_carry(rows, str(state), i)
        known = {r["user_id"]: r["carried"] for r in carry.carried_before(spark, str(state), i + 1).collect()}
        assert known == {"always": [i]} | {f"u{j}": [j] for j in range(i + 1)}
    assert len([p for p in state.iterdir() if p.is_dir()]) == 6  # 14 versions


def test_last_values_are_what_later_events_borrow(spark):
    rows = [("a", f"2026-01-01T00:00:{i:02d}", f"{i}", list(range(max(0, i - 7), i + 1))) for i in range(12)]
    df = spark.createDataFrame(rows + [("b", "2026-01-01", "x", [5])], "user_id string, occurred_at string, event_id string, window array<int>")
    assert {r["user_id"]: r["carried"] for r in last_values(df).collect()} == {"a": list(range(5, 12)), "b": [5]}


def test_decisions_are_checked_before_ledger_and_outputs(spark, tmp_path):
    """A scorer that leaves [0, 1] for some events: these become dead letters, nothing else."""
    put(tmp_path / "raw/access/a.jsonl", [access(event_id=""), access(event_id="", action="delete"), access(action="<absent>")])

    def scorer(events):
        scored = decide.heuristic_scorer()(events)
        return scored.withColumn("fused_anomaly_score", F.when(F.col("access.action") == "delete", F.lit(1.5)).otherwise(F.col("fused_anomaly_score")))

    out, path = str(tmp_path / "out"), str(tmp_path / "ledger")
    q = start_ingest(spark, str(tmp_path / "raw"), out, str(tmp_path / "cp"), ledger=path, ingested_at=NOW, scorer=scorer)
    q.awaitTermination()
    assert q.exception() is None
    assert written(spark, out, "decisions").count() == 1 == ledger.open_ledger(spark, path).count()
    assert written(spark, out, "events").select("access.action").first()[0] == "read"
    errors = sorted(tuple(r["errors"]) for r in written(spark, out, "dead").collect())
    assert errors == [("decision signals.fused_anomaly_score",), ("missing action",)]
    summary = written(spark, out, "summaries").collect()
    assert [(r["key"].endswith("raw/access/a.jsonl"), r["plane"], r["records"], r["dead"]) for r in summary] == [(True, "access", 1, 2)]


def batch_of(spark, tmp_path, name, rows):
    from gavel.sources.records import read_jsonl

    put(tmp_path / f"lake/raw/access/{name}.jsonl", rows)
    return read_jsonl(spark, str(tmp_path / f"lake/raw/access/{name}.jsonl"))


def ids(n, first=0):
    return [access(event_id=f"0f1e2d3c-4b5a-4978-8695-{i:012d}") for i in range(first, first + n)]


def test_store_and_ledger_agree(spark, tmp_path):
    """Written decisions carry ledger coordinates exactly where the ledger took them."""
    out, path = str(tmp_path / "out"), str(tmp_path / "ledger")
    how = {"root": str(tmp_path / "lake"), "out": out, "ledger": path, "ingested_at": NOW}
    first = batch_of(spark, tmp_path, "a", ids(5) + ids(2))  # two lines repeat
    govern_batch(first, 0, **how)
    govern_batch(batch_of(spark, tmp_path, "a", ids(5) + ids(3, 5)), 1, **how)  # five are on the ledger by now
    made = written(spark, out, "decisions")
    coordinates = made.filter("ledger IS NOT NULL").select("decision_id", "ledger.*")
    stored = ledger.open_ledger(spark, path)
    assert made.count() == 15 and stored.count() == 8
    assert sorted(map(tuple, coordinates.select("decision_id", "transaction_id").collect())) == sorted(
        map(tuple, stored.select("decision_id", "ledger_tx_id").collect())
    )
    assert {r["channel"] for r in coordinates.collect()} == {"governance"}
    assert {r["reason"] for r in written(spark, out, "rejects").collect()} == {ledger.DUPLICATE}
    assert written(spark, out, "rejects").count() == 7


@pytest.mark.parametrize("stop", ["record", "write_rows", "sorted_columns", "object_summary"])
def test_a_batch_that_stopped_anywhere_is_replayed_whole(spark, tmp_path, monkeypatch, stop):
    """The first run of the second batch fails at ``stop``; its replay adds what is missing only."""
    out, path = str(tmp_path / "out"), str(tmp_path / "ledger")
    how = {"root": str(tmp_path / "lake"), "out": out, "ledger": path}
    govern_batch(batch_of(spark, tmp_path, "a", ids(4)), 0, ingested_at=NOW, **how)
    second = batch_of(spark, tmp_path, "a", ids(6, 2) + ids(1, 7))  # the object comes again, longer

    def fail(*args, **kwargs):
        raise RuntimeError("stopped")

    with monkeypatch.context() as broken:
        broken.setattr(ingest, stop, fail)
        with pytest.raises(RuntimeError, match="stopped"):
            govern_batch(second, 1, ingested_at=NOW, **how)
    for moment in ("2026-08-02T00:00:00+00:00", "2026-08-03T00:00:00+00:00"):
        govern_batch(second, 1, ingested_at=moment, **how)
        stored = ledger.open_ledger(spark, path).collect()
        made = written(spark, out, "decisions", "0000000001").collect()
        assert len(stored) == len({r["decision_id"] for r in stored}) == 8
        assert len(made) == 7 and sum(r["ledger"] is not None for r in made) == 4
        # what the ledger holds is what the first staged run decided
        assert {r["decided_at"] for r in made} == {NOW}
    assert written(spark, out, "rejects", "0000000001").count() == 3


def test_staged_tables_do_not_pile_up(spark, tmp_path):
    out = tmp_path / "out"
    for i in range(5):
        govern_batch(batch_of(spark, tmp_path, str(i), ids(2, 2 * i)), i, root=str(tmp_path / "lake"), out=str(out), ledger=None, ingested_at=NOW)
    assert sorted(p.name for p in (out / "staged").iterdir()) == ["0", "1"]
    assert written(spark, str(out), "decisions").count() == 10


def test_fail_fast_writes_nothing(spark, tmp_path):
    rows = batch_of(spark, tmp_path, "a", [access(), access(action="<absent>")])
    with pytest.raises(Exception, match="invalid record: missing action"):
        govern_batch(rows, 0, root=str(tmp_path / "lake"), out=str(tmp_path / "out"), ledger=str(tmp_path / "l"), ingested_at=NOW, fail_fast=True)
    assert not (tmp_path / "l").exists() and not (tmp_path / "out/decisions").exists()


def test_metadata_is_written_as_an_object(spark, tmp_path):
    put(tmp_path / "lake/raw/content/c.jsonl", [{"document_id": "d", "text": "x", "metadata": {"b": 1, "a": [True, None]}}])
    from gavel.sources.records import read_jsonl

    govern_batch(read_jsonl(spark, str(tmp_path / "lake/raw/content")), 0, root=str(tmp_path / "lake"), out=str(tmp_path / "out"), ledger=None, ingested_at=NOW)
    (line,) = [r[0] for r in spark.read.text(str(tmp_path / "out/events/batch=0000000000")).collect()]
    assert line.startswith('{"content":{"document_id":"d","metadata":{"a":[true,null],"b":1},"text":"x"},"event_id":')


def test_batch_reads_only_its_ledger_directories(spark, tmp_path):
    path = str(tmp_path / "ledger")
    for i in range(3):
        govern_batch(batch_of(spark, tmp_path, str(i), ids(3, 3 * i)), i, root=str(tmp_path / "lake"), out=str(tmp_path / "out"), ledger=path, ingested_at=NOW)
    stored = ledger.open_ledger(spark, path)
    wanted = stored.limit(1).select("decision_id")
    plan = ledger.exists(stored, wanted)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(id_prefix" in plan and "dynamicpruning" in plan
    accepted, _ = ledger.record(decide.decisions_of(stored.filter("id_prefix < 'zz'")).withColumn("n", F.lit(0)), stored, F.col("n"))
    assert "dynamicpruning" in accepted._jdf.queryExecution().executedPlan().toString() and accepted.count() == 0
