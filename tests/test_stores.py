"""Sources, sinks, ledger, uploads and streams on temporary folders."""

import json

import pytest
from pyspark.sql import functions as F

from gavel import schemas as S
from gavel.operators import ledger, metrics
from gavel.operators.decide import decisions_of, from_ledger_rows
from gavel.operators.models import with_code
from gavel.operators.sequences import user_windows
from gavel.plans.upload import run_upload
from gavel.sources import decisions as D
from gavel.sources.records import list_files, list_keys, read_jsonl, read_text_documents, read_typed_jsonl, with_declared_plane
from gavel.streaming.buffer import streaming_windows
from gavel.streaming.ingest import govern_batch, start_ingest
from gavel.streaming.live import decision_stream, live_actions

from test_decisions import access

NOW = "2026-08-01T00:00:00+00:00"


def put(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + "\n", encoding="utf-8")


def test_jsonl_scan_keeps_odd_lines_apart(spark, tmp_path):
    put(tmp_path / "raw/access/a.jsonl", [access(), "", "   ", "{broken", "[1]", '{"text":"a b"}'])
    rows = with_declared_plane(read_jsonl(spark, str(tmp_path))).collect()
    assert sorted(r["malformed"] for r in rows) == [False, False, True, True]
    assert {r["plane"] for r in rows} == {"access"}


def test_keys_and_text_files(spark, tmp_path):
    put(tmp_path / "b/two.txt", ["  two  "])
    (tmp_path / "one.txt").write_bytes(b"caf\xff\n")
    (tmp_path / "blank.txt").write_text(" \n")
    assert [r[0] for r in list_keys(spark, str(tmp_path)).collect()] == ["b/two.txt", "blank.txt", "one.txt"]
    assert [r[0] for r in list_keys(spark, str(tmp_path), "b/").collect()] == ["b/two.txt"]
    docs = {r["document_id"]: r["text"] for r in read_text_documents(spark, str(tmp_path)).collect()}
    assert docs == {"two.txt": "two", "one.txt": "caf�", "blank.txt": None}


def test_missing_store_is_empty(spark, tmp_path):
    missing = str(tmp_path / "none")
    assert D.load_decisions(spark, missing).count() == 0
    assert D.load_run(spark, missing) is None
    row = metrics.totals(metrics.cube(D.load_decisions(spark, missing))).first()
    assert tuple(row) == (0, 0, 0, 0, 0.0, 0.0, 0.0)
    assert {r["n"] for r in metrics.by_action(metrics.cube(D.load_decisions(spark, missing))).collect()} == {0}


def test_json_sink_is_compact_and_sorted(spark, tmp_path):
    df = spark.createDataFrame([("b", None, ("x", 1.0))], "z string, a string, m struct<q:string,b:double>")
    D.append_json(df, str(tmp_path / "o"))
    D.append_json(df, str(tmp_path / "o"))
    lines = [r[0] for r in spark.read.text(str(tmp_path / "o")).collect()]
    assert lines == ['{"m":{"b":1.0,"q":"x"},"z":"b"}'] * 2


# --- ledger -----------------------------------------------------------------------------------------


def batch(spark, *rows):
    data = [(i, f"e{i}", NOW, a, ["r"]) for i, a in rows]
    df = spark.createDataFrame(data, "decision_id string, event_id string, decided_at string, action string, rule_ids array<string>")
    rank = F.expr("CASE action WHEN 'allow' THEN 0 WHEN 'flag' THEN 1 ELSE 2 END").alias("n")
    return decisions_of(df.withColumn("explanation", F.lit(None).cast("string")).withColumn("signals", F.lit(None).cast(S.SIGNALS)).select("*", rank), "n")


def test_ledger_is_write_once(spark, tmp_path):
    path = str(tmp_path / "ledger")
    first = batch(spark, ("aa1", "allow"), ("aa1", "flag"), ("bb2", "flag"), (None, "block"), ("", "allow"))
    rejected = ledger.append(first, path, F.col("n"), NOW).select("decision_id", "action", "reason")
    assert sorted(map(tuple, rejected.fillna("").collect())) == [
        ("", "allow", ledger.MISSING_ID), ("", "block", ledger.MISSING_ID), ("aa1", "flag", ledger.DUPLICATE),
    ]
    stored = ledger.open_ledger(spark, path)
    assert {(r["decision_id"], r["action"]) for r in stored.collect()} == {("aa1", "allow"), ("bb2", "flag")}
    ledger.append(first, path, F.col("n"), NOW)
    ledger.append(batch(spark, ("bb2", "block"), ("cc3", "alert")), path, F.col("n"), NOW)
    stored = ledger.open_ledger(spark, path)
    assert [r["decision_id"] for r in ledger.scan(stored).collect()] == ["aa1", "bb2", "cc3"]
    assert ledger.get(stored, "bb2").first()["action"] == "flag"
    with pytest.raises(KeyError):
        ledger.get(stored, "zz", required=True)
    (entry,) = ledger.history(stored, "cc3").collect()
    value = json.loads(entry["value"])
    assert not entry["is_delete"] and value["ledger_tx_id"] == entry["tx_id"] and list(value) == sorted(value)
    back = from_ledger_rows(stored).first()
    assert back["ledger"]["transaction_id"] and back["ledger"]["channel"] == "governance"
    found = {r["decision_id"]: r["found"] for r in ledger.lookup(stored, batch(spark, ("aa1", "allow"), ("q", "allow")).select("decision_id")).collect()}
    assert found == {"aa1": True, "q": False}


def test_ledger_point_read_prunes_directories(spark, tmp_path):
    path = str(tmp_path / "ledger")
    ledger.append(batch(spark, ("aa1", "allow"), ("bb2", "flag")), path, F.col("n"), NOW)
    plan = ledger.get(ledger.open_ledger(spark, path), "aa1")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(id_prefix" in plan and "PushedFilters: [IsNotNull(decision_id)" in plan


# --- uploads --------------------------------------------------------------------------------------------


def test_upload_run(spark, tmp_path):
    src = tmp_path / "in"
    put(src / "mixed.jsonl", [access(action="bulk_download", resource_class="PII"), {"document_id": "d", "text": "ssn"}, access(action="<absent>")])
    put(src / "broken.jsonl", [access(), access(), "{broken"])
    put(src / "note.txt", ["Our policy."])
    put(src / "blank.txt", [" "])
    put(src / "blank.jsonl", [""])
    (src / "scan.pdf").write_bytes(b"%PDF-1.4")
    decisions, runs = str(tmp_path / "decisions"), str(tmp_path / "runs")
    run_id = run_upload(spark, str(src), decisions_path=decisions, runs_path=runs, created_at="2026-08-01T10:00:00+00:00")
    results = D.load_run(spark, runs)
    errors = {(r["filename"], r["error"]) for r in results.filter("error IS NOT NULL").collect()}
    assert errors == {
        ("mixed.jsonl", "missing action"), ("broken.jsonl", "could not read file"),
        ("blank.txt", "no content found in file"), ("blank.jsonl", "no content found in file"),
        ("scan.pdf", "could not read file: PDF text extraction is not built in"),
    }
    assert sorted(r["action"] for r in results.filter("decision IS NOT NULL").select("decision.*").collect()) == ["allow", "block", "flag"]
    assert D.load_decisions(spark, decisions).count() == 3
    (row,) = metrics.latest_runs(D.load_runs(spark, runs)).collect()
    assert (row["run_id"], row["processed"], row["errors"]) == (run_id, 3, 5)
    later = run_upload(spark, str(src), decisions_path=decisions, runs_path=runs, created_at="2026-08-02T10:00:00+00:00")
    assert D.load_run(spark, runs).first()["run_id"] == later
    assert D.load_run(spark, runs, "nope") is None
    live = live_actions(decision_stream(spark, decisions)).writeStream.outputMode("complete").format("memory").queryName("live").trigger(availableNow=True).start()
    live.awaitTermination()
    assert {r["action"]: r["n"] for r in spark.sql("select * from live").collect()} == {"allow": 2, "block": 2, "flag": 2}


def tiny_run(spark, tmp_path, created_at="2026-08-01T10:00:00+00:00", src="in"):
    return run_upload(
        spark, str(tmp_path / src), decisions_path=str(tmp_path / "d"), runs_path=str(tmp_path / "r"), created_at=created_at
    )


@pytest.mark.parametrize("stop", ["put_json", "manifest", None])
def test_a_repeated_run_adds_nothing(spark, tmp_path, monkeypatch, stop):
    """A run that stopped before its manifest does not count; repeating it completes it."""
    put(tmp_path / "in/a.jsonl", [access(), access(action="delete"), "", access(action="<absent>")])
    with monkeypatch.context() as broken:
        if stop == "put_json":
            broken.setattr(D, "put_json", lambda *a: (_ for _ in ()).throw(RuntimeError("stopped")))
        if stop == "manifest":
            broken.setattr(metrics, "run_summary", lambda *a: (_ for _ in ()).throw(RuntimeError("stopped")))
        if stop:
            with pytest.raises(RuntimeError, match="stopped"):
                tiny_run(spark, tmp_path)
            assert D.load_run(spark, str(tmp_path / "r")) is None
    first = tiny_run(spark, tmp_path)
    assert tiny_run(spark, tmp_path) == first
    assert D.load_decisions(spark, str(tmp_path / "d")).count() == 2
    (row,) = D.load_runs(spark, str(tmp_path / "r")).collect()
    assert (row["run_id"], row["processed"], row["errors"]) == (first, 2, 1)
    assert D.load_run(spark, str(tmp_path / "r"), first).count() == 3


def test_an_empty_run_has_a_manifest(spark, tmp_path):
    (tmp_path / "in").mkdir()
    run = tiny_run(spark, tmp_path)
    (row,) = D.load_runs(spark, str(tmp_path / "r")).collect()
    assert (row["run_id"], row["processed"], row["errors"]) == (run, 0, 0)
    assert D.load_run(spark, str(tmp_path / "r")).count() == 0


def test_json_lines_are_read_by_splits(spark, tmp_path):
    """One file of many lines is many tasks, and no reader opens it as one value."""
    from gavel.plans.upload import upload_events

    put(tmp_path / "in/big.jsonl", [access(resource_id=f"sales-financial-{i:05d}") for i in range(4000)])
    put(tmp_path / "in/note.txt", ["Our policy."])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200000")
    try:
        assert read_jsonl(spark, str(tmp_path / "in")).rdd.getNumPartitions() > 4
        events, problems = upload_events(spark, str(tmp_path / "in"), NOW)
        assert events.count() == 4001 and problems.count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    texts = read_text_documents(spark, str(tmp_path / "in"), without=(".jsonl",))
    files = texts._jdf.queryExecution().executedPlan().toString()
    assert [r["document_id"] for r in texts.collect()] == ["note.txt"]
    assert "file_name" in files and texts.rdd.getNumPartitions() == 1
    listing = list_files(spark, str(tmp_path / "in"))
    assert "content" not in listing._jdf.queryExecution().executedPlan().toString()
    assert {r["filename"] for r in listing.collect()} == {"big.jsonl", "note.txt"}


# --- streams -----------------------------------------------------------------------------------------------


def test_ingest_stream_and_replay(spark, tmp_path):
    raw, out, ledger_path = tmp_path / "lake/raw", str(tmp_path / "out"), str(tmp_path / "ledger")
    put(raw / "access/2026/a b.jsonl", [access(), access(action="delete"), access(action="<absent>"), access()])
    put(raw / "content/c.jsonl", [{"document_id": "d", "text": "passport"}, "{broken"])
    put(raw / "other/x.jsonl", [access()])

    def go():
        q = start_ingest(spark, str(raw), out, str(tmp_path / "cp"), ledger=ledger_path, max_files=1, ingested_at=NOW)
        q.awaitTermination()
        assert q.exception() is None

    go()
    decisions = spark.read.json(f"{out}/decisions")
    assert decisions.count() == 4 and {r["source_file"] for r in decisions.select("source_file").collect()} == {"access/2026/a b.jsonl", "content/c.jsonl"}
    dead = spark.read.json(f"{out}/dead")
    assert sorted(",".join(r["errors"]) for r in dead.collect()) == ["malformed JSON", "missing action", "unknown data_plane"]
    stored = ledger.open_ledger(spark, ledger_path)
    assert stored.count() == 3  # the repeated line is one event
    put(raw / "access/2026/b.jsonl", [access(action="search")])
    go()
    assert ledger.open_ledger(spark, ledger_path).count() == 4
    again = read_jsonl(spark, str(raw)).filter(F.col("source_file").contains("/b.jsonl"))
    for _ in range(2):
        govern_batch(again, 99, root=str(tmp_path / "lake"), out=out, ledger=ledger_path, ingested_at=NOW)
    assert ledger.open_ledger(spark, ledger_path).count() == 4
    assert spark.read.json(f"{out}/decisions/batch=0000000099").count() == 1


def test_streaming_buffer_equals_batch_windows(spark, tmp_path):
    rows = [
        {"user_id": f"u{i % 3}" if i % 2 else "u0", "event_id": f"{i:04d}", "occurred_at": f"2026-01-05T{i // 4:02d}:{(i % 4) * 10:02d}:00+00:00", "code": i}
        for i in range(60)
    ]
    src = tmp_path / "in"
    src.mkdir()
    schema = "user_id string, event_id string, occurred_at string, code int"
    stream = streaming_windows(spark.readStream.schema(schema).json(str(src)))
    for part in range(3):  # history has to survive the batches and the restarts
        put(src / f"{part}.json", rows[part * 20 : part * 20 + 20])
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
    got = {r["event_id"]: r["window"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {r["event_id"]: r["window"] for r in user_windows(spark.createDataFrame(rows, schema)).collect()}
    assert got == want


def test_typed_read_reports_or_fails(spark, tmp_path):
    put(tmp_path / "t.jsonl", [access(), "{broken"])
    loose = read_typed_jsonl(spark, str(tmp_path / "t.jsonl"), S.RAW_ACCESS)
    assert loose.filter("user_id IS NOT NULL").count() == 1
    with pytest.raises(Exception):
        read_typed_jsonl(spark, str(tmp_path / "t.jsonl"), S.RAW_ACCESS, fail_fast=True).collect()
    coded = with_code(loose.filter("user_id IS NOT NULL"), prefix="")
    assert coded.first()["code"] > 0


@pytest.mark.parametrize("merge_every", [1, 2, 50])
def test_window_stream_carries_history(spark, tmp_path, monkeypatch, merge_every):
    from gavel.streaming import carry, windows

    monkeypatch.setattr(carry, "MERGE_EVERY", merge_every)
    schema = "user_id string, event_id string, occurred_at string, code int"
    rows = [("hot" if i % 3 else f"u{i % 4}", f"{i:04d}", f"2026-01-05T{i // 10:02d}:{i % 10:02d}:00+00:00", i) for i in range(90)]
    state, out = str(tmp_path / "state"), str(tmp_path / "out")
    sink = lambda df, i: df.write.mode("overwrite").parquet(f"{out}/batch={i}")
    parts = [rows[i * 18 : i * 18 + 18] for i in range(5)]
    for i in (0, 1, 1, 2, 3, 4):  # a replayed batch changes nothing
        windows.window_batch(spark.createDataFrame(parts[i], schema), i, state, sink=sink)
    got = {r["event_id"]: r["window"] for r in spark.read.parquet(out).collect()}
    want = {r["event_id"]: r["window"] for r in user_windows(spark.createDataFrame(rows, schema)).collect()}
    assert got == want
