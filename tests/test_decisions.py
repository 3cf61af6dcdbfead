"""Functions, contracts, rules and decisions on small records with known outcomes."""

import json

import pytest
from pyspark.sql import functions as F

from gavel import constants as K
from gavel.functions.clock import feature_hour, iso_hour
from gavel.functions.keys import output_key, plane_of_key
from gavel.functions.text import is_blank, keyword_class, normal_form, opening_signature, strip
from gavel.operators import decide, rules
from gavel.operators.contracts import event_checks, fail_on_error, split_valid, violations, with_errors
from gavel.operators.normalize import normalize
from gavel.plans.govern import fallback_engine, govern, with_decision_errors
from gavel.sources.records import JsonFields, infer_plane, parse_lines
from gavel.sources.rules import RuleError, load_rules, parse_rules, rule_rows, shipped_rules

NOW = "2026-08-01T00:00:00+00:00"


def access(**over):
    base = {
        "event_id": "0f1e2d3c-4b5a-4978-8695-a4b3c2d1e0f9", "occurred_at": "2026-01-05T08:00:00+00:00",
        "user_id": "u-1", "role": "analyst", "department": "sales", "resource_id": "sales-financial-009",
        "resource_class": "financial", "action": "read", "device_id": "managed-1", "source_ip": "10.9.8.7",
        "is_anomaly": False,
    }
    base.update(over)
    return {k: v for k, v in base.items() if v != "<absent>"}


def events(spark, records):
    lines = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)], "n int, value string")
    parsed = parse_lines(lines)
    fields = JsonFields("record")
    return with_errors(
        normalize(parsed, fields, plane=infer_plane(fields), source="test", ingested_at=NOW, keep=("n",))
    )


def decided(spark, records, **ports):
    valid, _ = split_valid(events(spark, records))
    return govern(valid, decided_at=NOW, **ports).orderBy("n").collect()


GOLDEN = [
    (access(), (0.15, 0.05, 0.1), "allow", ["default-allow"]),
    (access(action="search", resource_class="policy"), (0.15, 0.05, 0.1), "allow", ["default-allow"]),
    (access(action="bulk_download", resource_class="PII"), (0.75, 0.65, 0.7), "block", ["ACC-BULK-SENSITIVE", "ACC-MED-ANOMALY"]),
    (access(action="delete", device_id="unmanaged-31"), (0.95, 0.85, 0.9), "alert",
     ["ACC-DELETE-SENSITIVE", "ACC-HIGH-ANOMALY", "ACC-MED-ANOMALY"]),
    (access(action="bulk_download", resource_class="PII", occurred_at="2026-08-01T02:40:00+00:00", device_id="unmanaged-7"),
     (1.0, 0.95, 1.0), "block", ["ACC-BULK-SENSITIVE", "ACC-HIGH-ANOMALY", "ACC-MED-ANOMALY"]),
    (access(action="privilege_change", resource_class="policy", occurred_at="2026-08-01T23:05:00+00:00", device_id="unmanaged-7"),
     (1.0, 0.95, 1.0), "alert", ["ACC-PRIV-CHANGE", "ACC-HIGH-ANOMALY", "ACC-MED-ANOMALY"]),
]


def test_access_goldens(spark):
    rows = decided(spark, [g[0] for g in GOLDEN])
    for row, (_, scores, action, ids) in zip(rows, GOLDEN):
        s = row["signals"]
        assert (s["isolation_forest_score"], s["lstm_score"], s["fused_anomaly_score"]) == scores
        assert (row["action"], row["rule_ids"]) == (action, ids)
        assert s["content_class"] is None


DOCUMENTS = [
    ("Kim's passport is kept in the upper drawer.", "PII", 0.6, "flag", "CONT-PII"),
    ("Last spring the invoice went out twice.", "financial", 0.6, "flag", "CONT-FINANCIAL"),
    ("Our policy on guests fits on one page.", "policy", 0.6, "allow", "default-allow"),
    ("The kitchen gets new chairs on Friday.", "internal", 0.5, "allow", "default-allow"),
    ("A walk along the embankment.", "financial", 0.6, "flag", "CONT-FINANCIAL"),
]


def test_content_goldens(spark):
    rows = decided(spark, [{"document_id": f"d{i}", "text": d[0], "label": "public"} for i, d in enumerate(DOCUMENTS)])
    for row, (_, cls, conf, action, rule) in zip(rows, DOCUMENTS):
        assert (row["signals"]["content_class"], row["signals"]["content_confidence"]) == (cls, conf)
        assert (row["action"], row["rule_ids"]) == (action, [rule])
        assert row["content"]["label"] == "public"


def test_whole_word_keywords(spark):
    df = spark.createDataFrame([("the embankment",), ("the bank.",)], "t string")
    got = [r[0] for r in df.select(keyword_class(F.col("t"), whole_words=True)).collect()]
    assert got == ["internal", "financial"]


def test_dead_letters_name_the_problem(spark):
    records = [
        access(action="<absent>"), access(action=None), access(action="format"), access(event_id=""),
        access(event_id="not-a-uuid"), access(user_id=5), {"document_id": "d", "text": ""},
        {"document_id": "d", "text": "x", "label": "secret"}, {"text": "x", "user_id": "u", "document_id": "d"},
        {"document_id": "d", "text": "x", "metadata": "flat"}, {"document_id": "d", "text": "x", "metadata": {"a": 1}},
    ]
    got = [r["errors"] for r in events(spark, records).orderBy("n").collect()]
    assert got == [
        ["missing action"], ["access.action"], ["access.action"], [], ["event_id"], ["access.user_id"],
        ["missing text"], ["content.label"], [], ["content.metadata"], [],
    ]


def test_fail_fast_aborts(spark):
    with pytest.raises(Exception, match="invalid record: missing action"):
        fail_on_error(events(spark, [access(), access(action="<absent>")])).count()


def test_strict_datetime(spark):
    lines = spark.createDataFrame([(json.dumps(access(occurred_at="not-a-date")),)], "value string")
    fields = JsonFields("record")
    norm = normalize(parse_lines(lines), fields, plane="access", source="s", ingested_at=NOW)
    assert with_errors(norm).first()["errors"] == []
    assert with_errors(norm, strict_datetime=True).first()["errors"] == ["occurred_at"]


def test_labels_and_unknown_fields_do_not_leak(spark):
    row = events(spark, [access(is_anomaly=True, anomaly_reason="x", extra=1)]).first().asDict(recursive=True)
    assert "is_anomaly" not in json.dumps(row) and "extra" not in json.dumps(row)


def test_defaults_repeat_on_retry(spark):
    records = [access(event_id="", occurred_at="<absent>")]
    first, second = events(spark, records).first(), events(spark, records).first()
    assert first["event_id"] == second["event_id"] and first["occurred_at"] == NOW


@pytest.mark.parametrize(
    "text,hour",
    [
        ("2026-01-05T23:05:00-05:00", 23), ("2026-01-05T06:00:00+00:00", 6), ("2026-01-05T22:00:00Z", 22),
        ("2026-01-05", 0), ("2026-01-05 07:30", 7), ("20260105T091500", 9), ("2026-W02-1T11:00", 11),
        ("not-a-date", None), ("2026-02-30T10:00:00", None), ("2026-01-05T25:00:00", None), ("", None),
        ("2026-01-05T10:00:00.123456+00:00", 10), ("2026-01-05T10:00:00junk", None),
    ],
)
def test_iso_hour(spark, text, hour):
    df = spark.createDataFrame([(text,)], "t string")
    assert tuple(df.select(iso_hour(F.col("t")), feature_hour(F.col("t"))).first()) == (hour, 12 if hour is None else hour)


def test_unparsable_time_adds_no_risk(spark):
    (row,) = decided(spark, [access(occurred_at="not-a-date")])
    assert row["signals"]["fused_anomaly_score"] == 0.1


@pytest.mark.parametrize(
    "key,plane",
    [
        ("raw/access/x.jsonl", "access"), ("content/x.jsonl", "content"), ("raw/access/content/x.jsonl", None),
        ("raw/x.jsonl", None), ("RAW/ACCESS/x.jsonl", "access"),
    ],
)
def test_plane_of_key(spark, key, plane):
    df = spark.createDataFrame([(key,)], "k string")
    assert df.select(plane_of_key(F.col("k"))).first()[0] == plane


def test_output_key(spark):
    df = spark.createDataFrame([("raw/access/a.jsonl",), ("a.jsonl",)], "k string")
    assert [r[0] for r in df.select(output_key(F.col("k"))).collect()] == ["access/a.jsonl", "a.jsonl"]


def test_text_forms(spark):
    rows = [("\t Hello,\n  World  ",), ("hello world!",), ("...",), ("",)]
    df = spark.createDataFrame(rows, "t string")
    got = df.select(strip(F.col("t")), normal_form(F.col("t")), opening_signature(F.col("t")), is_blank(F.col("t"))).collect()
    assert got[0][0] == "Hello,\n  World" and got[0][1] == "hello, world"
    assert got[0][2] == got[1][2] != got[2][2]
    assert got[2][2] == "da39a3ee5e6b4b0d3255bfef95601890afd80709"
    assert [r[3] for r in got] == [False, False, False, True]


# --- rules ------------------------------------------------------------------------------------


ODD_RULES = parse_rules(
    [
        {"id": "ALWAYS", "action": "allow", "explanation": "always"},
        {"id": "NO-CLASS", "action": "flag", "when": {"content_class": None}},
        {"id": "LIST", "action": "flag", "when": {"role": ["analyst", None]}, "explanation": "list"},
        {"id": "MISSING", "action": "block", "when": {"unknown_score_gte": 0.1}},
        {"id": "NUMBER", "action": "alert", "when": {"fused_anomaly_score": 0.7}, "explanation": "number"},
        {"id": "MIXED", "action": "block", "when": {"role": 3}},
    ]
)


def test_rule_condition_kinds(spark):
    rows = decided(
        spark, [access(action="bulk_download"), access(role="manager"), {"document_id": "d", "text": "x"}],
        rules=lambda e: rules.fire(e, ODD_RULES),
    )
    assert [r["rule_ids"] for r in rows] == [
        ["NUMBER", "NO-CLASS", "LIST", "ALWAYS"], ["NO-CLASS", "ALWAYS"], ["LIST", "ALWAYS"],
    ]
    assert [r["action"] for r in rows] == ["alert", "flag", "flag"]
    assert [r["explanation"] for r in rows] == ["number list always", "always", "list always"]


SMALL = parse_rules([{"id": "TINY", "action": "flag", "when": {"lstm_score": [0.05, 0.0001]}}])


@pytest.mark.parametrize("rule_set", [shipped_rules(), ODD_RULES, SMALL, []])
def test_rules_as_rows_equal_compiled_rules(spark, rule_set):
    records = [g[0] | {"event_id": f"0f1e2d3c-4b5a-4978-8695-a4b3c2d1e0{i:02d}"} for i, g in enumerate(GOLDEN)]
    records += [{"document_id": f"d{i}", "text": d[0]} for i, d in enumerate(DOCUMENTS)]
    valid, _ = split_valid(events(spark, records))
    scored = decide.with_signals(decide.heuristic_scorer()(decide.keyword_classifier()(valid)))
    columns = ["event_id", "action", "rule_ids", "explanation"]
    compiled = sorted(rules.fire(scored, rule_set).select(columns).collect())
    assert compiled == sorted(rules.fire_from_tables(scored, rule_set).select(columns).collect())


def test_rules_from_tables_move_nothing(spark):
    valid, _ = split_valid(events(spark, [g[0] for g in GOLDEN]))
    scored = decide.with_signals(decide.heuristic_scorer()(decide.keyword_classifier()(valid)))
    fired = rules.fire_from_tables(scored, rule_rows(spark, shipped_rules()))
    plan = fired._jdf.queryExecution().executedPlan().toString()
    main = plan.split("Subqueries")[0].split("Subquery")[0]
    assert "Exchange" not in main and "Join" not in main
    assert fired.count() == len(GOLDEN)


def test_rule_tables_are_checked(spark):
    valid, _ = split_valid(events(spark, [access()]))
    scored = decide.with_signals(decide.heuristic_scorer()(decide.keyword_classifier()(valid)))
    heads, tests = rule_rows(spark, shipped_rules())
    wrong = heads.withColumn("action", F.lit("explode"))
    with pytest.raises(Exception, match="invalid action explode"):
        rules.fire_from_tables(scored, (wrong, tests)).collect()
    many = spark.range(10_001).select(
        F.col("id").cast("string").alias("rule_key"), F.lit("r").alias("rule_id"), F.lit("flag").alias("action"),
        F.lit("x").alias("explanation"), F.col("id").cast("int").alias("position"),
    )
    with pytest.raises(Exception, match="more than 10000 rules"):
        rules.fire_from_tables(scored, (many, tests)).collect()
    row = rules.fire_from_tables(scored, (many.limit(3000), tests.limit(0))).first()
    assert (row["action"], row["rule_ids"], len(row["explanation"])) == ("flag", ["r"], 5999)


def test_lists_without_values_and_repeated_ids(spark):
    odd = parse_rules(
        [
            {"id": "EMPTY", "action": "block", "when": {"role": []}},
            {"id": "TWICE", "action": "flag", "when": {"role": "analyst"}, "explanation": "one"},
            {"id": "TWICE", "action": "flag", "when": {"department": ["sales", "hr"]}, "explanation": "two"},
            {"id": "FLAGGED", "action": "flag", "when": {"fused_anomaly_score": [True, 0.1]}},
        ]
    )
    compiled = decided(spark, [access()], rules=lambda e: rules.fire(e, odd))
    by_rows = decided(spark, [access()], rules=lambda e: rules.fire_from_tables(e, odd))
    assert compiled == by_rows and by_rows[0]["rule_ids"] == ["TWICE", "FLAGGED"] and by_rows[0]["explanation"] == "one two"


def test_fallback_rules_differ_where_documented(spark):
    rows = decided(
        spark, [access(action="bulk_download", resource_class="PII"), {"document_id": "d", "text": "revenue"}],
        rules=fallback_engine(),
    )
    assert [(r["action"], r["rule_ids"]) for r in rows] == [("flag", ["ACC-MED-ANOMALY"]), ("flag", ["CONT-FIN"])]


def test_rule_files(tmp_path):
    good = tmp_path / "rules.json"
    good.write_text(json.dumps({"rules": K.RULES}))
    assert load_rules(good) == shipped_rules()
    (tmp_path / "empty.json").write_text("{}")
    assert load_rules(tmp_path / "empty.json") == []
    yaml = tmp_path / "rules.yaml"
    yaml.write_text("rules:\n  - {id: A, action: flag, when: {role: [x, y]}}\n")
    assert load_rules(yaml)[0].when == {"role": ["x", "y"]}
    with pytest.raises(RuleError):
        parse_rules([{"id": "A", "action": "explode"}])


def test_action_is_most_severe_rule(spark):
    severity = {r.id: r.severity for r in shipped_rules()} | {"default-allow": 0}
    for row in decided(spark, [g[0] for g in GOLDEN]):
        assert K.SEVERITY[row["action"]] == max(severity[i] for i in row["rule_ids"])


def test_decisions_meet_their_contract(spark):
    valid, _ = split_valid(events(spark, [g[0] for g in GOLDEN]))
    checked = with_decision_errors(govern(valid, decided_at=NOW))
    assert {tuple(r["errors"]) for r in checked.collect()} == {()}


def test_custom_port_is_checked(spark):
    valid, _ = split_valid(events(spark, [access()]))
    high = lambda e: decide.heuristic_scorer()(e).withColumn("fused_anomaly_score", F.lit(1.5))
    row = with_decision_errors(govern(valid, decided_at=NOW, scorer=high)).first()
    assert row["errors"] == ["signals.fused_anomaly_score"]


def test_contract_catches_two_planes(spark):
    df = events(spark, [access()]).drop("errors").withColumn("content", F.expr("named_struct('document_id','d','text','t','label',null,'metadata',null)"))
    assert "one_of" in df.select(violations(event_checks())).first()[0]
