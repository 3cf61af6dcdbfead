"""Named queries over the benchmark tables: ``name -> (spark, sf_dir) -> DataFrame``.

``COVERS`` maps each query to the inventory ids it answers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gavel import constants as K
from gavel.functions import features as feat
from gavel.functions.keys import decoded_key, output_key, plane_of_key
from gavel.functions.scores import clip01, fuse, min_max, round4
from gavel.functions.text import normal_form, opening_signature
from gavel.operators import contracts, corpus, decide, evaluate, ledger, metrics, ranks, rules
from gavel.operators.forest import draw_of, fit_forest, fit_trees
from gavel.operators.models import (
    AnomalyModel, classify_text, fit_sequence_model, fit_text_model, label_id, sequence_scores, with_code,
)
from gavel.operators.normalize import normalize_table
from gavel.operators.sequences import user_windows
from gavel.plans.govern import fallback_engine, govern
from gavel.plans.train import labelled, train_anomaly
from gavel.session import cut_lineage, stage
from gavel.sources import testbed as B
from gavel.sources.decisions import canonical_json, row_json
from gavel.sources.records import JsonFields, infer_plane, parse_lines
from gavel.sources.rules import references_table, shipped_rules

CLASSIFIER = decide.keyword_classifier(B.TEST_KEYWORDS)
SCORES = ("isolation_forest_score", "lstm_score", "fused_anomaly_score")


# --- shared inputs -------------------------------------------------------------------------


def governed(spark: SparkSession, d: str, planes: str = "both", **ports) -> DataFrame:
    events = {"both": B.canonical_events, "access": B.access_events, "content": B.content_events}[planes](spark, d)
    return govern(events, decided_at=F.col("occurred_at"), classifier=CLASSIFIER, **ports)


def half() -> Column:
    """A fixed half of all ids, by the last hex digit."""
    return F.substring("decision_id", -1, 1) < "8"


def decisions(spark: SparkSession, d: str, planes: str = "both") -> DataFrame:
    """Decisions of which the fixed half is on the ledger."""
    made = decide.decisions_of(governed(spark, d, planes)).drop("ledger")
    return decide.with_ledger(made, F.when(half(), ledger.transaction_id()))


def access_rows(df: DataFrame, *columns) -> DataFrame:
    return df.select("event_id", *[F.col(f"access.{n}").alias(n) for n in K.ACCESS_REQUIRED + K.ACCESS_OPTIONAL], *columns)


def rule_columns() -> list[Column]:
    return ["action", F.array_join("rule_ids", ",").alias("rule_ids"), "explanation"]


# --- normalisation, validation, routing ----------------------------------------------------------


def governed_actions(spark, d):
    return metrics.by_action(metrics.cube(decide.decisions_of(governed(spark, d))))


def normalized_access(spark, d):
    raw = B.dirty_access_records(spark, d)
    norm = normalize_table(raw, "access", source=B.ACCESS_SOURCE, ingested_at=B.INGESTED_AT)
    return access_rows(norm, "event_type", "data_plane", "occurred_at", "source")


def normalized_content(spark, d):
    norm = normalize_table(
        B.content_records(spark, d).drop("event_id"), "content", source=B.CONTENT_SOURCE, ingested_at=B.INGESTED_AT
    )
    return norm.select(
        "event_id", "event_type", "data_plane", "occurred_at", "source",
        F.col("content.document_id").alias("document_id"), F.md5("content.text").alias("text_md5"),
    )


def mixed_lines(spark, d) -> DataFrame:
    """JSON lines of both planes; some content lines also carry an access key, some
    access lines name nothing, and some lines are cut short."""
    access = B.access_records(spark, d).select(
        F.col("event_id").alias("id"),
        F.when(F.col("k") % 17 == 0, F.to_json(F.struct("role", "department")))
        .when(F.col("k") % 19 == 0, F.concat(F.lit('{"text":null,"user_id":"'), F.col("user_id"), F.lit('"}')))
        .when(F.col("k") % 23 == 0, F.lit('{"action":'))
        .otherwise(F.to_json(F.struct("action", "user_id", "role")))
        .alias("value"),
    )
    docs = B.content_records(spark, d).select(
        F.col("event_id").alias("id"), F.to_json(F.struct("document_id", "text")).alias("value")
    )
    return access.unionByName(docs)


def inferred_planes(spark, d):
    lines = parse_lines(mixed_lines(spark, d))
    plane = infer_plane(JsonFields("record"))
    return lines.select("id", "malformed", F.when(~F.col("malformed"), plane).alias("plane"))


def key_planes(spark, d):
    pages = B.table(spark, d, "pages").select("page_id", "url")
    folder = B.pick(
        ("raw/access/", "raw/content/", "content/", "RAW/ACCESS/", "raw/", "raw/access/content/"),
        F.pmod("page_id", F.lit(6)),
    )
    tail = F.regexp_replace("url", "^https?://[^/]*/", "")
    key = decoded_key(F.concat(folder, F.replace(tail, F.lit("="), F.lit("%3D+"))))
    return pages.select("page_id", key.alias("key")).select(
        "page_id", plane_of_key(F.col("key")).alias("plane"), output_key(F.col("key")).alias("output_key")
    )


def routed_planes(spark, d):
    """Both planes in one stream, each scored by its own model only."""
    return governed(spark, d).groupBy("data_plane", "event_type").agg(
        F.count("*").alias("n"),
        F.count("signals.content_class").alias("classified"),
        F.count("signals.fused_anomaly_score").alias("scored"),
    )


def checked_access(spark, d) -> DataFrame:
    raw = B.dirty_access_records(spark, d)
    return contracts.with_errors(
        normalize_table(raw, "access", source=B.ACCESS_SOURCE, ingested_at=B.INGESTED_AT, keep=("seq",))
    )


def event_contract(spark, d):
    return checked_access(spark, d).select("seq", F.array_join("errors", ",").alias("errors"))


def dead_letters(spark, d):
    """Bad access records and empty documents, by reason."""
    _, dead = contracts.split_valid(checked_access(spark, d))
    docs = B.content_records(spark, d).withColumn("text", F.when(F.col("seq") % 50 == 7, F.lit(" \n\t")).otherwise(F.col("text")))
    empty = docs.join(corpus.drop_empty(docs).select("seq"), "seq", "left_anti")
    reasons = dead.select(F.explode("errors").alias("reason")).unionByName(empty.select(F.lit("empty text").alias("reason")))
    return reasons.groupBy("reason").agg(F.count("*").alias("n"))


def decision_contract(spark, d):
    """Decisions with faults worked in, by the id's last digit."""
    digit = F.substring("decision_id", -1, 1)
    faulty = decisions(spark, d).withColumns(
        {
            "action": F.when(digit == "0", F.lit("escalate")).otherwise(F.col("action")),
            "rule_ids": F.when(digit == "1", F.array(F.lit("X"), F.lit("X")))
            .when(digit == "2", F.array().cast("array<string>"))
            .when(digit == "3", F.array(F.lit(""))).otherwise(F.col("rule_ids")),
            "signals": F.col("signals").withField(
                "fused_anomaly_score",
                F.when(digit == "4", F.col("signals.fused_anomaly_score") + 1.0).otherwise(F.col("signals.fused_anomaly_score")),
            ),
            "event_id": F.when(digit == "5", F.lit("x")).otherwise(F.col("event_id")),
        }
    )
    return faulty.select(
        "decision_id", F.array_join(contracts.violations(contracts.decision_checks()), ",").alias("errors")
    )


# --- decisions ----------------------------------------------------------------------------------------


def decision_table(spark, d):
    s = F.col("signals")
    return decisions(spark, d).select(
        "decision_id", "event_id", "decided_at", *rule_columns(),
        s.content_class.alias("content_class"), s.content_confidence.alias("content_confidence"),
        *[s[n].alias(n) for n in SCORES],
        decide.plane_of().alias("plane"), decide.is_recorded().alias("recorded"),
        F.col("ledger.transaction_id").alias("transaction_id"),
    )


def decision_display(spark, d):
    return decide.display_rows(decisions(spark, d))


def decision_json(spark, d):
    made = decisions(spark, d)
    return made.select("decision_id", row_json(made).alias("json"))


def access_heuristic(spark, d):
    return decide.heuristic_scorer()(B.access_events(spark, d)).select("event_id", *SCORES)


def keyword_classes(spark, d):
    return CLASSIFIER(B.content_events(spark, d)).select(
        F.col("content.document_id").alias("document_id"), "content_class", "content_confidence"
    )


def rule_decisions(spark, d):
    return governed(spark, d).select("event_id", *rule_columns())


def fallback_decisions(spark, d):
    return governed(spark, d, rules=fallback_engine()).select("event_id", *rule_columns())


def rule_rows_decisions(spark, d):
    """Rules held as rows."""
    scored = decide.with_signals(decide.heuristic_scorer()(CLASSIFIER(B.canonical_events(spark, d))))
    return rules.fire_from_tables(scored, shipped_rules()).select("event_id", *rule_columns())


def rule_references(spark, d):
    """References of the rules that fired."""
    fired = metrics.rule_frequency(decisions(spark, d)).select("rule_id")
    return fired.join(F.broadcast(references_table(spark, shipped_rules())), "rule_id")


def event_decision_pairs(spark, d):
    """Whole events of both planes joined back to their whole decisions."""
    events = B.canonical_events(spark, d)
    pairs = decide.with_own_decision(events, decisions(spark, d))
    c = F.col("content")
    return pairs.select(
        "event_id", "event_type", "data_plane", "occurred_at", "source",
        *[F.col(f"access.{n}").alias(n) for n in K.ACCESS_REQUIRED + K.ACCESS_OPTIONAL],
        c.document_id.alias("document_id"), F.md5(c.text).alias("text_md5"), c.label.alias("label"),
        canonical_json(F.col("decision"), pairs.schema["decision"].dataType).alias("decision"),
    )


# --- ledger ---------------------------------------------------------------------------------------------


def recorded_decisions(spark, d) -> DataFrame:
    """All decisions, written once: the batch and the stored ledger both come from them."""
    return cut_lineage(decide.decisions_of(governed(spark, d)))


def stored_ledger(made: DataFrame) -> DataFrame:
    rows = made.filter(half()).withColumn("ledger_tx_id", ledger.transaction_id())
    return ledger.ledger_rows(rows, F.col("decided_at"))


def ledger_batch(made: DataFrame) -> DataFrame:
    """All decisions again, a tenth of them twice and a few without an id."""
    digit = F.substring("decision_id", 1, 1)
    nameless = F.substring("decision_id", 1, 2) == "00"
    copies = F.when(digit == "3", F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    made = made.withColumn("decision_id", F.when(~nameless, F.col("decision_id")))
    return made.withColumn("copy", F.explode(copies))


def ledger_append(spark, d):
    made = recorded_decisions(spark, d)
    accepted, rejected = ledger.record(
        ledger_batch(made), stored_ledger(made).select("id_prefix", "decision_id"), F.col("copy")
    )
    done = accepted.select("event_id", "decision_id", F.lit("accepted").alias("outcome"), F.col("ledger_tx_id").alias("tx_id"))
    refused = rejected.select("event_id", "decision_id", F.col("reason").alias("outcome"), F.lit(None).cast("string").alias("tx_id"))
    return done.unionByName(refused)


def decided(spark, d) -> DataFrame:
    return decide.decisions_of(governed(spark, d))


def ledger_scan(spark, d):
    return ledger.scan(decide.from_ledger_rows(stored_ledger(decided(spark, d)))).select(
        "decision_id", "action", "decided_at", F.col("ledger.transaction_id").alias("transaction_id"),
        F.col("ledger.channel").alias("channel"),
    )


def ledger_keys(spark, d, *more: str) -> DataFrame:
    """``id_prefix, decision_id`` and ``more`` of all decisions as the ledger has them, staged:
    candidates, their directories and the stored half are all read from there."""
    rows = decided(spark, d).withColumn("ledger_tx_id", ledger.transaction_id())
    return stage(ledger.ledger_rows(rows, F.col("decided_at")).select("id_prefix", "decision_id", *more))


def ledger_lookup(spark, d):
    """The stored row of every decision, or that there is none."""
    made = ledger_keys(spark, d, "action", "ledger_tx_id")
    return ledger.lookup(made.filter(half()), made.select("decision_id"))


def ledger_exists(spark, d):
    made = ledger_keys(spark, d)
    return ledger.exists(made.filter(half()), made.select("decision_id"))


def ledger_history(spark, d):
    return ledger.history(stored_ledger(decided(spark, d)))


# --- reporting ------------------------------------------------------------------------------------------------


def _cube(spark, d):
    return metrics.cube(decisions(spark, d))


def metric_totals(spark, d):
    return metrics.totals(_cube(spark, d))


def metric_actions(spark, d):
    return metrics.by_action(_cube(spark, d))


def metric_planes(spark, d):
    return metrics.by_plane(_cube(spark, d))


def metric_breakdown(spark, d):
    return metrics.breakdown(_cube(spark, d))


def metric_grouping_sets(spark, d):
    return metrics.grouping_sets(decisions(spark, d)).withColumn("level", F.col("level").cast("bigint"))


def metric_indicators(spark, d):
    return metrics.indicators(metrics.totals(_cube(spark, d)))


def rule_frequency(spark, d):
    return metrics.rule_frequency(decisions(spark, d))


def top_rules(spark, d):
    return metrics.top_rules(metrics.rule_frequency(decisions(spark, d)))


def compliance_hits(spark, d):
    return metrics.compliance_hits(
        metrics.rule_frequency(decisions(spark, d)), references_table(spark, shipped_rules())
    )


def recent_decisions(spark, d):
    return metrics.recent(decisions(spark, d)).select("decision_id", "decided_at", "action")


def latest_alerts(spark, d):
    return metrics.latest_alerts(decisions(spark, d)).withColumn("rule_ids", F.array_join("rule_ids", ","))


def alert_view(spark, d):
    return metrics.alert_view(metrics.latest_alerts(decisions(spark, d)))


def run_summary(spark, d):
    """One run per day: decisions of valid records, errors of the others."""
    checked = checked_access(spark, d)
    results = checked.select(
        F.substring("occurred_at", 1, 10).alias("run_id"),
        F.when(F.size("errors") == 0, F.col("event_id")).alias("decision"),
        F.when(F.size("errors") > 0, F.array_join("errors", ",")).alias("error"),
    )
    return metrics.run_summary(results)


def batch_summary(spark, d):
    return metrics.batch_summary(governed(spark, d))


def anomaly_counts(spark, d):
    return metrics.class_counts(labelled_access(spark, d), "is_anomaly")


# --- features and windows -----------------------------------------------------------------------------------------


def labelled_access(spark, d) -> DataFrame:
    """Labelled rows beside their normalised events."""
    raw = B.access_records(spark, d)
    norm = normalize_table(
        raw, "access", source=B.ACCESS_SOURCE, ingested_at=B.INGESTED_AT, keep=("seq", "is_anomaly", "k")
    )
    return norm.drop("problems").withColumn("y", F.coalesce("is_anomaly", F.lit(False)).cast("int"))


def access_features(spark, d):
    events = labelled_access(spark, d)
    get = lambda n: F.col("occurred_at") if n == "occurred_at" else F.col(f"access.{n}")
    vec = feat.feature_vector(get)
    named = events.select("event_id", vec.alias("v"), feat.feature_code(get).alias("code"), "y", feat.resource_department(get("resource_id")).alias("resource_department"))
    return named.select(
        "event_id", "y", "resource_department", F.col("code").cast("bigint").alias("code"),
        F.array_join(F.transform(F.slice("v", 1, 20), lambda x: x.cast("int").cast("string")), "").alias("one_hots"),
        F.round(F.element_at("v", 21).cast("double"), 4).alias("hour_norm"),
        *[F.element_at("v", 22 + i).cast("int").alias(n) for i, n in enumerate(feat.FEATURE_NAMES[21:])],
    )


def score_fusion(spark, d):
    """Heuristic scores fused with the shipped weight and rescaled by fixed ranges."""
    scored = access_heuristic(spark, d)
    iso, seq = F.col("isolation_forest_score"), F.col("lstm_score")
    return scored.select(
        "event_id", round4(fuse(iso, seq)).alias("fused"),
        round4(min_max(iso, 0.2, 0.9)).alias("scaled"), round4(min_max(iso, 0.5, 0.5)).alias("flat"),
        clip01(iso * 2 - 0.5).alias("clipped"),
    )


def user_sequences(spark, d):
    """Windows of seconds-free event summaries: size, first and summed codes."""
    rows = with_code(B.access_events(spark, d)).select(
        F.col("access.user_id").alias("user_id"), "event_id", "occurred_at", "code"
    )
    w = user_windows(rows)
    return w.select(
        "event_id", F.size("window").cast("bigint").alias("size"), F.element_at("window", 1).cast("bigint").alias("oldest"),
        F.element_at("window", -1).cast("bigint").alias("newest"),
        F.aggregate("window", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"),
        F.array_join(F.transform("window", lambda x: x.cast("string")), ",").alias("codes"),
    )


def positional_split(spark, d):
    rows = B.access_records(spark, d).select("seq", "is_anomaly")
    return ranks.split_by_position(rows, "seq", K.VALIDATION_SHARE)


def split_sequences(spark, d):
    """Windows that restart at the validation split."""
    rows = ranks.split_by_position(labelled(B.access_records(spark, d), "seq"), "seq", K.VALIDATION_SHARE)
    w = user_windows(rows, within=("split",))
    return w.select("event_id", "split", F.array_join(F.transform("window", lambda x: x.cast("string")), ",").alias("codes"))


# --- evaluation ------------------------------------------------------------------------------------------------------


def scored_labels(spark, d) -> DataFrame:
    """Heuristic scores beside a truth they only partly explain."""
    scored, k = decide.heuristic_scorer()(labelled_access(spark, d)), F.col("k")
    truth = ((F.col("y") == 1) | (k % 9 == 4)) & (k % 13 != 5)
    return scored.select("event_id", *SCORES, truth.alias("truth"))


def confusion_rates(spark, d):
    rows = scored_labels(spark, d)
    return evaluate.confusion(rows, F.col("truth"), F.col("fused_anomaly_score") >= 0.5)


def roc_area(spark, d):
    out = evaluate.roc_auc(scored_labels(spark, d), "isolation_forest_score", F.col("truth"))
    return out.select(F.round("roc_auc", 9).alias("roc_auc"))


def class_weights(spark, d):
    return evaluate.class_weights(labelled_access(spark, d), "y")


def _fused_iso_seq():
    return F.col("isolation_forest_score"), F.col("lstm_score")


def fusion_sweep(spark, d):
    iso, seq = _fused_iso_seq()
    return evaluate.sweep(scored_labels(spark, d), iso, seq, F.col("truth"))


def fusion_choice(spark, d):
    iso, seq = _fused_iso_seq()
    return evaluate.best_cell(evaluate.sweep(scored_labels(spark, d), iso, seq, F.col("truth")))


OWN_THRESHOLDS = {"isolation_forest": 0.39, "lstm": 0.6, "fused": 0.5}


def scorer_report(spark, d):
    scores = {n: F.col(c) for n, c in zip(OWN_THRESHOLDS, SCORES)}
    return evaluate.evaluation_report(scored_labels(spark, d), scores, OWN_THRESHOLDS, F.col("truth"))


def labelled_documents(spark, d) -> DataFrame:
    """Documents with a quality label and two candidate predictions of it."""
    docs = B.table(spark, d, "documents").select("doc_id", "n_chars", "lang")
    labels = B.table(spark, d, "labels")
    long = F.when(F.col("n_chars") >= 400, F.lit(1)).otherwise(F.lit(0))
    english = F.when(F.col("lang") == "en", F.lit(1)).otherwise(F.lit(0))
    return docs.join(labels, "doc_id").select(
        "doc_id", F.col("quality").cast("string").alias("truth"),
        long.cast("string").alias("by_length"), english.cast("string").alias("by_language"),
    )


def _candidates(spark, d):
    rows = labelled_documents(spark, d).select(
        "truth",
        F.inline(F.array(*[F.struct(F.lit(n).alias("model"), F.col(n).alias("predicted")) for n in ("by_length", "by_language")])),
    )
    return evaluate.confusion_matrix(rows, "truth", "predicted", by=["model"])


def multiclass_report(spark, d):
    report = evaluate.multiclass_report(_candidates(spark, d), by=["model"])
    return report.withColumn("eval_count", F.col("eval_count").cast("bigint"))


def class_f1(spark, d):
    return evaluate.per_class_f1(_candidates(spark, d), labels=("0", "1", "2"), by=["model"])


def model_comparison(spark, d):
    return evaluate.best_model(evaluate.multiclass_report(_candidates(spark, d), by=["model"])).select("model", "macro_f1")


# --- document sets ---------------------------------------------------------------------------------------------------------


def _docs(spark, d) -> DataFrame:
    return B.table(spark, d, "documents").select("doc_id", "text", "lang")


def text_signatures(spark, d):
    return corpus.drop_empty(_docs(spark, d)).select(
        "doc_id", F.md5(normal_form(F.col("text"))).alias("norm_md5"), opening_signature(F.col("text")).alias("signature")
    )


def deduped_documents(spark, d):
    return corpus.dedupe(_docs(spark, d), "doc_id").select("doc_id", F.md5("text").alias("text_md5"))


def leakage_removed(spark, d):
    """Documents that share no opening with the benchmark or the labelled split."""
    docs = _docs(spark, d)
    marks = corpus.signed(docs, "doc_id")
    split = marks.join(B.table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi")
    seen = corpus.signatures(B.table(spark, d, "benchmark")).union(split.select("signature"))
    return corpus.remove_seen(docs, seen, "doc_id", marks=marks).select("doc_id")


def balanced_classes(spark, d):
    return ranks.balance(_docs(spark, d), "lang", "doc_id").select("doc_id", "lang")


def record_ids(spark, d):
    kept = _docs(spark, d).select("doc_id", "lang")
    return corpus.with_record_ids(kept, "doc_id", "740", label="lang").select("doc_id", "document_id")


# --- labelled tables and models --------------------------------------------------------------------------------------------------


def _train_rows(spark, d):
    """The labelled access log of the given events; the last fifth is held out."""
    return ranks.split_by_position(labelled(B.access_records(spark, d), "seq"), "seq", K.VALIDATION_SHARE)


def _fit_rows(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("split") == "fit")


def forest_nodes(spark, d):
    """The trees grown on the fit split."""
    nodes = fit_trees(_fit_rows(_train_rows(spark, d)).select("event_id", "code"))
    return nodes.withColumns({n: F.round(n, 9) for n in ("cut", "length")})


def forest_scores(spark, d):
    """Scores of all events by a forest grown on the fit split."""
    rows = _train_rows(spark, d)
    scored = fit_forest(_fit_rows(rows)).scores(rows)
    return scored.select("event_id", "split", round4(F.col("isolation_forest_score")).alias("isolation_forest_score"))


def _sequence_model(windows):
    weights = evaluate.class_weights(windows, "y").first()
    return fit_sequence_model(windows, "y", weights["positive_weight"], rounds=5, depth=3)


def _split_windows(spark, d):
    """Staged windows that restart at the split: those to fit on, and those held out."""
    windows = stage(user_windows(_train_rows(spark, d), within=("split",)))
    return _fit_rows(windows), windows.filter(F.col("split") == "validation")


def sequence_model_scores(spark, d):
    """Held-out events scored by a model fitted on the others."""
    fit, held_out = _split_windows(spark, d)
    return sequence_scores(held_out, _sequence_model(fit)).select("event_id", "y", "lstm_score")


def anomaly_model_scores(spark, d):
    """Held-out events scored by forest, sequence model and their fusion."""
    fit, held_out = _split_windows(spark, d)
    return AnomalyModel(fit_forest(fit), _sequence_model(fit)).scores(held_out).select("event_id", "y", *SCORES)


def trained_scorers_report(spark, d):
    """Scorers fitted on the first part of the log, tuned on the next, reported on the last fifth."""
    log = B.access_records(spark, d)
    start = ranks.validation_start(log, "seq", K.VALIDATION_SHARE)
    head, tail = log.filter(F.col("seq") < start), log.filter(F.col("seq") >= start)
    return train_anomaly(head, "seq", test=tail, rounds=5).report


def _split_documents(spark, d):
    """Labelled documents: four fifths to fit on, the others held out, by a digest of the id."""
    docs = stage(B.labelled_documents(spark, d))
    held_out = draw_of("held out", F.col("document_id")) % 5 == 0
    return docs.filter(~held_out), docs.filter(held_out)


def text_model_classes(spark, d):
    """Held-out documents classified by a model fitted on the others."""
    fit, held_out = _split_documents(spark, d)
    model = fit_text_model(fit.select("text", label_id(F.col("label")).alias("label_id")), features=1 << 12, rounds=10)
    return classify_text(held_out, model).select("document_id", "label", "content_class", "content_confidence")


COVERS = {
    "governed_actions": "P1 C2 R1-R10 A3",
    "normalized_access": "P1 P6 C15",
    "normalized_content": "P2 P5",
    "inferred_planes": "P3 S6",
    "key_planes": "P4 P7",
    "routed_planes": "P5 F1 U2",
    "event_contract": "V1",
    "dead_letters": "V3 F4",
    "decision_contract": "V2",
    "decision_table": "P8 P9 P10 P11 K5 U1 C15",
    "decision_display": "P14",
    "decision_json": "C14",
    "access_heuristic": "C2 C5 C7 C10",
    "keyword_classes": "C1",
    "rule_decisions": "R1-R10",
    "fallback_decisions": "R12",
    "rule_rows_decisions": "R13 J6",
    "rule_references": "S13",
    "event_decision_pairs": "J5",
    "ledger_append": "K4 J2",
    "ledger_scan": "S8 P12",
    "ledger_lookup": "S9",
    "ledger_exists": "S10 J3",
    "ledger_history": "S11",
    "metric_totals": "A1 A2 A17 F2",
    "metric_actions": "A3",
    "metric_planes": "A4",
    "metric_breakdown": "A8",
    "metric_grouping_sets": "A8",
    "metric_indicators": "A7",
    "rule_frequency": "A5",
    "top_rules": "O3",
    "compliance_hits": "A6 J1 C13",
    "recent_decisions": "O1",
    "latest_alerts": "O2 P13",
    "alert_view": "O5",
    "run_summary": "A9",
    "batch_summary": "A10",
    "anomaly_counts": "A16 S15",
    "access_features": "C3 C4 C5 C6 S15",
    "score_fusion": "C7 C8 C9",
    "user_sequences": "W1",
    "positional_split": "W5",
    "split_sequences": "W1 W5",
    "confusion_rates": "A11",
    "roc_area": "A12",
    "class_weights": "A14",
    "fusion_sweep": "J8 M6",
    "fusion_choice": "O6 M6",
    "scorer_report": "M7",
    "multiclass_report": "A13",
    "class_f1": "A13",
    "model_comparison": "M10",
    "text_signatures": "C11 C12 F4",
    "deduped_documents": "W2",
    "leakage_removed": "J4 S17 U3",
    "balanced_classes": "W3",
    "record_ids": "W4",
    "forest_nodes": "M1",
    "forest_scores": "M1 M2 W5",
    "sequence_model_scores": "M3 M4",
    "anomaly_model_scores": "M5",
    "trained_scorers_report": "M6 M7",
    "text_model_classes": "M8 M9",
}

QUERIES = {name: globals()[name] for name in COVERS}
