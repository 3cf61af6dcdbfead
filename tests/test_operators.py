"""Windows, ranks, evaluation, document sets and models against plain Python."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gavel import constants as K
from gavel.functions import features as feat
from gavel.operators import corpus, evaluate, forest, metrics, models, ranks
from gavel.operators.ordered import in_ranges, running_sums
from gavel.operators.sequences import left_padded, sequence_tensor, user_windows
from gavel.plans.train import train_anomaly
from gavel.session import checkpoint_dir, stage
from labelled import access_log_rows, labelled_texts

SEQ = "user_id string, occurred_at string, event_id string, code int"


def history(n=400, seed=1, hot=0.6):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        user = "hot" if rng.random() < hot else f"u{rng.randint(0, 5)}"
        moment = f"2026-01-{rng.randint(1, 3):02d}T{rng.choice((8, 9, 10)):02d}:{rng.randint(0, 3):02d}:00+00:00"
        rows.append((user, moment, f"{rng.getrandbits(64):016x}", i))
    return rows


def loop_windows(rows, size=K.WINDOW):
    out, seen = {}, defaultdict(list)
    for user, _, event, code in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        seen[user].append(code)
        out[event] = seen[user][-size:]
    return out


def collected(df):
    return {r["event_id"]: r["window"] for r in df.collect()}


def test_windows_equal_a_loop(spark):
    rows = history()
    assert collected(user_windows(spark.createDataFrame(rows, SEQ))) == loop_windows(rows)


@pytest.mark.parametrize("ranges", [1, 3, 40])
def test_windows_with_one_crowded_hour(spark, ranges):
    """Most events belong to one user and one hour; ranges cut them evenly all the same."""
    rows = history()
    rows += [("hot", "2026-01-02T09:00:00+00:00", f"{random.Random(i).getrandbits(64):016x}", 1000 + i) for i in range(600)]
    rows += [(None, "2026-01-02T09:00:00+00:00", f"{i:04d}", 5000 + i) for i in range(30)]
    df = spark.createDataFrame(rows, SEQ).repartition(6)
    want = loop_windows([(u or "", *rest) for u, *rest in rows])
    assert collected(user_windows(df, ranges=ranges)) == want
    sizes = [r["count"] for r in in_ranges(df, ["user_id", "occurred_at", "event_id"], ranges).groupBy("_part").count().collect()]
    assert sum(sizes) == len(rows) and max(sizes) < 2.5 * len(rows) / ranges


def test_windows_of_nothing(spark):
    assert user_windows(spark.createDataFrame([], SEQ)).collect() == []


def test_windows_restart_per_split_and_continue_from_carry(spark):
    rows = history(120)
    df = spark.createDataFrame(rows, SEQ).withColumn("split", F.when(F.col("code") < 60, "a").otherwise("b"))
    want = loop_windows([r for r in rows if r[3] < 60]) | loop_windows([r for r in rows if r[3] >= 60])
    assert collected(user_windows(df, within=("split",))) == want
    earlier = spark.createDataFrame([("hot", [7, 8, 9])], "user_id string, carried array<int>")
    got = collected(user_windows(df.drop("split"), earlier=earlier))
    first = min((r for r in rows if r[0] == "hot"), key=lambda r: (r[1], r[2]))
    assert got[first[2]] == [7, 8, 9, first[3]]


def test_hot_user_is_spread_over_tasks(spark):
    df = spark.createDataFrame(history(2000, hot=0.9), SEQ)
    plan = user_windows(df)._jdf.queryExecution().executedPlan().toString()
    # rows are shuffled by (user key, range), never by the user alone; a carry row per
    # user and range is
    assert re.search(r"hashpartitioning\(_key0#\d+, _part#\d+", plan) and "SinglePartition" not in plan


def test_padding_and_tensor(spark):
    df = spark.createDataFrame([([5, 6],)], "window array<int>")
    row = df.select(left_padded(F.col("window")).alias("p"), sequence_tensor(F.col("window")).alias("t")).first()
    assert row["p"] == [-1] * 6 + [5, 6]
    assert len(row["t"]) == 8 and all(len(v) == 25 for v in row["t"]) and sum(map(sum, row["t"][:6])) == 0


def test_code_and_vector_agree(spark, sf):
    from gavel.sources import testbed as B

    raw = B.dirty_access_records(spark, sf)
    get = F.col
    both = raw.select(feat.feature_vector(get).alias("a"), feat.vector_of_code(feat.feature_code(get)).alias("b"), feat.feature_code(get).alias("c"))
    assert both.filter("a <> b OR c < 0 OR c >= 193536").count() == 0
    assert feat.CODES == 193536 and len(feat.FEATURE_NAMES) == 25


# --- ranks -----------------------------------------------------------------------------------


def test_keep_first_and_positions(spark):
    rng = random.Random(3)
    rows = [(i * 7 + 1, rng.choice("ab" + "c" * 20), rng.choice("xy")) for i in range(500)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "id bigint, k string, label string")
    first = {}
    for i, k, _ in sorted(rows):
        first.setdefault(k, i)
    assert {r["id"] for r in ranks.keep_first(df, F.col("k"), "id").collect()} == set(first.values())
    got = {r["id"]: r["position"] for r in ranks.with_position(df, "id", after=F.col("label"), ranges=9).collect()}
    want = {r[0]: n for n, r in enumerate(sorted(rows, key=lambda r: (r[2], r[0])))}
    assert got == want


@pytest.mark.parametrize("spread", [1, 1_000_003])
def test_kth_value_balance_and_split(spark, spread):
    rng = random.Random(4)
    rows = [(i * spread - 50, rng.choice(["big"] * 6 + ["small", "mid", "mid"])) for i in range(700)]
    df = spark.createDataFrame(rows, "id bigint, label string")
    ids = sorted(r[0] for r in rows)
    for k in (0, 1, 350, 699):
        assert ranks.kth_values(df, "id", {None: k})[None] == ids[k]
    floor = min(Counter(r[1] for r in rows).values())
    got = ranks.balance(df, "label", "id").collect()
    for label in {"big", "small", "mid"}:
        want = sorted(r[0] for r in rows if r[1] == label)[:floor]
        assert sorted(r["id"] for r in got if r["label"] == label) == want
    tail = {r["id"] for r in ranks.split_by_position(df, "id", 0.2).filter("split = 'validation'").collect()}
    assert tail == set(ids[-140:])
    with pytest.raises(ValueError):
        ranks.split_by_position(df.limit(3), "id", 0.2)


@pytest.mark.parametrize("each", [False, True])
def test_positions_of_sparse_values_and_hot_labels(spark, each):
    """Order values far apart and one label with nearly all rows: no task numbers them alone."""
    rng = random.Random(8)
    rows = [(rng.randrange(-(2**62), 2**62), rng.choice(["hot"] * 20 + ["a", "b", None])) for _ in range(900)]
    df = spark.createDataFrame(rows, "id bigint, label string").repartition(5)
    placed = ranks.with_position(df, "id", after=F.col("label"), each=each, ranges=12)
    want, seen = {}, Counter()
    for n, (i, label) in enumerate(sorted(rows, key=lambda r: (r[1] is not None, r[1] or "", r[0]))):
        want[i] = seen[label] if each else n
        seen[label] += 1
    assert {r["id"]: r["position"] for r in placed.collect()} == want
    plan = placed._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
    assert ranks.with_position(df.limit(0), "id").count() == 0


def test_running_sums_equal_a_loop(spark):
    rng = random.Random(9)
    rows = [(rng.choice("aaaaab"), i, rng.randrange(-9, 9)) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, i bigint, x bigint").withColumn("d", F.col("x").cast("decimal(19,0)"))
    for group in ([], ["g"]):
        want, total = {}, Counter()
        for g, i, x in sorted(rows, key=lambda r: r[1]):
            want[i] = total[g if group else ""]
            total[g if group else ""] += x
        got = running_sums(df, ["i"], {"s": "x", "t": "d"}, group=group, ranges=7).collect()
        assert {r["i"]: r["s"] for r in got} == want == {r["i"]: int(r["t"]) for r in got}


def test_texts_stay_where_they_are(spark):
    """Neither dedup nor leakage removal shuffles a text while the list of losers is short."""
    rows = [(i, f"text number {i % 40} of many", f"lang{i % 3}") for i in range(300)]
    docs = spark.createDataFrame(rows, "id bigint, text string, lang string")
    seen = spark.createDataFrame([(1,)], "n int").select(corpus.opening_signature(F.lit("text number 3 of many")).alias("signature"))
    for kept, n in ((corpus.dedupe(docs, "id"), 40), (corpus.remove_seen(docs, seen, "id"), 292)):
        assert kept.count() == n
        plan = kept._jdf.queryExecution().executedPlan().toString()
        assert not re.search(r"Exchange hashpartitioning", plan) and "BroadcastHashJoin" in plan


def test_long_lists_of_losers_are_shuffled(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"t{i % 7}") for i in range(100)], "id bigint, text string")
    monkeypatch.setattr(ranks, "BROADCAST_ROWS", 10)
    kept = corpus.dedupe(docs, "id")
    assert sorted(r["id"] for r in kept.collect()) == list(range(7))
    assert "SortMergeJoin" in kept._jdf.queryExecution().executedPlan().toString()


# --- document sets ------------------------------------------------------------------------------


def first_of_each_opening(texts):
    """The smallest id of every group with the same first ten words, ignoring case and marks."""
    groups = defaultdict(list)
    for i, text in texts:
        if words := re.findall(r"\w+", text.lower()):
            groups[tuple(words[:10])].append(i)
        elif text.strip():
            groups[()].append(i)
    keep = {min(ids) for ids in groups.values()}
    return [(i, text.strip()) for i, text in texts if i in keep]


def test_dedupe_equals_a_loop(spark):
    rng = random.Random(5)
    words = ["alpha", "Beta", "gämma", "delta_1", "été", "x"]
    texts = []
    for i in range(300):
        body = " ".join(rng.choice(words) for _ in range(rng.randint(1, 3)))
        texts.append((i, rng.choice(["", " ", "\t", " "]) + body + rng.choice(["", "!", ", ...", "\n"])))
    texts += [(900, "..."), (901, "!!!"), (902, " \n"), (903, "")]
    df = spark.createDataFrame(texts, "id bigint, text string")
    got = sorted((r["id"], r["text"]) for r in corpus.dedupe(df, "id").collect())
    assert got == sorted(first_of_each_opening(texts))


def test_prepare_takes_classes_in_turn(spark):
    rows = [(1, "b", "same text"), (2, "a", "Same text!"), (3, "a", "other"), (4, "b", "third"), (5, "a", "seen one")]
    df = spark.createDataFrame(rows, "id bigint, label string, text string")
    seen = corpus.signatures(spark.createDataFrame([("seen, one",)], "text string"))
    got = corpus.prepare(df, "label", "id", seen=seen)
    assert sorted(r["id"] for r in got.collect()) == [2, 4]
    ids = corpus.with_record_ids(got, "id", "7", label="label")
    assert {r["id"]: r["document_id"] for r in ids.collect()} == {2: "llm-7-000000", 4: "llm-7-000001"}


# --- evaluation --------------------------------------------------------------------------------------


def scored(spark, n=300, decimals=2, seed=6):
    rng = random.Random(seed)
    rows = [(round(rng.random(), decimals), round(rng.random(), decimals), rng.random() < 0.3) for _ in range(n)]
    return rows, spark.createDataFrame(rows, "iso double, seq double, y boolean")


@pytest.mark.parametrize("decimals", [1, 2, 9])
def test_roc_auc(spark, decimals):
    rows, df = scored(spark, decimals=decimals)
    pos, neg = [r[0] for r in rows if r[2]], [r[0] for r in rows if not r[2]]
    want = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))
    assert evaluate.roc_auc(df, "iso", F.col("y")).first()[0] == pytest.approx(want, abs=1e-12)


@pytest.mark.parametrize("scale", [1e6, -1e6, 1e-9])
def test_roc_auc_of_any_range(spark, scale):
    """Scores beyond [0, 1], negative ones, infinities and groups without a class."""
    rng = random.Random(2)
    rows = [("g", (rng.randrange(40) - 20) * scale, rng.random() < 0.4) for _ in range(300)]
    rows += [("g", float("inf"), True), ("g", float("-inf"), False), ("g", None, True)]
    rows += [(None, 1.0, True), (None, 1.0, False), ("one class", 0.5, True)]
    df = spark.createDataFrame(rows, "g string, s double, y boolean")
    got = {r["g"]: r["roc_auc"] for r in evaluate.roc_auc(df, "s", F.col("y"), by=["g"]).collect()}
    pos = [s for g, s, y in rows if g == "g" and y and s is not None]
    neg = [s for g, s, y in rows if g == "g" and not y]
    want = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))
    assert got == {"g": pytest.approx(want, abs=1e-12), None: 0.5, "one class": None}
    assert evaluate.roc_auc(df.limit(0), "s", F.col("y")).first()["roc_auc"] is None


@pytest.mark.parametrize("decimals", [2, 9])
def test_sweep_equals_the_grid(spark, decimals):
    rows, df = scored(spark, n=120, decimals=decimals)
    cells = {(r["weight"], r["threshold"]): (r["tp"], r["fp"], r["tn"], r["fn"]) for r in
             evaluate.sweep(df, F.col("iso"), F.col("seq"), F.col("y")).collect()}
    assert len(cells) == 11 * 91
    best = (-1.0, None)
    for w in K.SWEEP_WEIGHTS:
        fused = [(max(0.0, min(1.0, w * s + (1.0 - w) * i)), y) for i, s, y in rows]
        for t in K.SWEEP_THRESHOLDS:
            tp = sum(f >= t and y for f, y in fused)
            fp = sum(f >= t and not y for f, y in fused)
            fn = sum(f < t and y for f, y in fused)
            assert cells[w, t] == (tp, fp, len(rows) - tp - fp - fn, fn)
            f1 = 2 * tp / (2 * tp + fp + fn) if tp else 0.0
            if f1 > best[0]:
                best = (f1, (w, t))
    chosen = evaluate.best_cell(evaluate.sweep(df, F.col("iso"), F.col("seq"), F.col("y"))).first()
    assert (chosen["weight"], chosen["threshold"]) == best[1]


def test_rates_with_empty_denominators(spark):
    df = spark.createDataFrame([(False,), (False,)], "y boolean")
    row = evaluate.confusion(df, F.col("y"), F.lit(False)).first()
    assert (row["precision"], row["recall_detection_rate"], row["f1"], row["false_positive_rate"]) == (0, 0, 0, 0)


def test_panels_agree(spark, sf):
    from gavel.plans.queries import decisions

    made = decisions(spark, sf)
    cube = metrics.cube(made)
    panels = {(r["panel"], r["name"]): r["n"] for r in metrics.breakdown(cube).collect()}
    assert panels["total", "all"] == metrics.totals(cube).first()["decisions"]
    assert {a: panels.get(("action", a), 0) for a in K.DECISION_ACTIONS} == {r["action"]: r["n"] for r in metrics.by_action(cube).collect()}
    assert {n: v for (p, n), v in panels.items() if p == "plane"} == {r["plane"]: r["n"] for r in metrics.by_plane(cube).collect()}


# --- forest and models --------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def access_log(spark):
    return access_log_rows(spark, 2500, seed=1)


def test_forest_scores_equal_a_walk(spark, access_log):
    rows = models.with_code(access_log, prefix="").select("event_id", "code")
    nodes = spark.createDataFrame(forest.fit_trees(rows, trees=12).toPandas(), forest.NODE)
    table = nodes.toPandas()
    assert table["tree"].nunique() == 12 and table.groupby("tree").size().max() <= 511 and table["sample"].max() == 256
    points = rows.select("code", feat.vector_of_code(F.col("code")).alias("vector")).limit(40)
    trees = {t: g.set_index("node") for t, g in table.groupby("tree")}
    for r in forest.raw_scores(points, nodes).collect():
        total = 0.0
        for tree in trees.values():
            node = tree.loc[0]
            while node["feature"] >= 0:
                goes_left = r["vector"][int(node["feature"])] <= node["cut"]
                node = tree.loc[int(node["left"] if goes_left else node["right"])]
            total += node["length"]
        want = 2.0 ** (-(total / len(trees)) / forest.average_path(256))
        assert r["raw"] == pytest.approx(want, abs=1e-12)


def test_average_path():
    assert forest.average_path(1) == 0 and forest.average_path(2) == 1
    assert forest.average_path(256) == pytest.approx(2 * (np.log(255) + np.euler_gamma) - 2 * 255 / 256)


def test_training_scoring_saving(spark, access_log, tmp_path):
    test = access_log_rows(spark, 1000, seed=2)
    out = train_anomaly(access_log, "row", test=test, trees=40, rounds=5)
    report = {r["scorer"]: r for r in out.report.collect()}
    assert set(report) == {"isolation_forest", "lstm", "fused"} == set(out.thresholds)
    assert report["lstm"]["roc_auc"] > 0.9 and report["isolation_forest"]["roc_auc"] > 0.75
    assert all(r["tp"] + r["fp"] + r["tn"] + r["fn"] == 1000 for r in report.values())
    out.model.save(str(tmp_path / "m"))
    loaded = models.AnomalyModel.load(spark, str(tmp_path / "m"))
    windows = user_windows(models.with_code(test, prefix="").select("user_id", "event_id", "occurred_at", "code"))
    names = ("event_id", "isolation_forest_score", "lstm_score", "fused_anomaly_score")
    a = sorted(tuple(r) for r in out.model.scores(windows).select(*names).collect())
    assert a == sorted(tuple(r) for r in loaded.scores(windows).select(*names).collect())
    assert all(0 <= v <= 1 for row in a for v in row[1:])


def test_model_ports_in_the_plan(spark, sf):
    from gavel.plans.govern import govern
    from gavel.sources import testbed as B

    events = B.canonical_events(spark, sf)
    access = models.with_code(B.access_events(spark, sf))
    flat = access.select("event_id", "code", "occurred_at", F.col("access.user_id").alias("user_id"), (F.col("access.action") == "delete").alias("y"))
    windows = user_windows(flat)
    model = models.AnomalyModel(forest.fit_forest(flat, trees=10), models.fit_sequence_model(windows, "y", 3.0, rounds=2))
    docs = labelled_texts(spark, 200)
    text = models.fit_text_model(models.training_rows(docs, "row"), features=1 << 10, rounds=5)
    governed = govern(events, decided_at="2026-01-01T00:00:00+00:00", classifier=models.text_classifier(text), scorer=model.scorer())
    got = {(r["data_plane"], r["c"], r["s"]): r["n"] for r in governed.groupBy(
        "data_plane", F.col("signals.content_class").isNotNull().alias("c"), F.col("signals.fused_anomaly_score").isNotNull().alias("s")
    ).agg(F.count("*").alias("n")).collect()}
    assert got == {("access", False, True): 1000, ("content", True, False): 200}


def test_text_model_learns_and_truncates(spark):
    docs = labelled_texts(spark, 300)
    model = models.fit_text_model(models.training_rows(docs, "row"), features=1 << 12, rounds=15)
    out = models.classify_text(docs, model)
    matrix = evaluate.confusion_matrix(out, "label", "content_class")
    assert evaluate.multiclass_report(matrix).first()["macro_f1"] > 0.9
    long = spark.createDataFrame([("word " * 300 + "passport",)], "text string")
    assert max(len(r["tokens"]) for r in model.transform(long).select("tokens").collect()) == K.MAX_TOKENS
    assert models.training_rows(docs, "row", limit=7).count() == 7


def test_external_models_plug_in(spark):
    def sequence():
        return lambda batch: np.asarray(batch, dtype=np.float64).sum(axis=(1, 2)) / 1000.0

    df = spark.createDataFrame([([1, 2],), ([3],)], "window array<int>")  # short windows are padded
    assert all(0 <= r[0] <= 1 for r in models.external_sequence_scores(df, sequence).select("lstm_score").collect())

    def encoder():
        return lambda texts: np.array([[0.1, 0.7, 0.1, 0.05, 0.05] for _ in texts], dtype=np.float32)

    events = spark.createDataFrame([("content", ("d", "t"))], "data_plane string, content struct<document_id:string,text:string>")
    row = models.external_text_classifier(encoder)(events).first()
    assert (row["content_class"], row["content_confidence"]) == ("financial", 0.7)


def test_staged_tables_are_read_back(spark, tmp_path):
    rows = stage(spark.range(5), str(tmp_path / "t"))
    assert "FileScan parquet" in rows._jdf.queryExecution().executedPlan().toString() and rows.count() == 5
    assert stage(spark.range(3), str(tmp_path / "t")).count() == 3  # replaced
    assert checkpoint_dir(spark) and stage(spark.range(2)).count() == 2
