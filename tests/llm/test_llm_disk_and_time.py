"""Less on disk at a time, and less worked out twice, with the same results."""

import random

import llm_brute as B
import pyarrow as pa
import pyarrow.parquet as pq

from gavel import session
from gavel.llm import jaccard_join, line_dedup, suffix_dedup

TEXTS = "doc_id long, text string"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def test_keys_meet_in_passes(spark, monkeypatch):
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefg") for _ in range(6)) for _ in range(30)]
    rows = []
    for i in range(60):
        line = " ".join(rng.choice(words) for _ in range(rng.choice([5, 7, 25])))
        rows += [(2 * i, line), (2 * i + 1, line[:-1] + "#")]
    frame, taken = spark.createDataFrame(rows, TEXTS), []
    monkeypatch.setattr(line_dedup, "KEY_ROWS", 1)
    for name in ("pairs_with_earliest", "pairs_with_earlier"):
        plain = getattr(line_dedup, name)
        monkeypatch.setattr(
            line_dedup, name, lambda keys, *more, plain=plain, name=name: taken.append(name) or plain(keys, *more)
        )
    got = {r["doc_id"]: (list(r["removed_lines"]), r["n_near"]) for r in line_dedup.line_report(frame).collect()}
    assert got == B.line_removals(rows)
    assert taken == ["pairs_with_earliest"] * line_dedup.KEY_PASSES + ["pairs_with_earlier"] * line_dedup.KEY_PASSES


def test_only_texts_of_pairs_that_letters_allow_are_joined(spark, monkeypatch):
    rng = random.Random(13)
    rows = []
    for i in range(40):
        line = "".join(rng.choice("abcdefg \u00e4\u00c9Z#") for _ in range(rng.choice([24, 50, 130])))
        # near, near, and of the same letters in COUNTED but others in FURTHER
        near = [line[:9] + "\u00e4\u00fc"[i % 2] + line[10:], line + "#"]
        other = line[:12] + line[12:].translate(str.maketrans("\u00e4Z", "\u00f6H")) + "zxqj,"
        rows += [(5 * i + k, text) for k, text in enumerate([line, *near, other])]
        rows.append((5 * i + 4, "".join(rng.choice("hijklmn") for _ in range(130))))
    seen, plain = [], line_dedup.measured

    def measured(pairs, texts):
        seen.append(({h for pair in pairs.collect() for h in pair}, {r["h"] for r in texts.select("h").collect()}))
        return plain(pairs, texts)

    monkeypatch.setattr(line_dedup, "measured", measured)
    monkeypatch.setattr(line_dedup, "TEXT_ROWS", 50)
    got = {r["doc_id"]: (list(r["removed_lines"]), r["n_near"]) for r in line_dedup.line_report(spark.createDataFrame(rows, TEXTS)).collect()}
    assert got == B.line_removals(rows)
    assert sum(n_near for _, n_near in got.values()) >= 60
    assert len(seen) >= 2 and all(pairs <= texts for pairs, texts in seen)
    assert 0 < max(len(texts) for _, texts in seen) <= 160


def test_removed_lines_are_staged_and_their_shuffles_dropped(spark, monkeypatch):
    staged, plain = [], line_dedup.stage

    def stage(df, path=None):
        staged.append((df.columns, spark.conf.get(CLEANUP, None)))
        return plain(df, path)

    monkeypatch.setattr(line_dedup, "stage", stage)
    before = spark.conf.get(CLEANUP, None)
    frame = spark.createDataFrame([(1, "one line\ntwo"), (2, "one line\nthree"), (3, "two"), (4, None)], TEXTS)
    got = {r["doc_id"]: r["text"] for r in line_dedup.without_repeated_lines(frame).collect()}
    assert got == {1: "one line\ntwo", 2: "three", 4: None}
    assert staged[-1] == (["doc_key", "text_key", "removed", "n_near"], "true")
    assert spark.conf.get(CLEANUP, None) == before


def test_staged_tables_are_in_zstd(spark, tmp_path):
    staged = session.stage(spark.range(10), f"{tmp_path}/t")
    (path,) = [f.removeprefix("file://") for f in staged.inputFiles() if pq.read_metadata(f.removeprefix("file://")).num_rows][:1]
    assert pq.read_metadata(path).row_group(0).column(0).compression == "ZSTD"


def test_shuffles_of_the_jaccard_join_are_dropped(spark, monkeypatch):
    settings, plain = [], jaccard_join.similar_sets

    def similar_sets(*given):
        settings.append(spark.conf.get(CLEANUP, None))
        return plain(*given)

    monkeypatch.setattr(jaccard_join, "similar_sets", similar_sets)
    before = spark.conf.get(CLEANUP, None)
    text = "a b c d e f g h i j"
    got = jaccard_join.near_duplicates(spark.createDataFrame([(1, text), (2, text), (3, "other")], TEXTS)).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {1: 1, 2: 1, 3: 3}
    assert settings == ["true"] and spark.conf.get(CLEANUP, None) == before


def test_anchors_are_those_of_the_stretches():
    rng = random.Random(12)
    texts = [b"", b"x" * 199, b"x" * 700, *(rng.randbytes(rng.randrange(200, 3000)) for _ in range(20))]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.binary())], names=["text"])
    got = [a for b in suffix_dedup._find_anchors(iter([batch])) for a in b.column(0).to_pylist()]
    assert got == [anchor for text in texts for anchor, *_ in suffix_dedup.stretches(text)]
