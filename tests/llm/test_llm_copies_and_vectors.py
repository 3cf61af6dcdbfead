"""Exact copies, centroid clustering and vector codes against plain versions."""

import collections
import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gavel.llm import exact_dedup, group_join
from gavel.llm.centroid_clustering import cluster, cluster_report, nearest_centroids
from gavel.llm.exact_dedup import exact_copies, without_copies
from gavel.llm.vector_codes import Search, code_report, encode
from gavel.llm.vectors import in_chunks, integers, rooted, squared_to

# --- exact copies -----------------------------------------------------------------------------

TEXTS = "doc_id long, text string"


def plain_copies(rows, keep=max):
    groups = collections.defaultdict(list)
    for doc_id, text in rows:
        groups[text or ""].append(doc_id)
    out = []
    for text, ids in groups.items():
        keep_id = keep((i for i in ids if i is not None), default=None)
        mark = hashlib.sha256(text.encode()).hexdigest()
        left = 1
        for i in ids:
            stays = left == 1 and i == keep_id
            left -= stays
            out.append((i, keep_id, len(ids), stays, mark))
    return sorted(out, key=repr)


def copies(frame, **how):
    return sorted((tuple(r) for r in exact_copies(frame, **how).collect()), key=repr)


def odd_texts():
    rng = random.Random(5)
    rows = [(i, rng.choice(["", "a", "a ", "A", "a\n", "é", "é", "a\u0000", "x" * 50_000])) for i in range(300)]
    rows += [(1000 + i, "held by many") for i in range(400)]
    rows += [(7, "same row")] * 5 + [(None, "no id")] * 3 + [(None, None), (None, "a"), (3, None), (3, "a"), (2**62, "held by many")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_copies_of_odd_rows(spark, keep):
    rows = odd_texts()
    frame = spark.createDataFrame(rows, TEXTS).repartition(7)
    assert copies(frame, keep=keep) == plain_copies(rows, max if keep == "largest" else min)


@pytest.mark.parametrize("part", [1, 20, 10**9])
def test_texts_that_share_a_hash_are_told_apart(spark, monkeypatch, part):
    monkeypatch.setattr(group_join, "LARGE_PART", part)  # no, some and all groups are large
    rows = odd_texts()
    frame = spark.createDataFrame(rows, TEXTS).repartition(5)

    def weak(text):  # a hash of one character, then of none
        return F.substring(F.md5(text), 1, 1)

    assert copies(frame, hash_of=weak) == plain_copies(rows)
    assert copies(frame, hash_of=lambda t: F.lit("same")) == plain_copies(rows)


def test_counted_copies_come_back_as_rows(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "BLOCK", 4)
    rows = [(1, "t")] * 13 + [(2, "t")] * 4 + [(3, "u")] * 8
    assert copies(spark.createDataFrame(rows, TEXTS)) == plain_copies(rows)


def test_copies_of_the_given_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert copies(docs) == plain_copies(rows)


def test_rows_that_stay_keep_their_columns(spark):
    rows = [(1, "a", "x", 1), (2, "a", "y", 2), (2, "a", "y", 3), (2, "b", None, 4), (None, "c", "z", 5), (None, "c", "z", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, hash string, n_rows long")
    kept = without_copies(docs)
    assert kept.columns == docs.columns
    got = sorted((r["doc_id"] or 0, r["text"], r["n_rows"]) for r in kept.collect())
    assert [(i, t) for i, t, _ in got] == [(0, "c"), (2, "a"), (2, "b")] and got[1][2] in (2, 3)
    assert without_copies(docs, keep="smallest").where("text = 'a'").first()["doc_id"] == 1


def test_no_documents(spark):
    empty = spark.createDataFrame([], TEXTS)
    assert exact_copies(empty).columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert not exact_copies(empty).count() and not without_copies(empty).count()


def test_a_large_group_does_not_move(spark):
    """Rows of a group that holds most rows meet a broadcast table, not a shuffle by hash."""
    rows = spark.range(3000).select("id", F.when(F.col("id") < 2900, F.lit(-1)).otherwise(F.col("id")).alias("key"))
    groups = rows.groupBy("key").agg(F.count("*").alias("n")).withColumn("tag", F.col("key") + 1)
    joined = group_join.with_group(rows, groups, ["key"], "n")
    assert joined.count() == 3000 and joined.where("tag <> key + 1").count() == 0
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") == 2 and plan.count("SortMergeJoin") == 1


# --- vectors ------------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int"


def floors(vector, scale):
    return [math.floor(scale * x) for x in vector]


def nearest(vector, centres):
    distances = [sum((a - b) ** 2 for a, b in zip(vector, c)) for c in centres]
    return distances.index(min(distances)), min(distances)


def moved(centres, vectors, homes):
    out = []
    for k, centre in enumerate(centres):
        mine = [v for v, h in zip(vectors, homes) if h == k]
        out.append([sum(x) // len(mine) for x in zip(*mine)] if mine else centre)
    return out


def plain_clusters(rows, n=40, rounds=5, dims=64):
    kept = [
        (i, floors(e, 256)) for i, e, _ in rows if e is not None and len(e) == dims and all(x is not None and math.isfinite(x) for x in e)
    ]
    start = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "~", r[1]))
    centres, vectors = [v for _, v in start[:n]], [v for _, v in kept]
    for _ in range(rounds):
        centres = moved(centres, vectors, [nearest(v, centres)[0] for v in vectors])
    last = [nearest(v, centres) for v in vectors]
    sums = collections.Counter()
    for k, d in last:
        sums[k] += d
    marks = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, k, d, sums[k], sum(sums.values()), marks[k]) for (i, _), (k, d) in zip(kept, last)), key=repr)


def plain_codes(rows, entries=16, rounds=6, parts=8):
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // parts if kept else 0
    cut = [[floors(e, 4096)[p * width : (p + 1) * width] for p in range(parts)] for _, e, _ in kept]
    books = [[v[p] for v in cut[:entries]] for p in range(parts)]
    for _ in range(rounds):
        books = [
            moved(book, [v[p] for v in cut], [nearest(v[p], book)[0] for v in cut]) for p, book in enumerate(books)
        ]
    found = [[nearest(v[p], books[p]) for p in range(parts)] for v in cut]
    errors = [sum(d for _, d in f) for f in found]
    by_label = collections.Counter()
    for (_, _, label), error in zip(kept, errors):
        by_label[label] += error
    mark = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(
        ((i, "".join(f"{k:02x}" for k, _ in f), e, by_label[label], mark) for (i, _, label), f, e in zip(kept, found, errors)),
        key=repr,
    )


def vector_rows(n, dims=64, seed=1):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 0.2) for _ in range(dims)] for _ in range(12)]
    rows = []
    for i in range(n):
        c = rng.choice(centres)
        v = [float(np.float32(x + rng.gauss(0, 0.05))) for x in c]
        rows.append((i, v, rng.choice([None, 0, 0, 0, 1, 2])))
    same = rows[3][1]
    rows += [(n + i, same, 7) for i in range(40)] + [(5, same, None), (5, same, None), (None, rows[0][1], 1)]
    rows += [(9001 + i, [0.25 * (i % 2)] * dims, 3) for i in range(20)]  # ties between equal centres
    return rows


BROKEN = [(8000, None, 1), (8001, [None] + [0.0] * 63, 1), (8002, [float("nan")] + [0.0] * 63, None), (8003, [float("inf")] * 64, 2)]


def collected(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def test_clusters_equal_a_full_search(spark):
    rows = vector_rows(300) + BROKEN + [(8004, [], 1), (8005, [0.5] * 63, 1)]
    frame = spark.createDataFrame(rows, VECTORS).repartition(5)
    assert collected(cluster_report(frame)) == plain_clusters(rows)


def test_clusters_of_the_given_vectors(spark, sf):
    frame = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in frame.collect()]
    assert collected(cluster_report(frame)) == plain_clusters(rows)


def test_pivots_spare_distances(spark):
    """Well-parted vectors: far fewer distances are measured than a full search takes."""
    rng = random.Random(4)
    rows = [(i, [float(8 * (i % 40))] * 32 + [rng.random() for _ in range(32)], 0) for i in range(800)]
    done = cluster(spark.createDataFrame(rows, VECTORS))
    assert done.possible == 5 * 800 * 40 and done.measured < done.possible / 3


def test_bounds_never_drop_the_nearest():
    rng = np.random.default_rng(3)
    for size in (3, 300, 90_000_000):
        points = rng.integers(-size, size, (40, 16))
        vectors = np.concatenate([rng.integers(-size, size, (500, 16)), points, points[:5] + 1])
        pivots = points[:8]
        got, distance, _ = nearest_centroids(
            vectors, rooted(squared_to(vectors, pivots)), points, rooted(squared_to(points, pivots))
        )
        full = squared_to(vectors, points)
        assert (got == full.argmin(axis=1)).all() and (distance == full.min(axis=1)).all()


def test_few_vectors_none_and_extra_columns(spark):
    rows = vector_rows(9)[:9]
    frame = spark.createDataFrame(rows, VECTORS).withColumns({"cluster": F.lit("c"), "code": F.lit(1), "v": F.lit(2)})
    assert collected(cluster_report(frame)) == plain_clusters(rows)
    assert collected(code_report(frame)) == plain_codes(rows)
    for none in (frame.limit(0), spark.createDataFrame(BROKEN, VECTORS)):
        assert not cluster_report(none).count() and not code_report(none).count()
    assert cluster_report(frame.limit(0)).columns == cluster_report(frame).columns
    assert code_report(frame.limit(0)).columns == code_report(frame).columns


def test_huge_components_are_held(spark):
    rows = [(i, [3e38 if i % 2 else -3e38] * 64, 0) for i in range(6)]
    frame = spark.createDataFrame(rows, VECTORS)
    assert {r["distance"] for r in cluster_report(frame).collect()} == {0}
    assert {r["error"] for r in code_report(frame).collect()} == {0}
    limit = frame.select(F.array_max(integers(F.col("embedding"), 256, 64)).alias("x")).agg(F.max("x")).first()[0]
    assert limit == 2**27 and (2 * limit) ** 2 * 64 <= 2**63 - 1


def test_codes_equal_a_full_search(spark):
    rows = vector_rows(250) + BROKEN
    frame = spark.createDataFrame(rows, VECTORS).repartition(6)
    assert collected(code_report(frame)) == plain_codes(rows)


def test_codes_of_other_lengths(spark):
    rows = [(i, [float(x) for x in e[:24]], label) for i, e, label in vector_rows(60)]
    other = [(-5, [], 1), (-4, [0.5] * 9, 1), (9999, [0.5] * 64, 1)]
    assert collected(code_report(spark.createDataFrame(rows + other, VECTORS))) == plain_codes(rows)


def test_codes_of_the_given_vectors(spark, sf):
    frame = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in frame.collect()]
    assert collected(code_report(frame)) == plain_codes(rows)


@pytest.mark.parametrize("n", [1, 4, 5, 16, 200])
def test_trees_find_the_nearest_entry(n):
    rng = np.random.default_rng(n)
    for size in (2, 60, 40_000_000):
        entries = rng.integers(-size, size, (n, 8))
        parts = np.concatenate([rng.integers(-size, size, (800, 8)), entries])
        search = Search(entries)
        entry, distance = search.nearest(parts)
        full = squared_to(parts, entries)
        assert (entry == full.argmin(axis=1)).all() and (distance == full.min(axis=1)).all()
    near = entries[rng.integers(0, n, 2000)] + rng.integers(-9, 9, (2000, 8))
    search = Search(entries)
    search.nearest(near)
    if n >= 16:  # whole subtrees are passed over
        assert search.measured < 0.8 * n * len(near)


def test_chunks_hold_all_rows():
    import pyarrow as pa

    batches = [pa.RecordBatch.from_arrays([pa.array(range(a, a + n))], names=["x"]) for a, n in ((0, 3), (3, 0), (3, 25), (28, 1))]
    got = list(in_chunks(iter(batches), 10))
    assert [x for b in got for x in b.column("x").to_pylist()] == list(range(29)) and len(got) <= 4


def test_codebooks_have_their_shape(spark):
    done = encode(spark.createDataFrame(vector_rows(100), VECTORS))
    assert done.codebooks.shape == (8, 16, 8)
