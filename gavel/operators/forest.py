"""Isolation forest on Spark (Liu, Ting and Zhou, 2008).

Trees are grown independently, one small group per tree, from samples of at most 256
rows; every choice is drawn from a digest of names (row, tree, node), so a forest can be
recomputed anywhere. The features of an access event take 193,536 different values in all:
scoring a table is a join with the raw scores of its distinct codes instead of a walk
through 200 trees per row, and a saved forest has the scores of all codes.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gavel import constants as K
from gavel.functions.features import CODES, vector_of_code
from gavel.functions.scores import min_max
from gavel.session import cut_lineage

NODE = T.StructType(
    [
        T.StructField("tree", T.IntegerType()),
        T.StructField("node", T.IntegerType()),
        T.StructField("feature", T.IntegerType()),  # -1: leaf
        T.StructField("cut", T.DoubleType()),
        T.StructField("left", T.IntegerType()),
        T.StructField("right", T.IntegerType()),
        T.StructField("length", T.DoubleType()),  # path length credited at a leaf
        T.StructField("sample", T.IntegerType()),
    ]
)


def average_path(n: int) -> float:
    """Mean path length of an unsuccessful search among ``n`` points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n


def draw(*parts) -> int:
    """A number below 2^32 that ``parts`` decide; ``draw_of`` gives the same in a query."""
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:8], 16)


def draw_of(*parts) -> Column:
    texts = [p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *texts)), 1, 8), 16, 10).cast("bigint")


def _grow(points: np.ndarray, seed: int, tree: int) -> list[list[float]]:
    """One tree as rows of (node, feature, cut, left, right, length). The children of node
    n are 2n + 1 and 2n + 2; feature and cut are drawn from the node's own name."""
    limit = (max(len(points), 2) - 1).bit_length()
    rows: list[list[float]] = []
    pending = [(points, 0, 0)]
    while pending:
        part, depth, node = pending.pop()
        low, high = part.min(axis=0), part.max(axis=0)
        varied = np.flatnonzero(high > low)
        if depth >= limit or len(part) <= 1 or len(varied) == 0:
            rows.append([node, -1, 0.0, -1, -1, depth + average_path(len(part))])
            continue
        feature = int(varied[draw(seed, tree, node, "feature") % len(varied)])
        cut = float(low[feature] + (high[feature] - low[feature]) * (draw(seed, tree, node, "cut") / 2.0**32))
        goes_left = part[:, feature] <= cut
        left, right = 2 * node + 1, 2 * node + 2
        rows.append([node, feature, cut, left, right, 0.0])
        pending += [(part[goes_left], depth + 1, left), (part[~goes_left], depth + 1, right)]
    return rows


class _Stack:
    """All trees side by side as (tree, node) arrays, walked together."""

    def __init__(self, nodes: pd.DataFrame):
        nodes = nodes.sort_values(["tree", "node"])
        tree = nodes["tree"].rank(method="dense").astype(int).to_numpy() - 1
        self.trees, width = int(tree.max()) + 1, int(nodes["node"].max()) + 1
        at = tree * width + nodes["node"].to_numpy()

        def spread(name: str, kind) -> np.ndarray:
            out = np.zeros(self.trees * width, dtype=kind)
            out[at] = nodes[name].to_numpy()
            return out

        self.feature, self.cut, self.length = spread("feature", np.int64), spread("cut", float), spread("length", float)
        base = tree * width
        self.left, self.right = (np.zeros(self.trees * width, dtype=np.int64) for _ in range(2))
        self.left[at] = base + nodes["left"].to_numpy()
        self.right[at] = base + nodes["right"].to_numpy()
        self.roots = np.arange(self.trees, dtype=np.int64) * width
        self.scale = average_path(int(nodes["sample"].max())) or 1.0

    def scores(self, points: np.ndarray) -> np.ndarray:
        """2^(-mean path / c(sample)) of every point."""
        row = np.repeat(np.arange(len(points)), self.trees)
        at = np.tile(self.roots, len(points))
        moving = np.flatnonzero(self.feature[at] >= 0)
        while len(moving):
            here = at[moving]
            go = points[row[moving], self.feature[here]] <= self.cut[here]
            at[moving] = np.where(go, self.left[here], self.right[here])
            moving = moving[self.feature[at[moving]] >= 0]
        mean = self.length[at].reshape(len(points), self.trees).mean(axis=1)
        return np.power(2.0, -mean / self.scale)


def tree_samples(
    df: DataFrame, code: str, row_id: str, *, trees: int, sample: int, seed: int
) -> DataFrame:
    """``tree, code, row_id`` with about ``sample`` rows for every tree.

    Draws from the row id decide which trees a row joins, so the choice repeats
    on retry. Above trees x sample rows only a fraction of the table leaves the
    scan; below it a row serves several trees, never twice the same one.
    """
    n = df.count()
    wanted = math.ceil(1.3 * sample)  # head room: group sizes vary
    share = min(1.0, trees * wanted / max(n, 1))
    copies = min(trees, max(1, math.ceil(trees * wanted / max(n, 1))))
    row = F.col(row_id)
    picked = df.filter(draw_of(seed, row) % 1_000_000 < math.ceil(share * 1_000_000)) if share < 1 else df
    # every row steps through the trees at its own stride, so that no two trees share more
    # rows than chance has them share; strides without a common divisor never come back early
    strides = [s for s in range(1, trees + 1) if math.gcd(s, trees) == 1]
    turn = draw_of(seed + 2, row) % len(strides)
    stride = F.element_at(F.array(*map(F.lit, strides)), turn.cast("int") + 1)
    return picked.select(
        F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy"), (draw_of(seed + 1, row) % trees).alias("first"),
        stride.alias("stride"), F.col(code).alias("code"), row.alias("row_id"),
    ).select(
        F.pmod(F.col("first") + F.col("copy") * F.col("stride"), F.lit(trees)).cast("int").alias("tree"), "code", "row_id"
    )


@dataclass(frozen=True)
class ForestModel:
    """Fitted trees, the raw score range of the fit split and the score lookup."""

    nodes: DataFrame
    low: float
    high: float
    lookup: DataFrame | None = None  # code, raw: one row per feature code

    def scores(self, df: DataFrame, code: str = "code", name: str = "isolation_forest_score") -> DataFrame:
        """Adds the normalised score. A loaded model joins its table of all codes; a model
        just fitted walks its trees for the codes that ``df`` holds, each once. Either way
        there are at most ``CODES`` of them."""
        lookup = self.lookup
        if lookup is None:
            lookup = walked(df.select(F.col(code).alias("code")).distinct(), self.nodes)
        table = F.broadcast(
            lookup.select(
                F.col("code").alias(code), min_max(F.col("raw"), self.low, self.high).alias(name)
            )
        )
        return df.join(table, code)

    def save(self, path: str) -> None:
        spark = self.nodes.sparkSession
        self.nodes.coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
        lookup = score_lookup(spark, self.nodes) if self.lookup is None else self.lookup
        lookup.coalesce(1).write.mode("overwrite").parquet(f"{path}/lookup")
        spark.createDataFrame([(self.low, self.high)], "low double, high double").coalesce(1).write.mode(
            "overwrite"
        ).parquet(f"{path}/range")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> ForestModel:
        low, high = spark.read.parquet(f"{path}/range").first()
        return cls(
            spark.read.parquet(f"{path}/nodes"), low, high, spark.read.parquet(f"{path}/lookup")
        )


def fit_trees(
    df: DataFrame, *, code: str = "code", row_id: str = "event_id",
    trees: int = K.FOREST_TREES, sample: int = K.FOREST_SAMPLE, seed: int = K.FOREST_SEED,
) -> DataFrame:
    """Tree nodes: at most trees x 511 rows."""
    chosen = tree_samples(df, code, row_id, trees=trees, sample=sample, seed=seed)

    def grow(group: pd.DataFrame) -> pd.DataFrame:
        tree = int(group["tree"].iloc[0])
        if len(group) > sample:
            group = group.assign(rank=[draw(seed + 3, tree, row) for row in group["row_id"]])
            group = group.sort_values(["rank", "row_id"]).iloc[:sample]
        points = np.stack(group["vector"].to_numpy()).astype(np.float64)
        out = pd.DataFrame(_grow(points, seed, tree), columns=["node", "feature", "cut", "left", "right", "length"])
        out.insert(0, "tree", tree)
        out["sample"] = len(points)
        kinds = {f.name: "float64" if f.dataType == T.DoubleType() else "int32" for f in NODE.fields}
        return out.astype(kinds)

    with_vectors = chosen.withColumn("vector", vector_of_code(F.col("code"))).drop("code")
    return with_vectors.groupBy("tree").applyInPandas(grow, NODE)


def raw_scores(vectors: DataFrame, nodes: DataFrame, vector: str = "vector", name: str = "raw") -> DataFrame:
    """Adds 2^(-mean path / c(sample)) by walking the trees over Arrow batches."""
    spark = vectors.sparkSession
    forest = spark.sparkContext.broadcast(nodes.toPandas())  # at most trees x 511 rows

    @F.pandas_udf(T.DoubleType())
    def walk(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        stack = _Stack(forest.value)
        for batch in batches:
            points = np.stack(batch.to_numpy()).astype(np.float64)
            parts = np.array_split(points, max(1, len(points) // 2000))
            yield pd.Series(np.concatenate([stack.scores(p) for p in parts]))

    return vectors.withColumn(name, walk(F.col(vector)))


def walked(codes: DataFrame, nodes: DataFrame) -> DataFrame:
    """``code, raw`` of the given codes, ``CODES`` at most: little data, but much to walk, so
    they are dealt to all cores."""
    codes = codes.repartition(min(codes.sparkSession.sparkContext.defaultParallelism, 256), "code")
    scored = raw_scores(codes.withColumn("vector", vector_of_code(F.col("code"))), nodes)
    return scored.select("code", "raw")


def score_lookup(spark: SparkSession, nodes: DataFrame) -> DataFrame:
    """``code, raw`` for every feature code there can be."""
    return walked(spark.range(CODES).select(F.col("id").cast("int").alias("code")), nodes)


def fit_forest(df: DataFrame, **options) -> ForestModel:
    """Fit on the rows of ``df`` (``code``, ``event_id``).

    Trees are bounded (trees x 511 nodes) and written to the checkpoint folder, so later
    plans never regrow one. Save the model to keep it longer than that folder; a saved
    model also has the raw scores of all ``CODES`` codes.
    """
    code = options.get("code", "code")
    nodes = cut_lineage(fit_trees(df, **options))
    seen = df.select(F.col(code).alias("code")).distinct()
    low, high = walked(seen, nodes).agg(F.min("raw"), F.max("raw")).first()
    return ForestModel(nodes, low, high)
