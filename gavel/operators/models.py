"""Sequence model, text model and the combined anomaly scorer, on Spark ML."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import HashingTF, IDF, SQLTransformer
from pyspark.ml.functions import array_to_vector, predict_batch_udf, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gavel import constants as K
from gavel.functions.features import feature_code
from gavel.functions.scores import clip01, fuse, round4
from gavel.functions.text import NOT_WORD
from gavel.operators.forest import ForestModel
from gavel.operators.sequences import sequence_tensor, user_windows
from gavel.session import stage


# Rows that one task of the sequence model's fit holds: flattened, a window takes 1 to 2 KB.
FIT_ROWS = 50_000


def with_code(df: DataFrame, prefix: str = "access.") -> DataFrame:
    """Adds the feature ``code`` of an access event."""
    return df.withColumn(
        "code",
        feature_code(lambda n: F.col("occurred_at") if n == "occurred_at" else F.col(prefix + n)),
    )


def on_plane(events: DataFrame, plane: str, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``work`` done on the events of one plane only, beside the others as they are.

    The events are staged first, so that the two sides do not read the source twice.
    """
    rows = stage(events)
    mine = F.col("data_plane").eqNullSafe(F.lit(plane))
    return work(rows.filter(mine)).unionByName(rows.filter(~mine), allowMissingColumns=True)


def flat_sequence(window: Column) -> Column:
    """The 8 x 25 window as one ML vector of 200 floats."""
    return array_to_vector(F.flatten(sequence_tensor(window)))


def fit_sequence_model(
    windows: DataFrame, label: str, positive_weight: float, *, rounds: int = 20, depth: int = 4, seed: int = K.FOREST_SEED
) -> PipelineModel:
    """Supervised, class-weighted model of the flattened window (``window``, ``label``).

    The fit keeps every flattened row, some twenty times its stored size, so rows are dealt
    evenly before they are flattened, ``FIT_ROWS`` at most to a task.
    """
    tasks = max(windows.sparkSession.sparkContext.defaultParallelism, math.ceil(windows.count() / FIT_ROWS))
    rows = windows.select("window", label).repartition(tasks).select(
        flat_sequence(F.col("window")).alias("sequence"),
        F.col(label).cast("double").alias("label"),
        F.when(F.col(label).cast("int") == 1, F.lit(float(positive_weight))).otherwise(F.lit(1.0)).alias("weight"),
    )
    trees = GBTClassifier(
        featuresCol="sequence", labelCol="label", weightCol="weight",
        maxIter=rounds, maxDepth=depth, seed=seed,
    )
    return Pipeline(stages=[trees]).fit(rows)


def sequence_scores(windows: DataFrame, model: PipelineModel, name: str = "lstm_score") -> DataFrame:
    """Adds the sequence score in [0, 1]."""
    scored = model.transform(windows.withColumn("sequence", flat_sequence(F.col("window"))))
    return scored.withColumn(name, clip01(vector_to_array("probability")[1])).drop(
        "sequence", "rawPrediction", "probability", "prediction"
    )


def external_sequence_scores(
    windows: DataFrame, make_predict: Callable, name: str = "lstm_score", batch_size: int = 1024
) -> DataFrame:
    """The same column from a user's own network, loaded once per worker:
    ``make_predict() -> f(batch of (8, 25) float32) -> scores``."""
    predict = predict_batch_udf(
        make_predict, return_type=T.DoubleType(), batch_size=batch_size, input_tensor_shapes=[[K.WINDOW, K.N_FEATURES]]
    )
    flat = F.flatten(sequence_tensor(F.col("window")))
    return windows.withColumn(name, clip01(predict(flat)))


@dataclass(frozen=True)
class AnomalyModel:
    """Forest, sequence model and their fusion, as one scorer."""

    forest: ForestModel
    sequence: PipelineModel
    weight: float = K.FUSION_WEIGHT
    threshold: float = K.FUSION_THRESHOLD

    def raw_scores(self, windows: DataFrame) -> DataFrame:
        """Unrounded scores of rows that carry ``code`` and ``window``."""
        scored = sequence_scores(self.forest.scores(windows), self.sequence)
        fused = fuse(F.col("isolation_forest_score"), F.col("lstm_score"), self.weight)
        return scored.withColumn("fused_anomaly_score", fused)

    def scores(self, windows: DataFrame) -> DataFrame:
        """Scores as decisions carry them, rounded to 4 places."""
        names = ("isolation_forest_score", "lstm_score", "fused_anomaly_score")
        return self.raw_scores(windows).withColumns({n: round4(F.col(n)) for n in names})

    def scorer(self) -> Callable[[DataFrame], DataFrame]:
        """Anomaly scorer port over canonical events of both planes (batch)."""

        def score(access: DataFrame) -> DataFrame:
            rows = with_code(access).withColumn("_user", F.col("access.user_id"))
            return self.scores(user_windows(rows, user="_user")).drop("_user", "code", "window")

        return lambda events: on_plane(events, "access", score)

    def save(self, path: str) -> None:
        self.forest.save(f"{path}/forest")
        self.sequence.write().overwrite().save(f"{path}/sequence")
        spark = self.forest.nodes.sparkSession
        fusion = spark.createDataFrame([(self.weight, self.threshold)], "weight double, threshold double")
        fusion.coalesce(1).write.mode("overwrite").json(f"{path}/fusion")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> AnomalyModel:
        fusion = spark.read.schema("weight double, threshold double").json(f"{path}/fusion").first()
        return cls(
            ForestModel.load(spark, f"{path}/forest"), PipelineModel.load(f"{path}/sequence"),
            fusion["weight"], fusion["threshold"],
        )


# --- text ---------------------------------------------------------------------------


def label_id(label: Column, labels: Sequence[str] = K.CLASSES) -> Column:
    """Position of a label in the vocabulary, by name; null for an unknown one."""
    chain = F.when(label == labels[0], F.lit(0.0))
    for i, name in enumerate(labels[1:], 1):
        chain = chain.when(label == name, F.lit(float(i)))
    return chain


def training_rows(docs: DataFrame, order: str, labels: Sequence[str] = K.CLASSES, limit: int | None = None) -> DataFrame:
    """``text, label_id``; ``limit`` asks for the first rows only (smoke tests)."""
    rows = docs.orderBy(order).limit(limit) if limit else docs
    return rows.select("text", label_id(F.col("label"), labels).alias("label_id"))


def fit_text_model(rows: DataFrame, *, features: int = 1 << 14, rounds: int = 20) -> PipelineModel:
    """Bag-of-words classifier over the first 256 tokens (``text``, ``label_id``).

    A text is cut while it is split: two parts more than needed are made (one may be empty,
    the last one is the rest), however long the text is.
    """
    n = K.MAX_TOKENS
    parts = f"slice(split(lower(text), r'{NOT_WORD}+', {n + 2}), 1, {n + 1})"
    stages = [
        SQLTransformer(statement=f"SELECT *, slice(filter({parts}, t -> t <> ''), 1, {n}) AS tokens FROM __THIS__"),
        HashingTF(inputCol="tokens", outputCol="counts", numFeatures=features),
        IDF(inputCol="counts", outputCol="weights"),
        LogisticRegression(
            featuresCol="weights", labelCol="label_id", family="multinomial", maxIter=rounds, regParam=0.01
        ),
    ]
    return Pipeline(stages=stages).fit(rows)


def classify_text(
    docs: DataFrame, model: PipelineModel, labels: Sequence[str] = K.CLASSES, text: str = "text"
) -> DataFrame:
    """Adds ``content_class`` (argmax, mapped by name) and its rounded probability."""
    source = docs if text == "text" else docs.withColumn("text", F.col(text))
    scored = model.transform(source)
    names = F.array(*[F.lit(n) for n in labels])
    out = scored.withColumns(
        {
            "content_class": F.element_at(names, F.col("prediction").cast("int") + 1),
            "content_confidence": round4(F.array_max(vector_to_array("probability"))),
        }
    )
    scratch = ["tokens", "counts", "weights", "rawPrediction", "probability", "prediction"]
    return out.drop(*scratch, *([] if text == "text" else ["text"]))


def text_classifier(model: PipelineModel, labels: Sequence[str] = K.CLASSES):
    """Content classifier port over canonical events of both planes."""

    def classify(content: DataFrame) -> DataFrame:
        texts = content.withColumn("_text", F.coalesce("content.text", F.lit("")))
        return classify_text(texts, model, labels, text="_text").drop("_text")

    return lambda events: on_plane(events, "content", classify)


def external_text_classifier(make_predict: Callable, labels: Sequence[str] = K.CLASSES, batch_size: int = 64):
    """Port for a user's own encoder: ``make_predict() -> f(texts) -> probabilities``
    of shape (batch, classes)."""
    predict = predict_batch_udf(make_predict, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size)
    names = F.array(*[F.lit(n) for n in labels])

    def classify(content: DataFrame) -> DataFrame:
        found = content.withColumn("_p", predict(F.coalesce("content.text", F.lit(""))))
        best = F.array_max("_p")
        return found.withColumns(
            {
                "content_class": F.element_at(names, F.array_position("_p", best).cast("int")),
                "content_confidence": round4(best.cast("double")),
            }
        ).drop("_p")

    return lambda events: on_plane(events, "content", classify)
