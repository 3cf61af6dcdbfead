"""Model evaluation as aggregates: rates, ROC-AUC, reports and sweeps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gavel import constants as K
from gavel.functions.scores import fuse, ratio, round4
from gavel.operators.ordered import known_key, running_sums


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """``n_neg, n_pos, positive_weight``; the negative weight is 1."""
    is_pos = F.coalesce(F.col(label).cast("int"), F.lit(0)) == 1
    return df.agg(F.count_if(~is_pos).alias("n_neg"), F.count_if(is_pos).alias("n_pos")).withColumn(
        "positive_weight", F.col("n_neg") / F.greatest("n_pos", F.lit(1)).cast("double")
    )


def confusion(df: DataFrame, truth: Column, predicted: Column, by: Sequence[str] = ()) -> DataFrame:
    """``tp, fp, tn, fn`` and the rates made of them, per ``by``."""
    counts = df.groupBy(*by).agg(
        F.count_if(predicted & truth).alias("tp"),
        F.count_if(predicted & ~truth).alias("fp"),
        F.count_if(~predicted & ~truth).alias("tn"),
        F.count_if(~predicted & truth).alias("fn"),
    )
    return with_rates(counts)


def with_rates(counts: DataFrame) -> DataFrame:
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return counts.withColumns(
        {
            "precision": ratio(tp, tp + fp),
            "recall_detection_rate": ratio(tp, tp + fn),
            "f1": ratio(2 * tp, 2 * tp + fp + fn),
            "false_positive_rate": ratio(fp, fp + tn),
        }
    )


def roc_auc(df: DataFrame, score: str, truth: Column, by: Sequence[str] = ()) -> DataFrame:
    """Exact area under the ROC curve per ``by``, for scores of any range.

    Counts the (positive, negative) pairs in the right order, ties half. Rows collapse to
    distinct scores map-side; the negatives below each score are a running sum over
    ranges of scores, so no window ever covers all of them. Rows without a score are
    left out. Null without a positive or a negative.
    """
    by = list(by)
    keys = {name: known_key(F.col(name)) for name in by}
    level = (
        df.filter(F.col(score).isNotNull())
        .groupBy(*[key.alias(name) for name, key in keys.items()], F.col(score).alias("s"))
        .agg(F.count_if(truth).alias("pos"), F.count_if(~truth).alias("neg"))
        # products of counts outgrow a long: twice the pairs, as whole decimals
        .withColumns({n: F.col(n).cast("decimal(19,0)") for n in ("pos", "neg")})
    )
    below = running_sums(level, ["s"], {"below": "neg"}, group=by)
    pairs = F.col("pos") * F.col("neg") + 2 * F.col("pos") * F.col("below").cast("decimal(19,0)")
    area = below.withColumn("pairs", pairs.cast("decimal(38,0)")).groupBy(*by).agg(
        F.sum("pairs").cast("decimal(38,0)").alias("pairs"),
        *[F.sum(c).cast("decimal(19,0)").alias(c) for c in ("pos", "neg")],
    )
    all_pairs = F.nullif(F.col("pos").cast("double") * F.col("neg"), F.lit(0.0))
    return area.select(
        *[F.col(f"{name}.value").alias(name) for name in by],
        (F.col("pairs").cast("double") / 2 / all_pairs).alias("roc_auc"),
    )


def confusion_matrix(df: DataFrame, truth: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """``truth, predicted, n``: as many rows as label pairs occur."""
    return df.groupBy(*by, F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(
        F.count("*").alias("n")
    )


def per_class(matrix: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall and F1 of every label in truth or prediction."""
    hit = F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(F.lit(0))
    sides = matrix.select(
        *by,
        F.inline(
            F.array(
                F.struct(F.col("truth").alias("label"), F.col("n").alias("actual"), F.lit(0).cast("bigint").alias("called"), hit.alias("tp")),
                F.struct(F.col("predicted").alias("label"), F.lit(0).cast("bigint").alias("actual"), F.col("n").alias("called"), F.lit(0).cast("bigint").alias("tp")),
            )
        ),
    )
    sums = sides.groupBy(*by, "label").agg(*[F.sum(c).alias(c) for c in ("tp", "actual", "called")])
    tp, actual, called = (F.col(c).cast("double") for c in ("tp", "actual", "called"))
    zero = F.lit(0.0)
    return sums.select(
        *by, "label",
        F.when(called > 0, F.try_divide(tp, called)).otherwise(zero).alias("precision"),
        F.when(actual > 0, F.try_divide(tp, actual)).otherwise(zero).alias("recall"),
        F.when(actual + called > 0, F.try_divide(2 * tp, actual + called)).otherwise(zero).alias("f1"),
        F.col("actual").alias("support"),
        F.col("tp").alias("tp"),
    )


def multiclass_report(matrix: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy and macro averages over the labels that occur."""
    classes = per_class(matrix, by)
    return classes.groupBy(*by).agg(
        F.sum("support").alias("eval_count"),
        round4(F.sum("tp") / F.sum("support").cast("double")).alias("accuracy"),
        round4(F.avg("precision")).alias("macro_precision"),
        round4(F.avg("recall")).alias("macro_recall"),
        round4(F.avg("f1")).alias("macro_f1"),
    )


def per_class_f1(matrix: DataFrame, labels: Sequence[str] = K.CLASSES, by: Sequence[str] = ()) -> DataFrame:
    """Per ``by`` one row with the F1 of every label of the vocabulary; 0 where it never occurs."""
    classes = per_class(matrix, by)
    return classes.groupBy(*by).agg(
        *[
            F.coalesce(round4(F.max(F.when(F.col("label") == c, F.col("f1")))), F.lit(0.0)).alias(c)
            for c in labels
        ]
    )


def best_model(reports: DataFrame) -> DataFrame:
    """The candidate with the highest macro F1; ties by name."""
    return reports.orderBy(F.desc("macro_f1"), "model").limit(1)


def with_slot(df: DataFrame, thresholds: Sequence[float], score: str = "score") -> DataFrame:
    """Adds ``slot``: how many of the ascending, evenly spaced thresholds the score reaches.

    Arithmetic gives the slot to within one; comparing with the two thresholds
    around it makes ``score >= threshold`` exact for every one of them.
    """
    n, first, step = len(thresholds), thresholds[0], thresholds[1] - thresholds[0]
    table = F.array(*[F.lit(float(t)) for t in thresholds])
    certain = F.greatest(F.lit(0), F.least(F.lit(n), F.floor((F.col(score) - first) / step).cast("int")))

    def reached(ahead: int) -> Column:
        at = F.get(table, F.col("_certain") + (ahead - 1))  # null past the last threshold
        return F.when(F.col(score) >= at, F.lit(1)).otherwise(F.lit(0))

    return df.withColumn("_certain", certain).withColumn("slot", F.col("_certain") + reached(1) + reached(2))


def sweep(
    df: DataFrame, iso: Column, sequence: Column, truth: Column,
    weights: Sequence[float] = K.SWEEP_WEIGHTS, thresholds: Sequence[float] = K.SWEEP_THRESHOLDS,
) -> DataFrame:
    """Confusion rates of every (weight, threshold).

    A row adds one count per weight, not one per cell of the grid: it falls into
    the slot "reaches k thresholds", and suffix sums over the slots give each
    threshold its counts. The shuffle carries weights x slots partial counts.
    """
    fused = F.array(
        *[F.struct(F.lit(float(w)).alias("weight"), fuse(iso, sequence, w).alias("score")) for w in weights]
    )
    counted = (
        with_slot(df.select(truth.alias("y"), F.inline(fused)), thresholds)
        .groupBy("weight", "slot")
        .agg(F.count_if("y").alias("pos"), F.count_if(~F.col("y")).alias("neg"))
    )
    return _grid(counted, ["weight"], thresholds)


def threshold_sweep(
    df: DataFrame, scores: dict[str, Column], truth: Column, thresholds: Sequence[float] = K.SWEEP_THRESHOLDS
) -> DataFrame:
    """Confusion rates of every threshold for each named score."""
    named = F.array(*[F.struct(F.lit(name).alias("scorer"), c.alias("score")) for name, c in scores.items()])
    counted = (
        with_slot(df.select(truth.alias("y"), F.inline(named)), thresholds)
        .groupBy("scorer", "slot")
        .agg(F.count_if("y").alias("pos"), F.count_if(~F.col("y")).alias("neg"))
    )
    return _grid(counted, ["scorer"], thresholds)


def _grid(counted: DataFrame, by: list[str], thresholds: Sequence[float]) -> DataFrame:
    """Slot counts -> rates per threshold; works on a few thousand rows at most."""
    n = len(thresholds)
    wide = counted.groupBy(*by).agg(
        F.map_from_entries(F.collect_list(F.struct("slot", F.struct("pos", "neg")))).alias("cells"),
        F.sum("pos").alias("all_pos"),
        F.sum("neg").alias("all_neg"),
    )
    cells = wide.select(
        *by, "cells", "all_pos", "all_neg",
        F.posexplode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("i", "threshold"),
    )

    def above(part: str) -> Column:
        slots = F.sequence(F.col("i") + 1, F.lit(n))
        count = lambda s: F.coalesce(F.try_element_at("cells", s)[part], F.lit(0).cast("bigint"))
        return F.aggregate(slots, F.lit(0).cast("bigint"), lambda total, s: total + count(s))

    counts = cells.select(*by, "threshold", "all_pos", "all_neg", above("pos").alias("tp"), above("neg").alias("fp"))
    return with_rates(
        counts.select(
            *by, "threshold", "tp", "fp",
            (F.col("all_neg") - F.col("fp")).alias("tn"),
            (F.col("all_pos") - F.col("tp")).alias("fn"),
        )
    )


def exact_f1() -> Column:
    """Unrounded F1, which picks the winner of a sweep."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return F.coalesce(F.try_divide((2 * tp).cast("double"), 2 * tp + fp + fn), F.lit(0.0))


def best_cell(grid: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Highest F1; then the smallest weight; then the smallest threshold."""
    ranks = [F.desc("_f1")] + [F.asc(c) for c in ("weight", "threshold") if c in grid.columns]
    scored = grid.withColumn("_f1", exact_f1())
    if not by:
        return scored.orderBy(*ranks).limit(1).drop("_f1")
    first = F.row_number().over(Window.partitionBy(*by).orderBy(*ranks))  # 91 rows a scorer
    return scored.withColumn("_rank", first).filter(F.col("_rank") == 1).drop("_rank", "_f1")


def evaluation_report(
    df: DataFrame, scores: dict[str, Column], thresholds: dict[str, float], truth: Column
) -> DataFrame:
    """Rates at each scorer's own threshold, with its ROC-AUC."""
    rows = df.select(
        truth.alias("y"),
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(n).alias("scorer"), c.alias("score"), (c >= F.lit(float(thresholds[n]))).alias("hit"))
                    for n, c in scores.items()
                ]
            )
        ),
    )
    rates = confusion(rows, F.col("y"), F.col("hit"), by=["scorer"])
    area = roc_auc(rows, "score", F.col("y"), by=["scorer"])
    return rates.join(area, "scorer").withColumn("roc_auc", round4(F.col("roc_auc")))
