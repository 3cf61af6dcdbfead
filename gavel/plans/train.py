"""The training plan: labelled access log in, scorer and report out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gavel import constants as K
from gavel.functions.scores import fuse
from gavel.operators.evaluate import (
    best_cell, class_weights, evaluation_report, sweep, threshold_sweep,
)
from gavel.operators.forest import fit_forest
from gavel.operators.models import AnomalyModel, fit_sequence_model, sequence_scores, with_code
from gavel.operators.ranks import split_by_position
from gavel.operators.sequences import user_windows
from gavel.session import cut_lineage


@dataclass(frozen=True)
class Trained:
    model: AnomalyModel
    thresholds: dict[str, float]
    report: DataFrame | None = None


def labelled(df: DataFrame, order: str) -> DataFrame:
    """Label and feature code of a labelled access log; a missing label is a normal event."""
    coded = with_code(df, prefix="")
    label = F.coalesce(F.col("is_anomaly").cast("boolean"), F.lit(False))
    return coded.select("event_id", "user_id", "occurred_at", F.col(order), "code", label.alias("y"))


def train_anomaly(
    train: DataFrame, order: str, *, test: DataFrame | None = None,
    validation_share: float = K.VALIDATION_SHARE, trees: int = K.FOREST_TREES, rounds: int = 20,
) -> Trained:
    """Fit on the head of ``train`` in ``order``, choose fusion weight and thresholds on
    its tail, report on ``test``.

    Windows restart per split. Scored splits feed several aggregates, so they
    are checkpointed rather than recomputed.
    """
    rows = split_by_position(labelled(train, order), order, validation_share)
    windows = user_windows(rows, within=("split",))
    fit = cut_lineage(windows.filter(F.col("split") == "fit"))
    validation = windows.filter(F.col("split") == "validation")

    forest = fit_forest(fit.select("event_id", "code"), trees=trees)
    weights = class_weights(fit, "y").first()
    sequence = fit_sequence_model(fit, "y", weights["positive_weight"], rounds=rounds)

    iso, seq, y = F.col("isolation_forest_score"), F.col("lstm_score"), F.col("y")
    scored = cut_lineage(
        sequence_scores(forest.scores(validation), sequence).select("isolation_forest_score", "lstm_score", "y")
    )
    chosen = best_cell(sweep(scored, iso, seq, y)).first()
    own = best_cell(
        threshold_sweep(scored, {"isolation_forest": iso, "lstm": seq}, y), by=["scorer"]
    ).collect()
    thresholds = {r["scorer"]: r["threshold"] for r in own} | {"fused": chosen["threshold"]}
    model = AnomalyModel(forest, sequence, chosen["weight"], chosen["threshold"])

    report = None
    if test is not None:
        held_out = cut_lineage(model.raw_scores(user_windows(labelled(test, order))))
        report = evaluation_report(
            held_out, {"isolation_forest": iso, "lstm": seq, "fused": fuse(iso, seq, model.weight)}, thresholds, y
        )
    return Trained(model, thresholds, report)
