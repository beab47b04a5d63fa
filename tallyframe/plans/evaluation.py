"""Evaluation of a scorer: samples to predictions, metrics document, gates and deltas."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe import defaults
from tallyframe.operators import gates, metrics, sampling, scoring
from tallyframe.session import materialize
from tallyframe.sources import sinks


@dataclass(frozen=True)
class Evaluation:
    predictions: DataFrame
    metrics: DataFrame
    gate_checks: DataFrame | None
    delta: DataFrame | None
    verdict: DataFrame | None


def choose_samples(
    samples: DataFrame, limit_per_class: int | None = None, limit: int | None = None,
    classes: Sequence[str] = defaults.CLASS_LABELS,
) -> DataFrame:
    """A stratified choice, else the first ``limit`` samples (``index`` is dense), else all."""
    if limit_per_class is not None:
        return sampling.stratified_limit(samples, "true_label", ["index"], limit_per_class, classes, strict=True)
    return samples if limit is None else samples.where(F.col("index") < limit)


def evaluate(
    samples: DataFrame,
    scorer: Callable[[pd.Series, pd.Series], pd.Series],
    gate: str = "none",
    classes: Sequence[str] = defaults.CLASS_LABELS,
    positive: Sequence[str] = defaults.POSITIVE_LABELS,
    baseline: Mapping | None = defaults.FULL_PRECISION_BASELINE,
    output: str | None = None,
    answers: DataFrame | None = None,
    metadata: Mapping[str, str] | None = None,
) -> Evaluation:
    """Score every sample once and derive everything else from the written predictions.

    Without ``baseline`` nothing is compared. ``answers`` (a column ``text``) adds the check that each of them is one
    answer line with a known class. The verdict is over the gate, the comparison and the answers, as far as there are
    any; None without all three. The stored document holds them too, and ``metadata``.
    """
    scored = scoring.score_conversations(samples, scorer, classes, positive)
    predictions = materialize(scored, "predictions")
    document = materialize(metrics.compute_metrics(predictions, classes, positive), "metrics")
    if document.isEmpty():
        raise ValueError("There are no predictions to evaluate.")
    checks = gates.gate_checks(document, gate, classes=classes)
    result = gates.gate_result(checks) if checks is not None else None
    delta = gates.baseline_delta(document, baseline) if baseline is not None else None
    structured = None if answers is None else gates.all_structured(answers, classes)
    parts = [part for part in (result, delta, structured) if part is not None]
    verdict = gates.combined_verdict(*parts) if parts else None
    if output is not None:
        stored = with_results(document, result, delta, structured)
        for name, value in (metadata or {}).items():
            stored = stored.withColumn(name, F.lit(value))
        sinks.write_evaluation(stored, predictions, output)
    return Evaluation(predictions, document, checks, delta, verdict)


def with_results(
    document: DataFrame, gate: DataFrame | None = None, delta: DataFrame | None = None, structured: DataFrame | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """The document with what was decided on it: ``gate`` (name, passed), ``delta`` and ``structured_output``."""

    def joined(left: DataFrame, right: DataFrame, name: str, value) -> DataFrame:
        # One row per document on both sides.
        side = right.select(*[F.col(key).alias(f"__{i}") for i, key in enumerate(by)], value.alias(name))
        if not by:
            return left.withColumn(name, side.scalar())
        same = reduce(Column.__and__, [left[key].eqNullSafe(side[f"__{i}"]) for i, key in enumerate(by)])
        return left.join(side, same, "left").drop(*[f"__{i}" for i in range(len(by))])

    if gate is not None:
        document = joined(document, gate, "gate", F.struct(F.col("gate").alias("name"), "passed"))
    if delta is not None:
        document = joined(document, delta, "delta", F.struct(*[c for c in delta.columns if c not in by]))
    if structured is not None:
        document = joined(document, structured, "structured_output", F.col("passed"))
    return document


def class_centroids(df: DataFrame, label_col: str, vector_col: str) -> DataFrame:
    """Mean vector per class as ``(label, centroid)``; sums are combined before the shuffle."""
    cells = df.select(label_col, F.posexplode(vector_col).alias("pos", "x"))
    means = cells.groupBy(label_col, "pos").agg(F.avg("x").alias("m"))
    # One entry per dimension.
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda e: e["m"])
    return means.groupBy(label_col).agg(ordered.alias("centroid"))


def centroid_scorer(centroids: np.ndarray, scale: float) -> Callable[[pd.Series], pd.Series]:
    """A scorer that gives the scaled inner product with every centroid."""

    def score(vectors: pd.Series) -> pd.Series:
        stacked = np.stack(vectors.to_numpy()).astype(np.float64)
        return pd.Series(list(stacked @ centroids.T * scale))

    return score


def document_rows(document: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """A metrics document as long rows ``(metric, label, other, value)``."""
    none = F.lit(None).cast("string")

    def row(metric: str, label, other, value):
        return F.struct(
            F.lit(metric).alias("metric"), label.alias("label"), other.alias("other"), value.cast("double").alias("value")
        )

    scalars = F.array(
        *[row(m, none, none, F.col(m)) for m in ("total_samples", "accuracy", "macro_f1", "binary_roc_auc")]
    )
    labels = F.col("labels")
    def class_rows(field: str):
        return F.transform(labels, lambda x: row(field, x, none, F.element_at(F.col("per_class"), x)[field]))

    def distribution_rows(name: str):
        return F.transform(F.map_entries(name), lambda e: row(name, e["key"], none, e["value"]))

    per_class = [class_rows(field) for field in ("precision", "recall", "f1", "support")]
    cells = F.flatten(
        F.transform(
            labels,
            lambda t, i: F.transform(
                labels, lambda p, j: row("confusion", t, p, F.get(F.get(F.col("confusion_matrix.matrix"), i), j))
            ),
        )
    )
    spread = [distribution_rows(name) for name in ("class_distribution", "prediction_distribution")]
    order = F.transform(labels, lambda x, i: row("label_order", x, none, i))
    return document.select(*by, F.inline(F.concat(scalars, *per_class, cells, *spread, order)))
