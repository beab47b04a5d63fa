"""Classification metrics from prediction rows.

Prediction rows carry a true label, a predicted label, an ``index`` that orders them and a score of the positive group.
Everything but the ROC-AUC is derived from one aggregate of (true, predicted) pairs, so the rows are shuffled once,
pre-counted. Every function takes ``by`` columns to compute one result per checkpoint, source or run.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe import defaults

_TRUE, _PRED, _SCORE = "true_label", "predicted_label", "binary_score"


def pair_counts(
    df: DataFrame, by: Sequence[str] = (), true_col: str = _TRUE, pred_col: str = _PRED, index_col: str | None = None
) -> DataFrame:
    """Rows per (true, predicted) pair, with the smallest index when one is given."""
    first = F.min(index_col) if index_col else F.lit(None)
    return (
        df.groupBy(*by, F.col(true_col).alias(_TRUE), F.col(pred_col).alias(_PRED))
        .agg(F.count("*").alias("n"), first.cast("bigint").alias("first_index"))
    )


def _label_rows(pairs: DataFrame, by: Sequence[str], classes: Sequence[str]) -> DataFrame:
    """One row per ``by`` group and label with its counts, and the row of the confusion matrix."""
    zero = F.lit(0).cast("bigint")
    far = F.lit((1 << 62)).cast("bigint")

    def entry(label: Column, seen: Column, hit: Column, support: Column, predicted: Column, cell: Column) -> Column:
        return F.struct(
            label.alias("label"), seen.alias("seen"), hit.alias("tp"), support.alias("support"),
            predicted.alias("predicted"), cell.alias("cell"),
        )

    n, same = F.col("n"), F.col(_TRUE) == F.col(_PRED)
    no_cell = F.lit(None).cast("struct<label:string,n:bigint>")
    pair_rows = F.array(
        entry(
            F.col(_TRUE), F.coalesce(F.col("first_index") * 2, far), F.when(same, n).otherwise(zero), n, zero,
            F.struct(F.col(_PRED).alias("label"), n.alias("n")),
        ),
        entry(F.col(_PRED), F.coalesce(F.col("first_index") * 2 + 1, far), zero, zero, n, no_cell),
    )
    # One entry too many, so that the type is known without classes, too.
    base_rows = F.slice(F.array(*[entry(F.lit(c), far, zero, zero, zero, no_cell) for c in [*classes, ""]]), 1, len(classes))
    # The base classes appear even when no row has them: one extra row per class and group.
    if by:
        lead = F.row_number().over(Window.partitionBy(*by).orderBy(_TRUE, _PRED)) == 1
        stacked = pairs.withColumn("__lead", lead).select(
            *by, F.inline(F.concat(pair_rows, F.when(F.col("__lead"), base_rows).otherwise(F.slice(base_rows, 1, 0))))
        )
    else:
        stacked = pairs.select(F.inline(pair_rows)).unionByName(
            pairs.sparkSession.range(1).select(F.inline(base_rows))
        )
    position = F.array_position(F.array(*[F.lit(c) for c in classes]).cast("array<string>"), F.col("label"))
    return (
        stacked
        .groupBy(*by, "label")
        .agg(
            F.min("seen").alias("seen"),
            F.sum("tp").alias("tp"),
            F.sum("support").alias("support"),
            F.sum("predicted").alias("predicted"),
            F.collect_list("cell").alias("cells"),
        )
        .withColumn("is_base", position > 0)
        .withColumn("base_order", F.when(position > 0, position - 1).otherwise(len(classes)))
        .withColumn("precision", F.coalesce(F.try_divide("tp", "predicted"), F.lit(0.0)))
        .withColumn("recall", F.coalesce(F.try_divide("tp", "support"), F.lit(0.0)))
        .withColumn("f1", F.coalesce(F.try_divide(F.col("tp") * 2, F.col("support") + F.col("predicted")), F.lit(0.0)))
    )


def class_metrics(
    df: DataFrame,
    classes: Sequence[str] = defaults.CLASS_LABELS,
    by: Sequence[str] = (),
    true_col: str = _TRUE,
    pred_col: str = _PRED,
    index_col: str | None = None,
) -> DataFrame:
    """Precision, recall, F1, support and number of predictions per label; division by zero gives 0."""
    rows = _label_rows(pair_counts(df, by, true_col, pred_col, index_col), by, classes)
    return rows.select(*by, "label", "precision", "recall", "f1", "support", "predicted", "tp")


def metric_labels(
    df: DataFrame,
    index_col: str,
    classes: Sequence[str] = defaults.CLASS_LABELS,
    by: Sequence[str] = (),
    true_col: str = _TRUE,
    pred_col: str = _PRED,
) -> DataFrame:
    """Base classes in their order, then other labels as first seen, the true label of a row before the predicted."""
    rows = _label_rows(pair_counts(df, by, true_col, pred_col, index_col), by, classes)
    # One row per label.
    order = Window.partitionBy(*by).orderBy("base_order", "seen", "label")
    return rows.select(*by, "label", (F.row_number().over(order) - 1).cast("bigint").alias("label_order"))


def sparse_confusion(
    df: DataFrame, by: Sequence[str] = (), true_col: str = _TRUE, pred_col: str = _PRED
) -> DataFrame:
    """The pairs of labels that occur, and how often: the confusion matrix of label sets of any size."""
    return pair_counts(df, by, true_col, pred_col).drop("first_index")


def confusion(
    df: DataFrame,
    classes: Sequence[str] = defaults.CLASS_LABELS,
    by: Sequence[str] = (),
    true_col: str = _TRUE,
    pred_col: str = _PRED,
) -> DataFrame:
    """Long confusion matrix: one row per pair of labels, zero-filled, so for a short list of labels.

    For open label sets see ``sparse_confusion``.
    """
    pairs = pair_counts(df, by, true_col, pred_col)
    labels = _label_rows(pairs, by, classes).select(*by, F.col("label").alias(_TRUE))
    # A row per true label carries all labels; the counts, which stay sparse, join the pairs.
    listed = labels.groupBy(*by).agg(F.collect_list(_TRUE).alias("__labels"))
    names = [*by, _TRUE, _PRED]
    if by:
        side = listed.withColumnsRenamed({name: f"__{i}" for i, name in enumerate(by)})
        grid = labels.join(side, reduce(Column.__and__, [labels[n].eqNullSafe(side[f"__{i}"]) for i, n in enumerate(by)]))
    else:
        grid = labels.withColumn("__labels", listed.scalar())
    grid = grid.select(*by, _TRUE, F.explode("__labels").alias(_PRED))
    counts = pairs.select(*[F.col(name).alias(f"__c{i}") for i, name in enumerate(names)], "n")
    same = reduce(Column.__and__, [grid[name].eqNullSafe(counts[f"__c{i}"]) for i, name in enumerate(names)])
    return grid.join(counts, same, "left").select(*names, F.coalesce("n", F.lit(0)).alias("n"))


def _cell(cells: Column, label: Column) -> Column:
    return F.aggregate(
        F.filter(cells, lambda c: c["label"] == label), F.lit(0).cast("bigint"), lambda total, c: total + c["n"]
    )


def accuracy(df: DataFrame, by: Sequence[str] = (), true_col: str = _TRUE, pred_col: str = _PRED) -> DataFrame:
    hit = (F.col(true_col) == F.col(pred_col)).cast("int")
    return df.groupBy(*by).agg(F.count("*").alias("total_samples"), F.avg(hit).alias("accuracy"))


def macro_f1(
    df: DataFrame,
    classes: Sequence[str] = defaults.CLASS_LABELS,
    by: Sequence[str] = (),
    true_col: str = _TRUE,
    pred_col: str = _PRED,
) -> DataFrame:
    """Unweighted mean of F1 over all labels; an absent base class counts 0."""
    rows = class_metrics(df, classes, by, true_col, pred_col)
    return rows.groupBy(*by).agg(F.avg("f1").alias("macro_f1"))


def label_distributions(
    df: DataFrame, by: Sequence[str] = (), true_col: str = _TRUE, pred_col: str = _PRED
) -> DataFrame:
    """Rows per true and per predicted label, in one pass."""
    pairs = pair_counts(df, by, true_col, pred_col)
    sides = F.array(
        F.struct(F.lit("true").alias("side"), F.col(_TRUE).alias("label"), "n"),
        F.struct(F.lit("predicted").alias("side"), F.col(_PRED).alias("label"), "n"),
    )
    return (
        pairs.select(*by, F.inline(sides)).groupBy(*by, "side", "label").agg(F.sum("n").alias("n"))
    )


def roc_auc(
    df: DataFrame,
    positive: Column,
    score_col: str = _SCORE,
    by: Sequence[str] = (),
) -> DataFrame:
    """Area under the ROC curve, ties counted half; null when only one class is present.

    Rows are reduced to distinct scores, which are range-partitioned so that each partition holds one stretch of the
    score axis. Each partition counts the pairs inside it; pairs across partitions follow from the totals of the
    partitions. No group of equal scores and no ``by`` group has to fit one task.
    """
    is_positive = F.coalesce(positive, F.lit(False))
    per_score = df.groupBy(*by, F.col(score_col).alias("score")).agg(
        F.count_if(is_positive).alias("pos"), F.count_if(~is_positive).alias("neg")
    )
    stretch = per_score.repartitionByRange(*by, "score").withColumn("stretch", F.spark_partition_id())
    inside = Window.partitionBy(*by, "stretch").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    below = F.coalesce(F.sum("neg").over(inside), F.lit(0))
    pieces = (
        stretch.withColumn("below", below)
        .groupBy(*by, "stretch")
        .agg(
            F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2)).alias("wins"),
            F.sum("pos").alias("pos"),
            F.sum("neg").alias("neg"),
        )
    )
    # One row per stretch: as many as partitions.
    earlier = Window.partitionBy(*by).orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("neg").over(earlier), F.lit(0))
    total = F.sum("pos").cast("double") * F.sum("neg")
    return (
        pieces.withColumn("wins", F.col("wins") + F.col("pos").cast("double") * before)
        .groupBy(*by)
        .agg(F.when(total > 0, F.sum("wins") / total).alias("roc_auc"))
    )


def compute_metrics(
    df: DataFrame,
    classes: Sequence[str] = defaults.CLASS_LABELS,
    positive: Sequence[str] = defaults.POSITIVE_LABELS,
    by: Sequence[str] = (),
    true_col: str = _TRUE,
    pred_col: str = _PRED,
    score_col: str | None = _SCORE,
    index_col: str | None = "index",
    sparse: bool = False,
) -> DataFrame:
    """The metrics document: one row (per ``by`` group) with totals, per-class map, confusion matrix, distributions.

    No prediction rows give no document. With ``sparse`` the field ``matrix`` of the confusion matrix is a map from each
    true label that occurs to the sorted predicted labels and their counts, so that a document grows with the pairs that
    occur and not with the square of the labels.
    """
    rows = _label_rows(pair_counts(df, by, true_col, pred_col, index_col), by, classes)
    fields = F.struct(
        "base_order", "seen", "label", "precision", "recall", "f1", "support", "predicted", "tp", "cells"
    )
    doc = rows.groupBy(*by).agg(
        F.sum("support").alias("total_samples"),
        F.try_divide(F.sum("tp"), F.sum("support")).alias("accuracy"),
        F.avg("f1").alias("macro_f1"),
        F.array_sort(F.collect_list(fields)).alias("rows"),
    ).where("total_samples > 0")
    labels = F.transform("rows", lambda r: r["label"])
    per_class = F.map_from_arrays(
        labels,
        F.transform(
            "rows",
            lambda r: F.struct(
                r["precision"].alias("precision"), r["recall"].alias("recall"), r["f1"].alias("f1"),
                r["support"].alias("support"),
            ),
        ),
    )
    if sparse:
        true_rows = F.filter("rows", lambda r: F.size(r["cells"]) > 0)
        matrix = F.map_from_arrays(
            F.transform(true_rows, lambda r: r["label"]), F.transform(true_rows, lambda r: F.array_sort(r["cells"]))
        )
    else:
        matrix = F.transform(
            "rows", lambda t: F.transform(F.col("rows"), lambda p: _cell(t["cells"], p["label"]))
        )

    def distribution(field: str) -> Column:
        return F.map_from_entries(
            F.array_sort(
                F.transform(
                    F.filter("rows", lambda r: r[field] > 0),
                    lambda r: F.struct(r["label"].alias("key"), r[field].alias("value")),
                )
            )
        )

    out = doc.select(
        *by,
        "total_samples",
        labels.alias("labels"),
        "accuracy",
        "macro_f1",
        per_class.alias("per_class"),
        F.array(*[F.lit(p) for p in positive]).cast("array<string>").alias("binary_positive_labels"),
        F.struct(labels.alias("labels"), matrix.alias("matrix")).alias("confusion_matrix"),
        distribution("support").alias("class_distribution"),
        distribution("predicted").alias("prediction_distribution"),
    )
    if score_col is None:
        return out.withColumn("binary_roc_auc", F.lit(None).cast("double"))
    auc = roc_auc(df, F.col(true_col).isin(*positive), score_col, by).withColumnRenamed("roc_auc", "binary_roc_auc")
    if not by:
        return out.withColumn("binary_roc_auc", auc.scalar())
    # One row per group on both sides; a null group is a group.
    side = auc.select(*[F.col(name).alias(f"__{i}") for i, name in enumerate(by)], "binary_roc_auc")
    same = [out[name].eqNullSafe(side[f"__{i}"]) for i, name in enumerate(by)]
    return out.join(side, reduce(Column.__and__, same), "left").drop(*[f"__{i}" for i in range(len(by))])


def zero_recall_labels(
    per_class: str | Column = "per_class", classes: Sequence[str] = defaults.CLASS_LABELS
) -> Column:
    """Base classes that occur but are never found."""
    column = F.col(per_class) if isinstance(per_class, str) else per_class
    return F.filter(
        F.array(*[F.lit(c) for c in classes]),
        lambda c: F.coalesce(
            (F.element_at(column, c)["support"] > 0) & (F.element_at(column, c)["recall"] <= 0), F.lit(False)
        ),
    )


def prediction_count(label: str | Column, distribution: str = "prediction_distribution") -> Column:
    key = F.lit(label) if isinstance(label, str) else label
    return F.coalesce(F.element_at(F.col(distribution), key), F.lit(0).cast("bigint"))


def best_checkpoint(df: DataFrame, step_col: str = "step", metric: str = "macro_f1") -> DataFrame:
    """The document with the largest metric; of equal ones the first step."""
    best = F.max_by(F.struct(*df.columns), F.struct(F.col(metric).alias("m"), (-F.col(step_col)).alias("s")))
    return df.agg(best.alias("b")).where("b is not null").select("b.*")
