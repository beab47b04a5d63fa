"""Pass/fail checks on metrics documents (one row per document, see ``metrics.compute_metrics``).

A gate turns each document into check rows ``(gate, check, label, labels, passed, actual, minimum, maximum)``: ``label`` is
the class a check is about, ``labels`` are the classes that ``no_zero_recall`` found lost (null for other checks). Columns
named in ``by`` are carried along, so that many checkpoints are judged in one pass.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe import defaults
from tallyframe.functions.messages import structured_label
from tallyframe.operators.metrics import prediction_count, zero_recall_labels

GATES = ("none", *defaults.GATE_NAMES)


def scaled_count(full_count: int, total: Column, full_size: int) -> Column:
    """A count for the full set scaled to ``total`` rows, rounded up, at least 1."""
    if full_size <= 0:
        raise ValueError("The full size must be positive.")
    return F.greatest(F.lit(1).cast("bigint"), F.ceil(F.lit(full_count) * total / F.lit(full_size)))


def size_gb(size_bytes: Column) -> Column:
    return size_bytes / F.lit(float(1024**3))


def _check(name: str, passed: Column, actual=None, minimum=None, maximum=None, label: str | None = None, labels=None) -> Column:
    def number(value) -> Column:
        if value is None:
            return F.lit(None).cast("double")
        return (value if isinstance(value, Column) else F.lit(value)).cast("double")

    return F.struct(
        F.lit(name).alias("check"),
        F.lit(label).cast("string").alias("label"),
        (F.lit(None) if labels is None else labels).cast("array<string>").alias("labels"),
        F.coalesce(passed, F.lit(False)).alias("passed"),
        number(actual).alias("actual"),
        number(minimum).alias("minimum"),
        number(maximum).alias("maximum"),
    )


def _no_zero_recall(classes: Sequence[str]) -> Column:
    lost = zero_recall_labels("per_class", classes)
    return _check("no_zero_recall", F.size(lost) == 0, F.size(lost), None, 0, labels=lost)


def _no_monopoly() -> Column:
    top = F.coalesce(F.array_max(F.map_values("prediction_distribution")), F.lit(0).cast("bigint"))
    limit = F.lit(defaults.MONOPOLY_SHARE) * F.col("total_samples")
    return _check("no_prediction_monopoly", top <= limit, top, None, F.floor(limit))


def _at_least(name: str, label: str, minimum) -> Column:
    count = prediction_count(label)
    return _check(name, count >= minimum, count, minimum, None, label)


def _between(name: str, label: str, low: int, high: int) -> Column:
    count = prediction_count(label)
    return _check(name, count.between(low, high), count, low, high, label)


def _value_at_least(column: str, minimum: float) -> Column:
    return _check(column, F.col(column) >= minimum, F.col(column), minimum)


def _early_diagnostic(classes: Sequence[str], full_size: int) -> list[Column]:
    """Scaled minimum for the rare class, any prediction of the common one."""
    rare, common = classes[0], classes[1]
    least = scaled_count(defaults.MINIMUM_PREDICTIONS, F.col("total_samples"), full_size)
    return [
        _no_zero_recall(classes),
        _no_monopoly(),
        _at_least(f"{rare}_predictions_minimum", rare, least),
        _at_least(f"{common}_predictions_nonzero", common, F.lit(1)),
    ]


def _later_diagnostic(classes: Sequence[str]) -> list[Column]:
    """The same fixed minimum for every class."""
    minimums = [
        _at_least("minimum_predictions_per_class", c, F.lit(defaults.MINIMUM_PREDICTIONS)) for c in classes
    ]
    return [_no_zero_recall(classes), _no_monopoly(), *minimums]


def _full(classes: Sequence[str], full_size: int) -> list[Column]:
    rare, *others = classes
    low, high = defaults.FULL_GATE["prediction_range"]
    return [
        _check("full_val_size", F.col("total_samples") == full_size, F.col("total_samples"), full_size, full_size),
        _value_at_least("macro_f1", defaults.FULL_GATE["macro_f1"]),
        _value_at_least("accuracy", defaults.FULL_GATE["accuracy"]),
        *[_between(f"{c}_predictions_range", c, low, high) for c in others],
        _at_least(f"{rare}_predictions_minimum", rare, F.lit(defaults.MINIMUM_PREDICTIONS)),
        _no_zero_recall(classes),
    ]


def gate_checks(
    metrics: DataFrame,
    gate: str,
    full_size: int = defaults.FULL_VALIDATION_SIZE,
    classes: Sequence[str] = defaults.CLASS_LABELS,
    by: Sequence[str] = (),
) -> DataFrame | None:
    """Check rows of a gate chosen by name; ``none`` gives None, an unknown name is an error.

    The rows carry the name of the result (``defaults.GATE_NAMES``). The first class of the list is the rare one. A check that covers every class has one row per class.
    """
    if gate == "none":
        return None
    if gate == "run3-diagnostic":
        checks = _early_diagnostic(classes, full_size)
    elif gate == "run4-diagnostic":
        checks = _later_diagnostic(classes)
    elif gate == "run3-full":
        checks = _full(classes, full_size)
    else:
        raise ValueError(f"Unknown gate {gate}; choose from {', '.join(GATES)}.")
    return metrics.select(*by, F.lit(defaults.GATE_NAMES[gate]).alias("gate"), F.inline(F.array(*checks)))


def gate_result(checks: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Whether all checks of each gate passed."""
    return checks.groupBy(*by, "gate").agg(F.bool_and("passed").alias("passed"))


def _baseline_f1(baseline: Mapping) -> Column:
    entries = [x for label, f1 in baseline["per_class_f1"].items() for x in (F.lit(label), F.lit(float(f1)))]
    return F.create_map(*entries)


def class_deltas(metrics: DataFrame, baseline: Mapping, by: Sequence[str] = ()) -> DataFrame:
    """Current against baseline F1 for every class of the baseline; a class without metrics counts 0."""
    f1 = F.coalesce(F.element_at(F.col("per_class"), F.col("label"))["f1"], F.lit(0.0))
    return metrics.select(*by, "per_class", F.explode(_baseline_f1(baseline)).alias("label", "baseline_f1")).select(
        *by, "label", "baseline_f1", f1.alias("current_f1"), (f1 - F.col("baseline_f1")).alias("delta")
    )


def baseline_delta(
    metrics: DataFrame,
    baseline: Mapping = defaults.FULL_PRECISION_BASELINE,
    max_drop: float = defaults.MAX_MACRO_F1_DROP,
    by: Sequence[str] = (),
) -> DataFrame:
    """Accuracy and macro-F1 changes. Passed when the drop of macro F1, unrounded, is at most ``max_drop``."""
    base_accuracy, base_f1 = F.lit(float(baseline["accuracy"])), F.lit(float(baseline["macro_f1"]))
    drop = F.greatest(F.lit(0.0), base_f1 - F.col("macro_f1"))
    return metrics.select(
        *by,
        base_accuracy.alias("baseline_accuracy"),
        "accuracy",
        (F.col("accuracy") - base_accuracy).alias("accuracy_delta"),
        base_f1.alias("baseline_macro_f1"),
        "macro_f1",
        (F.col("macro_f1") - base_f1).alias("macro_f1_delta"),
        drop.alias("macro_f1_drop"),
        F.lit(float(max_drop)).alias("max_allowed_drop"),
        (drop <= F.lit(float(max_drop))).alias("passed"),
    )


def ablation_checks(
    metrics: DataFrame,
    gate_passed: Column,
    baseline: Mapping = defaults.EARLIER_BASELINE,
    margin: float = defaults.ABLATION_MARGIN,
    tolerance: Mapping[str, float] = defaults.ABLATION_DROP_TOLERANCE,
    by: Sequence[str] = (),
) -> DataFrame:
    """Checks behind the ablation decision: clear gains overall, gate passed, no class much worse.

    A class that has no metrics fails its check.
    """
    checks = [
        _check(f"{name}_gain", F.col(name) - baseline[name] > margin, F.col(name) - baseline[name], margin)
        for name in ("accuracy", "macro_f1")
    ]
    checks.append(_check("gate_passed", gate_passed))
    for label, f1 in baseline["per_class_f1"].items():
        drop = F.lit(float(f1)) - F.element_at(F.col("per_class"), F.lit(label))["f1"]
        checks.append(_check("class_drop", drop <= tolerance[label], drop, None, tolerance[label], label))
    return metrics.select(*by, F.lit("ablation").alias("gate"), F.inline(F.array(*checks)))


def all_structured(answers: DataFrame, classes: Sequence[str] = defaults.CLASS_LABELS) -> DataFrame:
    """Whether every ``text`` is nothing but one answer line with a known class; one row, false without answers."""
    good = structured_label(F.col("text"), classes).isNotNull()
    return answers.agg(F.coalesce(F.bool_and(F.coalesce(good, F.lit(False))), F.lit(False)).alias("passed"))


def combined_verdict(*parts: DataFrame | None, by: Sequence[str] = ()) -> DataFrame:
    """Whether all given results passed; a part that is None is left out."""
    present = [part.select(*by, "passed") for part in parts if part is not None]
    union = present[0]
    for part in present[1:]:
        union = union.unionByName(part)
    return union.groupBy(*by).agg(F.bool_and("passed").alias("passed"))
