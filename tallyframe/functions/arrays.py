"""Numeric array expressions: scores, token masks and heat maps, one row per sample and no shuffle.

Arguments are bound with ``let`` before a lambda uses them: Catalyst may inline the expression behind a column into the
lambda, which would evaluate it once per element.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyframe import defaults
from tallyframe.functions.text import let


def array_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, x: total + x.cast("double"))


def softmax(scores: Column) -> Column:
    """Softmax shifted by the largest score; an empty array stays empty."""
    return let(
        scores,
        lambda raw: let(
            F.array_max(raw),
            lambda top: let(
                F.transform(raw, lambda s: F.exp(s - top)),
                lambda exps: let(array_sum(exps), lambda total: F.transform(exps, lambda e: e / total)),
            ),
        ),
    )


def argmax_label(probabilities: Column, labels: Sequence[str]) -> Column:
    """Label of the largest value; the first of equal ones."""
    names = F.array(*[F.lit(label) for label in labels])
    return let(probabilities, lambda p: F.get(names, F.array_position(p, F.array_max(p)).cast("int") - 1))


def positive_score(
    probabilities: Column, labels: Sequence[str], positive: Sequence[str] = defaults.POSITIVE_LABELS
) -> Column:
    """Probability mass of the positive labels; a positive label that is no candidate adds nothing."""
    places = [i for i, label in enumerate(labels) if label in positive]

    def total(p: Column) -> Column:
        return sum((F.coalesce(F.get(p, F.lit(i)), F.lit(0.0)) for i in places), F.lit(0.0))

    return let(probabilities, total)


def labelled(values: Column, labels: Sequence[str]) -> Column:
    """Map from label to value."""
    return F.map_from_arrays(F.array(*[F.lit(label) for label in labels]), values)


def mask_prompt(
    input_ids: Column,
    attention_mask: Column,
    prompt_length: Column,
    padding_side: str = "left",
    ignore: int = defaults.IGNORE_INDEX,
) -> Column:
    """Target ids with padding and the prompt span replaced by ``ignore``.

    The span starts after the padding on the left, at 0 otherwise. A prompt longer than the sequence is an error.
    """
    def masked(given: Column) -> Column:
        ids, mask, prompt, actual = given["ids"], given["mask"], given["prompt"], given["actual"]
        start = (F.size(ids) - actual) if padding_side == "left" else F.lit(0)
        targets = let(
            start,
            lambda first: F.transform(
                F.arrays_zip(ids, mask),
                lambda token, i: F.when(
                    (token["mask"] == 0) | ((i >= first) & (i < first + prompt)), F.lit(ignore).cast("bigint")
                ).otherwise(token["ids"].cast("bigint")),
            ),
        )
        problem = F.raise_error(F.concat(F.lit("Prompt longer than its sequence: "), prompt.cast("string")))
        return F.when(prompt > actual, problem.cast("array<bigint>")).otherwise(targets)

    given = F.struct(
        input_ids.alias("ids"), attention_mask.alias("mask"), prompt_length.alias("prompt"),
        array_sum(attention_mask).cast("int").alias("actual"),
    )
    return let(given, masked)


def prompt_fits(attention_mask: Column, prompt_length: Column) -> Column:
    return prompt_length <= array_sum(attention_mask)


def scored_tokens(targets: Column, ignore: int = defaults.IGNORE_INDEX) -> Column:
    return F.size(F.filter(targets, lambda x: x != ignore)).cast("bigint")


def masked_tokens(targets: Column, ignore: int = defaults.IGNORE_INDEX) -> Column:
    return F.size(F.filter(targets, lambda x: x == ignore)).cast("bigint")


def log_softmax_at(logits: Column, index: Column) -> Column:
    """Log-probability of one vocabulary entry under a softmax over ``logits``."""
    def relative(top: Column) -> Column:
        mass = F.aggregate(logits, F.lit(0.0), lambda total, x: total + F.exp(x - top))
        return F.get(logits, index.cast("int")) - top - F.log(mass)

    return let(F.array_max(logits), relative)


def mean_log_likelihood(logits: Column, targets: Column, ignore: int = defaults.IGNORE_INDEX) -> Column:
    """Mean log-probability of the targets that are not ``ignore``; position i is predicted from the logits before it.

    ``logits`` is ``array<array<double>>`` (token, vocabulary). A row without any scored target is an error.
    """
    def mean(pairs: Column) -> Column:
        values = F.transform(pairs, lambda p: log_softmax_at(p["logits"], p["target"]))
        problem = F.raise_error(F.lit("A row holds no scored target token.")).cast("double")
        return F.when(F.size(pairs) == 0, problem).otherwise(array_sum(values) / F.size(pairs))

    pairs = F.filter(
        F.arrays_zip(
            F.slice(logits, F.lit(1), F.greatest(F.size(logits) - 1, F.lit(0))).alias("logits"),
            F.slice(targets, F.lit(2), F.greatest(F.size(targets) - 1, F.lit(0))).alias("target"),
        ),
        lambda p: p["target"] != ignore,
    )
    return let(pairs, mean)


def shapes(fields: dict[str, Column]) -> Column:
    """Map from name to dimensions of array columns; the dimensions of nested arrays are those of the first element."""
    entries = []
    for name, (column, depth) in fields.items():
        dims, inner = [], column
        for _ in range(depth):
            dims.append(F.size(inner).cast("bigint"))
            inner = F.get(inner, F.lit(0))
        entries += [F.lit(name), F.array(*dims)]
    return F.create_map(*entries)


def minmax_normalize(values: Column, eps: float = defaults.SALIENCY_EPSILON) -> Column:
    """Shift to 0, divide by the new maximum; all zeros when that is at most ``eps``."""
    return let(
        values,
        lambda v: let(
            F.struct(F.array_min(v).alias("low"), (F.array_max(v) - F.array_min(v)).alias("width")),
            lambda r: F.transform(
                v, lambda x: F.when(r["width"] <= eps, F.lit(0.0)).otherwise((x - r["low"]) / r["width"])
            ),
        ),
    )


def percentile_of(sorted_values: Column, percent: float) -> Column:
    """Percentile of an ascending array with linear interpolation between neighbours."""
    place = (F.size(sorted_values) - 1) * F.lit(percent / 100.0)
    low = F.floor(place).cast("int")
    below = F.get(sorted_values, low)
    above = F.coalesce(F.get(sorted_values, low + 1), below)
    return below + (above - below) * (place - low)


def is_finite_grid(grid: Column) -> Column:
    """Whether a 2-D array holds neither NaN nor infinite values and all rows have one length."""
    finite = F.forall(
        grid, lambda row: F.forall(row, lambda x: ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    )
    even = F.size(F.array_distinct(F.transform(grid, lambda row: F.size(row)))) == 1
    return F.coalesce(finite & even, F.lit(False))


def check_clip_settings(low: float, high: float, gamma: float) -> None:
    if not 0.0 <= low < high <= 100.0:
        raise ValueError("Clip percentiles must satisfy 0 <= low < high <= 100.")
    if gamma <= 0:
        raise ValueError("Gamma must be positive.")


def percentile_normalize(
    values: Column,
    low: float = defaults.CLIP_PERCENTILES[0],
    high: float = defaults.CLIP_PERCENTILES[1],
    gamma: float = defaults.GAMMA,
) -> Column:
    """Clip at two percentiles, scale to 0..1 and apply ``gamma``.

    Equal percentiles fall back to minimum and maximum; a flat array gives zeros.
    """
    check_clip_settings(low, high, gamma)

    def scaled(v: Column, r: Column) -> Column:
        def point(x: Column) -> Column:
            unit = F.least(F.greatest((x - r["low"]) / (r["high"] - r["low"]), F.lit(0.0)), F.lit(1.0))
            return F.when(r["high"] <= r["low"], F.lit(0.0)).otherwise(F.pow(unit, F.lit(gamma)))

        return F.transform(v, point)

    def limits(ordered: Column) -> Column:
        return let(
            F.struct(percentile_of(ordered, low).alias("a"), percentile_of(ordered, high).alias("b")),
            lambda p: F.when(p["b"] > p["a"], F.struct(p["a"].alias("low"), p["b"].alias("high"))).otherwise(
                F.struct(F.get(ordered, F.lit(0)).alias("low"), F.try_element_at(ordered, F.lit(-1)).alias("high"))
            ),
        )

    return let(values, lambda v: let(let(F.array_sort(v), limits), lambda r: scaled(v, r)))


def gaussian_kernel(sigma: float) -> list[float]:
    """Weights of a Gaussian, their sum 1, as wide as four sigmas on each side, rounded to an odd number of places."""
    if sigma <= 0:
        raise ValueError("Sigma must be positive.")
    radius = (round(8 * sigma + 1) | 1) // 2
    raw = [math.exp(-(place**2) / (2 * sigma**2)) for place in range(-radius, radius + 1)]
    return [weight / sum(raw) for weight in raw]


def _smooth_rows(grid: Column, kernel: list[float]) -> Column:
    """Each row convolved with the kernel; beyond its ends a row goes on as its mirror image, the ends not repeated."""
    weights, radius = F.array(*[F.lit(w) for w in kernel]), len(kernel) // 2

    def smooth(row: Column) -> Column:
        period = F.greatest(2 * (F.size(row) - 1), F.lit(1))

        def point(_: Column, i: Column) -> Column:
            def add(total: Column, k: Column) -> Column:
                place = F.pmod(i + k, period)
                mirrored = F.when(place < F.size(row), place).otherwise(period - place)
                return total + F.get(weights, k + radius) * F.get(row, mirrored)

            return F.aggregate(F.sequence(F.lit(-radius), F.lit(radius)), F.lit(0.0), add)

        return F.transform(row, point)

    return F.transform(grid, smooth)


def _transposed(grid: Column) -> Column:
    width = F.coalesce(F.size(F.get(grid, F.lit(0))), F.lit(0))
    columns = F.filter(F.sequence(F.lit(0), width), lambda n: n < width)
    return F.transform(columns, lambda n: F.transform(grid, lambda row: F.get(row, n)))


def gaussian_smooth(grid: Column, sigma: float) -> Column:
    """A 2-D array of doubles smoothed by a Gaussian, along its rows and then along its columns.

    Rows must have one length (see ``is_finite_grid``). A null grid stays null, an empty one empty.
    """
    kernel = gaussian_kernel(sigma)
    smooth = let(let(_smooth_rows(grid, kernel), _transposed), lambda turned: let(_smooth_rows(turned, kernel), _transposed))
    return F.when(grid.isNotNull(), smooth)


def normalize_grid(
    grid: Column,
    low: float = defaults.CLIP_PERCENTILES[0],
    high: float = defaults.CLIP_PERCENTILES[1],
    gamma: float = defaults.GAMMA,
    sigma: float = 0.0,
) -> Column:
    """``percentile_normalize`` of a 2-D array, smoothed by a Gaussian before ``gamma`` where ``sigma`` is positive."""
    if sigma < 0:
        raise ValueError("Sigma must not be negative.")

    def reshaped(given: Column) -> Column:
        width = F.size(F.get(given["grid"], F.lit(0)))
        return F.transform(given["grid"], lambda _, i: F.slice(given["flat"], i * width + 1, width))

    def shaped(held: Column) -> Column:
        flat = percentile_normalize(F.flatten(held), low, high, 1.0)
        return let(F.struct(held.alias("grid"), flat.alias("flat")), reshaped)

    unit = let(grid, shaped)
    unit = gaussian_smooth(unit, sigma) if sigma > 0 else unit
    bent = lambda x: F.pow(F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)), F.lit(gamma))
    return F.transform(unit, lambda row: F.transform(row, bent))


def token_saliency(activations: Column, gradients: Column, eps: float = defaults.SALIENCY_EPSILON) -> Column:
    """Gradient-weighted activation per token, as ``struct<method string, scores array<double>>``.

    Channel weight: mean gradient over the tokens. Score: positive part of the weighted channel sum. When no score
    exceeds ``eps``, the absolute sum of activation times gradient is used and the method says so.
    """
    def channel_sum(left: Column, right: Column) -> Column:
        return F.aggregate(
            F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double")),
            F.lit(0.0),
            lambda total, x: total + x,
        )

    def scored(act: Column, grad: Column, weights: Column) -> Column:
        direct = F.transform(act, lambda row: F.greatest(F.lit(0.0), channel_sum(row, weights)))
        fallback = F.zip_with(act, grad, lambda a, g: F.abs(channel_sum(a, g)))
        return let(
            direct,
            lambda scores: F.when(
                F.array_max(scores) > eps,
                F.struct(F.lit("grad_cam").alias("method"), minmax_normalize(scores, eps).alias("scores")),
            ).otherwise(
                F.struct(
                    F.lit("gradient_activation_fallback").alias("method"),
                    minmax_normalize(fallback, eps).alias("scores"),
                )
            ),
        )

    def run(given: Column) -> Column:
        act, grad = given["act"], given["grad"]
        # Column sums of the gradients in one pass over the tokens.
        totals = F.aggregate(
            F.slice(grad, F.lit(2), F.greatest(F.size(grad) - 1, F.lit(0))),
            F.transform(F.get(grad, F.lit(0)), lambda g: g.cast("double")),
            lambda total, row: F.zip_with(total, row, lambda a, b: a + b.cast("double")),
        )
        same = (F.size(act) == F.size(grad)) & F.forall(
            F.zip_with(act, grad, lambda a, g: F.size(a) == F.size(g)), lambda ok: ok
        )
        result = let(F.transform(totals, lambda t: t / F.size(grad)), lambda w: scored(act, grad, w))
        problem = F.raise_error(F.lit("Activations and gradients differ in shape."))
        return F.when(same, result).otherwise(problem.cast("struct<method:string,scores:array<double>>"))

    return let(F.struct(activations.alias("act"), gradients.alias("grad")), run)


def spatial_map(scores: Column, t: Column, h: Column, w: Column) -> Column:
    """Mean over the first axis of a ``t x h x w`` token grid, normalised, as ``h*w`` values in row order."""
    def run(given: Column) -> Column:
        v, nt, nh, nw = given["v"], given["t"], given["h"], given["w"]
        cells = F.transform(
            F.sequence(F.lit(0), nh * nw - 1),
            lambda cell: F.aggregate(
                F.sequence(F.lit(0), nt - 1),
                F.lit(0.0),
                lambda total, step: total + F.get(v, step * nh * nw + cell),
            )
            / nt,
        )
        problem = F.raise_error(F.lit("The number of token scores does not match the grid."))
        return F.when(F.size(v) == nt * nh * nw, minmax_normalize(cells)).otherwise(problem.cast("array<double>"))

    return let(F.struct(scores.alias("v"), t.alias("t"), h.alias("h"), w.alias("w")), run)
