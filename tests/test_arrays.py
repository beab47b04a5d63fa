import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.functions import arrays
from tallyframe.operators import saliency, scoring

LABELS = ("a", "b", "c")


def value(spark, expression):
    return spark.range(1).select(expression.alias("x")).first()["x"]


def numbers(values, kind="double"):
    return F.lit(None) if values is None else F.array(*[F.lit(v) for v in values]).cast(f"array<{kind}>")


def matrix(rows):
    return F.array(*[numbers(row) for row in rows])


def test_softmax_and_argmax(spark):
    found = value(spark, arrays.softmax(numbers([2.0, 1.0, 0.0])))
    assert sum(found) == pytest.approx(1.0)
    assert found[0] / found[1] == pytest.approx(math.e)
    assert value(spark, arrays.softmax(numbers([1000.0, 1000.0]))) == [0.5, 0.5]
    assert value(spark, arrays.softmax(numbers([]))) == []
    assert value(spark, arrays.argmax_label(numbers([0.2, 0.4, 0.4]), LABELS)) == "b"
    assert value(spark, arrays.positive_score(numbers([0.2, 0.3, 0.5]), LABELS, ("a", "c", "z"))) == pytest.approx(0.7)


@pytest.mark.parametrize(
    "ids, mask, prompt, side, expected",
    [
        ([0, 10, 11, 12, 13], [0, 1, 1, 1, 1], 2, "left", [-100, -100, -100, 12, 13]),
        ([20, 21, 22, 23, 24], [1, 1, 1, 1, 1], 3, "left", [-100, -100, -100, 23, 24]),
        ([10, 11, 12, 0], [1, 1, 1, 0], 2, "right", [-100, -100, 12, -100]),
        ([10, 11], [1, 1], 0, "left", [10, 11]),
    ],
)
def test_mask_prompt(spark, ids, mask, prompt, side, expected):
    assert value(spark, arrays.mask_prompt(numbers(ids, "bigint"), numbers(mask, "bigint"), F.lit(prompt), side)) == expected


def test_mask_prompt_rejects_long_prompts(spark):
    with pytest.raises(Exception, match="Prompt longer"):
        value(spark, arrays.mask_prompt(numbers([1, 2], "bigint"), numbers([0, 1], "bigint"), F.lit(2)))


def test_mean_log_likelihood(spark):
    rng = np.random.default_rng(1)
    logits = rng.normal(size=(5, 4)) * 30
    targets = [-100, 3, -100, 0, 2]
    shifted = logits - logits.max(axis=1, keepdims=True)
    logp = shifted - np.log(np.exp(shifted).sum(axis=1, keepdims=True))
    expected = np.mean([logp[i - 1, t] for i, t in enumerate(targets) if i and t != -100])
    found = value(spark, arrays.mean_log_likelihood(matrix(logits.tolist()), numbers(targets, "bigint")))
    assert found == pytest.approx(expected)
    with pytest.raises(Exception, match="no scored target"):
        value(spark, arrays.mean_log_likelihood(matrix(logits.tolist()), numbers([5] + [-100] * 4, "bigint")))


def test_batch_checks(spark):
    rows = spark.createDataFrame(
        [(1, [1, 2], [1, 1], [-100, 2]), (2, [1, 2], [1, 1], [-100, -100]), (3, [1, 2], [1, 1], [1, 2]), (4, [1, 2], [1, 1], [-100])],
        "i int, input_ids array<bigint>, attention_mask array<bigint>, labels array<bigint>",
    )
    assert {r["i"]: r["problem"] for r in scoring.batch_problems(rows).collect()} == {
        2: "no scored token", 3: "no masked token", 4: "labels and input_ids differ in length"}
    with pytest.raises(ValueError, match="lacks fields: image_grid_thw, mm_token_type_ids, pixel_values"):
        scoring.batch_summary(rows)
    rows = rows.withColumns({name: F.lit(0) for name in ("mm_token_type_ids", "pixel_values", "image_grid_thw")})
    good = scoring.batch_summary(rows.where("i = 1"), strict=True).first()
    assert (good["label_tokens"], good["masked_tokens"]) == (1, 1)
    with pytest.raises(ValueError, match="Invalid batch rows"):
        scoring.batch_summary(rows, strict=True)
    with pytest.raises(ValueError, match="lacks fields: labels"):
        scoring.batch_summary(rows.drop("labels"))


def test_shapes(spark):
    found = value(spark, arrays.shapes({"m": (matrix([[1, 2, 3], [4, 5, 6]]), 2), "v": (numbers([1]), 1)}))
    assert found == {"m": [2, 3], "v": [1]}


def saliency_row(spark, act, grad):
    rows = spark.range(1).select(matrix(act).alias("activations"), matrix(grad).alias("gradients"))
    return saliency.token_saliency(rows).first()


def test_token_saliency(spark):
    found = saliency_row(spark, [[2, 0], [0, 1], [0, 0.5]], [[1, 0], [0, 1], [0, 0]])
    assert found["method"] == "grad_cam" and max(found["token_scores"]) == 1.0
    assert found["token_scores"][0] > found["token_scores"][2]
    flat = saliency_row(spark, [[1, 1], [1, 1]], [[0, 0], [0, 0]])
    assert (flat["method"], flat["token_scores"]) == ("gradient_activation_fallback", [0.0, 0.0])
    with pytest.raises(Exception, match="differ in shape"):
        saliency_row(spark, [[1, 2], [3, 4]], [[1], [2]])


@pytest.mark.parametrize("seed", range(3))
def test_token_saliency_equals_numpy(spark, seed):
    rng = np.random.default_rng(seed)
    act, grad = rng.normal(size=(6, 3)), rng.normal(size=(6, 3))
    cam = np.maximum((act * grad.mean(axis=0)).sum(axis=1), 0)
    expected = (cam - cam.min()) / (cam - cam.min()).max()
    assert saliency_row(spark, act.tolist(), grad.tolist())["token_scores"] == pytest.approx(expected.tolist())


def test_grid_map(spark):
    rows = spark.range(1).select(numbers(range(8)).alias("token_scores"), F.expr("struct(2 AS t, 2 AS h, 2 AS w)").alias("grid"))
    assert saliency.grid_map(rows).first()["cells"] == pytest.approx([0, 1 / 3, 2 / 3, 1])
    with pytest.raises(Exception, match="does not match the grid"):
        saliency.grid_map(rows.withColumn("grid", F.expr("struct(1 AS t, 2 AS h, 2 AS w)"))).collect()


@pytest.mark.parametrize("low, high, gamma", [(20, 80, 1.0), (55, 99.5, 0.8), (0, 100, 2.0)])
def test_percentile_normalize(spark, low, high, gamma):
    rng = random.Random(5)
    data = [rng.gauss(0, 5) for _ in range(41)]
    a, b = np.percentile(data, [low, high])
    expected = np.clip((np.array(data) - a) / (b - a), 0, 1) ** gamma
    assert value(spark, arrays.percentile_normalize(numbers(data), low, high, gamma)) == pytest.approx(expected.tolist())


def test_percentile_normalize_edges(spark):
    found = value(spark, arrays.percentile_normalize(numbers([0, 0, 1, 2, 100]), 20, 80, 1.0))
    assert min(found) == 0.0 and max(found) == 1.0
    assert value(spark, arrays.percentile_normalize(numbers([3, 3, 3]))) == [0.0, 0.0, 0.0]
    # Equal percentiles fall back to the extremes.
    assert value(spark, arrays.percentile_normalize(numbers([0, 5, 5, 5, 5, 5, 10]), 30, 60, 1.0)) == pytest.approx([0, .5, .5, .5, .5, .5, 1])
    for bad in ((50, 50, 1), (-1, 50, 1), (0, 101, 1), (0, 50, 0)):
        with pytest.raises(ValueError):
            arrays.percentile_normalize(numbers([1]), *bad)


def test_finite_maps(spark):
    grids = [[[1.0, 2.0], [3.0, 4.0]], [[1.0, math.nan]], [[math.inf]], [[1.0], [2.0, 3.0]]]
    rows = spark.createDataFrame([(i, g) for i, g in enumerate(grids)], "i int, grid array<array<double>>")
    assert [r["i"] for r in saliency.finite_maps(rows, "grid").collect()] == [0]
    with pytest.raises(ValueError, match="bad_maps=3"):
        saliency.finite_maps(rows, "grid", strict=True)


def mirrored_blur(grid, sigma):
    """Each point as the weighted sum over all neighbours, with mirrored borders, by the definition."""
    radius = (round(8 * sigma + 1) | 1) // 2
    weights = [math.exp(-(k**2) / (2 * sigma**2)) for k in range(-radius, radius + 1)]
    weights = [w / sum(weights) for w in weights]

    def at(place, size):
        while size > 1 and not 0 <= place < size:
            place = -place if place < 0 else 2 * (size - 1) - place
        return place if size > 1 else 0

    height, width = len(grid), len(grid[0])
    steps = range(-radius, radius + 1)
    return [[sum(weights[a + radius] * weights[b + radius] * grid[at(y + a, height)][at(x + b, width)] for a in steps for b in steps)
             for x in range(width)] for y in range(height)]


@pytest.mark.parametrize("height, width, sigma", [(5, 7, 0.8), (3, 4, 2.5), (1, 6, 1.0), (6, 1, 1.0), (2, 2, 1.3), (1, 1, 1.0)])
def test_gaussian_smooth(spark, height, width, sigma):
    rng = random.Random(height * width)
    grid = [[rng.random() for _ in range(width)] for _ in range(height)]
    column = F.array(*[numbers(row) for row in grid])
    found = value(spark, arrays.gaussian_smooth(column, sigma))
    assert np.array(found) == pytest.approx(np.array(mirrored_blur(grid, sigma)))
    low, high = np.percentile(grid, [10, 90])
    unit = np.clip((np.array(grid) - low) / (high - low), 0, 1).tolist() if high > low else [[0.0]]
    for blur in (0.0, sigma):
        expected = np.clip(mirrored_blur(unit, blur) if blur else unit, 0, 1) ** 0.7
        assert np.array(value(spark, arrays.normalize_grid(column, 10, 90, 0.7, blur))) == pytest.approx(expected)


def test_gaussian_smooth_edges(spark):
    kind = "array<array<double>>"
    assert value(spark, arrays.gaussian_smooth(F.lit(None).cast(kind), 1.0)) is None
    assert value(spark, arrays.gaussian_smooth(F.array().cast(kind), 1.0)) == []
    for bad in (0, -1.0):
        with pytest.raises(ValueError):
            arrays.gaussian_smooth(F.array().cast(kind), bad)
    with pytest.raises(ValueError):
        arrays.normalize_grid(F.array().cast(kind), sigma=-0.1)
