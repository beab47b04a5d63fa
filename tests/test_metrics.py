import random

import pytest
from pyspark.sql import functions as F

from tallyframe import defaults
from tallyframe.operators import gates, metrics

SCHEMA = "index bigint, true_label string, predicted_label string, binary_score double"


def predictions(spark, rows):
    return spark.createDataFrame([(i, *row) for i, row in enumerate(rows)], SCHEMA)


FOUR = [("active_tb", "active_tb", 0.90), ("healthy", "healthy", 0.10), ("sick_but_non_tb", "healthy", 0.20), ("active_tb", "active_tb", 0.85)]


def test_compute_metrics(spark):
    doc = metrics.compute_metrics(predictions(spark, FOUR)).first()
    assert (doc["total_samples"], doc["accuracy"], doc["binary_roc_auc"]) == (4, 0.75, 1.0)
    assert doc["labels"] == ["active_tb", "healthy", "sick_but_non_tb"]
    assert doc["class_distribution"] == {"active_tb": 2, "healthy": 1, "sick_but_non_tb": 1}
    assert doc["prediction_distribution"] == {"active_tb": 2, "healthy": 2}
    assert doc["confusion_matrix"]["matrix"] == [[2, 0, 0], [0, 1, 0], [0, 1, 0]]
    assert doc["macro_f1"] == pytest.approx((1 + 2 / 3 + 0) / 3)
    assert doc["per_class"]["healthy"].asDict() == pytest.approx({"precision": 0.5, "recall": 1.0, "f1": 2 / 3, "support": 1})


def test_unseen_labels_follow_in_first_seen_order(spark):
    rows = [("healthy", "zebra", 0.1), ("apple", "healthy", 0.2), ("healthy", "apple", 0.3)]
    doc = metrics.compute_metrics(predictions(spark, rows)).first()
    assert doc["labels"] == ["active_tb", "healthy", "sick_but_non_tb", "zebra", "apple"]
    assert doc["binary_roc_auc"] is None
    assert doc["per_class"]["active_tb"].asDict() == {"precision": 0.0, "recall": 0.0, "f1": 0.0, "support": 0}


def test_open_label_sets_stay_sparse(spark):
    """20,000 labels: a document as large as the pairs that occur."""
    names = F.concat(F.lit("c"), F.col("id") % 20_000)
    rows = spark.range(60_000).select(
        F.col("id").alias("index"), names.alias("true_label"), F.lit(0.5).alias("binary_score"),
        F.when(F.col("id") % 3 == 0, F.lit("c0")).otherwise(names).alias("predicted_label"))
    doc = metrics.compute_metrics(rows, classes=("c0", "none"), sparse=True).first()
    assert len(doc["labels"]) == 20_001 and doc["total_samples"] == 60_000
    matrix = {t: {cell["label"]: cell["n"] for cell in cells} for t, cells in doc["confusion_matrix"]["matrix"].items()}
    assert "none" not in matrix and matrix["c0"] == {"c0": 3} and matrix["c1"] == {"c0": 1, "c1": 2}
    pairs = {(t, p): n for t, cells in matrix.items() for p, n in cells.items()}
    assert pairs == {(r["true_label"], r["predicted_label"]): r["n"] for r in metrics.sparse_confusion(rows).collect()}
    dense = metrics.compute_metrics(predictions(spark, FOUR), sparse=True).first()
    assert {t: [tuple(c) for c in cells] for t, cells in dense["confusion_matrix"]["matrix"].items()} == {
        "active_tb": [("active_tb", 2)], "healthy": [("healthy", 1)], "sick_but_non_tb": [("healthy", 1)]}


def test_no_predictions_give_no_document(spark):
    assert metrics.compute_metrics(predictions(spark, FOUR).limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_roc_auc_with_ties(spark, many_partitions, seed):
    rng = random.Random(seed)
    rows = [(rng.choice(["p", "n", "n"]), "x", rng.choice([0.1, 0.2, 0.2, rng.random()])) for _ in range(150)]
    pos, neg = [s for t, _, s in rows if t == "p"], [s for t, _, s in rows if t == "n"]
    wins = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg)
    found = metrics.roc_auc(predictions(spark, rows), F.col("true_label") == "p").first()["roc_auc"]
    assert found == pytest.approx(wins / len(pos) / len(neg))


def document(spark, total, predicted, accuracy=0.5, macro_f1=0.3, recall=0.5, support=100):
    per_class = {c: (0.5, recall, 0.4, support) for c in defaults.CLASS_LABELS}
    schema = ("total_samples bigint, accuracy double, macro_f1 double, prediction_distribution map<string,bigint>,"
              "per_class map<string,struct<precision:double,recall:double,f1:double,support:bigint>>")
    return spark.createDataFrame([(total, accuracy, macro_f1, predicted, per_class)], schema)


def passed(checks):
    return gates.gate_result(checks).first()["passed"]


def counts(tb, healthy, sick):
    return {k: v for k, v in zip(defaults.CLASS_LABELS, (tb, healthy, sick)) if v}


def test_early_diagnostic_gate(spark):
    bad = gates.gate_checks(document(spark, 5, counts(0, 0, 5), recall=0.0, support=1), "run3-diagnostic")
    assert {r["check"] for r in bad.where("not passed").collect()} == {
        "no_zero_recall", "no_prediction_monopoly", "active_tb_predictions_minimum", "healthy_predictions_nonzero"}
    told = {r["check"]: r for r in bad.collect()}
    assert {r["gate"] for r in told.values()} == {"run3_diagnostic"}
    assert told["no_zero_recall"]["labels"] == list(defaults.CLASS_LABELS) and told["no_prediction_monopoly"]["labels"] is None
    good = gates.gate_checks(document(spark, 450, counts(13, 200, 237)), "run3-diagnostic")
    assert passed(good) and {r["check"]: r["minimum"] for r in good.collect()}["active_tb_predictions_minimum"] == 13


def test_later_diagnostic_gate(spark):
    assert not passed(gates.gate_checks(document(spark, 450, counts(49, 201, 200)), "run4-diagnostic"))
    assert passed(gates.gate_checks(document(spark, 450, counts(50, 200, 200)), "run4-diagnostic"))


def test_full_gate(spark):
    assert passed(gates.gate_checks(document(spark, 1800, counts(100, 850, 850), 0.51, 0.31), "run3-full"))
    for changed in (
        document(spark, 1800, counts(100, 500, 1200), 0.51, 0.31), document(spark, 1799, counts(100, 850, 849), 0.51, 0.31),
        document(spark, 1800, counts(100, 850, 850), 0.49, 0.31), document(spark, 1800, counts(100, 850, 850), 0.51, 0.31, recall=0.0),
    ):
        assert not passed(gates.gate_checks(changed, "run3-full"))


def test_gate_by_name(spark):
    doc = document(spark, 10, {})
    assert gates.gate_checks(doc, "none") is None
    with pytest.raises(ValueError, match="Unknown gate"):
        gates.gate_checks(doc, "other")
    with pytest.raises(ValueError):
        gates.scaled_count(50, F.lit(1), 0)


@pytest.mark.parametrize("macro, drop, ok", [(0.965, 0.013787, True), (0.99, 0.0, True), (0.958787, 0.02, False), (0.9, 0.078787, False)])
def test_baseline_delta(spark, macro, drop, ok):
    found = gates.baseline_delta(document(spark, 1800, {}, macro_f1=macro)).first()
    assert found["macro_f1_drop"] == pytest.approx(drop, abs=1e-9) and found["passed"] is ok


def test_class_deltas(spark):
    baseline = {"accuracy": 1.0, "macro_f1": 1.0, "per_class_f1": {"healthy": 0.6, "unseen": 0.5}}
    found = {r["label"]: (r["current_f1"], round(r["delta"], 6)) for r in gates.class_deltas(document(spark, 1, {}), baseline).collect()}
    assert found == {"healthy": (0.4, -0.2), "unseen": (0.0, -0.5)}


def test_ablation_and_verdict(spark):
    base = {"accuracy": 0.49, "macro_f1": 0.29, "per_class_f1": {"healthy": 0.41}}
    doc = document(spark, 1, {})
    good = gates.ablation_checks(doc, F.lit(True), base, tolerance={"healthy": 0.02})
    assert passed(good)
    assert not passed(gates.ablation_checks(doc, F.lit(None).cast("boolean"), base, tolerance={"healthy": 0.02}))
    assert not passed(gates.ablation_checks(doc, F.lit(True), base, margin=0.0101, tolerance={"healthy": 0.02}))
    assert not passed(gates.ablation_checks(doc, F.lit(True), base, tolerance={"healthy": 0.005}))
    delta = gates.baseline_delta(doc)
    assert gates.combined_verdict(gates.gate_result(good), None).first()["passed"]
    assert not gates.combined_verdict(gates.gate_result(good), delta).first()["passed"]


def test_best_checkpoint_prefers_the_first_of_equals(spark):
    rows = spark.createDataFrame([(800, 0.5), (400, 0.7), (1600, 0.7)], "step int, macro_f1 double")
    assert metrics.best_checkpoint(rows).first()["step"] == 400
    assert metrics.best_checkpoint(rows.limit(0)).count() == 0


def test_groups_with_null_keys(spark):
    rows = spark.createDataFrame(
        [(None, 0, "active_tb", "active_tb", 0.9), (None, 1, "healthy", "healthy", 0.1), ("a", 0, "healthy", "active_tb", 0.9),
         ("a", 1, "active_tb", "active_tb", 0.2)],
        "run string, index bigint, true_label string, predicted_label string, binary_score double")
    found = {r["run"]: r["binary_roc_auc"] for r in metrics.compute_metrics(rows, positive=["active_tb"], by=["run"]).collect()}
    assert found == {None: 1.0, "a": 0.0}
    grid = {(r["run"], r["true_label"], r["predicted_label"]): r["n"] for r in metrics.confusion(rows, by=["run"]).collect()}
    assert len(grid) == 18 and grid[None, "healthy", "healthy"] == 1 and grid["a", "healthy", "active_tb"] == 1
    assert sum(grid.values()) == 4
