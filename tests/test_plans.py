import json

import pytest
from pyspark.sql import functions as F

from tallyframe.functions import arrays
from tallyframe.functions import messages as msg
from tallyframe.operators import scoring
from tallyframe.plans import balanced_sampling, evaluation
from tallyframe.plans.scoring_queries import byte_tokenizer
from tallyframe.sources import sinks


@pytest.fixture()
def samples(spark):
    rows = [(i, c) for i, c in enumerate(["healthy", "active_tb", "sick_but_non_tb"] * 4)]
    frame = spark.createDataFrame(rows, "index bigint, true_label string")
    path = F.concat(F.lit("/x/"), F.col("true_label"), F.lit("-"), F.col("index").cast("string"))
    return frame.withColumn("image_path", path).withColumn("messages", msg.training_messages(path, F.col("true_label")))


def knowing_scorer(conversation, prompt):
    """Right for every class but sick_but_non_tb, where it says healthy."""
    def score(talk, question):
        answer = json.loads(talk)[1]["content"][0]["text"].removeprefix("Classification: ")
        path = json.loads(question)[0]["content"][0]["path"]
        wanted = "healthy" if "sick" in path else path.split("/")[-1].split("-")[0]
        return 0.0 if answer == wanted else -2.0

    return conversation.combine(prompt, score)


def test_evaluate(spark, samples, tmp_path):
    done = evaluation.evaluate(samples, knowing_scorer, "run3-diagnostic", output=str(tmp_path / "e"))
    document = done.metrics.first()
    assert document["accuracy"] == pytest.approx(2 / 3) and document["binary_roc_auc"] == 1.0
    assert document["prediction_distribution"] == {"active_tb": 4, "healthy": 8}
    assert {r["check"]: r["passed"] for r in done.gate_checks.collect()} == {
        "no_zero_recall": False, "no_prediction_monopoly": True, "active_tb_predictions_minimum": True, "healthy_predictions_nonzero": True}
    assert not done.verdict.first()["passed"]
    assert spark.read.text(str(tmp_path / "e" / "predictions.jsonl")).count() == 12
    row = done.predictions.where("index = 1").first()
    assert row["predicted_label"] == "active_tb" and row["class_log_likelihoods"]["healthy"] == -2.0
    assert sum(row["class_probabilities"].values()) == pytest.approx(1.0)
    stored = json.loads(spark.read.text(str(tmp_path / "e" / "eval_results.json")).first()[0])
    assert stored["gate"] == {"name": "run3_diagnostic", "passed": False} and stored["delta"]["passed"] is False
    with pytest.raises(ValueError, match="no predictions"):
        evaluation.evaluate(samples.limit(0), knowing_scorer)


def test_evaluate_without_baseline(spark, samples, tmp_path):
    answers = spark.createDataFrame([("Classification: healthy",), ("Classification: active_tb",)], "text string")
    done = evaluation.evaluate(samples, knowing_scorer, baseline=None, output=str(tmp_path / "e"), answers=answers, metadata={"run": "4"})
    stored = json.loads(spark.read.text(str(tmp_path / "e" / "eval_results.json")).first()[0])
    assert done.delta is None and done.verdict.first()["passed"] and stored["structured_output"] is True and stored["run"] == "4"
    loose = answers.unionByName(spark.createDataFrame([("Finding: healthy",)], "text string"))
    assert not evaluation.evaluate(samples, knowing_scorer, baseline=None, answers=loose).verdict.first()["passed"]
    assert evaluation.evaluate(samples, knowing_scorer, baseline=None).verdict is None


def test_choose_samples(samples):
    assert evaluation.choose_samples(samples, limit_per_class=2).count() == 6
    assert [r["index"] for r in evaluation.choose_samples(samples, limit=3).orderBy("index").collect()] == [0, 1, 2]
    assert evaluation.choose_samples(samples).count() == 12
    with pytest.raises(ValueError, match="missing"):
        evaluation.choose_samples(samples, limit_per_class=5)


@pytest.mark.parametrize("side", ["left", "right"])
def test_collate(samples, side):
    done = scoring.collate(samples.withColumn("b", F.floor(F.col("index") / 2)), byte_tokenizer, side, batch_col="b")
    rows = done.select("*", arrays.scored_tokens(F.col("labels")).alias("n")).collect()
    assert len(rows) == 12
    for row in rows:
        widths = {len(r["input_ids"]) for r in rows if r["b"] == row["b"]}
        assert widths == {len(row["labels"])} == {len(row["attention_mask"])}
        answer = bytes(x for x in row["labels"] if x != -100).decode()
        assert row["true_label"] in answer and "role\":\"user" not in answer
        assert (row["input_ids"][0] == 0) == (side == "left" and sum(row["attention_mask"]) < len(row["input_ids"]))


def test_a_tokenizer_gets_a_bounded_part_of_a_batch(spark):
    def tokenizer(texts):
        assert texts.str.len().sum() - texts.str.len().max() < 1 << 19
        return byte_tokenizer(texts)

    rows = spark.range(0, 4000, 1, 1).select(
        F.col("id").alias("index"), F.concat(F.lit("/"), F.repeat(F.lit("p"), F.when(F.col("id") == 70, 700_000).otherwise(200))).alias("path"),
        F.lit("healthy").alias("true_label"))
    talks = rows.withColumn("messages", msg.training_messages(F.col("path"), F.col("true_label")))
    done = scoring.collate(talks, tokenizer).select("index", F.size("input_ids").alias("n"), "prompt_length", F.length("path").alias("p"))
    got = done.agg(F.count("*"), F.count_distinct(F.col("n") - F.col("p")), F.count_distinct(F.col("prompt_length") - F.col("p")), F.max("p")).first()
    assert tuple(got) == (4000, 1, 1, 700_001)
    picked = scoring.calibration_dataset(talks.where("index <> 70").withColumnRenamed("path", "image_path"), tokenizer, 50, 3000, ["healthy"])
    assert {len(r["input_ids"]) for r in picked.collect()} == {50} and picked.count() == 3000


def test_training_draws_and_batches(spark, samples, tmp_path):
    target = str(tmp_path / "train")
    sinks.write_conversations(samples, target)
    draws = balanced_sampling.training_draws(spark, target, "soft-balanced", boost_class="healthy", boost=2.0)
    rows = draws.collect()
    assert sorted(r["draw"] for r in rows) == list(range(12))
    assert all(r["label"] in r["messages_json"] for r in rows)
    batches = balanced_sampling.training_batches(draws, byte_tokenizer, 4)
    assert batches.count() == 12 and batches.select("batch").distinct().count() == 3
