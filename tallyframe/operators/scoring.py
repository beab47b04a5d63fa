"""Scoring samples against candidate labels.

The scorer is a user function over pandas Series, run in Arrow batches. Each sample keeps its candidates side by side in
one row, so neither the expansion nor the way back needs a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyframe import defaults
from tallyframe.functions import arrays
from tallyframe.functions import messages as msg
from tallyframe.operators.sampling import calibration_sample, require_none, round_robin

# How much text a user's tokenizer gets at once.
CHARACTERS_AT_ONCE = 1 << 18


def expand_candidates(df: DataFrame, labels: Sequence[str], candidate_col: str = "candidate") -> DataFrame:
    """One row per sample and candidate with the candidate's place in the list."""
    listed = F.array(*[F.lit(label) for label in labels])
    return df.select(*df.columns, F.posexplode(listed).alias("candidate_order", candidate_col))


def regroup_scores(
    scored: DataFrame, keys: Sequence[str], score_col: str = "score", candidate_col: str = "candidate"
) -> DataFrame:
    """Long scores back to one row per sample: ``scores`` in candidate order and ``score_by_label``."""
    entries = F.array_sort(F.collect_list(F.struct("candidate_order", candidate_col, score_col)))
    grouped = scored.groupBy(*keys).agg(entries.alias("__entries"))
    return grouped.select(
        *keys,
        F.transform("__entries", lambda e: e[score_col]).alias("scores"),
        F.map_from_arrays(
            F.transform("__entries", lambda e: e[candidate_col]), F.transform("__entries", lambda e: e[score_col])
        ).alias("score_by_label"),
    )


def predictions_from_scores(
    df: DataFrame,
    labels: Sequence[str] = defaults.CLASS_LABELS,
    positive: Sequence[str] = defaults.POSITIVE_LABELS,
    scores_col: str = "scores",
) -> DataFrame:
    """Prediction rows from an array of scores in label order: probabilities, argmax and positive score."""
    with_probabilities = df.withColumn("__p", arrays.softmax(F.col(scores_col)))
    probabilities = F.col("__p")
    return with_probabilities.select(
        *[c for c in df.columns if c != scores_col],
        arrays.argmax_label(probabilities, labels).alias("predicted_label"),
        arrays.positive_score(probabilities, labels, positive).alias("binary_score"),
        arrays.labelled(probabilities, labels).alias("class_probabilities"),
        arrays.labelled(F.col(scores_col), labels).alias("class_log_likelihoods"),
    )


def score_conversations(
    samples: DataFrame,
    scorer: Callable[[pd.Series, pd.Series], pd.Series],
    labels: Sequence[str] = defaults.CLASS_LABELS,
    positive: Sequence[str] = defaults.POSITIVE_LABELS,
) -> DataFrame:
    """Score every candidate answer of every sample with ``scorer(conversation_json, prompt_json) -> float``.

    ``samples`` has ``index, messages, true_label, image_path``. One user function gets the prompt and the answers of a
    sample once and calls ``scorer`` once per batch, for all candidates of all samples in it.
    """
    count = len(labels)

    @F.pandas_udf("array<double>")
    def run(prompts: pd.Series, answers: pd.Series) -> pd.Series:
        # A conversation is its prompt, a list of at most one message, and the answer.
        talks = [
            prompt[:-1] + ("," if len(prompt) > 2 else "") + answer + "]"
            for prompt, listed in zip(prompts, answers)
            for answer in listed
        ]
        scores = scorer(pd.Series(talks), prompts.repeat(count).reset_index(drop=True))
        return pd.Series(list(np.asarray(scores, dtype=float).reshape(-1, count)))

    talk = F.col("messages")
    answers = [msg.messages_json(F.slice(msg.candidate_messages(talk, label, labels), 2, 1)) for label in labels]
    bare = F.array(*[F.substr(answer, F.lit(2), F.length(answer) - 2) for answer in answers])
    prompt = F.coalesce(msg.messages_json(msg.prompt_messages(talk)), F.lit("[]"))
    scored = samples.withColumn("scores", run(prompt, bare)).drop("messages")
    return predictions_from_scores(scored, labels, positive)


def score_features(
    samples: DataFrame,
    feature_col: str,
    scorer: Callable[[pd.Series], pd.Series],
    labels: Sequence[str],
    positive: Sequence[str] = (),
) -> DataFrame:
    """Score all candidates of a sample at once with ``scorer(feature) -> array of one score per label``."""
    run = F.pandas_udf(scorer, "array<double>")
    return predictions_from_scores(samples.withColumn("scores", run(feature_col)).drop(feature_col), labels, positive)


def _pieces(*columns: pd.Series) -> Iterator[tuple[pd.Series, ...]]:
    """Consecutive rows of a batch of texts with about ``CHARACTERS_AT_ONCE`` characters, one row at least.

    Ids take 8 bytes for each byte of a text or less, and a batch has a bound on its rows but none on its ids.
    """
    sizes = sum(column.str.len().fillna(0).astype("int64") for column in columns)
    number = (sizes.cumsum() - sizes) // CHARACTERS_AT_ONCE
    for _, rows in number.groupby(number, sort=False):
        yield tuple(column.loc[rows.index] for column in columns)


def collate(
    df: DataFrame,
    tokenizer: Callable[[pd.Series], pd.Series],
    padding_side: str = "left",
    pad_id: int = 0,
    batch_col: str | None = None,
) -> DataFrame:
    """Token rows from conversations: ``input_ids, attention_mask, prompt_length, labels``.

    ``tokenizer(conversation_json) -> array of ids`` runs on the full conversation and on its prompt alone. With
    ``batch_col`` rows are padded to the longest row of their batch.
    """

    @F.pandas_udf("ids array<bigint>, prompt_length int")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for talks, prompts in _pieces(*batch):
                # Of the prompt, only its length is sent back.
                lengths = [None if ids is None else len(ids) for ids in tokenizer(prompts.reset_index(drop=True))]
                ids = tokenizer(talks.reset_index(drop=True)).reset_index(drop=True)
                yield pd.DataFrame({"ids": ids, "prompt_length": pd.Series(lengths, dtype="Int32")})

    talk = F.col("messages")
    rows = df.withColumn("__tokens", run(msg.messages_json(talk), msg.messages_json(msg.prompt_messages(talk))))
    rows = rows.withColumn("__ids", F.col("__tokens.ids")).withColumn("prompt_length", F.col("__tokens.prompt_length"))
    rows = rows.drop("__tokens")
    if batch_col is None:
        rows = rows.withColumn("__width", F.size("__ids"))
    else:
        # A batch is small, and the tokenizer need not run once more for the widths.
        rows = rows.withColumn("__width", F.max(F.size("__ids")).over(Window.partitionBy(batch_col)))
    gap = F.col("__width") - F.size("__ids")
    ids, pad = F.col("__ids"), F.array_repeat(F.lit(pad_id).cast("bigint"), gap)
    on = F.transform(ids, lambda x: F.lit(1).cast("bigint"))
    off = F.array_repeat(F.lit(0).cast("bigint"), gap)
    left = padding_side == "left"
    padded = rows.withColumn("input_ids", F.concat(pad, ids) if left else F.concat(ids, pad)).withColumn(
        "attention_mask", F.concat(off, on) if left else F.concat(on, off)
    )
    targets = arrays.mask_prompt(F.col("input_ids"), F.col("attention_mask"), F.col("prompt_length"), padding_side)
    return padded.withColumn("labels", targets).drop("__ids", "__width")


def batch_problems(df: DataFrame, ignore: int = defaults.IGNORE_INDEX) -> DataFrame:
    """Token rows that cannot be trained on, with the reason."""
    targets, ids = F.col("labels"), F.col("input_ids")
    reason = (
        F.when(F.size(targets) != F.size(ids), "labels and input_ids differ in length")
        .when(arrays.scored_tokens(targets, ignore) == 0, "no scored token")
        .when(arrays.masked_tokens(targets, ignore) == 0, "no masked token")
    )
    return df.withColumn("problem", reason).where("problem is not null")


def batch_summary(
    df: DataFrame,
    required: Sequence[str] = defaults.REQUIRED_BATCH_FIELDS,
    ignore: int = defaults.IGNORE_INDEX,
    strict: bool = False,
) -> DataFrame:
    """Scored and masked tokens per row; a missing field is an error, ``strict`` makes a bad row one too."""
    absent = sorted(set(required) - set(df.columns))
    if absent:
        raise ValueError(f"The batch lacks fields: {', '.join(absent)}")
    if strict:
        require_none(batch_problems(df, ignore).select("problem"), "Invalid batch rows")
    targets = F.col("labels")
    return df.withColumn("label_tokens", arrays.scored_tokens(targets, ignore)).withColumn(
        "masked_tokens", arrays.masked_tokens(targets, ignore)
    )


def preprocess(
    records: DataFrame, processor: Callable[[pd.DataFrame], pd.DataFrame], schema: str, limit: int | None = 10
) -> DataFrame:
    """Run a user processor over a balanced subset of the records; ``messages`` holds the training conversation.

    ``processor`` gets Arrow batches as pandas frames and returns frames of ``schema``.
    """
    chosen = records if limit is None else round_robin(records, "category", ["path"], limit)
    ready = chosen.withColumn(
        "messages_json", msg.messages_json(msg.training_messages(F.col("path"), F.col("category")))
    )

    def run(batches):
        for frame in batches:
            yield processor(frame)

    return ready.mapInPandas(run, schema)


def calibration_dataset(
    samples: DataFrame,
    tokenizer: Callable[[pd.Series], pd.Series],
    max_length: int,
    total: int = defaults.CALIBRATION_SIZE,
    classes: Sequence[str] = defaults.CLASS_LABELS,
    index_col: str = "index",
) -> DataFrame:
    """Token ids, cut at ``max_length``, of a balanced sample with answers and image URIs."""

    @F.pandas_udf("array<bigint>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            for (talks,) in _pieces(batch):
                yield tokenizer(talks.reset_index(drop=True))

    picked = calibration_sample(samples, "true_label", [index_col], total, classes)
    talk = msg.messages_json(msg.vision_messages(F.col("messages"), include_answer=True))
    return picked.select("position", F.slice(run(talk), 1, max_length).alias("input_ids"))
