"""Class-balanced sampling for training: stored rows, weights, draws, token rows."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.functions import messages as msg
from tallyframe.operators import sampling, scoring
from tallyframe.sources.conversations import training_rows


def training_draws(
    spark: SparkSession,
    path: str,
    strategy: str = "balanced",
    exponent: float | None = None,
    boost_class: str | None = None,
    boost: float = 1.0,
    seed: int = 42,
    limit: int | None = None,
) -> DataFrame:
    """``draw, messages_json, label``: as many draws with replacement as the file has rows."""
    rows = sampling.require_labels(training_rows(spark, path, limit))
    return sampling.weighted_draws(
        rows, "label", ["messages_json"], seed, None, boost_class, boost, sampling.weight_exponent(exponent, strategy)
    )


def training_batches(
    draws: DataFrame, tokenizer: Callable[[pd.Series], pd.Series], batch_size: int = 2, padding_side: str = "left"
) -> DataFrame:
    """Token rows of consecutive draws, padded inside each batch."""
    talks = sampling.batches(draws, batch_size, "draw").withColumn(
        "messages", msg.feature_messages(F.lit(None).cast(msg.MESSAGES_TYPE), F.col("messages_json"))
    )
    return scoring.collate(talks, tokenizer, padding_side, batch_col="batch")
