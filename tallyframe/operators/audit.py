"""Image audits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe import defaults
from tallyframe.operators.ranking import smallest


def wrong_size(headers: DataFrame, size: tuple[int, int] = defaults.IMAGE_SIZE) -> DataFrame:
    """Images of another (width, height) or unreadable ones."""
    width, height = size
    return headers.where(~F.col("readable") | (F.col("width") != width) | (F.col("height") != height))


def first_violations(violations: DataFrame, order: str = "path", shown: int = 20) -> tuple[DataFrame, DataFrame]:
    """The first violations in order, and one row with the number of further ones."""
    head = smallest(violations, [order], shown, "__rank").drop("__rank")
    rest = violations.agg(F.greatest(F.count("*") - shown, F.lit(0)).alias("more"))
    return head, rest
