"""Saliency maps from saved activations and gradients, one row per sample and no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe import defaults
from tallyframe.functions import arrays
from tallyframe.operators.sampling import require_none


def token_saliency(df: DataFrame, activations: str = "activations", gradients: str = "gradients") -> DataFrame:
    """Add ``method`` and ``token_scores`` from two ``array<array<...>>`` (token, channel) columns."""
    result = arrays.token_saliency(F.col(activations), F.col(gradients))
    return df.withColumn("__s", result).select(*df.columns, "__s.method", F.col("__s.scores").alias("token_scores"))


def grid_map(df: DataFrame, scores: str = "token_scores", grid: str = "grid") -> DataFrame:
    """Add ``cells``: the token scores as an h x w map in row order, from ``grid struct<t,h,w>``."""
    size = F.col(grid)
    return df.withColumn("cells", arrays.spatial_map(F.col(scores), size["t"], size["h"], size["w"]))


def heat_map(
    df: DataFrame,
    cells: str = "cells",
    low: float = defaults.CLIP_PERCENTILES[0],
    high: float = defaults.CLIP_PERCENTILES[1],
    gamma: float = defaults.GAMMA,
) -> DataFrame:
    """Add ``heat``: percentile-clipped values in 0..1."""
    return df.withColumn("heat", arrays.percentile_normalize(F.col(cells), low, high, gamma))


def finite_maps(df: DataFrame, grid: str, strict: bool = False) -> DataFrame:
    """Rows whose 2-D map is rectangular and finite; ``strict`` raises when there are others."""
    good = arrays.is_finite_grid(F.col(grid))
    if strict:
        require_none(df.where(~good).agg(F.count("*").alias("bad_maps")).where("bad_maps > 0"), "Invalid maps")
    return df.where(good)
