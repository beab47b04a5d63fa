"""Writers. Outputs are Spark output folders; documents are written as one file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.functions import messages as msg


def write_conversations(df: DataFrame, path: str, by_split: bool = False, mode: str = "error") -> None:
    """One JSON object per line; ``by_split`` writes one sub-folder ``split=...`` per split in the same job."""
    line = msg.jsonl_line(F.col("messages")).alias("value")
    if by_split:
        df.select("split", line).write.mode(mode).partitionBy("split").text(path)
    else:
        df.select(line).write.mode(mode).text(path)


def sorted_json(df: DataFrame) -> DataFrame:
    """Rows as JSON text with the top-level keys in alphabetical order."""
    return df.select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("value"))


def write_json_lines(df: DataFrame, path: str, mode: str = "error") -> None:
    sorted_json(df).write.mode(mode).text(path)


def write_document(df: DataFrame, path: str, mode: str = "error") -> None:
    """A one-row table as one key-sorted JSON document."""
    sorted_json(df).coalesce(1).write.mode(mode).text(path)


def write_evaluation(metrics: DataFrame, predictions: DataFrame, path: str, mode: str = "error") -> tuple[str, str]:
    """Metrics document and prediction lines below ``path``."""
    targets = f"{path}/eval_results.json", f"{path}/predictions.jsonl"
    write_document(metrics, targets[0], mode)
    write_json_lines(predictions, targets[1], mode)
    return targets


def sample_array(samples: DataFrame) -> DataFrame:
    """A few conversations (one per class) as one JSON array in ``position`` order."""
    lines = F.sort_array(F.collect_list(F.struct("position", msg.jsonl_line(F.col("messages")).alias("line"))))
    return samples.agg(
        F.concat(F.lit("["), F.array_join(F.transform(lines, lambda x: x["line"]), ","), F.lit("]")).alias("value")
    )


def write_sample_array(samples: DataFrame, path: str, mode: str = "error") -> None:
    sample_array(samples).coalesce(1).write.mode(mode).text(path)
