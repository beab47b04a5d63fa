"""Token counts of whole texts (operator 1).

A string that the vocabulary provably encodes as one token counts as one without any merge; only other pre-tokens are
merged. The proof is made from the vocabulary alone, before any text is read (``word_tokens.proven_tokens``).
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm import vocab
from tallyframe.llm.word_tokens import length_table

TOKEN_LIMIT = 2048


def count_tokens(
    docs: DataFrame, text_col: str = "text", vocabulary: str = vocab.WORD_BPE, limit: int = TOKEN_LIMIT
) -> DataFrame:
    """Add ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens) to every row.

    Tokens are those of the tokenizers library for the file ``vocabulary``, without added begin or end; strings of its
    special tokens inside a text count as these tokens. A null or empty text has 0 bytes and 0 tokens. Rows are neither
    moved nor dropped, and repeated rows give repeated results. Bytes that are not UTF-8 count as U+FFFD.
    """
    data = vocab.broadcast_file(docs.sparkSession, vocabulary)

    @F.arrow_udf("bigint")
    def tokens(texts: pa.Array) -> pa.Array:
        table = length_table(data.value)
        return pa.array([sum(table.values(text.as_py())) for text in texts], pa.int64())

    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.withColumns(
        {"n_bytes": F.octet_length(text).cast("bigint"), "n_tokens": tokens(text.cast("binary"))}
    ).withColumn("over_limit", F.col("n_tokens") > limit)
