"""Vocabulary files of public tokenizers: read once by the driver, sent to the tasks, opened once per Python worker."""

from __future__ import annotations

import base64
import functools
import os

import public_tokenizers
from pyspark import Broadcast
from pyspark.sql import SparkSession

from tallyframe.llm.batches import bound_batches

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.tiktoken")
BYTE_PATTERN = public_tokenizers.PATTERN

# A vocabulary file is a parameter of fixed size; a larger file is refused rather than broadcast.
MAX_VOCABULARY_BYTES = 64 << 20


def broadcast_file(spark: SparkSession, path: str) -> Broadcast:
    """The bytes of the vocabulary file at ``path`` (a folder of the driver), for use in tasks that read texts."""
    bound_batches(spark)
    size = os.path.getsize(path)
    if size > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} has {size} bytes; a vocabulary has {MAX_VOCABULARY_BYTES} at most")
    with open(path, "rb") as file:
        return spark.sparkContext.broadcast(file.read())


@functools.lru_cache(maxsize=4)
def word_tokenizer(data: bytes):
    """The tokenizer of a ``tokenizers`` file, one thread, without truncation and padding."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(data.decode("utf-8"))
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


@functools.lru_cache(maxsize=4)
def byte_encoding(data: bytes, pattern: str = BYTE_PATTERN):
    """The byte-level encoding of a rank file (one base64 token and its rank per line), without special tokens."""
    import tiktoken

    ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines()) if token}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
