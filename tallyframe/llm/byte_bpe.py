"""Byte-level BPE: whole texts to token ids and back (operator 2).

A text of any length is cut into overlapping chunks that are encoded in parallel. Around each cut the bytes are
pre-tokenised twice, once from before the cut and once from the cut itself; the first boundary that both have, next to
ASCII on either side, is where the pieces meet. Both neighbours see the same bytes around the cut, so they find the
same place. Pre-tokens do not depend on what precedes their start, so the pieces' ids, one after another, are the
text's ids. Texts within one chunk are encoded where they are, without a shuffle.
"""

from __future__ import annotations

import base64
import functools
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm import vocab

CHUNK_BYTES = 32 << 10
OVERLAP_BYTES = 1 << 10

# A letter, digit or sign followed by white space: no pre-token of the pattern goes across.
_CERTAIN = re.compile(rb"[!-~][\t-\r ]")
# White space of Unicode. Long runs are cut out, for the library's own matcher recurses over them.
_LONG_SPACE = re.compile("[\t-\r \x85\xa0  -     　]{20000,}")


@functools.lru_cache(maxsize=4)
def _pre_token(pattern: str):
    import regex

    return regex.compile(pattern)


def meeting_point(around: bytes, cut: int, pattern: str = vocab.BYTE_PATTERN) -> int | None:
    """The first offset behind ``cut`` that is a boundary of pre-tokens from the start of ``around`` and from ``cut``."""
    while cut < len(around) and around[cut] & 0xC0 == 0x80:
        cut += 1
    start = 0
    while start < cut and around[start] & 0xC0 == 0x80:
        start += 1
    match = _pre_token(pattern)

    def boundaries(begin: int) -> set[int]:
        found, at = set(), begin
        for token in match.finditer(around[begin:].decode("utf-8", "replace")):
            found.add(at)
            at += len(token.group().encode("utf-8"))
        return found

    common = boundaries(start) & boundaries(cut)
    return min((at for at in common if at > cut and _CERTAIN.match(around, at - 1)), default=None)


def encode_text(encoding, text: str) -> bytes:
    """Ids of one text as little-endian unsigned 32-bit integers."""
    import numpy as np

    ids: list[int] = []
    at = 0
    for run in _LONG_SPACE.finditer(text):
        # Before a character that is not white space the run leaves its last character to the next pre-token.
        end = run.end() if run.end() == len(text) else run.end() - 1
        ids += encoding.encode_ordinary(text[at : run.start()])
        ids += encoding._encode_single_piece(text[run.start() : end])
        at = end
    ids = ids + encoding.encode_ordinary(text[at:]) if at else encoding.encode_ordinary(text)
    return np.array(ids, "<u4").tobytes()


def _chunks(raw: Column, chunk: int, overlap: int) -> Column:
    """Chunks of ``raw`` with ``overlap`` bytes more on both sides."""
    count = F.ceil(F.octet_length(raw) / chunk).cast("int")
    return F.transform(
        F.sequence(F.lit(0), count - 1),
        lambda k: F.struct(
            k.alias("k"),
            (k == 0).alias("first"),
            (k == count - 1).alias("last"),
            F.substring(
                raw,
                F.greatest(F.lit(1), k * chunk - overlap + 1),
                F.when(k == 0, chunk + overlap).otherwise(chunk + 2 * overlap),
            ).alias("bytes"),
        ),
    )


@functools.lru_cache(maxsize=4)
def _token_bytes(data: bytes) -> tuple["np.ndarray", "np.ndarray", "np.ndarray"]:  # noqa: F821
    """All tokens' bytes one after another by id, and where each starts and how long it is."""
    import numpy as np

    ranks = sorted((int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, data.splitlines()) if token)
    sizes = np.zeros(ranks[-1][0] + 1, np.int64)
    sizes[[rank for rank, _ in ranks]] = [len(token) for _, token in ranks]
    return np.frombuffer(b"".join(token for _, token in ranks), np.uint8), np.cumsum(sizes) - sizes, sizes


def decode_ids(data: bytes, raw: bytes) -> bytes:
    """The bytes of the tokens whose ids, unsigned 32-bit little-endian, are in ``raw``."""
    import numpy as np

    whole, starts, sizes = _token_bytes(data)
    out = []
    ids = np.frombuffer(raw, "<u4")
    # A part at a time bounds the memory for texts of any length.
    for at in range(0, len(ids), 1 << 16):
        part = ids[at : at + (1 << 16)]
        size = sizes[part]
        if not size.all():
            raise ValueError("an id is not in the vocabulary")
        first = starts[part] - (np.cumsum(size) - size)
        out.append(whole[np.repeat(first, size) + np.arange(size.sum())].tobytes())
    return b"".join(out)


def encode(
    docs: DataFrame,
    text_col: str = "text",
    vocabulary: str = vocab.BYTE_BPE,
    pattern: str = vocab.BYTE_PATTERN,
    chunk_bytes: int = CHUNK_BYTES,
    overlap_bytes: int = OVERLAP_BYTES,
    decoded_col: str | None = None,
) -> DataFrame:
    """Add ``ids`` (binary, little-endian unsigned 32-bit) and ``n_tokens`` to every row.

    Ids are those of the tiktoken library for the ranks in ``vocabulary``, without special tokens. A null or empty text
    has no ids. Repeated long texts are encoded once. A text that has no meeting point near one of its cuts (no white
    space in ``overlap_bytes``) is encoded as a whole in one task. Bytes that are not UTF-8 are read as U+FFFD.
    ``overlap_bytes`` must be less than ``chunk_bytes``. With ``decoded_col`` the same tasks decode the ids again, as
    ``decode`` does, into that column.
    """
    data = vocab.broadcast_file(docs.sparkSession, vocabulary)

    @F.arrow_udf("struct<ids binary, decoded binary>")
    def coded(known: pa.Array, texts: pa.Array) -> pa.Array:
        """Ids that are known, or else those of the text."""
        encoding = vocab.byte_encoding(data.value, pattern)
        ids, decoded = [], []
        for found, text in zip(known, texts):
            found = found.as_py()
            if found is None:
                found = encode_text(encoding, (text.as_py() or b"").decode("utf-8", "replace"))
            ids.append(found)
            decoded.append(decode_ids(data.value, found) if decoded_col else None)
        return pa.StructArray.from_arrays([pa.array(ids, pa.binary()), pa.array(decoded, pa.binary())], ["ids", "decoded"])

    @F.arrow_udf("binary")
    def piece(firsts: pa.Array, lasts: pa.Array, chunks: pa.Array) -> pa.Array:
        encoding = vocab.byte_encoding(data.value, pattern)
        out = []
        for first, last, raw in zip(firsts.to_pylist(), lasts.to_pylist(), chunks.to_pylist()):
            begin, end = 0, len(raw)
            if not first:
                begin = meeting_point(raw[: 2 * overlap_bytes], overlap_bytes, pattern)
            if not last:
                at = (0 if first else overlap_bytes) + chunk_bytes - overlap_bytes
                found = meeting_point(raw[at : at + 2 * overlap_bytes], overlap_bytes, pattern)
                end = None if found is None else at + found
            known = begin is not None and end is not None
            out.append(encode_text(encoding, raw[begin:end].decode("utf-8", "replace")) if known else None)
        return pa.array(out, pa.binary())

    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    nothing = F.lit(None).cast("binary")
    code = "__llm_code"
    long = F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)) > chunk_bytes
    short_rows = docs.where(~long).withColumn(code, coded(nothing, raw))

    key = "__llm_text_key"
    long_rows = docs.where(long).withColumn(key, F.sha2(raw, 256))
    cut = (
        long_rows.select(key, F.explode(_chunks(raw, chunk_bytes, overlap_bytes)).alias("c"))
        .select(key, "c.*")
        # One row per text and chunk: deals out the chunks, and encodes repeated texts once.
        .groupBy(key, "k")
        .agg(F.first("first").alias("first"), F.first("last").alias("last"), F.first("bytes").alias("bytes"))
        .select(key, "k", piece("first", "last", "bytes").alias("piece"))
    )
    # The pieces of one text in order; null where one of them has no ends.
    joined = cut.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("k", "piece"))).alias("pieces")).select(
        key,
        F.when(
            ~F.exists("pieces", lambda p: p["piece"].isNull()),
            F.unhex(F.array_join(F.transform("pieces", lambda p: F.hex(p["piece"])), "")),
        ).alias("__llm_ids"),
    )
    found = long_rows.join(joined, key, "left")
    unknown = F.when(F.col("__llm_ids").isNull(), raw)
    long_encoded = found.withColumn(code, coded(F.col("__llm_ids"), unknown))
    named = {"ids": F.col(f"{code}.ids"), "n_tokens": (F.octet_length(f"{code}.ids") / 4).cast("bigint")}
    if decoded_col:
        named[decoded_col] = F.col(f"{code}.decoded")
    columns = [c for c in docs.columns if c.lower() not in {name.lower() for name in named}]
    out = short_rows.select(*columns, code).unionByName(long_encoded.select(*columns, code))
    return out.withColumns(named).drop(code)


def decode(rows: DataFrame, ids_col: str = "ids", out_col: str = "decoded", vocabulary: str = vocab.BYTE_BPE) -> DataFrame:
    """Add ``out_col``: the bytes of the tokens in ``ids_col``, one after another. Null ids give null.

    An id that the vocabulary lacks, or a column whose size is not a multiple of four, is an error.
    """
    data = vocab.broadcast_file(rows.sparkSession, vocabulary)

    @F.arrow_udf("binary")
    def text(ids: pa.Array) -> pa.Array:
        out = [None if row.as_py() is None else decode_ids(data.value, row.as_py()) for row in ids]
        return pa.array(out, pa.binary())

    return rows.withColumn(out_col, text(ids_col))
