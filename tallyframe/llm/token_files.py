"""Token ids of whole texts in compressed files (operator 8).

Format: ``<path>/code`` holds a code length per id, from the counts of all ids; ``<path>/blocks`` holds blocks of whole
documents in ascending order: part, place in the part, ids before it in the part, the documents' ids and numbers of
tokens, the Huffman bits and the bit offsets of the checkpoints. A block needs nothing but the code to be decoded, from
any checkpoint on. Both are Parquet, written and read by Spark on any store.
"""

from __future__ import annotations

import functools
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyframe.llm import vocab
from tallyframe.llm.word_tokens import PieceTable
from tallyframe.session import materialize

END_ID = 1
# A block ends with the document that fills it.
BLOCK_IDS = 1 << 18

_COUNTS = "id int, n bigint"
_BLOCKS = (
    "part int, block int, first bigint, docs array<bigint>, sizes array<bigint>, bits binary, checkpoints binary"
)
_DOCUMENTS = "part int, doc bigint, first bigint, n_tokens bigint, ids binary"


def _pack_ids(ids: list[int]) -> bytes:
    return array("H", ids).tobytes()


@functools.lru_cache(maxsize=2)
def _id_table(data: bytes) -> PieceTable:
    return PieceTable(data, _pack_ids)


def tokenize(docs: DataFrame, text_col: str = "text", vocabulary: str = vocab.WORD_BPE, end_id: int = END_ID) -> DataFrame:
    """Add ``ids``: token ids of the whole text and ``end_id``, as unsigned 16-bit integers in the machine's order.

    A null or empty text has the end id only. Ids above 65,535 are an error.
    """
    data = vocab.broadcast_file(docs.sparkSession, vocabulary)

    @F.arrow_udf("binary")
    def ids(texts: pa.Array) -> pa.Array:
        end = _pack_ids([end_id])
        table = _id_table(data.value)
        return pa.array([b"".join(table.values(text.as_py())) + end for text in texts], pa.binary())

    return docs.withColumn("ids", ids(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))


def _count_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import numpy as np

    total = np.zeros(1 << 16, np.int64)
    for batch in batches:
        ids = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint16)
        total += np.bincount(ids, minlength=1 << 16)
    used = np.flatnonzero(total)
    yield pa.record_batch([pa.array(used, pa.int32()), pa.array(total[used], pa.int64())], ["id", "n"])


def id_counts(tokens: DataFrame) -> DataFrame:
    """``id`` and ``n`` over all rows of ``ids``; each task hands on one row per id that it met."""
    counted = tokens.select("ids").mapInArrow(_count_ids, _COUNTS)
    return counted.groupBy("id").agg(F.sum("n").alias("n"))


def _lengths(rows) -> "np.ndarray":  # noqa: F821
    import numpy as np

    out = np.zeros(1 << 16, np.uint8)
    for row in rows:
        out[row["id"]] = row["length"]
    return out


def write_tokens(tokens: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """Write ``tokens`` (``id_col`` bigint and ``ids``) to the empty folder ``path``, in ascending order of ``id_col``.

    Null ids come first; rows of one id stand side by side in any order. The ids of the vocabulary (65,536 at most) and
    their counts are all that the driver sees.
    """
    import numpy as np

    from tallyframe.llm import huffman

    spark = tokens.sparkSession
    stored = materialize(
        tokens.select(F.col(id_col).cast("bigint").alias("doc"), F.monotonically_increasing_id().alias("uid"), "ids"),
        "token-ids",
    )
    counts = np.zeros(1 << 16, np.int64)
    for row in id_counts(stored).collect():
        counts[row["id"]] = row["n"]
    lengths = huffman.code_lengths(counts)
    table = pa.table({"id": np.flatnonzero(lengths).astype(np.int32), "length": lengths[lengths > 0].astype(np.int32)})
    spark.createDataFrame(table).coalesce(1).write.parquet(f"{path}/code")
    shared = spark.sparkContext.broadcast(lengths)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, coded = shared.value, huffman.codes(shared.value)
        part = TaskContext.get().partitionId()
        docs: list = []
        parts: list[bytes] = []
        number = first = held = 0

        def block() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(parts), np.uint16)
            bits, checkpoints = huffman.pack(ids, size, coded)
            row = [part, number, first, docs, [len(p) // 2 for p in parts], bits, checkpoints.astype("<u8").tobytes()]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
            names = ["part", "block", "first", "docs", "sizes", "bits", "checkpoints"]
            return pa.record_batch([pa.array([v], k) for v, k in zip(row, kinds)], names)

        for batch in batches:
            for doc, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                docs.append(doc)
                parts.append(ids)
                held += len(ids) // 2
                if held >= BLOCK_IDS:
                    yield block()
                    docs, parts, number, first, held = [], [], number + 1, first + held, 0
        if docs:
            yield block()

    # Parts are numbered in order, for each task writes one range of ids.
    placed = stored.repartitionByRange("doc", "uid").sortWithinPartitions("doc", "uid").select("doc", "ids")
    placed.mapInArrow(blocks, _BLOCKS).write.option("compression", "none").parquet(f"{path}/blocks")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``doc``, ``start`` (ids of all documents before it), ``n_tokens`` and ``ids`` (little-endian unsigned 32-bit)."""
    from tallyframe.llm import huffman

    shared = spark.sparkContext.broadcast(_lengths(spark.read.parquet(f"{path}/code").collect()))

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        decoder = huffman.Decoder(shared.value)
        for batch in batches:
            for row in batch.to_pylist():
                sizes = np.array(row["sizes"], np.int64)
                ends = np.cumsum(sizes)
                ids = decoder.unpack(row["bits"], np.frombuffer(row["checkpoints"], "<u8"), int(ends[-1]))
                raw = memoryview(ids.astype("<u4").tobytes())
                cut = [bytes(raw[4 * (end - size) : 4 * end]) for end, size in zip(ends.tolist(), sizes.tolist())]
                columns = [
                    pa.array([row["part"]] * len(cut), pa.int32()),
                    pa.array(row["docs"], pa.int64()),
                    pa.array(row["first"] + ends - sizes, pa.int64()),
                    pa.array(sizes, pa.int64()),
                    pa.array(cut, pa.binary()),
                ]
                yield pa.record_batch(columns, ["part", "doc", "first", "n_tokens", "ids"])

    blocks = spark.read.parquet(f"{path}/blocks")
    # One row per part.
    sizes = blocks.select("part", F.aggregate("sizes", F.lit(0).cast("bigint"), lambda n, s: n + s).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.groupBy("part").agg(F.sum("n").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")
    )
    found = blocks.select("part", "first", "docs", "sizes", "bits", "checkpoints").mapInArrow(documents, _DOCUMENTS)
    # As many rows as the write had tasks, whatever the table holds.
    return found.join(F.broadcast(offsets), "part").select("doc", (F.col("offset") + F.col("first")).alias("start"), "n_tokens", "ids")
