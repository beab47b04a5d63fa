r"""Phrases whose words stand together more often than their parts do elsewhere (operator 12).

Words that are frequent enough to be part of a frequent phrase get numbers, texts become sequences of them, and tasks count
n-grams of numbers in counting quotient filters (``quotient``), which are merged block by block. Pairs are counted first,
since a longer frequent phrase holds frequent pairs only. All counts are exact; scores and choices are DataFrame functions
over the frequent phrases alone.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm import quotient
from tallyframe.llm.batches import bound_batches
from tallyframe.operators.ranking import global_rank, smallest_per_group
from tallyframe.session import broadcast_if_small, materialize

MIN_COUNT = 30
MAX_WORDS = 4
SCALE = 2_000_000
COVERED_PERCENT = 80
TOP = 2000
NO_LANG = "und"

# Vocabulary and frequent pairs are broadcast up to so many bytes; beyond, words are joined and pairs do not prune.
MAX_BROADCAST_BYTES = 32 << 20
# Words that a task counts, and n-grams that it holds, before it hands them on.
HELD_WORDS = 300_000
HELD_GRAMS = 1 << 21
# So many words of the corpus per block of the filters; a text is tokenised in chunks of so many bytes.
WORDS_PER_BLOCK = 1 << 20
CHUNK_BYTES = 1 << 20
# Words more frequent than one in so many are joined apart from the others.
HOT_ONE_IN = 1000
LEAST_BITS = 16

# A-Z in lower case, tab to space, and every separator of pieces to a line feed.
_TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz " + b"\n" * 9)


def _chunks(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, a line feed between pieces and empty strings between spaces, cut where pieces end."""
    text = text.translate(_TABLE)
    start = 0
    while start < len(text):
        end = text.find(b"\n", start + CHUNK_BYTES) if start + CHUNK_BYTES < len(text) else -1
        end = len(text) if end < 0 else end
        yield text[start:end].replace(b"\n", b" \n ").split(b" ")
        start = end + 1


def _inputs(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(
        F.coalesce(F.col(lang_col).cast("string"), F.lit(NO_LANG)).alias("lang"),
        F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"),
    )


def count_words(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``lang``, ``word`` and how often it occurs (``n``)."""
    from collections import Counter

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}

        def rows() -> Iterator[pa.RecordBatch]:
            for lang, counter in held.items():
                del counter[b""], counter[b"\n"]
                words, counts = pa.array(counter.keys(), pa.binary()), pa.array(counter.values(), pa.int64())
                langs = pa.DictionaryArray.from_arrays(pa.array([0] * len(counter), pa.int32()), [lang]).cast(pa.string())
                yield pa.record_batch([langs, words, counts], names=["lang", "word", "n"])
            held.clear()

        for batch in batches:
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"]):
                counter = held.setdefault(lang, Counter())
                for words in _chunks(text.as_py()):
                    counter.update(words)
                    if sum(map(len, held.values())) > HELD_WORDS:
                        yield from rows()
                        counter = held.setdefault(lang, Counter())
        yield from rows()

    counted = _inputs(docs, text_col, lang_col).mapInArrow(partial, "lang string, word binary, n bigint")
    return counted.groupBy("lang", F.col("word").cast("string").alias("word")).agg(F.sum("n").alias("n"))


@functools.lru_cache(maxsize=1)
def _numbers(table: bytes) -> dict[str, dict[bytes, int]]:
    read = pa.ipc.open_stream(table).read_all()
    numbers: dict[str, dict[bytes, int]] = {}
    for lang, word, number in zip(read["lang"].to_pylist(), read["word"].to_pylist(), read["id"].to_pylist()):
        numbers.setdefault(lang, {b"": -1})[word] = number
    return numbers


def _without_gaps(ids: np.ndarray) -> np.ndarray:
    """No -1 (nothing between spaces), and one 0 (a border or a rare word) for several."""
    ids = ids[ids >= 0]
    return ids[np.append(True, (ids[1:] > 0) | (ids[:-1] > 0))] if len(ids) else ids


def _ids_by_broadcast(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    table = vocabulary.select("lang", F.col("word").cast("binary").alias("word"), "id").toArrow()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    shared = spark.sparkContext.broadcast(sink.getvalue().to_pybytes())

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, held, size = _numbers(shared.value), [], 0
        for batch in batches:
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"]):
                find = numbers.get(lang, {b"": -1}).get
                for words in _chunks(text.as_py()):
                    ids = _without_gaps(np.fromiter((find(word, 0) for word in words), np.int64, len(words)))
                    held += [ids.astype("<u4"), np.zeros(1, "<u4")]
                    size += len(ids) + 1
                    if size > CHUNK_BYTES:
                        yield pa.record_batch([pa.array([np.concatenate(held).tobytes()], pa.binary())], names=["ids"])
                        held, size = [], 0
        if held:
            yield pa.record_batch([pa.array([np.concatenate(held).tobytes()], pa.binary())], names=["ids"])

    return docs.mapInArrow(numbered, "ids binary")


def _ids_by_join(docs: DataFrame, vocabulary: DataFrame, words: int) -> DataFrame:
    """As ``_ids_by_broadcast`` for a vocabulary of any size: words meet their numbers in joins, hot words apart."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, lang, text in zip(batch["row"].to_pylist(), batch["lang"].to_pylist(), batch["text"]):
                for chunk, parts in enumerate(_chunks(text.as_py())):
                    parts = [part for part in parts if part]
                    at = [place for place, part in enumerate(parts) if part != b"\n"]
                    yield pa.record_batch(
                        [
                            pa.array([row] * len(at), pa.int64()),
                            pa.array([chunk] * len(at), pa.int64()),
                            pa.array(at, pa.int64()),
                            pa.array([lang] * len(at), pa.string()),
                            pa.array([parts[place] for place in at], pa.binary()),
                        ],
                        names=["row", "chunk", "at", "lang", "word"],
                    )

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for found in batch["found"]:
                at = np.array(found.values.field("at"), np.int64)
                spread = np.zeros(2 * len(at) + 1, np.int64)
                spread[0:-1:2] = np.array(found.values.field("id"), np.int64)
                spread[1:-1:2] = np.append(np.where(np.diff(at) == 1, -1, 0), 0) if len(at) else []
                out.append(_without_gaps(spread).astype("<u4").tobytes())
            yield pa.record_batch([pa.array(out, pa.binary())], names=["ids"])

    # Written, so that a row keeps its number when a task runs again.
    rows = docs.withColumn("row", F.monotonically_increasing_id())
    tokens = materialize(
        rows.mapInArrow(listed, "row bigint, chunk bigint, at bigint, lang string, word binary").withColumn(
            "word", F.col("word").cast("string")
        ),
        "collocation-words",
    )
    hot = F.col("n") > max(words // HOT_ONE_IN, MIN_COUNT)
    few = F.broadcast(vocabulary.where(hot).select("lang", "word", F.col("id").alias("hot_id")))
    marked = tokens.join(few, ["lang", "word"], "left")
    met = marked.where("hot_id IS NULL").join(vocabulary.where(~hot).select("lang", "word", "id"), ["lang", "word"])
    met = met.select("row", "chunk", "at", "id").unionByName(
        marked.where("hot_id IS NOT NULL").select("row", "chunk", "at", F.col("hot_id").alias("id"))
    )
    found = met.groupBy("row", "chunk").agg(F.sort_array(F.collect_list(F.struct("at", "id"))).alias("found"))
    return found.select("found").mapInArrow(packed, "ids binary")


def _pairs(ids: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Permuted pairs of neighbours."""
    both = (ids[:-1] > 0) & (ids[1:] > 0)
    return quotient.permute(ids[:-1][both], ids[1:][both], bits)


def _longer(ids: np.ndarray, bits: int, frequent: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Permuted triples and quadruples; only those of frequent pairs where these are known."""
    ids = np.concatenate([ids, np.zeros(3, np.uint64)])
    linked = (ids[:-1] > 0) & (ids[1:] > 0)
    if frequent is not None:
        high, low = quotient.permute(ids[:-1][linked], ids[1:][linked], bits)
        keys = (high << np.uint64(bits)) | low
        place = np.minimum(np.searchsorted(frequent, keys), len(frequent) - 1)
        linked[linked] = frequent[place] == keys if len(frequent) else False
    third = np.flatnonzero(linked[:-1] & linked[1:])
    fourth = third[linked[np.minimum(third + 2, len(linked) - 1)] & (third + 2 < len(linked))]
    width = np.uint64(bits)
    at = np.concatenate([third, fourth])
    last = np.concatenate([np.zeros(len(third), np.uint64), ids[fourth + 3]])
    return quotient.permute((ids[at] << width) | ids[at + 1], (ids[at + 2] << width) | last, 2 * bits)


def _filters(ids: DataFrame, bits: int, block_bits: int, longer: bool, shared=None) -> DataFrame:
    """Filters of the n-grams that single tasks met: ``block`` and ``filter``."""
    half = 2 * bits if longer else bits

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = _sorted_pairs(shared.value) if shared is not None else None
        held: list[quotient.Counted] = []

        def rows() -> Iterator[pa.RecordBatch]:
            blocks = quotient.split(quotient.merge(held, half), half, block_bits) if held else []
            held.clear()
            for start in range(0, len(blocks), 64):
                some = blocks[start : start + 64]
                yield pa.record_batch(
                    [pa.array([b for b, _ in some], pa.int64()), pa.array([f for _, f in some], pa.binary())],
                    names=["block", "filter"],
                )

        for batch in batches:
            for packed in batch["ids"]:
                sequence = np.frombuffer(packed.as_py(), "<u4").astype(np.uint64)
                high, low = _longer(sequence, bits, frequent) if longer else _pairs(sequence, bits)
                held.append(quotient.count(high, low, half))
                if sum(len(part.high) for part in held) > HELD_GRAMS:
                    held[:] = [quotient.merge(held, half)]
                    if len(held[0].high) > HELD_GRAMS // 2:
                        yield from rows()
        yield from rows()

    return ids.mapInArrow(partial, "block bigint, filter binary")


@functools.lru_cache(maxsize=1)
def _sorted_pairs(filters: tuple[bytes, ...]) -> np.ndarray:
    """All keys of filters of pairs, both halves in one number, ascending."""
    parts = [np.zeros(0, np.uint64)]
    for data in filters:
        keys, bits = quotient.decode(data)
        parts.append((keys.high << np.uint64(bits)) | keys.low)
    return np.sort(np.concatenate(parts))


def merge_filters(filters: DataFrame, min_count: int = 1) -> DataFrame:
    """One filter per block, with the counts of all, of the keys that reach ``min_count``."""

    def merged(table: pa.Table) -> pa.Table:
        decoded = [quotient.decode(data) for data in table["filter"].to_pylist()]
        bits = decoded[0][1]
        keys = quotient.merge([keys for keys, _ in decoded], bits)
        kept = keys.count >= min_count
        keys = quotient.Counted(*[column[kept] for column in keys])
        block_bits, block = table["filter"][0].as_py()[1], table["block"][0].as_py()
        return pa.table(
            {"block": [block], "filter": pa.array([quotient.encode(keys, bits, block_bits, block)], pa.binary())}
        )

    return filters.groupBy("block").applyInArrow(merged, "block bigint, filter binary")


def read_filters(filters: DataFrame, bits: int) -> DataFrame:
    """The word numbers ``w1`` to ``w4`` (0: none) of each key, and its count ``a``."""
    width, low_word = np.uint64(bits), np.uint64((1 << bits) - 1)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch["filter"]:
                keys, half = quotient.decode(data.as_py())
                high, low = quotient.restore(keys.high, keys.low, half)
                none = np.zeros(len(high), np.uint64)
                if half == bits:
                    words = [high, low, none, none]
                else:
                    words = [high >> width, high & low_word, low >> width, low & low_word]
                yield pa.record_batch(
                    [pa.array(column.astype(np.int64)) for column in (*words, keys.count)],
                    names=["w1", "w2", "w3", "w4", "a"],
                )

    return filters.mapInArrow(rows, "w1 bigint, w2 bigint, w3 bigint, w4 bigint, a bigint")


WORDS = [f"w{n}" for n in range(1, MAX_WORDS + 1)]
_SIZE = "int(w1 > 0) + int(w2 > 0) + int(w3 > 0) + int(w4 > 0)"


def _part(first: Column | int, size: Column | int) -> list[Column]:
    """The numbers of ``size`` words of a phrase from the 0-based ``first`` on, then zeros."""
    listed = F.array(*WORDS)
    return [
        F.when(F.lit(n) < size, F.coalesce(F.get(listed, first + F.lit(n)), F.lit(0))).otherwise(0).alias(name)
        for n, name in enumerate(WORDS)
    ]


def _score(counts: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Each phrase with its lowest-scoring cut: ``l``, ``r`` and ``score``; of equal scores the earliest cut."""
    none = [F.lit(0).cast("bigint").alias(name) for name in WORDS[1:]]
    parts = counts.unionByName(vocabulary.select(F.col("id").alias("w1"), *none, F.col("n").alias("a")))
    cuts = counts.select(*WORDS, "a", F.expr(f"explode(sequence(1, {_SIZE} - 1))").alias("k"))
    for name, first, size in (("l", F.lit(0), F.col("k")), ("r", F.col("k"), F.lit(MAX_WORDS))):
        key = F.struct(*_part(first, size))
        found = parts.select(F.struct(*WORDS).alias(f"{name}_key"), F.col("a").alias(name))
        cuts = cuts.withColumn(f"{name}_key", key).join(found, f"{name}_key").drop(f"{name}_key")
    # Decimals, since the products may pass 64 bits; the quotient is at most SCALE / 2.
    score = F.expr(f"(decimal({SCALE}) * cast(a AS decimal(20, 0))) div (cast(l AS decimal(20, 0)) + cast(r AS decimal(20, 0)))")
    lowest = cuts.groupBy(*WORDS, "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    return lowest.select(*WORDS, "a", "cut.l", "cut.r", "cut.score")


def _uncovered(scored: DataFrame, counts: DataFrame) -> DataFrame:
    """Without phrases that stand inside a longer one at least COVERED_PERCENT as frequent as they."""
    spans = [(first, size) for size in range(2, MAX_WORDS) for first in range(MAX_WORDS - size + 1)]
    inner = F.array(
        *[
            F.when(F.expr(_SIZE) >= F.lit(max(first + size, size + 1)), F.struct(*_part(first, size)))
            for first, size in spans
        ]
    )
    longer = counts.select(F.explode(F.filter(inner, lambda part: part.isNotNull())).alias("part"), "a")
    longest = longer.groupBy("part").agg(F.max("a").alias("longest")).select("part.*", "longest")
    covered = F.expr(f"decimal(100) * cast(longest AS decimal(20, 0)) >= decimal({COVERED_PERCENT}) * cast(a AS decimal(20, 0))")
    met = scored.join(longest, WORDS, "left")
    return met.where(F.col("longest").isNull() | ~covered).drop("longest")


def _named(phrases: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """With ``lang`` and the ``phrase`` in words instead of numbers."""
    for number, name in enumerate(WORDS):
        told = ["lang"] if number == 0 else []
        words = vocabulary.select(F.col("id").alias(name), *told, F.col("word").alias(f"word{name}"))
        phrases = phrases.join(words, name, "inner" if number < 2 else "left")
    # array_join leaves out nulls.
    return phrases.withColumn("phrase", F.array_join(F.array(*[f"word{name}" for name in WORDS]), " "))


def mine(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    min_count: int = MIN_COUNT,
    top: int = TOP,
    max_broadcast: int = MAX_BROADCAST_BYTES,
) -> DataFrame:
    r"""The ``top`` phrases of each language: ``lang, rank, phrase, a, l, r, n, score``.

    A-Z is lower-cased; texts are split at ``[.,;:!?\x0A-\x0D]`` and the pieces into words ``[^\x20\x09]+``. A phrase is two
    to four words that stand side by side in pieces of a language at least ``min_count`` times (``a``). Of its cuts into two
    parts that occur ``l`` and ``r`` times, that with the lowest score counts. Ranks go by score and ``a`` descending, then
    by the phrase in the order of its UTF-8 bytes. A null text is empty, a null language is ``und`` (with documents that
    say so), repeated rows count each, and a table without frequent phrases gives no rows. Other columns do not matter.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    words = materialize(count_words(docs, text_col, lang_col), "collocation-counts")
    order = [-F.col("n"), "lang", "word"]
    vocabulary = materialize(
        global_rank(words.where(F.col("n") >= min_count), order, rank_col="id"), "collocation-vocabulary"
    )
    total = words.agg(F.sum("n")).first()[0] or 0
    known, size = vocabulary.agg(F.count("*"), F.sum(F.octet_length("word") + F.octet_length("lang") + 8)).first()
    bits = max(LEAST_BITS, known.bit_length())
    block_bits = min(bits, max(3, (total // WORDS_PER_BLOCK).bit_length()))

    texts = _inputs(docs, text_col, lang_col)
    by_broadcast = (size or 0) <= max_broadcast
    numbered = _ids_by_broadcast(texts, vocabulary) if by_broadcast else _ids_by_join(texts, vocabulary, total)
    ids = materialize(numbered, "collocation-ids")
    pairs = materialize(merge_filters(_filters(ids, bits, block_bits, longer=False), min_count), "collocation-pairs")
    shared = None
    if (pairs.agg(F.sum(F.octet_length("filter"))).first()[0] or 0) <= max_broadcast:
        shared = spark.sparkContext.broadcast(tuple(bytes(row[0]) for row in pairs.select("filter").collect()))
    longer = materialize(
        merge_filters(_filters(ids, bits, block_bits, longer=True, shared=shared), min_count), "collocation-longer"
    )
    counts = read_filters(pairs, bits).unionByName(read_filters(longer, bits))
    counts = materialize(counts, "collocation-phrases")

    kept = _named(_uncovered(_score(counts, vocabulary), counts), vocabulary)
    kept = kept.withColumns({"by_score": -F.col("score"), "by_a": -F.col("a")})
    best = smallest_per_group(
        materialize(kept.select("lang", "by_score", "by_a", "phrase", "a", "l", "r", "score"), "collocation-scored"),
        ["by_score", "by_a", "phrase"],
        ["lang"],
        top,
    )
    # One row per language.
    totals = broadcast_if_small(words.groupBy("lang").agg(F.sum("n").alias("n")))
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
