"""Token counts, byte-level BPE and token files against the public libraries."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.llm import byte_bpe, huffman, queries, token_counts, token_files, vocab, word_tokens
from tallyframe.session import scratch_path
from tests.llm.conftest import SF, prose


@pytest.fixture(scope="module")
def word_file():
    with open(vocab.WORD_BPE, "rb") as file:
        return file.read()


@pytest.fixture(scope="module")
def ranks():
    with open(vocab.BYTE_BPE, "rb") as file:
        return vocab.byte_encoding(file.read())


def library_ids(data, text):
    return vocab.word_tokenizer(data).encode(text or "", add_special_tokens=False).ids


def test_pieces_encode_as_in_the_library(word_file):
    table = word_tokens.PieceTable(word_file, tuple)
    texts = ["", "It's 12,5% of a<|endoftext|>b <|ENDOFTEXT|> ''s", "H̱ T̈ İ ΑΣ ﬁ ½", "日本語テキスト 🙂👍🏽 x​y", "a" * 700]
    texts += ["a" + chr(c) + "b" + chr(c) + " " + chr(c) + "'s9" + chr(c) for c in [*range(1, 0x250), *range(0x2000, 0x2040)]]
    for text in texts:
        assert [n for ids in table.values(text.encode()) for n in ids] == library_ids(word_file, text), repr(text)


def test_whole_tokens_are_single_tokens(word_file):
    proven = word_tokens.proven_tokens(word_file)
    table = word_tokens.PieceTable(word_file, tuple)
    sample = sorted(table.whole)[::500]
    assert len(proven) > 49_000 and all(library_ids(word_file, text) == [table.whole[text]] for text in sample)


def test_a_full_table_starts_anew(word_file, monkeypatch):
    monkeypatch.setattr(word_tokens, "TABLE_ENTRIES", 0)
    table = word_tokens.PieceTable(word_file, tuple)
    text = prose(3, 50)
    assert [n for ids in table.values(text.encode()) for n in ids] == library_ids(word_file, text)
    assert len(table.known) <= len(table.known.seed) + 1


def test_token_counts(awkward, nothing, word_file):
    counted = token_counts.count_tokens(awkward).collect()
    assert len(counted) == awkward.count()
    for row in counted:
        count = len(library_ids(word_file, row.text))
        assert (row.n_tokens, row.n_bytes, row.over_limit) == (count, len((row.text or "").encode()), count > 2048)
    assert token_counts.count_tokens(nothing).collect() == []


@pytest.mark.parametrize("chunk, overlap", [(64, 16), (1024, 128), (byte_bpe.CHUNK_BYTES, byte_bpe.OVERLAP_BYTES)])
def test_byte_bpe_round_trip(awkward, ranks, chunk, overlap):
    encoded = byte_bpe.encode(awkward, chunk_bytes=chunk, overlap_bytes=overlap)
    rows = byte_bpe.decode(encoded).collect()
    at_once = byte_bpe.encode(awkward, chunk_bytes=chunk, overlap_bytes=overlap, decoded_col="Decoded").collect()
    key = lambda row: (str(row.doc_id), bytes(row.ids), bytes(row[-1]))
    assert sorted(map(key, rows)) == sorted(map(key, at_once))
    assert len(rows) == awkward.count()
    for row in rows:
        ids = np.array(ranks.encode_ordinary(row.text or ""), "<u4")
        assert (bytes(row.ids), row.n_tokens) == (ids.tobytes(), len(ids))
        assert bytes(row.decoded).decode() == (row.text or "")


def test_long_white_space(spark, ranks):
    texts = ["a" + " " * 70_000 + "b", "\n" * 50_000, " " * 30_000 + "x"]
    rows = byte_bpe.encode(spark.createDataFrame([(t,) for t in texts], "text string")).collect()
    for row in rows:
        assert bytes(row.ids) == np.array(ranks.encode_ordinary(row.text), "<u4").tobytes()


def test_meeting_points_are_pre_token_boundaries():
    import regex

    text = (prose(4, 40) + " don't!!  \n\n é12 ") * 3
    raw = text.encode()
    bounds, at = set(), 0
    for token in regex.findall(vocab.BYTE_PATTERN, text):
        bounds.add(at)
        at += len(token.encode())
    for cut in range(40, len(raw) - 40, 7):
        point = byte_bpe.meeting_point(raw[cut - 40 : cut + 40], 40)
        assert point is None or point + cut - 40 in bounds
    assert byte_bpe.meeting_point(b"x" * 80, 40) is None


def test_byte_bpe_of_an_empty_table(nothing):
    assert byte_bpe.decode(byte_bpe.encode(nothing)).collect() == []


def test_code_lengths_are_optimal_and_limited():
    import heapq

    counts = np.random.default_rng(1).integers(1, 1000, 500)
    lengths = huffman.code_lengths(counts)
    heap, cost = sorted(counts.tolist()), 0
    while len(heap) > 1:
        joined = heapq.heappop(heap) + heapq.heappop(heap)
        cost += joined
        heapq.heappush(heap, joined)
    assert (lengths * counts).sum() == cost
    steep = 2 ** np.arange(40, dtype=np.int64)
    limited = huffman.code_lengths(steep, 8)
    assert limited.max() <= 8 and sum(2.0 ** -int(n) for n in limited) == 1


@pytest.mark.parametrize("count", [0, 1, 2, 127, 128, 129, 5000])
def test_huffman_round_trip(count):
    ids = (np.random.default_rng(count).zipf(1.4, count) % 3000).astype(np.uint16)
    lengths = huffman.code_lengths(np.bincount(ids, minlength=1 << 16))
    bits, checkpoints = huffman.pack(ids, lengths, huffman.codes(lengths))
    assert (huffman.Decoder(lengths).unpack(bits, checkpoints, count) == ids).all()
    # A later run decodes without what is before it.
    if count > 256:
        part = huffman.Decoder(lengths).unpack(bits, checkpoints[1:], count - 128)
        assert (part == ids[128:]).all()


@pytest.mark.parametrize("block_ids", [1, 300, token_files.BLOCK_IDS])
def test_token_files(spark, awkward, word_file, monkeypatch, block_ids):
    monkeypatch.setattr(token_files, "BLOCK_IDS", block_ids)
    path = scratch_path(spark, "tokens-test")
    token_files.write_tokens(token_files.tokenize(awkward), path)
    rows = token_files.read_tokens(spark, path).orderBy("start").collect()
    texts = sorted(((-1 if r.doc_id is None else r.doc_id), r.text or "") for r in awkward.collect())
    assert [-1 if r.doc is None else r.doc for r in rows] == [doc for doc, _ in texts]
    start, found, wanted = 0, {}, {}
    for row, (doc, text) in zip(rows, texts):
        assert row.start == start and row.n_tokens == len(row.ids) // 4
        start += row.n_tokens
        # Rows of one id stand in any order.
        found.setdefault(row.doc, []).append(bytes(row.ids))
        wanted.setdefault(None if doc == -1 else doc, []).append(
            np.array(library_ids(word_file, text) + [token_files.END_ID], "<u4").tobytes()
        )
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in wanted.items()}


def test_token_files_of_an_empty_table(spark, nothing):
    path = scratch_path(spark, "tokens-test")
    token_files.write_tokens(token_files.tokenize(nothing), path)
    assert token_files.read_tokens(spark, path).collect() == []


def test_token_queries(spark, word_file, ranks):
    texts = {r.doc_id: r.text for r in queries.documents(spark, SF).collect()}
    ids = {doc: library_ids(word_file, text) for doc, text in texts.items()}
    for row in queries.op1_token_counts(spark, SF).collect():
        assert (row.n_tokens, row.n_bytes) == (len(ids[row.doc_id]), len(texts[row.doc_id].encode()))
    start = 0
    for row in queries.op8_token_files(spark, SF).orderBy("doc_id").collect():
        whole = np.array(ids[row.doc_id] + [1], "<u4")
        assert (row.start, row.n_tokens, row.ids_crc32) == (start, len(whole), zlib.crc32(whole.tobytes()))
        start += len(whole)
    for row in queries.op2_byte_bpe(spark, SF).collect():
        own = np.array(ranks.encode_ordinary(texts[row.doc_id]), "<u4").tobytes()
        assert row.ids_sha256 == hashlib.sha256(own).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(texts[row.doc_id].encode()).hexdigest()
    assert queries.op2_byte_bpe(spark, SF).select(F.count_distinct("doc_id")).first()[0] == len(texts)
