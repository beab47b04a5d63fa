"""The pipeline against its stages by themselves, and on awkward and empty tables."""

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

from tallyframe.llm import byte_bpe, lines, quality, simhash, vocab
from tests.llm.conftest import SF


def test_stages_return_document_columns(spark, awkward, nothing):
    for table in (awkward, nothing):
        docs = table
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns, name
            assert stage(spark, docs.limit(0), SF).collect() == []
            out.collect()
        last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
        assert last.count() == docs.count()


def test_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = corpus_pipeline.run(spark, SF).collect()
    good = quality.measure(docs).where("kept").select(*docs.columns)
    assert good.count() < docs.count()
    unshared = lines.drop_shared_lines(good).drop("n_lines", "n_dropped")
    marked = simhash.near_duplicates(unshared)
    distinct = {r.doc_id: r.text for r in marked.where("doc_id = component_id").collect()}
    assert {r.doc_id for r in rows} <= set(distinct)
    with open(vocab.BYTE_BPE, "rb") as file:
        encoding = vocab.byte_encoding(file.read())
    for row in rows:
        assert bytes(row.ids) == np.array(encoding.encode_ordinary(distinct[row.doc_id] or ""), "<u4").tobytes()
    # Copies come from the mix: up to three of a document, and as many words as before, about.
    counts = {}
    for row in rows:
        counts[row.doc_id] = counts.get(row.doc_id, 0) + 1
    assert max(counts.values()) <= 3
    size = {doc: len((text or "").split()) for doc, text in distinct.items()}
    taken, whole = sum(size[r.doc_id] for r in rows), sum(size.values())
    assert abs(taken - whole) < 0.05 * whole


def test_unshared_lines_update_n_chars(spark):
    docs = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet")
    out = corpus_pipeline.unshared_lines(spark, docs, SF)
    assert out.where(F.col("n_chars") != F.length("text")).count() == 0
    assert out.agg(F.sum("n_chars")).first()[0] < docs.agg(F.sum("n_chars")).first()[0]


def test_byte_bpe_is_the_last_stage():
    assert [name for name, _ in corpus_pipeline.STAGES][-1] == "byte-level BPE" and byte_bpe.CHUNK_BYTES > byte_bpe.OVERLAP_BYTES
