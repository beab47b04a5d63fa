"""The named queries of this subpackage, each with the SQL that must give the same rows (None where SQL cannot)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm import (
    audio,
    byte_bpe,
    collocations,
    extraction,
    lines,
    manifest,
    mixing,
    pii,
    quality,
    sharding,
    simhash,
    token_counts,
    token_files,
)
from tallyframe.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count_tokens(documents(spark, sf_dir).select("doc_id", "text"))
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


@query
def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = byte_bpe.encode(documents(spark, sf_dir).select("doc_id", "text"), decoded_col="decoded")
    return coded.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = quality.measure(documents(spark, sf_dir).select("doc_id", "text"))
    return measured.drop("text")


SQL["op3_quality_rules"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM d
),
windows AS (SELECT r, i, ws[i:i + 4] AS win FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
repeated AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS n FROM windows) WHERE n > 1),
covered AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM repeated) GROUP BY r
),
m AS (
  SELECT doc_id, t, ls, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
    coalesce(n, 0)::BIGINT AS n_repeat_words,
    len(list_filter(ws, lambda x: NOT regexp_matches(x, '\p{L}'))) AS unlettered
  FROM w LEFT JOIN covered USING (r)
),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND 10 * n_symbols <= n_words AND word_chars BETWEEN 2 * n_words AND 15 * n_words
    AND (n_dup_lines <= 2 OR 10 * n_dup_lines <= 3 * len(ls)) AND 10 * unlettered <= 3 * n_words
    AND 10 * len(regexp_extract_all(t, '\p{Lu}')) <= 4 * length(t) AS kept
FROM f
"""


@query
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.drop_shared_lines(documents(spark, sf_dir).select("doc_id", "text"))
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    return kept.select("doc_id", "n_lines", "n_dropped", digest.alias("kept_sha256"))


SQL["op10_line_dedup"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
e AS (SELECT r, doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS pos FROM d),
k AS (
  SELECT r, doc_id, pos, line,
    translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM e
),
shared AS (
  SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
),
marked AS (SELECT k.*, keeper IS NOT NULL AND keeper <> doc_id AS dropped FROM k LEFT JOIN shared USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (dropped)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY r, doc_id
"""


@query
def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(quality.WORD)).cast("bigint")
    mixed = mixing.mix(documents(spark, sf_dir).select("doc_id", "source", size.alias("size")))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@query
def op7_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    rows = documents(spark, sf_dir).select(
        "doc_id",
        (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("text_hash"),
    )
    placed = sharding.shard_by_size(rows, "text_hash", "doc_id", "size")
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-files")
    token_files.write_tokens(token_files.tokenize(documents(spark, sf_dir).select("doc_id", "text")).drop("text"), path)
    read = token_files.read_tokens(spark, path)
    return read.select(F.col("doc").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op9_simhash_balls(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit("")).alias("text")
    return simhash.near_duplicates(documents(spark, sf_dir).select("doc_id", text)).drop("text")


# Stands for a secret of the user's own.
DEMONSTRATION_KEY = b"a key for demonstrations only"


@query
def op5_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymize(documents(spark, sf_dir).select("doc_id", "text"), DEMONSTRATION_KEY)


# A vector sounds as one note per number: SAMPLES_PER_NOTE samples, pitched by SEMITONES per unit around FIRST_HZ.
SAMPLES_PER_NOTE = 512
SEMITONES = 40.0
FIRST_HZ = 220.0


def sounded(vector: list[float] | None) -> "np.ndarray":  # noqa: F821
    """Samples of a vector of numbers, ``audio.RATE`` per second; none for null."""
    import numpy as np

    steps = np.clip(np.round(np.nan_to_num(np.array(vector or [], float)) * SEMITONES), -24, 24)
    hertz = np.repeat(FIRST_HZ * 2 ** (steps / 12), SAMPLES_PER_NOTE)
    return 0.5 * np.sin(2 * np.pi * np.cumsum(hertz) / audio.RATE)


@query
def op6_audio_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector sounds; its second half is that of the query vector below it, so that recordings quote each other."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    asked = F.col("vec_id") % 50 == 0
    quoted = vectors.where(asked).select(F.col("vec_id").alias("quoted_id"), F.col("embedding").alias("quoted"))
    medley = vectors.join(quoted, F.col("vec_id") - F.col("vec_id") % 50 == F.col("quoted_id"), "left").select(
        "vec_id",
        F.concat(F.slice("embedding", 1, 32), F.slice(F.coalesce("quoted", "embedding"), 33, 32)).alias("notes"),
    )
    recordings = medley.select(
        "vec_id",
        audio.fingerprint(F.col("notes"), decode=sounded).alias("ints"),
        audio.phases(F.when(asked, F.col("notes")), decode=sounded).alias("phases"),
    )
    return audio.align_recordings(recordings, asked, "vec_id", phases_col="phases")


@query
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    lowered = F.translate("text", lines.CAPITALS, lines.CAPITALS.lower())
    columns = [F.col(name) for name in ("doc_id", "source", "lang", "n_chars")]
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    hashed = docs.select(
        "doc_id",
        "lang",
        manifest.leaf_digest(*columns, F.col("text")).alias("leaf"),
        manifest.leaf_digest(*columns, F.when(tampered, lowered).otherwise(F.col("text"))).alias("now"),
    )
    folded = manifest.prove(hashed, "leaf", ["doc_id"], "lang").select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        F.sha2(manifest.siblings(F.col("proof")).cast("binary"), 256).alias("proof_sha256"),
        manifest.fold(F.col("now"), F.col("proof")).alias("folded_root"),
    )
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))


SQL["op11_merkle_manifest"] = r"""
WITH RECURSIVE crc AS (
  SELECT doc_id, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''),
    lambda c: ascii(c)::BIGINT)), lambda a, c: list_reduce(list_prepend(xor(a, c), range(8)),
    lambda x, bit: xor(x >> 1, (x & 1) * 3988292384)))) % 3 = 0 AS tampered
  FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)
),
t AS (
  SELECT doc_id, lang, text, concat(
      coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'),
      coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-')) AS head,
    CASE WHEN tampered THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS now
  FROM documents LEFT JOIN crc USING (doc_id)
),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
    count(*) OVER (PARTITION BY lang) AS n
  FROM (
    SELECT doc_id, lang, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
      sha256(head || coalesce(strlen(now) || ':' || now, '-')) AS now
    FROM t
  )
),
nodes AS (
  SELECT lang, 0 AS level, i, n, leaf AS h FROM leaves
  UNION ALL
  SELECT lang, level + 1, i // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY i))
  FROM nodes WHERE n > 1 GROUP BY lang, level, i // 8, n
),
tops AS (
  SELECT lang, 0 AS level, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n, h
  FROM nodes WHERE n = 1
),
above AS (
  SELECT level, i, n, h FROM tops
  UNION ALL
  SELECT level + 1, i // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY i)) FROM above WHERE n > 1 GROUP BY level, i // 8, n
),
runs AS (SELECT lang, level, i // 8 AS run, list(h ORDER BY i) AS hs FROM nodes GROUP BY ALL),
upper_runs AS (SELECT level, i // 8 AS run, list(h ORDER BY i) AS hs FROM above GROUP BY ALL),
climb AS (
  SELECT doc_id, lang, leaf, 0 AS level, i, n, now, '' AS proof FROM leaves
  UNION ALL
  SELECT doc_id, lang, leaf, level + 1, i // 8, (n + 7) // 8,
    sha256(array_to_string(hs[1:i % 8], '') || now || array_to_string(hs[i % 8 + 2:], '')),
    proof || array_to_string(hs[1:i % 8], '') || array_to_string(hs[i % 8 + 2:], '')
  FROM (
    SELECT c.*, hs FROM climb c JOIN runs r ON c.lang IS NOT DISTINCT FROM r.lang AND c.level = r.level AND i // 8 = run
    WHERE n > 1
  )
),
climb_on AS (
  SELECT doc_id, c.lang, leaf, t.h AS subroot, 0 AS level, t.i, t.n, now, proof
  FROM climb c JOIN tops t ON c.lang IS NOT DISTINCT FROM t.lang WHERE c.n = 1
  UNION ALL
  SELECT doc_id, lang, leaf, subroot, level + 1, i // 8, (n + 7) // 8,
    sha256(array_to_string(hs[1:i % 8], '') || now || array_to_string(hs[i % 8 + 2:], '')),
    proof || array_to_string(hs[1:i % 8], '') || array_to_string(hs[i % 8 + 2:], '')
  FROM (SELECT c.*, hs FROM climb_on c JOIN upper_runs r ON c.level = r.level AND i // 8 = run WHERE n > 1)
)
SELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, now AS folded_root, now = h AS verified
FROM climb_on c, (SELECT h FROM above WHERE n = 1) WHERE c.n = 1
"""


@query
def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(documents(spark, sf_dir).select("text", "lang"))


SQL["op12_phrase_collocations"] = r"""
WITH pieces AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws
  FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents
  )
),
starts AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM pieces),
grams AS (
  SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase
  FROM (SELECT *, unnest([1, 2, 3, 4]) AS k FROM starts) WHERE i + k - 1 <= len(ws)
),
f AS (SELECT lang, k, phrase, count(*) AS a FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
candidates AS (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND a >= 30),
cuts AS (
  SELECT c.*, left_f.a AS l, right_f.a AS r, cut, 2000000::HUGEINT * c.a // (left_f.a::HUGEINT + right_f.a) AS score
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM candidates) c
  JOIN f left_f ON left_f.lang = c.lang AND left_f.k = cut AND left_f.phrase = array_to_string(ws[1:cut], ' ')
  JOIN f right_f ON right_f.lang = c.lang AND right_f.k = c.k - cut AND right_f.phrase = array_to_string(ws[cut + 1:], ' ')
),
lowest AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS pick FROM cuts),
inside AS (
  SELECT DISTINCT c.lang, array_to_string(ws[i:i + size - 1], ' ') AS phrase, c.a AS longer
  FROM (SELECT *, unnest(range(1, k)) AS i FROM candidates) c, (SELECT unnest([2, 3]) AS size)
  WHERE size < k AND i + size - 1 <= k
),
covered AS (SELECT lang, phrase, max(longer) AS longest FROM inside GROUP BY ALL),
ranked AS (
  SELECT s.*, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, s.a DESC, s.phrase) AS rank
  FROM lowest s LEFT JOIN covered c ON s.lang = c.lang AND s.phrase = c.phrase
  WHERE pick = 1 AND (longest IS NULL OR 100::HUGEINT * longest < 80::HUGEINT * s.a)
)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""


@query
def op13_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extraction.extract(pages).select("page_id", "url", "text", "n_chars")
