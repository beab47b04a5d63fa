"""Candidate scores, softmax, predictions and their evaluation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe import defaults
from tallyframe.functions import arrays
from tallyframe.functions import messages as msg
from tallyframe.operators import metrics, scoring
from tallyframe.plans import conversation_queries as cq
from tallyframe.plans import evaluation
from tallyframe.plans.registry import query, table
from tallyframe.session import materialize

_SCALE = 8.0
_DIGITS = tuple(str(d) for d in range(10))
_POSITIVE = ("0", "1", "11")

_CENTROID_SQL = """
cells AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings),
means AS (SELECT label, pos, avg(x::DOUBLE) AS m FROM cells GROUP BY label, pos),
centroids AS (SELECT label::VARCHAR AS candidate, list(m ORDER BY pos) AS centroid FROM means GROUP BY label)"""
_SCORED_SQL = f"""{_CENTROID_SQL},
raw AS (
  SELECT vec_id, label::VARCHAR AS true_label, candidate, list_dot_product(embedding::DOUBLE[], centroid) * {_SCALE} AS score
  FROM embeddings, centroids),
shifted AS (SELECT *, exp(score - max(score) OVER (PARTITION BY vec_id)) AS e FROM raw),
probs AS (SELECT *, e / sum(e) OVER (PARTITION BY vec_id) AS p FROM shifted),
predictions AS (
  SELECT vec_id AS idx, true_label, arg_max(candidate, score) AS predicted_label,
    sum(p) FILTER (WHERE candidate IN ('0', '1', '11')) AS score FROM probs GROUP BY vec_id, true_label)"""


@query(f"WITH {_CENTROID_SQL} SELECT candidate AS label, round(list_sum(centroid), 6) AS total, len(centroid) AS width FROM centroids")
def class_centroids(spark, sf_dir):
    found = evaluation.class_centroids(table(spark, sf_dir, "embeddings"), "label", "embedding")
    return found.select(
        F.col("label").cast("string").alias("label"), F.round(arrays.array_sum(F.col("centroid")), 6).alias("total"),
        F.size("centroid").cast("bigint").alias("width"),
    )


def vector_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("index"), F.col("label").cast("string").alias("true_label"), "embedding"
    )


def vector_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of a centroid model, scored in Arrow batches by a user function."""
    found = evaluation.class_centroids(table(spark, sf_dir, "embeddings"), "label", "embedding")
    # The model: one vector per class.
    rows = sorted(found.collect(), key=lambda r: str(r["label"]))
    labels = tuple(str(r["label"]) for r in rows)
    scorer = evaluation.centroid_scorer(np.array([r["centroid"] for r in rows]), _SCALE)
    return scoring.score_features(vector_samples(spark, sf_dir), "embedding", scorer, labels, _POSITIVE)


_PREDICTION_SQL = f"""WITH {_SCORED_SQL}
  SELECT idx AS index, true_label, predicted_label, round(score, 6) AS binary_score FROM predictions"""


@query(_PREDICTION_SQL)
def user_scorer(spark, sf_dir):
    return vector_predictions(spark, sf_dir).select(
        "index", "true_label", "predicted_label", F.round("binary_score", 6).alias("binary_score")
    )


@query(_PREDICTION_SQL)
def candidate_softmax_argmax(spark, sf_dir):
    """The same predictions with array expressions only."""
    found = evaluation.class_centroids(table(spark, sf_dir, "embeddings"), "label", "embedding")
    listed = F.array_sort(F.collect_list(F.struct(F.col("label").cast("string"), "centroid")))
    model = found.agg(F.transform(listed, lambda e: e["centroid"]).alias("model"))

    def inner(centroid):
        products = F.zip_with(centroid, F.col("embedding"), lambda a, b: a * b.cast("double"))
        return arrays.array_sum(products) * _SCALE

    with_model = vector_samples(spark, sf_dir).withColumn("model", model.scalar())
    scored = with_model.withColumn("scores", F.transform("model", inner)).drop("embedding", "model")
    return scoring.predictions_from_scores(scored, _DIGITS, _POSITIVE).select(
        "index", "true_label", "predicted_label", F.round("binary_score", 6).alias("binary_score")
    )


@query("""WITH s AS (SELECT vec_id, unnest(range(len(embedding))) AS candidate_order, unnest(embedding) AS score FROM embeddings),
  e AS (SELECT *, exp(score::DOUBLE - max(score::DOUBLE) OVER (PARTITION BY vec_id)) AS e FROM s)
  SELECT vec_id, 'd' || lpad(candidate_order::VARCHAR, 4, '0') AS candidate, round(score::DOUBLE, 6) AS score,
    round(e / sum(e) OVER (PARTITION BY vec_id), 6) AS probability FROM e""")
def regroup_candidates(spark, sf_dir):
    """Samples times candidates, one per dimension, and back to one row per sample."""
    width = table(spark, sf_dir, "embeddings").agg(F.max(F.size("embedding"))).first()[0] or 0
    names = tuple(f"d{number:04}" for number in range(width))
    expanded = scoring.expand_candidates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), names)
    scored = expanded.select(
        "vec_id", "candidate_order", "candidate", F.get("embedding", F.col("candidate_order")).cast("double").alias("score")
    )
    back = scoring.regroup_scores(scored, ["vec_id"])
    pairs = F.arrays_zip(F.col("scores").alias("score"), arrays.softmax(F.col("scores")).alias("p"))
    labelled = F.transform(
        pairs,
        lambda p, i: F.struct(
            F.get(F.map_keys("score_by_label"), i).alias("candidate"), F.round(p["score"], 6).alias("score"),
            F.round(p["p"], 6).alias("probability"),
        ),
    )
    return back.select("vec_id", F.inline(labelled))


@query("""WITH t AS (SELECT vec_id, unnest(range(7)) AS i, embedding FROM embeddings),
  p AS (SELECT vec_id, i, list_transform(embedding[i * 8 + 1 : i * 8 + 8], lambda x: x::DOUBLE * 10) AS logits,
          CASE WHEN (vec_id + i + 1) % 3 = 0 THEN -100 ELSE (vec_id + i + 1) % 8 END AS target FROM t),
  l AS (SELECT vec_id, logits[(target + 1)::INT] - list_max(logits)
          - ln(list_sum(list_transform(logits, lambda x: exp(x - list_max(logits))))) AS lp FROM p WHERE target <> -100)
  SELECT vec_id, round(avg(lp), 6) AS mean_log_likelihood FROM l GROUP BY vec_id""")
def loglik_mean(spark, sf_dir):
    """Vectors as logits of 8 tokens over 8 words."""
    key = F.col("vec_id")
    scaled = F.transform("embedding", lambda x: x.cast("double") * 10)
    rows = table(spark, sf_dir, "embeddings").select(
        "vec_id",
        F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice(scaled, i * 8 + 1, F.lit(8))).alias("logits"),
        F.transform(
            F.sequence(F.lit(0), F.lit(7)), lambda i: F.when((key + i) % 3 == 0, -100).otherwise((key + i) % 8)
        ).alias("targets"),
    )
    return rows.select(
        "vec_id",
        F.round(arrays.mean_log_likelihood(F.col("logits"), F.col("targets")), 6).alias("mean_log_likelihood"),
    )


METRIC_ROWS_SQL = """
names AS (
  SELECT label, ord, 0 AS seen FROM classes
  UNION ALL
  SELECT label, 1000 AS ord, min(seen) FROM (
    SELECT true_label AS label, idx * 2 AS seen FROM predictions
    UNION ALL SELECT predicted_label, idx * 2 + 1 FROM predictions)
  WHERE label NOT IN (SELECT label FROM classes) GROUP BY label),
stats AS (
  SELECT n.label, row_number() OVER (ORDER BY ord, seen) - 1 AS label_order,
    (SELECT count(*) FROM predictions WHERE true_label = n.label) AS support,
    (SELECT count(*) FROM predictions WHERE predicted_label = n.label) AS predicted,
    (SELECT count(*) FROM predictions WHERE predicted_label = n.label AND true_label = n.label) AS tp FROM names n),
scores AS (
  SELECT *, coalesce(tp / nullif(predicted, 0), 0) AS "precision", coalesce(tp / nullif(support, 0), 0) AS recall,
    coalesce(2 * tp / nullif(support + predicted, 0), 0) AS f1 FROM stats),
ranked AS (
  SELECT true_label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS r FROM predictions),
auc AS (
  SELECT (sum(r) FILTER (WHERE pos) - p * (p + 1) / 2) / nullif(p * n, 0) AS auc FROM (
    SELECT r, true_label IN (POSITIVE) AS pos, count(*) FILTER (WHERE true_label IN (POSITIVE)) OVER () AS p,
      count(*) FILTER (WHERE true_label NOT IN (POSITIVE)) OVER () AS n FROM ranked) GROUP BY p, n),
long AS (
  SELECT 'total_samples' AS metric, NULL AS label, NULL AS other, count(*)::DOUBLE AS value FROM predictions
  UNION ALL SELECT 'accuracy', NULL, NULL, avg((true_label = predicted_label)::INT) FROM predictions
  UNION ALL SELECT 'macro_f1', NULL, NULL, avg(f1) FROM scores
  UNION ALL SELECT 'binary_roc_auc', NULL, NULL, (SELECT auc FROM auc)
  UNION ALL SELECT 'precision', label, NULL, "precision" FROM scores
  UNION ALL SELECT 'recall', label, NULL, recall FROM scores
  UNION ALL SELECT 'f1', label, NULL, f1 FROM scores
  UNION ALL SELECT 'support', label, NULL, support FROM scores
  UNION ALL SELECT 'label_order', label, NULL, label_order FROM scores
  UNION ALL SELECT 'class_distribution', label, NULL, support FROM scores WHERE support > 0
  UNION ALL SELECT 'prediction_distribution', label, NULL, predicted FROM scores WHERE predicted > 0
  UNION ALL SELECT 'confusion', t.label, p.label,
    (SELECT count(*) FROM predictions WHERE true_label = t.label AND predicted_label = p.label) FROM names t, names p)"""


@query(f"""WITH {_SCORED_SQL}, classes(label, ord) AS (VALUES {', '.join(f"('{d}', {i})" for i, d in enumerate(_DIGITS))}),
  {METRIC_ROWS_SQL.replace('POSITIVE', "'0', '1', '11'")} SELECT metric, label, other, round(value, 6) AS value FROM long""")
def metrics_document(spark, sf_dir):
    """Centroids, scores, softmax, predictions, metrics: the whole evaluation of the embeddings."""
    predictions = materialize(
        vector_predictions(spark, sf_dir).select("index", "true_label", "predicted_label", "binary_score"), "predictions"
    )
    document = metrics.compute_metrics(predictions, _DIGITS, _POSITIVE)
    return evaluation.document_rows(document).withColumn("value", F.round("value", 6))


# ---- user functions over conversations ----------------------------------------------------------------------------


def _talks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cq.labelled_files(spark, sf_dir).select(
        F.col("doc_id").alias("index"), "path", "split", "category", F.col("category").alias("true_label"),
        msg.training_messages(F.col("path"), F.col("category")).alias("messages"), F.col("path").alias("image_path"),
    )


_ANSWER_FRAME = ',{"role":"assistant","content":[{"type":"text","text":"Classification: "}]}'


def length_scorer(conversation: pd.Series, prompt: pd.Series) -> pd.Series:
    """A toy model: the nearer the length of the class is to seven and the last figure of the sum of the prompt's digits,
    the better."""
    wanted = prompt.map(lambda text: 7 + sum(map(int, filter(str.isdecimal, text))) % 10)
    return 0.0 - (conversation.str.len() - prompt.str.len() - len(_ANSWER_FRAME) - wanted).abs()


@query(f"""WITH {cq.LABELLED_SQL}, c(candidate, ord) AS (VALUES ('active_tb', 0), ('healthy', 1), ('sick_but_non_tb', 2)),
  prompts AS (SELECT doc_id, category, '[{{"role":"user","content":[{{"type":"image","path":"' || path ||
    '"}},{{"type":"text","text":"{defaults.PROMPT}"}}]}}]' AS prompt FROM labelled),
  s AS (SELECT doc_id, category, candidate, ord,
    0 - abs(length(candidate) - 7 - list_sum(list_transform(regexp_extract_all(prompt, '[0-9]'), lambda x: x::INT)) % 10)::DOUBLE AS score
    FROM prompts, c)
  SELECT doc_id AS index, category AS true_label, arg_max(candidate, (score, -ord)) AS predicted_label,
    round(max(score), 6) AS best_score FROM s GROUP BY doc_id, category""")
def score_conversations(spark, sf_dir):
    scored = scoring.score_conversations(_talks(spark, sf_dir), length_scorer)
    return scored.select(
        "index", "true_label", "predicted_label",
        F.round(F.array_max(F.map_values("class_log_likelihoods")), 6).alias("best_score"),
    )


def byte_tokenizer(texts: pd.Series) -> pd.Series:
    """A toy tokenizer: the bytes of the text, 0 being kept for padding."""
    return texts.map(lambda text: np.frombuffer(text.encode("utf-8"), dtype=np.uint8).astype(np.int64))


_PROMPT_LENGTH = f"""length('[{{"role":"user","content":[{{"type":"image","path":"' || path ||
  '"}},{{"type":"text","text":"{defaults.PROMPT}"}}]}}]')"""
_ANSWER_LENGTH = """length(',{"role":"assistant","content":"Classification: ' || category || '"}')"""


@query(f"""WITH {cq.LABELLED_SQL},
  l AS (SELECT doc_id, doc_id // 100 AS batch, {_PROMPT_LENGTH} AS prompt, {_PROMPT_LENGTH} + {_ANSWER_LENGTH} AS total FROM labelled)
  SELECT doc_id AS index, max(total) OVER (PARTITION BY batch) AS width, total AS tokens, prompt AS prompt_length,
    total - prompt AS label_tokens FROM l""")
def collate_conversations(spark, sf_dir):
    rows = _talks(spark, sf_dir).withColumn("batch", F.floor(F.col("index") / 100))
    done = scoring.collate(rows, byte_tokenizer, batch_col="batch")
    return done.select(
        "index",
        F.size("input_ids").cast("bigint").alias("width"),
        arrays.array_sum(F.col("attention_mask")).cast("bigint").alias("tokens"),
        F.col("prompt_length").cast("bigint").alias("prompt_length"),
        arrays.scored_tokens(F.col("labels")).alias("label_tokens"),
    )


def shape_processor(frame: pd.DataFrame) -> pd.DataFrame:
    """A toy processor: number of characters and of JSON objects of the conversation."""
    talk = frame["messages_json"]
    return pd.DataFrame(
        {"path": frame["path"], "category": frame["category"], "characters": talk.str.len(), "objects": talk.str.count("{")}
    )


@query(f"""WITH {cq.LABELLED_SQL},
  t AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY path) AS turn FROM labelled)
  SELECT path, category, {_PROMPT_LENGTH} + {_ANSWER_LENGTH} AS characters, 4::BIGINT AS objects
  FROM t ORDER BY turn, category LIMIT 40""")
def preprocess_subset(spark, sf_dir):
    rows = _talks(spark, sf_dir).select("path", "split", "category")
    schema = "path string, category string, characters bigint, objects bigint"
    return scoring.preprocess(rows, shape_processor, schema, 40)


@query(f"""WITH {cq.LABELLED_SQL}, c(category, ord) AS (VALUES ('active_tb', 0), ('healthy', 1), ('sick_but_non_tb', 2)),
  t AS (SELECT doc_id, path, category, ord, row_number() OVER (PARTITION BY category ORDER BY doc_id) AS turn FROM labelled JOIN c USING (category)),
  p AS (SELECT *, row_number() OVER (ORDER BY turn, ord) - 1 AS position FROM t)
  SELECT position, least({_PROMPT_LENGTH} + {_ANSWER_LENGTH} + 8, 385) AS tokens, ascii('[')::BIGINT AS first_id FROM p WHERE position < 128""")
def calibration_tokens(spark, sf_dir):
    # "path" becomes "image" and "file://" is put in front: 8 characters more.
    done = scoring.calibration_dataset(_talks(spark, sf_dir), byte_tokenizer, 385)
    return done.select(
        "position", F.size("input_ids").cast("bigint").alias("tokens"), F.get("input_ids", F.lit(0)).alias("first_id")
    )
