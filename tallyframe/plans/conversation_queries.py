"""Conversation records: building, parsing, rewriting, masking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe import defaults
from tallyframe.functions import arrays
from tallyframe.functions import messages as msg
from tallyframe.operators import conversations, scoring
from tallyframe.plans import fixtures as fx
from tallyframe.plans.registry import query, table

_CLASS_SQL = "CASE WHEN toxic = 1 THEN 'sick_but_non_tb' WHEN quality = 1 THEN 'healthy' ELSE 'active_tb' END"


def labelled_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, path, split, category``: the labelled documents as image records with one of the three classes."""
    category = F.when(F.col("toxic") == 1, "sick_but_non_tb").when(F.col("quality") == 1, "healthy").otherwise("active_tb")
    files = fx.document_files(spark, sf_dir)
    return files.join(table(spark, sf_dir, "labels"), "doc_id").select(
        "doc_id", "path", F.when(F.col("doc_id") % 4 == 0, "val").otherwise("train").alias("split"), category.alias("category")
    )


LABELLED_SQL = f"""{fx.FILES_SQL},
labelled AS (
  SELECT doc_id, path, CASE WHEN doc_id % 4 = 0 THEN 'val' ELSE 'train' END AS split, {_CLASS_SQL} AS category
  FROM files JOIN labels USING (doc_id))"""


@query(f"WITH {LABELLED_SQL} SELECT doc_id, 'Classification: ' || category AS answer, category <> 'active_tb' AS supported FROM labelled")
def answer_lines(spark, sf_dir):
    return labelled_files(spark, sf_dir).select(
        "doc_id",
        msg.answer_text(F.col("category")).alias("answer"),
        msg.is_supported(F.col("category"), ("healthy", "sick_but_non_tb")).alias("supported"),
    )


@query(f"""WITH {LABELLED_SQL} SELECT doc_id, '{{"messages":[{{"role":"user","content":[{{"type":"image","path":"' || path ||
  '"}},{{"type":"text","text":"{defaults.PROMPT}"}}]}},{{"role":"assistant","content":"Classification: ' || category || '"}}]}}' AS line
  FROM labelled""")
def build_messages(spark, sf_dir):
    talk = msg.training_messages(F.col("path"), F.col("category"))
    return labelled_files(spark, sf_dir).select("doc_id", msg.jsonl_line(talk).alias("line"))


# Lines as a third party may write them: good ones, and every kind of bad one.
_ANSWERS = [
    '"Classification: {c}"',
    '"Finding: x\\r\\nClassification:  {c}  \\nClassification: other"',
    '"[Classification: {c}"',
    '[{{"type":"text","text":"Classification: {c}"}}]',
    '" Classification: {c}\\n"',
    '"Classification: latent_tb"',
]


def chat_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("doc_id")
    answers = F.array(*[F.lit(a.replace("{{", "{").replace("}}", "}")) for a in _ANSWERS])
    answer = F.replace(F.get(answers, (key % 6).cast("int")), F.lit("{c}"), F.col("category"))
    image = F.when(key % 5 == 0, F.lit('{"type":"image"}')).otherwise(
        F.concat(F.lit('{"type":"image","path":"'), F.when(key % 10 == 1, F.expr("substr(path, 2)")).otherwise(F.col("path")), F.lit('","n":[1,2]}'))
    )
    line = F.when(key % 37 == 0, F.lit("not json")).otherwise(
        F.concat(
            F.lit('{"id":'), key.cast("string"),
            F.lit(',"messages":[{"role":"user","content":[{"type":"text","text":"é?"},'), image,
            F.lit(']},{"role":"assistant","content":'), answer, F.lit("}]}"),
        )
    )
    return labelled_files(spark, sf_dir).select("doc_id", "path", "category", line.alias("value"))


_CHAT_SQL = f"""{LABELLED_SQL},
chats AS (
  SELECT doc_id, doc_id % 37 <> 0 AS valid, doc_id % 6 AS kind,
    CASE WHEN doc_id % 37 = 0 THEN NULL WHEN doc_id % 6 IN (0, 1) THEN category WHEN doc_id % 6 = 5 THEN 'latent_tb' END AS label,
    CASE WHEN doc_id % 37 = 0 OR doc_id % 5 = 0 THEN NULL WHEN doc_id % 10 = 1 THEN substr(path, 2) ELSE path END AS image_path,
    category, path
  FROM labelled)"""


def _chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_lines(spark, sf_dir).withColumn("messages", msg.parse_messages(F.col("value")))


@query(f"WITH {_CHAT_SQL} SELECT doc_id, label, image_path FROM chats")
def parse_labels_paths(spark, sf_dir):
    return _chats(spark, sf_dir).select(
        "doc_id", msg.answer_label(F.col("messages")).alias("label"), msg.image_path(F.col("messages")).alias("image_path")
    )


@query(f"""WITH {_CHAT_SQL} SELECT doc_id, valid AND kind IN (0, 5) AS locked,
  CASE WHEN NOT valid THEN NULL WHEN kind IN (0, 4) THEN category END AS structured FROM chats""")
def structured_answers(spark, sf_dir):
    answer = F.get("messages", F.lit(1))["text"]
    return _chats(spark, sf_dir).select(
        "doc_id",
        msg.has_locked_format(F.col("messages")).alias("locked"),
        msg.structured_label(answer).alias("structured"),
    )


@query(f"""WITH {_CHAT_SQL} SELECT doc_id, CASE WHEN NOT valid THEN 'invalid JSON' WHEN image_path IS NULL THEN 'missing image path'
  WHEN label IS NULL THEN 'missing answer' END AS problem FROM chats
  WHERE NOT valid OR image_path IS NULL OR label IS NULL""")
def conversation_violations(spark, sf_dir):
    parsed = _chats(spark, sf_dir).select(
        F.col("doc_id").alias("index"), "messages", msg.answer_label(F.col("messages")).alias("label"),
        msg.image_path(F.col("messages")).alias("image_path"),
    )
    return conversations.violations(parsed).withColumnRenamed("index", "doc_id")


@query(f"""WITH {_CHAT_SQL} SELECT coalesce(label, '(none)') AS label, count(*) AS n,
  count(*) FILTER (WHERE image_path IS NOT NULL AND image_path NOT IN (SELECT path FROM disk)) AS missing,
  count(*) FILTER (WHERE image_path NOT LIKE '/%') AS relative FROM chats GROUP BY 1""")
def validation_counts(spark, sf_dir):
    parsed = _chats(spark, sf_dir).select(
        msg.answer_label(F.col("messages")).alias("label"), msg.image_path(F.col("messages")).alias("image_path")
    )
    return conversations.label_path_counts(parsed, fx.disk_inventory(spark, sf_dir)).select(
        F.coalesce("label", F.lit("(none)")).alias("label"), "n", "missing", "relative"
    )


@query(f"""WITH {_CHAT_SQL} SELECT count(*) AS total_records,
  count(*) FILTER (WHERE label = 'healthy') AS healthy, count(*) FILTER (WHERE label = 'latent_tb') AS latent_tb,
  count(*) FILTER (WHERE image_path IS NOT NULL AND image_path NOT IN (SELECT path FROM files)) AS missing_paths,
  count(*) FILTER (WHERE image_path NOT LIKE '/%') AS relative_paths,
  count(*) FILTER (WHERE image_path NOT IN (SELECT path FROM files) OR image_path NOT LIKE '/%') = 0 AS is_valid FROM chats""")
def validation_summary(spark, sf_dir):
    parsed = _chats(spark, sf_dir).select(
        msg.answer_label(F.col("messages")).alias("label"), msg.image_path(F.col("messages")).alias("image_path")
    )
    summary = conversations.validation_summary(parsed, fx.document_files(spark, sf_dir))
    return summary.select(
        "total_records",
        F.coalesce(F.try_element_at("category_counts", F.lit("healthy")), F.lit(0)).alias("healthy"),
        F.coalesce(F.try_element_at("category_counts", F.lit("latent_tb")), F.lit(0)).alias("latent_tb"),
        "missing_paths", "relative_paths", "is_valid",
    )


@query(f"""WITH {_CHAT_SQL} SELECT doc_id, 'user' AS roles,
  CASE WHEN doc_id % 5 = 0 THEN NULL ELSE 'file://' || CASE WHEN doc_id % 10 = 1 THEN '/base' || path ELSE path END END AS uri,
  CASE WHEN doc_id % 5 = 0 THEN '[{{"text":"é?","type":"text"}},{{"type":"image"}}]'
    ELSE '[{{"text":"é?","type":"text"}},{{"type":"image","image":"file://' || CASE WHEN doc_id % 10 = 1 THEN '/base' || path ELSE path END || '"}}]'
  END AS parts FROM chats WHERE valid""")
def vision_messages(spark, sf_dir):
    talk = msg.vision_messages(F.col("messages"), base_dir="/base")
    first = F.get("talk", F.lit(0))
    uri = F.get_json_object(F.get(first["parts"], F.lit(1)), "$.image")
    return (
        _chats(spark, sf_dir)
        .withColumn("talk", talk)
        .where("messages is not null")
        .select(
            "doc_id", msg.roles(F.col("talk")).alias("roles"), uri.alias("uri"),
            F.concat(F.lit("["), F.array_join(first["parts"], ","), F.lit("]")).alias("parts"),
        )
    )


@query(f"""WITH {_CHAT_SQL}, wanted(candidate) AS (VALUES ('active_tb'), ('healthy'), ('sick_but_non_tb'))
  SELECT doc_id, candidate, 'user,assistant' AS roles, 'user' AS prompt_roles, 2::BIGINT AS first_parts,
    '[{{"role":"assistant","content":[{{"type":"text","text":"Classification: ' || candidate || '"}}]}}]' AS answer
  FROM chats, wanted WHERE valid""")
def candidate_messages(spark, sf_dir):
    expanded = scoring.expand_candidates(_chats(spark, sf_dir).where("messages is not null"), defaults.CLASS_LABELS)
    talk = F.col("talk")
    return expanded.withColumn("talk", msg.candidate_messages(F.col("messages"), F.col("candidate"))).select(
        "doc_id", "candidate", msg.roles(talk).alias("roles"), msg.roles(msg.prompt_messages(talk)).alias("prompt_roles"),
        F.size(F.get(talk, F.lit(0))["parts"]).cast("bigint").alias("first_parts"),
        msg.messages_json(F.slice(talk, 2, 1)).alias("answer"),
    )


@query("""SELECT conv_id, turn, role AS roles, md5(text) AS text_hash, role = 'assistant' AS is_answer, 1::BIGINT AS n
  FROM conversations""")
def stored_messages(spark, sf_dir):
    """Texts of any content survive being written as JSON and parsed again."""
    talks = table(spark, sf_dir, "conversations").withColumn("messages", F.array(msg.message(F.col("role"), F.col("text"))))
    stored = talks.withColumn("stored", msg.messages_json(F.col("messages")))
    given = F.when(F.col("turn") % 2 == 0, F.col("messages"))
    back = stored.withColumn("talk", msg.feature_messages(given, F.col("stored")))
    return back.select(
        "conv_id", "turn", msg.roles(F.col("talk")).alias("roles"),
        F.md5(F.get("talk", F.lit(0))["text"].cast("binary")).alias("text_hash"),
        (F.size(msg.vision_messages(F.col("talk"))) == 0).alias("is_answer"),
        F.size("talk").cast("bigint").alias("n"),
    )


def token_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as token rows: ids from the values, ``vec_id % 5`` padding tokens on the left."""
    key = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select(
        "vec_id",
        F.transform("embedding", lambda x: F.floor(F.abs(x.cast("double")) * 1000).cast("bigint")).alias("input_ids"),
        F.transform("embedding", lambda x, i: F.when(i < key % 5, 0).otherwise(1).cast("bigint")).alias("attention_mask"),
        (key % 7 + 1).alias("prompt_length"),
    )


_TOKENS_SQL = """
tokens AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(abs(x::DOUBLE) * 1000)::BIGINT) AS ids FROM embeddings),
masked AS (
  SELECT vec_id, list_transform(ids, lambda x, i: CASE WHEN i - 1 < vec_id % 5 + vec_id % 7 + 1 THEN -100 ELSE x END) AS left_side,
    list_transform(ids, lambda x, i: CASE WHEN i - 1 < vec_id % 5 OR i - 1 < vec_id % 7 + 1 THEN -100 ELSE x END) AS right_side
  FROM tokens)"""


@query(f"""WITH {_TOKENS_SQL} SELECT vec_id, array_to_string(left_side, ',') AS left_labels,
  array_to_string(right_side, ',') AS right_labels FROM masked""")
def mask_labels(spark, sf_dir):
    def masked(side: str):
        targets = arrays.mask_prompt(F.col("input_ids"), F.col("attention_mask"), F.col("prompt_length"), side)
        return F.array_join(F.transform(targets, lambda x: x.cast("string")), ",")

    return token_rows(spark, sf_dir).select("vec_id", masked("left").alias("left_labels"), masked("right").alias("right_labels"))


@query(f"""WITH {_TOKENS_SQL} SELECT vec_id, len(list_filter(left_side, lambda x: x <> -100)) AS label_tokens,
  len(list_filter(left_side, lambda x: x = -100)) AS masked_tokens, 64::BIGINT AS width, true AS fits FROM masked""")
def batch_summary(spark, sf_dir):
    targets = arrays.mask_prompt(F.col("input_ids"), F.col("attention_mask"), F.col("prompt_length"))
    rows = token_rows(spark, sf_dir).withColumn("labels", targets)
    fits = arrays.prompt_fits(F.col("attention_mask"), F.col("prompt_length"))
    dims = arrays.shapes({"input_ids": (F.col("input_ids"), 1)})
    image = {name: F.lit(None).cast("array<int>") for name in ("mm_token_type_ids", "pixel_values", "image_grid_thw")}
    return scoring.batch_summary(rows.withColumns(image)).select(
        "vec_id", "label_tokens", "masked_tokens",
        F.get(F.element_at(dims, "input_ids"), F.lit(0)).alias("width"), fits.alias("fits"),
    )


@query(f"""WITH {_TOKENS_SQL} SELECT vec_id, 'no scored token' AS problem FROM masked WHERE vec_id % 9 = 0
  UNION ALL SELECT vec_id, 'no masked token' FROM masked WHERE vec_id % 9 = 1
  UNION ALL SELECT vec_id, 'labels and input_ids differ in length' FROM masked WHERE vec_id % 9 = 2""")
def batch_problems(spark, sf_dir):
    key = F.col("vec_id")
    targets = (
        F.when(key % 9 == 0, F.transform("input_ids", lambda x: F.lit(-100).cast("bigint")))
        .when(key % 9 == 1, F.col("input_ids"))
        .when(key % 9 == 2, F.slice("input_ids", 1, 10))
        .otherwise(arrays.mask_prompt(F.col("input_ids"), F.col("attention_mask"), F.col("prompt_length")))
    )
    rows = token_rows(spark, sf_dir).withColumn("labels", targets)
    return scoring.batch_problems(rows).select("vec_id", "problem")
