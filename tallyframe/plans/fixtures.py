"""Record sets derived from the driver's tables, as DataFrames and as SQL fragments with the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe import defaults
from tallyframe.plans.registry import table

ROOT = "/data"
_SPLIT_DIRS = ["train", "Validation-set", "my_val", "valid", "test", "trainer", "misc"]
_STEMS = ["h", "tb", "s", "active-tb-"]
_EXTENSIONS = ["png", "JPG", "csv"]
_RAW_LABELS = ["Normal case", "latent-TB!", "sick_but_non-tb", "abnormal"]


def pick(values: list[str], position: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), position.cast("int"))


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file path per document, with directories and names that tell class and split in many ways."""
    docs = table(spark, sf_dir, "documents")
    key = F.col("doc_id")
    folder = (
        F.when(F.col("lang") == "en", "normal")
        .when(F.col("lang") == "de", "Sick-But-Non_TB")
        .when(F.col("lang") == "fr", "x_latent_tb_y")
        .otherwise("abnormal")
    )
    path = F.concat(
        F.lit(ROOT + "/"), pick(_SPLIT_DIRS, key % 7), F.lit("/"), folder, F.lit("/"),
        pick(_STEMS, key % 4), key.cast("string"), F.lit("."), pick(_EXTENSIONS, key % 3),
    )
    return docs.select("doc_id", path.alias("path"))


def disk_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All those files as they lie on the disk, where every third one was moved away."""
    moved = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("/moved"), F.col("path"))).otherwise(F.col("path"))
    return document_files(spark, sf_dir).select(moved.alias("path"))


def _sql_list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


FILES_SQL = f"""
files AS (
  SELECT doc_id, '{ROOT}/' || list_extract({_sql_list(_SPLIT_DIRS)}, (doc_id % 7 + 1)::INT) || '/' ||
    CASE lang WHEN 'en' THEN 'normal' WHEN 'de' THEN 'Sick-But-Non_TB' WHEN 'fr' THEN 'x_latent_tb_y' ELSE 'abnormal' END
    || '/' || list_extract({_sql_list(_STEMS)}, (doc_id % 4 + 1)::INT) || doc_id || '.' ||
    list_extract({_sql_list(_EXTENSIONS)}, (doc_id % 3 + 1)::INT) AS path
  FROM documents),
disk AS (SELECT CASE WHEN doc_id % 3 = 0 THEN '/moved' || path ELSE path END AS path FROM files)"""

IMAGE_SQL = "regexp_matches(lower(path), '[^/][.](jpg|jpeg|png|bmp|tif|tiff|webp)$')"


def token_sql(column: str) -> str:
    return f"trim(regexp_replace(lower(coalesce({column}, '')), '[^a-z0-9]+', '_', 'g'), '_')"


def split_sql(token: str) -> str:
    return (
        f"CASE WHEN contains({token}, 'validation') OR regexp_matches({token}, '(^|_)val(id)?(_|$)') THEN 'val' "
        f"WHEN regexp_matches({token}, '(^|_)train(_|$)') THEN 'train' "
        f"WHEN regexp_matches({token}, '(^|_)test(_|$)') THEN 'test' END"
    )


ALIAS_SQL = "alias(name, parts, category, ord) AS (VALUES " + ", ".join(
    f"('{token}', {len(token.split('_'))}, '{category}', {order})"
    for order, (category, names) in enumerate(defaults.CATEGORY_ALIASES.items())
    for token in dict.fromkeys(n.replace("-", "_") for n in (category, *names))
) + ")"


def category_sql(source: str, key: str, text: str, name: str) -> str:
    """CTE ``name(key, category)``: the alias with most words found in ``text`` of ``source``."""
    return f"""
{name} AS (
  SELECT {key}, arg_max(a.category, a.parts * 10 - a.ord) AS category
  FROM (SELECT {key}, {token_sql(text)} AS t FROM {source}) x
  JOIN alias a ON contains('_' || x.t || '_', '_' || a.name || '_')
  GROUP BY {key})"""


# Class and split of every file from its path alone.
PATH_SQL = f"""
{ALIAS_SQL},
{FILES_SQL},
pieces AS (
  SELECT doc_id, unnest(string_split(substr(path, {len(ROOT) + 2}), '/')) AS part,
         generate_subscripts(string_split(substr(path, {len(ROOT) + 2}), '/'), 1) AS pos,
         len(string_split(substr(path, {len(ROOT) + 2}), '/')) AS n
  FROM files),
tokens AS (SELECT doc_id, pos, n, {token_sql('part')} AS t FROM pieces),
matched AS (
  SELECT doc_id, pos, n, arg_max(category, parts * 10 - ord) AS category
  FROM tokens JOIN alias ON contains('_' || t || '_', '_' || name || '_') GROUP BY doc_id, pos, n),
by_dir AS (SELECT doc_id, arg_max(category, pos) AS category FROM matched WHERE pos < n GROUP BY doc_id),
by_name AS (SELECT doc_id, category FROM matched WHERE pos = n),
stems AS (
  SELECT doc_id, path, {token_sql("regexp_replace(regexp_extract(path, '[^/]*$'), '[.][^.]+$', '')")} AS stem FROM files),
split_steps AS (SELECT doc_id, pos, n, {split_sql('t')} AS split FROM tokens),
split_dir AS (SELECT doc_id, arg_max(split, pos) AS split FROM split_steps WHERE pos < n AND split IS NOT NULL GROUP BY doc_id),
split_name AS (SELECT doc_id, split FROM split_steps WHERE pos = n),
path_facts AS (
  SELECT s.doc_id, s.path,
    coalesce(d.category,
      CASE WHEN regexp_full_match(stem, 'h[0-9]+') THEN 'healthy' WHEN regexp_full_match(stem, 'tb[0-9]+') THEN 'active_tb'
           WHEN regexp_full_match(stem, 's[0-9]+') THEN 'sick_but_non_tb' END,
      n.category) AS category,
    coalesce(sd.split, sn.split) AS split
  FROM stems s LEFT JOIN by_dir d USING (doc_id) LEFT JOIN by_name n USING (doc_id)
  LEFT JOIN split_dir sd USING (doc_id) LEFT JOIN split_name sn USING (doc_id))"""


def raw_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hand-written looking annotations of the documents that have labels: file, class text, split text."""
    labels = table(spark, sf_dir, "labels")
    files = document_files(spark, sf_dir)
    key = F.col("doc_id")
    text = F.when(F.col("toxic") == 1, pick(_RAW_LABELS, F.lit(2))).when(
        F.col("quality") == 1, pick(_RAW_LABELS, (key % 2) * 3)
    ).otherwise(pick(_RAW_LABELS, F.lit(1)))
    split = F.when(key % 5 == 0, "TRAIN").when(key % 5 == 1, "validation 2")
    return files.join(labels, "doc_id").select("doc_id", "path", text.alias("label_text"), split.alias("split_text"))


ANNOTATION_SQL = f"""
notes AS (
  SELECT doc_id, path,
    CASE WHEN toxic = 1 THEN '{_RAW_LABELS[2]}' WHEN quality = 1 AND doc_id % 2 = 0 THEN '{_RAW_LABELS[0]}'
         WHEN quality = 1 THEN '{_RAW_LABELS[3]}' ELSE '{_RAW_LABELS[1]}' END AS label_text,
    CASE doc_id % 5 WHEN 0 THEN 'TRAIN' WHEN 1 THEN 'validation 2' END AS split_text
  FROM files JOIN labels USING (doc_id)),
{category_sql('notes', 'doc_id', 'label_text', 'note_category')},
annotated AS (
  SELECT n.doc_id, n.path, coalesce(c.category, f.category) AS category,
         coalesce({split_sql(token_sql('n.split_text'))}, f.split) AS split
  FROM notes n JOIN path_facts f USING (doc_id) LEFT JOIN note_category c USING (doc_id)
  WHERE coalesce(c.category, f.category) IS NOT NULL
    AND coalesce({split_sql(token_sql('n.split_text'))}, f.split) IS NOT NULL),
folders AS (
  SELECT path, coalesce(split, 'unsplit') AS split, category FROM path_facts
  WHERE {IMAGE_SQL} AND category IS NOT NULL),
records AS (
  SELECT DISTINCT path, split, category FROM annotated
  UNION ALL
  SELECT path, split, category FROM folders
  WHERE category IN ('healthy', 'active_tb', 'sick_but_non_tb') AND category NOT IN (SELECT category FROM annotated))"""


def quality_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions from an integer rule: true class from the labels, predicted class from the document's length.

    Four classes occur; 'flagged' is outside the base list of ``QUALITY_CLASSES``, 'missing' occurs nowhere.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    labels = table(spark, sf_dir, "labels")
    true = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").otherwise("poor")
    predicted = (
        F.when(F.col("n_chars") % 11 == 0, "flagged")
        .when(F.col("n_chars") % 5 == 0, "toxic")
        .when(F.col("n_chars") < 600, "poor")
        .otherwise("good")
    )
    return docs.join(labels, "doc_id").select(
        F.col("doc_id").alias("index"), "lang", "source", true.alias("true_label"), predicted.alias("predicted_label"),
        (F.col("n_chars") % 1000 / 1000.0).alias("binary_score"),
    )


QUALITY_CLASSES = ("poor", "good", "toxic", "missing")
QUALITY_POSITIVE = ("toxic", "absent")

PREDICTIONS_SQL = """
predictions AS (
  SELECT doc_id AS idx, lang, source,
    CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 1 THEN 'good' ELSE 'poor' END AS true_label,
    CASE WHEN n_chars % 11 = 0 THEN 'flagged' WHEN n_chars % 5 = 0 THEN 'toxic' WHEN n_chars < 600 THEN 'poor'
         ELSE 'good' END AS predicted_label,
    n_chars % 1000 / 1000.0::DOUBLE AS score
  FROM documents JOIN labels USING (doc_id)),
classes(label, ord) AS (VALUES ('poor', 0), ('good', 1), ('toxic', 2), ('missing', 3))"""


def by_source_sql(group: str) -> str:
    """CTEs ``stats`` (per group and label) and ``totals`` (per group) of the predictions."""
    return f"""
{PREDICTIONS_SQL},
groups AS (SELECT DISTINCT {group} FROM predictions),
names AS (
  SELECT {group}, label FROM groups, classes
  UNION SELECT {group}, true_label FROM predictions UNION SELECT {group}, predicted_label FROM predictions),
stats AS (
  SELECT n.{group}, n.label,
    count(*) FILTER (WHERE p.true_label = n.label) AS support,
    count(*) FILTER (WHERE p.predicted_label = n.label) AS predicted,
    count(*) FILTER (WHERE p.predicted_label = n.label AND p.true_label = n.label) AS tp
  FROM names n JOIN predictions p ON p.{group} = n.{group} GROUP BY n.{group}, n.label),
scores AS (
  SELECT *, coalesce(tp / nullif(predicted, 0), 0) AS "precision", coalesce(tp / nullif(support, 0), 0) AS recall,
         coalesce(2 * tp / nullif(support + predicted, 0), 0) AS f1 FROM stats),
totals AS (
  SELECT {group}, sum(support) AS total_samples, sum(tp) / sum(support) AS accuracy, avg(f1) AS macro_f1,
         max(predicted) AS top FROM scores GROUP BY {group})"""
