"""Sources and sinks: each query writes files derived from the tables to the scratch folder and reads them back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.functions import messages as msg
from tallyframe.operators import conversations, metrics, records, sampling
from tallyframe.plans import conversation_queries as cq
from tallyframe.plans import dataset_build
from tallyframe.plans import fixtures as fx
from tallyframe.plans import metric_queries as mq
from tallyframe.plans.registry import query, table
from tallyframe.session import scratch_path
from tallyframe.sources import annotations, files, sinks
from tallyframe.sources import conversations as readers

_PROMPT_SQL = cq.defaults.PROMPT


def written_conversations(spark: SparkSession, sf_dir: str) -> str:
    """Training conversations of the labelled documents, one folder per split."""
    talks = cq.labelled_files(spark, sf_dir).select(
        "split", msg.training_messages(F.col("path"), F.col("category")).alias("messages")
    )
    path = scratch_path(spark, "conversations")
    sinks.write_conversations(talks, path, by_split=True)
    return path


@query(f"WITH {cq.LABELLED_SQL} SELECT path AS image_path, category AS true_label FROM labelled WHERE split = 'val'")
def evaluation_samples(spark, sf_dir):
    path = written_conversations(spark, sf_dir)
    return readers.evaluation_samples(spark, f"{path}/split=val").select("image_path", "true_label")


@query(f"""WITH {cq.LABELLED_SQL} SELECT count(*) AS n, 0::BIGINT AS first_index, count(*) - 1 AS last_index, count(*) AS n_distinct
  FROM labelled WHERE split = 'train'""")
def evaluation_index(spark, sf_dir):
    path = written_conversations(spark, sf_dir)
    return readers.evaluation_samples(spark, f"{path}/split=train", strict=False).agg(
        F.count("*").alias("n"), F.min("index").alias("first_index"), F.max("index").alias("last_index"),
        F.count_distinct("index").alias("n_distinct"),
    )


@query(f"""WITH {cq.LABELLED_SQL} SELECT path, category AS label, 'user,assistant' AS roles FROM labelled WHERE split = 'train'""")
def training_rows(spark, sf_dir):
    path = written_conversations(spark, sf_dir)
    rows = readers.training_rows(spark, f"{path}/split=train")
    talk = msg.feature_messages(F.lit(None).cast(msg.MESSAGES_TYPE), F.col("messages_json"))
    parsed = rows.withColumn("messages", talk)
    return parsed.select(msg.image_path(F.col("messages")).alias("path"), "label", msg.roles(F.col("messages")).alias("roles"))


@query(f"""WITH {cq.LABELLED_SQL} SELECT split, count(*) AS total_records, count(*) FILTER (WHERE category = 'healthy') AS healthy,
  count(*) FILTER (WHERE path NOT IN (SELECT path FROM disk)) AS missing_paths, 0::BIGINT AS relative_paths, count(*) FILTER (WHERE path NOT IN (SELECT path FROM disk)) = 0 AS is_valid
  FROM labelled GROUP BY split""")
def build_dataset(spark, sf_dir):
    chosen = cq.labelled_files(spark, sf_dir).select("path", "split", "category")
    built = dataset_build.build_dataset(chosen, fx.disk_inventory(spark, sf_dir), scratch_path(spark, "dataset"))
    return built.summaries.select(
        "split", "total_records", F.element_at("category_counts", "healthy").alias("healthy"),
        "missing_paths", "relative_paths", "is_valid",
    )


@query(f"""WITH {cq.LABELLED_SQL}, wanted(split, category, n) AS (VALUES ('train', 'active_tb', 600), ('train', 'healthy', 3000),
    ('train', 'sick_but_non_tb', 3000), ('val', 'active_tb', 200), ('val', 'healthy', 800), ('val', 'sick_but_non_tb', 800)),
  actual AS (SELECT split, category, count(*) AS n FROM labelled GROUP BY ALL)
  SELECT split, category, coalesce(w.n, 0)::BIGINT AS expected, coalesce(a.n, 0) AS actual FROM wanted w FULL JOIN actual a
  USING (split, category) WHERE coalesce(w.n, 0) <> coalesce(a.n, 0)""")
def build_dataset_differences(spark, sf_dir):
    chosen = cq.labelled_files(spark, sf_dir).select("path", "split", "category")
    inventory = fx.document_files(spark, sf_dir).select("path")
    return dataset_build.build_dataset(chosen, inventory, scratch_path(spark, "dataset")).differences


@query(f"""WITH {fx.PATH_SQL} SELECT path, 'val' AS split, category FROM path_facts
  WHERE category IS NOT NULL AND {fx.IMAGE_SQL} AND path IN (SELECT path FROM disk)""")
def listed_records(spark, sf_dir):
    """A list of relative paths with blank lines; some of the files are not on the disk."""
    found = fx.document_files(spark, sf_dir)
    entry = F.concat(F.lit("  "), F.substr(F.col("path"), F.lit(len(fx.ROOT) + 2)))
    path = scratch_path(spark, "list")
    found.select(F.explode(F.array(entry, F.lit("  "))).alias("value")).write.text(path)
    inventory = files.images(fx.disk_inventory(spark, sf_dir))
    return readers.listed_records(spark, path, "val", fx.ROOT, inventory, fx.ROOT)


_CHOICE_QUOTAS = {"val": {"healthy": 7, "active_tb": 9, "sick_but_non_tb": 5}}
_CHOICE_SQL = f"""WITH {fx.PATH_SQL}, {fx.ANNOTATION_SQL}, flat AS (
    SELECT CASE lang WHEN 'en' THEN 'healthy' WHEN 'de' THEN 'sick_but_non_tb' ELSE 'active_tb' END AS category,
      '{fx.ROOT}/flat/' || CASE lang WHEN 'en' THEN 'h' WHEN 'de' THEN 's' ELSE 'tb' END || doc_id || '.png' AS path FROM documents),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY path) AS place FROM flat)
  SELECT path, 'train' AS split, category FROM path_facts
    WHERE category IS NOT NULL AND {fx.IMAGE_SQL} AND path IN (SELECT path FROM disk) AND doc_id % 4 = 0
  UNION ALL SELECT path, 'val', category FROM ranked
    WHERE place <= CASE category WHEN 'healthy' THEN 7 WHEN 'active_tb' THEN 9 ELSE 5 END
  UNION ALL SELECT path, split, category FROM folders WHERE split = 'test' AND path IN (SELECT path FROM disk)"""


@query(_CHOICE_SQL)
def chosen_records(spark, sf_dir):
    """Three splits from three sources: a list of files, a flat folder by quota, and the folders themselves.

    The root is a name in the inventory only; whatever a store holds there by chance is not read.
    """
    docs = table(spark, sf_dir, "documents")
    letter = F.when(F.col("lang") == "en", "h").when(F.col("lang") == "de", "s").otherwise("tb")
    flat = docs.select(F.concat(F.lit(f"{fx.ROOT}/flat/"), letter, F.col("doc_id"), F.lit(".png")).alias("path"))
    there = fx.disk_inventory(spark, sf_dir).where(F.col("path").startswith(f"{fx.ROOT}/"))
    listed = scratch_path(spark, "list")
    named = fx.document_files(spark, sf_dir).where("doc_id % 4 = 0")
    named.select(F.substr(F.col("path"), F.lit(len(fx.ROOT) + 2)).alias("value")).write.text(listed)
    absent = f"{listed}.absent"
    lists = {"train": listed, "val": absent, "test": absent}
    inventory = there.unionByName(flat)
    return dataset_build.choose_records(spark, fx.ROOT, lists, fx.ROOT, f"{fx.ROOT}/flat", _CHOICE_QUOTAS, inventory, absent)


@query("SELECT count(*) AS n, count(DISTINCT doc_id) AS n_distinct FROM documents")
def list_entries(spark, sf_dir):
    path = scratch_path(spark, "list")
    docs = table(spark, sf_dir, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit("\n \n")).alias("value"))
    docs.write.text(path)
    entries = files.list_entries(spark, path)
    return entries.agg(F.count("*").alias("n"), F.count_distinct("entry").alias("n_distinct"))


def written_annotations(spark: SparkSession, sf_dir: str) -> str:
    """Annotations of the labelled documents as headed CSV, headed TSV and headerless text lists."""
    root = scratch_path(spark, "annotations")
    notes = fx.raw_annotations(spark, sf_dir)
    named = notes.select(
        "doc_id", F.substr(F.col("path"), F.lit(len(fx.ROOT) + 2)).alias("Image Path"), F.col("label_text").alias("Finding"),
        F.col("split_text").alias("Data Set"),
    )
    named.where("doc_id % 3 = 0").drop("doc_id").write.option("header", True).csv(f"{root}/comma")
    named.where("doc_id % 3 = 1").drop("doc_id").write.options(header=True, sep="\t", extension="tsv").csv(f"{root}/tab")
    words = F.concat_ws(" ", "path", "label_text", "split_text").alias("value")
    notes.where("doc_id % 3 = 2").select(words).write.text(f"{root}/words")
    return root


def _annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = written_annotations(spark, sf_dir)
    written = files.file_inventory(spark, folder).select("path")
    pictures = files.images(fx.document_files(spark, sf_dir).select("path"))
    return annotations.annotation_records(spark, fx.ROOT, written.unionByName(pictures), folder=folder)


@query(f"WITH {fx.PATH_SQL}, {fx.ANNOTATION_SQL} SELECT DISTINCT path, split, category FROM annotated WHERE {fx.IMAGE_SQL}")
def annotation_files(spark, sf_dir):
    return records.distinct_records(_annotated(spark, sf_dir))


@query(f"""WITH {fx.PATH_SQL}, {fx.ANNOTATION_SQL} SELECT CASE doc_id % 3 WHEN 0 THEN 'csv' WHEN 1 THEN 'tsv' ELSE 'txt' END AS kind,
  count(*) AS n FROM annotated WHERE {fx.IMAGE_SQL} GROUP BY 1""")
def annotation_formats(spark, sf_dir):
    kind = F.regexp_extract("source", r"([a-z]+)$", 1)
    return _annotated(spark, sf_dir).groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@query(f"WITH {fx.PATH_SQL}, {fx.ANNOTATION_SQL} SELECT path, split, category FROM annotated WHERE {fx.IMAGE_SQL}")
def annotation_line_breaks(spark, sf_dir):
    """Headed CSV whose notes, in front of the class, hold line breaks and quotes: one file, read in blocks of 8 KB."""
    notes = fx.raw_annotations(spark, sf_dir)
    note = F.concat(F.lit('first, "'), F.col("doc_id"), F.lit('"\nsecond'))
    named = notes.select(F.substr(F.col("path"), F.lit(len(fx.ROOT) + 2)).alias("Image Path"), note.alias("Note\nof it"),
                         F.col("label_text").alias("Finding"), F.col("split_text").alias("Data Set"))
    root = scratch_path(spark, "breaks")
    named.coalesce(1).write.options(header=True, escape='"').csv(root)
    pictures = files.images(fx.document_files(spark, sf_dir).select("path"))
    inventory = files.file_inventory(spark, root).select("path").unionByName(pictures)
    return _read_in_blocks(spark, inventory, root)


def _read_in_blocks(spark: SparkSession, inventory: DataFrame, folder: str) -> DataFrame:
    found = annotations.annotation_records(spark, fx.ROOT, inventory, folder=folder, block_bytes=8192)
    return found.select("path", "split", "category")


def _renamed(spark: SparkSession, folder: str, suffix: str) -> None:
    """Give the part files of a written folder another suffix."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    store = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in store.globStatus(path(f"{folder}/part-*")):
        store.rename(status.getPath(), path(f"{folder}/{status.getPath().getName().split('.')[0]}{suffix}"))


@query(f"WITH {fx.PATH_SQL}, {fx.ANNOTATION_SQL} SELECT path, split, category FROM annotated WHERE {fx.IMAGE_SQL} AND doc_id % 2 = 0")
def annotation_lines(spark, sf_dir):
    """JSON lines; one folder has a bad line in each of its files, which drops them."""
    notes = fx.raw_annotations(spark, sf_dir)
    item = F.struct(F.col("path").alias("file_name"), F.col("label_text").alias("finding"), F.col("split_text").alias("phase"))
    line = F.to_json(item, {"ignoreNullFields": "false"})
    root = scratch_path(spark, "lines")
    notes.where("doc_id % 2 = 0").select(line.alias("value")).write.text(f"{root}/good")
    notes.where("doc_id % 2 = 1").select(F.concat(line, F.lit("\n{broken")).alias("value")).write.text(f"{root}/bad")
    for part in ("good", "bad"):
        _renamed(spark, f"{root}/{part}", ".jsonl")
    pictures = files.images(fx.document_files(spark, sf_dir).select("path"))
    inventory = files.file_inventory(spark, root).select("path").unionByName(pictures)
    return annotations.annotation_records(spark, fx.ROOT, inventory, folder=root).select("path", "split", "category")


@query(f"WITH {fx.PATH_SQL}, {fx.ANNOTATION_SQL} SELECT path, split, category FROM annotated WHERE {fx.IMAGE_SQL}")
def annotation_document_blocks(spark, sf_dir):
    """One JSON document of all annotations, read in blocks of 8 KB; its notes hold quotes, commas and brackets."""
    notes = fx.raw_annotations(spark, sf_dir)
    note = F.concat(F.lit('a "note", [{'), F.col("doc_id"), F.lit("\\"))
    item = F.struct(F.col("path").alias("file_name"), note.alias("note"), F.col("label_text").alias("finding"), F.col("split_text").alias("phase"))
    row = F.concat(F.to_json(item, {"ignoreNullFields": "false"}), F.lit(","))
    head = spark.range(1).select(F.lit(0).alias("part"), F.lit('{"info": {"images": [1, 2]}, "records": [').alias("value"))
    end = spark.range(1).select(F.lit(2).alias("part"), F.lit("{}], \"items\": [3]}").alias("value"))
    lines = head.unionByName(notes.select(F.lit(1).alias("part"), row.alias("value"))).unionByName(end)
    root = scratch_path(spark, "document")
    lines.coalesce(1).sortWithinPartitions("part").select("value").write.text(root)
    _renamed(spark, root, ".json")
    pictures = files.images(fx.document_files(spark, sf_dir).select("path"))
    return _read_in_blocks(spark, files.file_inventory(spark, root).select("path").unionByName(pictures), root)


_DOCUMENT_ROWS = 500


def _write_documents(rows: DataFrame, path: str) -> None:
    """One JSON document per row and file; nulls are written, since the first item of a document names its fields."""
    rows.write.options(maxRecordsPerFile=1, ignoreNullFields="false").json(path)


@query(f"WITH {fx.PATH_SQL}, {fx.ANNOTATION_SQL} SELECT path, split, category FROM annotated WHERE {fx.IMAGE_SQL}")
def annotation_documents(spark, sf_dir):
    """JSON documents of at most 500 annotations each."""
    notes = fx.raw_annotations(spark, sf_dir)
    item = F.struct(F.col("path").alias("file_name"), F.col("label_text").alias("finding"), F.col("split_text").alias("phase"))
    packed = notes.groupBy(F.floor(F.col("doc_id") / _DOCUMENT_ROWS)).agg(F.collect_list(item).alias("records"))
    root = scratch_path(spark, "documents")
    _write_documents(packed.select(F.lit("v1").alias("data"), "records"), root)
    pictures = files.images(fx.document_files(spark, sf_dir).select("path"))
    inventory = files.file_inventory(spark, root).select("path").unionByName(pictures)
    return annotations.annotation_records(spark, fx.ROOT, inventory, folder=root).select("path", "split", "category")


@query(f"""WITH {fx.FILES_SQL} SELECT path AS file_name FROM files JOIN documents USING (doc_id)
  WHERE lang = 'fr' AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)""")
def coco_documents(spark, sf_dir):
    """COCO documents of at most 500 images: images of one category that also stand in a list."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    names = ("en", "fr", "de", "es")
    number = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("lang"))
    rows = fx.document_files(spark, sf_dir).join(docs, "doc_id")
    packed = rows.groupBy(F.floor(F.col("doc_id") / _DOCUMENT_ROWS)).agg(
        F.collect_list(F.struct(F.col("doc_id").alias("image_id"), number.alias("category_id"))).alias("annotations"),
        F.collect_list(F.struct(F.col("doc_id").alias("id"), F.col("path").alias("file_name"))).alias("images"),
    )
    categories = F.array(*[F.struct(F.lit(i + 1).alias("id"), F.lit(n).alias("name")) for i, n in enumerate(names)])
    root = scratch_path(spark, "coco")
    _write_documents(packed.select(categories.alias("categories"), "annotations", "images"), root)
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    entries = fx.document_files(spark, sf_dir).join(good, "doc_id").select(F.col("path").alias("entry"))
    return records.annotated_listed_images(*readers.coco_tables(spark, root), entries, "fr").select("file_name")


def _written_orders(spark: SparkSession, sf_dir: str) -> str:
    root = scratch_path(spark, "orders")
    line = F.concat_ws("|", "o_orderkey", "o_custkey", "o_orderpriority").alias("value")
    table(spark, sf_dir, "orders").select("o_orderstatus", line).write.partitionBy("o_orderstatus").text(f"{root}/lines")
    return root


@query("""SELECT 'o_orderstatus=' || o_orderstatus AS directory, sum(strlen(o_orderkey || '|' || o_custkey || '|' || o_orderpriority) + 1)::BIGINT AS size_bytes
  FROM orders GROUP BY 1""")
def directory_sizes(spark, sf_dir):
    root = _written_orders(spark, sf_dir)
    inventory = files.file_inventory(spark, root)
    name = F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)
    return inventory.groupBy(name.alias("directory")).agg(F.sum("length").alias("size_bytes"))


@query("""SELECT sum(strlen(o_orderkey || '|' || o_custkey || '|' || o_orderpriority) + 1)::BIGINT AS size_bytes,
  round(sum(strlen(o_orderkey || '|' || o_custkey || '|' || o_orderpriority) + 1) / 1073741824.0::DOUBLE, 6) AS size_gb FROM orders""")
def size_report(spark, sf_dir):
    report = files.file_metadata(spark, _written_orders(spark, sf_dir))
    return report.select("size_bytes", F.round("size_gb", 6).alias("size_gb"))


@query("""SELECT * FROM (SELECT DISTINCT 'lines/o_orderstatus=' || o_orderstatus AS directory, 2::BIGINT AS depth, true AS has_files FROM orders)
  UNION ALL VALUES ('', 0, false), ('lines', 1, false)""")
def folder_structure(spark, sf_dir):
    root = _written_orders(spark, sf_dir)
    plain = files.file_inventory(spark, root)
    top = plain.select(F.regexp_extract("path", r"^(.*)/lines/", 1).alias("top")).first()["top"]
    tree = files.files_per_directory(plain, top)
    below = F.regexp_replace(F.substr(F.col("directory"), F.lit(len(top) + 1)), "^/", "")
    return tree.select(below.alias("directory"), "depth", (F.col("direct_files") > 0).alias("has_files"))


@query(f"""WITH {fx.by_source_sql('source')},
  steps AS (SELECT unnest(range(22)) AS step)
  SELECT step, total_samples IS NOT NULL AS found, coalesce(total_samples, 0)::BIGINT AS total_samples, round(coalesce(macro_f1, 0), 6) AS macro_f1
  FROM steps LEFT JOIN totals ON source = 'src' || step""")
def checkpoint_files(spark, sf_dir):
    """One metrics document per source and folder, read back by step; steps without a document are reported."""
    root = scratch_path(spark, "checkpoints")
    mq.source_documents(spark, sf_dir).drop("source").write.partitionBy("step").json(root)
    found = readers.checkpoint_metrics(spark, f"{root}/step=*", range(22), r"step=([0-9]+)")
    return found.select(
        "step", "found", F.coalesce("total_samples", F.lit(0)).alias("total_samples"),
        F.round(F.coalesce("macro_f1", F.lit(0.0)), 6).alias("macro_f1"),
    )


@query(f"""WITH {fx.by_source_sql('source')} SELECT substr(source, 4)::BIGINT AS step FROM totals ORDER BY macro_f1 DESC, 1 LIMIT 1""")
def best_checkpoint_file(spark, sf_dir):
    root = scratch_path(spark, "checkpoints")
    mq.source_documents(spark, sf_dir).drop("source").write.partitionBy("step").json(root)
    found = readers.checkpoint_metrics(spark, f"{root}/step=*", range(22), r"step=([0-9]+)")
    return metrics.best_checkpoint(found.where("found")).select("step")


@query(f"""WITH {fx.PREDICTIONS_SQL} SELECT '{{"index":' || idx || ',"predicted_label":"' || predicted_label || '","true_label":"' || true_label || '"}}' AS value
  FROM predictions""")
def prediction_lines(spark, sf_dir):
    path = scratch_path(spark, "evaluation")
    rows = fx.quality_predictions(spark, sf_dir).select("true_label", "predicted_label", "index")
    document = metrics.compute_metrics(rows, fx.QUALITY_CLASSES, fx.QUALITY_POSITIVE, score_col=None)
    _, predictions = sinks.write_evaluation(document, rows, path)
    return spark.read.text(predictions)


@query(f"""WITH {fx.PREDICTIONS_SQL} SELECT count(*) AS total_samples, round(avg((true_label = predicted_label)::INT), 6) AS accuracy,
  'accuracy,binary_positive_labels,binary_roc_auc,class_distribution,confusion_matrix,labels,macro_f1,per_class,prediction_distribution,total_samples' AS keys
  FROM predictions""")
def metrics_file(spark, sf_dir):
    path = scratch_path(spark, "evaluation")
    rows = fx.quality_predictions(spark, sf_dir)
    document = metrics.compute_metrics(rows, fx.QUALITY_CLASSES, fx.QUALITY_POSITIVE)
    target, _ = sinks.write_evaluation(document, rows, path)
    stored = spark.read.text(target)
    return stored.select(
        F.get_json_object("value", "$.total_samples").cast("bigint").alias("total_samples"),
        F.round(F.get_json_object("value", "$.accuracy").cast("double"), 6).alias("accuracy"),
        F.array_join(F.json_object_keys("value"), ",").alias("keys"),
    )


@query(f"""WITH {cq.LABELLED_SQL}, best AS (SELECT category, arg_min(path, (split <> 'train', path)) AS path FROM labelled GROUP BY category)
  SELECT '[' || string_agg('{{"messages":[{{"role":"user","content":[{{"type":"image","path":"' || path || '"}},{{"type":"text","text":"{_PROMPT_SQL}"}}]}},'
    || '{{"role":"assistant","content":"Classification: ' || category || '"}}]}}', ',' ORDER BY list_position(['healthy', 'active_tb', 'sick_but_non_tb'], category)) || ']' AS value
  FROM best""")
def sample_document(spark, sf_dir):
    chosen = cq.labelled_files(spark, sf_dir).select("path", "split", "category")
    path = scratch_path(spark, "samples")
    sinks.write_sample_array(readers.sample_documents(dataset_build.sample_records(None, chosen)), path)
    return spark.read.text(path)


@query(f"""WITH {cq.LABELLED_SQL}, n AS (SELECT category AS label, count(*) AS n FROM labelled WHERE split = 'train' GROUP BY 1)
  SELECT sum(n)::BIGINT AS draws, count(*) AS classes FROM n""")
def training_draws(spark, sf_dir):
    from tallyframe.plans.balanced_sampling import training_draws as draw

    path = written_conversations(spark, sf_dir)
    drawn = draw(spark, f"{path}/split=train", "soft-balanced", boost_class="active_tb", boost=2.0)
    return drawn.agg(F.count_distinct("draw").alias("draws"), F.count_distinct("label").alias("classes"))


@query("SELECT conv_id, turn FROM conversations ORDER BY md5('1:' || conv_id || '-' || turn), conv_id || '-' || turn LIMIT 50")
def spot_checks(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat_ws("-", "conv_id", "turn").alias("key"))
    return sampling.seeded_sample(rows, "key", 50, 1).select("conv_id", "turn")


@query(f"""WITH {cq.LABELLED_SQL} SELECT path AS image_path, 'missing' AS problem FROM labelled WHERE path NOT IN (SELECT path FROM disk)""")
def path_problems(spark, sf_dir):
    path = written_conversations(spark, sf_dir)
    parsed = readers.parsed_lines(spark, [f"{path}/split=train", f"{path}/split=val"])
    return conversations.path_problems(parsed, fx.disk_inventory(spark, sf_dir))
