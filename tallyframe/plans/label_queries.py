"""Label and path normalisation, record sets, path resolution and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe import defaults
from tallyframe.functions import paths, tokens
from tallyframe.functions.image_headers import checked_header
from tallyframe.operators import aliases, audit, records
from tallyframe.plans import fixtures as fx
from tallyframe.plans.registry import query, table
from tallyframe.session import materialize


@query(f"""SELECT p_partkey, {fx.token_sql('p_name')} AS name_token, {fx.token_sql('p_brand')} AS brand_token,
  {fx.token_sql("p_name || '!! (' || p_brand || ') '")} AS joined_token FROM part""")
def normalize_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    joined = F.concat("p_name", F.lit("!! ("), "p_brand", F.lit(") "))
    return part.select(
        "p_partkey",
        tokens.normalize_token(F.col("p_name")).alias("name_token"),
        tokens.normalize_token(F.col("p_brand")).alias("brand_token"),
        tokens.normalize_token(joined).alias("joined_token"),
    )


@query(f"SELECT doc_id, md5({fx.token_sql('text')}) AS token_hash, length({fx.token_sql('text')}) AS token_length FROM documents")
def normalize_texts(spark, sf_dir):
    token = tokens.normalize_token(F.col("text"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.md5(token.cast("binary")).alias("token_hash"), F.length(token).cast("bigint").alias("token_length")
    )


_ITEM_ALIASES_SQL = f"""listed AS (SELECT 'c' || (item_id % 5) AS category, item_id % 5 AS position,
    array_to_string(string_split(text, ' ')[1:(item_id % 3 + 1)::INT], ' ') AS alias FROM benchmark),
  every AS (SELECT * FROM listed UNION ALL SELECT category, min(position), category FROM listed GROUP BY category),
  aliases AS (SELECT DISTINCT category, position, {fx.token_sql('alias')} AS alias FROM every)"""


@query(f"""WITH {_ITEM_ALIASES_SQL}, tokens AS (SELECT doc_id, '_' || {fx.token_sql('text')} || '_' AS token FROM documents)
SELECT doc_id, (SELECT arg_min(category, [-len(string_split(alias, '_')), position]) FROM aliases
  WHERE alias <> '' AND contains(token, '_' || alias || '_')) AS category FROM tokens""")
def alias_table_categories(spark, sf_dir):
    """Classes of whole documents by a table of aliases: the words that benchmark items begin with."""
    item = F.col("item_id")
    words = F.slice(F.split("text", " "), F.lit(1), (item % 3 + 1).cast("int"))
    listed = table(spark, sf_dir, "benchmark").select(
        F.concat(F.lit("c"), item % 5).alias("category"), F.array_join(words, " ").alias("alias"), (item % 5).alias("position")
    )
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return aliases.categories_by_alias(docs, "text", listed).select("doc_id", "category")


_PRIORITY_ALIASES = {
    "soon": ("urgent", "high"),
    "later": ("low", "medium"),
    "unknown": ("not specified", "4"),
    "given": ("specified",),
}


@query("""SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '%NOT SPECIFIED' THEN 'unknown'
  WHEN o_orderpriority LIKE '%URGENT' OR o_orderpriority LIKE '%HIGH' THEN 'soon' ELSE 'later' END AS category
  FROM orders""")
def canonical_labels(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", tokens.canonical_category(F.col("o_orderpriority"), _PRIORITY_ALIASES).alias("category")
    )


@query(f"""WITH {fx.ALIAS_SQL}, {fx.FILES_SQL}, {fx.category_sql('files', 'doc_id', 'path', 'best')}
  SELECT doc_id, best.category FROM files LEFT JOIN best USING (doc_id)""")
def canonical_labels_of_paths(spark, sf_dir):
    return fx.document_files(spark, sf_dir).select(
        "doc_id", tokens.canonical_category(F.col("path")).alias("category")
    )


@query(f"""WITH {fx.FILES_SQL}
  SELECT doc_id, {fx.split_sql(fx.token_sql("string_split(path, '/')[3]"))} AS split FROM files""")
def canonical_splits(spark, sf_dir):
    folder = F.get(F.split("path", "/"), F.lit(2))
    return fx.document_files(spark, sf_dir).select("doc_id", tokens.canonical_split(folder).alias("split"))


@query(f"""WITH {fx.FILES_SQL}
  SELECT doc_id, lower(regexp_extract(path, '[.][^.]+$')) AS extension,
    regexp_replace(regexp_extract(path, '[^/]*$'), '[.][^.]+$', '') AS stem,
    {fx.IMAGE_SQL} AS is_image, regexp_matches(path, '[.]csv$') AS is_annotation FROM files""")
def file_kinds(spark, sf_dir):
    path = F.col("path")
    return fx.document_files(spark, sf_dir).select(
        "doc_id",
        paths.extension(path).alias("extension"),
        paths.stem(path).alias("stem"),
        paths.is_image(path).alias("is_image"),
        paths.is_annotation(path).alias("is_annotation"),
    )


@query(f"WITH {fx.PATH_SQL} SELECT doc_id, category FROM path_facts")
def label_from_path(spark, sf_dir):
    return fx.document_files(spark, sf_dir).select(
        "doc_id", tokens.category_from_path(F.col("path"), fx.ROOT).alias("category")
    )


@query(f"WITH {fx.PATH_SQL} SELECT doc_id, split FROM path_facts")
def split_from_path(spark, sf_dir):
    return fx.document_files(spark, sf_dir).select(
        "doc_id", tokens.split_from_path(F.col("path"), fx.ROOT).alias("split")
    )


def annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.col("path")
    return fx.raw_annotations(spark, sf_dir).select(
        "path",
        F.coalesce(
            tokens.canonical_split(F.col("split_text")), tokens.split_from_path(path, fx.ROOT)
        ).alias("split"),
        F.coalesce(
            tokens.canonical_category(F.col("label_text")), tokens.category_from_path(path, fx.ROOT)
        ).alias("category"),
    ).where("split is not null and category is not null")


_RECORDS = f"WITH {fx.PATH_SQL}, {fx.ANNOTATION_SQL}"


@query(f"{_RECORDS} SELECT path, split, category FROM annotated")
def annotated_records(spark, sf_dir):
    return annotated(spark, sf_dir)


@query(f"{_RECORDS} SELECT path, split, category FROM folders")
def folder_records(spark, sf_dir):
    return records.records_from_folders(fx.document_files(spark, sf_dir), fx.ROOT)


@query(f"{_RECORDS} SELECT DISTINCT path, split, category FROM annotated")
def distinct_records(spark, sf_dir):
    twice = annotated(spark, sf_dir)
    return records.distinct_records(twice.unionByName(twice))


def combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    folders = records.records_from_folders(fx.document_files(spark, sf_dir), fx.ROOT)
    return records.combine_records(annotated(spark, sf_dir), folders)[0]


@query(f"{_RECORDS} SELECT path, split, category FROM records")
def dedupe_union_fill(spark, sf_dir):
    return combined(spark, sf_dir)


@query(f"""{_RECORDS} SELECT t.category FROM (VALUES ('healthy'), ('active_tb'), ('sick_but_non_tb')) t(category)
  WHERE t.category NOT IN (SELECT category FROM annotated)""")
def missing_categories(spark, sf_dir):
    return records.missing_categories(annotated(spark, sf_dir))


@query(f"{_RECORDS} SELECT split, count(*) AS n FROM records GROUP BY split")
def split_counts(spark, sf_dir):
    return records.split_counts(combined(spark, sf_dir))


@query(f"""{_RECORDS} SELECT split, count(*) FILTER (WHERE category = 'healthy') AS healthy,
  count(*) FILTER (WHERE category = 'active_tb') AS active_tb,
  count(*) FILTER (WHERE category = 'sick_but_non_tb') AS sick_but_non_tb
  FROM (SELECT split, category FROM records UNION ALL VALUES ('train', NULL), ('val', NULL), ('test', NULL)) GROUP BY split""")
def split_class_distribution(spark, sf_dir):
    return records.class_distribution(combined(spark, sf_dir))


@query(f"{_RECORDS} SELECT split, category, count(*) AS n FROM records GROUP BY split, category")
def split_category_counts(spark, sf_dir):
    return records.distribution(combined(spark, sf_dir))


@query(f"{_RECORDS} SELECT DISTINCT split FROM records WHERE split NOT IN ('train', 'val', 'test')")
def extra_splits(spark, sf_dir):
    return records.extra_splits(combined(spark, sf_dir))


@query(f"""{_RECORDS} SELECT count(*) FILTER (WHERE split = 'train') AS train, count(*) FILTER (WHERE split = 'val') AS val
  FROM records""")
def dataset_counts(spark, sf_dir):
    return records.dataset_counts(combined(spark, sf_dir))


# ---- path resolution over the pages -------------------------------------------------------------------------------

_HOST, _PAGE = r"^[a-z]+://([^/]+)/", r"^[a-z]+://[^/]+/([^?#]*?)/?([?#].*)?$"


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a file ``/site/host/lang/number``; the numbers collide between hosts."""
    pages = table(spark, sf_dir, "pages")
    below = F.concat_ws("/", F.regexp_extract("url", _HOST, 1), F.regexp_extract("url", _PAGE, 1))
    return pages.select("page_id", below.alias("below"), F.concat(F.lit("/site/"), below).alias("path"))


def raw_page_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("page_id")
    name = paths.base_name(F.col("path"))
    raw = (
        F.when(key % 7 == 6, F.concat(F.lit("lost-"), key.cast("string")))
        .when(key % 4 == 0, F.col("path"))
        .when(key % 4 == 1, F.concat(F.lit("./"), F.col("below")))
        .when(key % 4 == 2, name)
        .otherwise(F.concat(F.lit("moved/"), name))
    )
    return page_files(spark, sf_dir).select("page_id", raw.alias("raw_path"))


_PAGES_SQL = r"""
files AS (
  SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]+)/', 1) || '/' ||
         regexp_extract(url, '^[a-z]+://[^/]+/([^?#]*?)/?([?#].*)?$', 1) AS below FROM pages),
inventory AS (SELECT DISTINCT CASE WHEN page_id % 2 = 0 THEN '/site/' ELSE '/site/old/' END || below AS path FROM files),
names AS (SELECT regexp_extract(path, '[^/]*$') AS name, min(path) AS path FROM inventory GROUP BY 1),
raws AS (
  SELECT page_id, CASE WHEN page_id % 7 = 6 THEN 'lost-' || page_id WHEN page_id % 4 = 0 THEN '/site/' || below
    WHEN page_id % 4 = 1 THEN './' || below WHEN page_id % 4 = 2 THEN regexp_extract(below, '[^/]*$')
    ELSE 'moved/' || regexp_extract(below, '[^/]*$') END AS raw_path FROM files)"""


def page_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as they lie on the disk: every other one in a folder for old pages."""
    folder = F.when(F.col("page_id") % 2 == 0, "/site/").otherwise("/site/old/")
    return page_files(spark, sf_dir).select(F.concat(folder, F.col("below")).alias("path")).distinct()


@query(f"""WITH {_PAGES_SQL}
  SELECT page_id, raw_path, coalesce(i.path, n.path) AS path FROM raws
  LEFT JOIN inventory i ON i.path = CASE WHEN raw_path LIKE '/%' THEN raw_path
    ELSE '/site/' || regexp_replace(raw_path, '^[.]/', '') END
  LEFT JOIN names n ON n.name = regexp_extract(raw_path, '[^/]*$')""")
def path_resolution(spark, sf_dir):
    return records.resolve_paths(
        raw_page_paths(spark, sf_dir), page_inventory(spark, sf_dir), "/site", "raw_path", keep_unresolved=True
    )


@query(f"WITH {_PAGES_SQL} SELECT page_id, '/site/' || below AS path FROM files WHERE '/site/' || below IN (SELECT path FROM inventory)")
def existing_paths(spark, sf_dir):
    files = page_files(spark, sf_dir).select("page_id", "path")
    return records.existing_only(files, page_inventory(spark, sf_dir)).select("page_id", "path")


@query(f"""WITH {_PAGES_SQL}
  SELECT page_id, raw_path, 'missing' AS problem FROM raws WHERE raw_path NOT IN (SELECT path FROM inventory)
  UNION ALL SELECT page_id, raw_path, 'relative' FROM raws WHERE raw_path NOT LIKE '/%'""")
def missing_and_relative_paths(spark, sf_dir):
    raw = raw_page_paths(spark, sf_dir)
    missing = records.missing_paths(raw, page_inventory(spark, sf_dir), "raw_path").withColumn("problem", F.lit("missing"))
    relative = records.relative_paths(raw, "raw_path").withColumn("problem", F.lit("relative"))
    return missing.unionByName(relative).select("page_id", "raw_path", "problem")


_CHAIN_SQL = """
marked AS (SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name = 'NATION_7'),
listed AS (SELECT DISTINCT c_name FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus = 'F')"""


def _listed_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer")
    finished = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return customer.join(finished, "c_custkey", "left_semi").select(F.col("c_name").alias("entry"))


def _chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer")
    return records.annotated_listed_images(
        table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")),
        customer.select(F.col("c_custkey").alias("image_id"), F.col("c_nationkey").alias("category_id")),
        customer.select(
            F.col("c_custkey").alias("position"), F.col("c_custkey").alias("id"), F.col("c_name").alias("file_name")
        ),
        _listed_customers(spark, sf_dir),
        "NATION_7",
    )


@query(f"""WITH {_CHAIN_SQL} SELECT c_custkey AS position, c_name AS file_name FROM customer
  WHERE c_custkey IN (SELECT c_custkey FROM marked) AND c_name IN (SELECT c_name FROM listed)""")
def annotation_semi_chain(spark, sf_dir):
    return _chain(spark, sf_dir)


@query(f"""WITH {_CHAIN_SQL} SELECT c_name AS file_name FROM customer
  WHERE c_custkey IN (SELECT c_custkey FROM marked) AND c_name IN (SELECT c_name FROM listed) ORDER BY c_custkey LIMIT 1""")
def first_annotated_image(spark, sf_dir):
    from tallyframe.operators.sampling import first_row

    return first_row(_chain(spark, sf_dir), "file_name", "position")


@query(f"""WITH {_PAGES_SQL} SELECT '/site/' || below AS path FROM files
  WHERE url_prefix(below) AND '/site/' || below IN (SELECT path FROM inventory) ORDER BY page_id LIMIT 1""".replace(
    "url_prefix(below)", "starts_with(below, 'm.')"))
def first_listed_path(spark, sf_dir):
    from tallyframe.operators.sampling import first_row

    listed = page_files(spark, sf_dir).where(F.col("below").startswith("m.")).select("page_id", "path")
    return first_row(records.existing_only(listed, page_inventory(spark, sf_dir)), "path", "page_id")


@query("""WITH actual AS (SELECT source, lang, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY ALL),
  wanted AS (SELECT source, CASE lang WHEN 'es' THEN 'it' ELSE lang END AS lang, count(*) // 2 AS n FROM documents GROUP BY ALL)
  SELECT source, lang, coalesce(w.n, 0) AS expected, coalesce(a.n, 0) AS actual
  FROM wanted w FULL JOIN actual a USING (source, lang) WHERE coalesce(w.n, 0) <> coalesce(a.n, 0)""")
def count_expectation_diff(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    labelled = docs.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id")
    renamed = docs.withColumn("lang", F.when(F.col("lang") == "es", "it").otherwise(F.col("lang")))
    expected = renamed.groupBy("source", "lang").agg(F.floor(F.count("*") / 2).cast("bigint").alias("n"))
    return records.count_differences(labelled, expected, ["source", "lang"])


@query("SELECT doc_id, n_chars FROM documents WHERE n_chars > 3000 ORDER BY doc_id LIMIT 20")
def first_violations(spark, sf_dir):
    return audit.first_violations(_long_documents(spark, sf_dir), "doc_id", 20)[0]


@query("SELECT greatest(count(*) - 20, 0) AS more FROM documents WHERE n_chars > 3000")
def further_violations(spark, sf_dir):
    return audit.first_violations(_long_documents(spark, sf_dir), "doc_id", 20)[1]


def _long_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("n_chars > 3000").select("doc_id", "n_chars")


def _part_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored image header per part, in turn of each format; every ninth one is cut short, every tenth is no image."""
    key, size = F.col("p_partkey"), F.col("p_size")
    number = F.when(key % 3 == 0, 512).otherwise(1 + key * 37 % 5000), F.when(size % 2 == 0, 512).otherwise(1 + size * 101 % 4000)
    big = lambda value, size: F.lpad(F.hex(value), 2 * size, "0")

    def little(value, size):
        return F.concat(*[F.substring(big(value, size), 2 * n + 1, 2) for n in reversed(range(size))])

    width, height = number
    headers = [
        [F.lit("89504E470D0A1A0A0000000D49484452"), big(width, 4), big(height, 4), F.lit("0806000000")],
        [F.lit("FFD8FFE000104A46494600010100000100010000FFC2000B08"), big(height, 2), big(width, 2), F.lit("01011100")],
        [F.lit("474946383961"), little(width, 2), little(height, 2)],
        [F.lit("424D" + "00" * 12 + "28000000"), little(width, 4), little(height, 4), F.lit("01001800")],
        [F.lit("4D4D002A000000080002" + "0100000300000001"), big(width, 2), F.lit("0000" + "0101000300000001"), big(height, 2), F.lit("0000")],
        [F.lit("524946460000000057454250565038580A00000010000000"), little(width - 1, 3), little(height - 1, 3)],
    ]
    made = F.concat(*headers[0])
    for turn, parts in enumerate(headers[1:], 1):
        made = F.when(key % 6 == turn, F.concat(*parts)).otherwise(made)
    content = F.when(key % 10 == 0, F.lit("6E6F")).when(key % 9 == 0, F.substring(made, 1, 36)).otherwise(made)
    rows = table(spark, sf_dir, "part").select("p_partkey", F.unhex(content).alias("content"))
    return materialize(rows, "images").select("p_partkey", checked_header(F.col("content")).alias("header")).select("p_partkey", "header.*")


_IMAGES_SQL = """WITH made AS (SELECT p_partkey, p_partkey % 6 AS turn,
    CASE WHEN p_partkey % 3 = 0 THEN 512 ELSE 1 + p_partkey * 37 % 5000 END::BIGINT AS w,
    CASE WHEN p_size % 2 = 0 THEN 512 ELSE 1 + p_size * 101 % 4000 END::BIGINT AS h,
    CASE WHEN p_partkey % 10 = 0 THEN 'unknown format' WHEN p_partkey % 9 = 0 THEN 'cut short' END AS error FROM part),
  images AS (SELECT p_partkey, ['png', 'jpeg', 'gif', 'bmp', 'tiff', 'webp'][turn + 1] AS format, w AS width, h AS height,
    [4, 1, 1, 3, 1, 4][turn + 1]::BIGINT AS channels, error FROM made)"""


@query(f"""{_IMAGES_SQL} SELECT p_partkey, CASE WHEN error IS NULL THEN format END AS format,
  CASE WHEN error IS NULL THEN width END AS width, CASE WHEN error IS NULL THEN height END AS height,
  CASE WHEN error IS NULL THEN channels END AS channels, error FROM images""")
def image_headers(spark, sf_dir):
    """Size and channels from stored headers; broken ones have an error instead."""
    good = F.col("readable")
    told = [F.when(good, F.col(name)).alias(name) for name in ("format", "width", "height", "channels")]
    return _part_images(spark, sf_dir).select("p_partkey", *told, "error")


@query(f"""{_IMAGES_SQL} SELECT width, height, error, count(*) AS n FROM (
    SELECT CASE WHEN error IS NULL THEN width END AS width, CASE WHEN error IS NULL THEN height END AS height, error FROM images)
  WHERE error IS NOT NULL OR width <> 512 OR height <> 512 GROUP BY ALL""")
def wrong_sizes(spark, sf_dir):
    headers = _part_images(spark, sf_dir)
    told = [F.when(F.col("readable"), F.col(name)).alias(name) for name in ("width", "height")]
    return audit.wrong_size(headers, defaults.IMAGE_SIZE).select(*told, "error").groupBy("width", "height", "error").agg(F.count("*").alias("n"))
