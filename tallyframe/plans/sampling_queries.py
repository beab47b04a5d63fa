"""Ranks, samples, quotas, class weights and weighted draws."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.operators import sampling
from tallyframe.operators.ranking import global_rank
from tallyframe.plans.registry import query, table


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "event_type")


def _turns_sql(order: str, limit: int) -> str:
    return f"""WITH turns AS (
    SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY {order}) AS turn FROM events)
  SELECT event_id, event_type, row_number() OVER (ORDER BY turn, event_type) - 1 AS position FROM turns
  ORDER BY turn, event_type LIMIT {limit}"""


@query(_turns_sql("event_id", 203))
def round_robin_subset(spark, sf_dir):
    return sampling.round_robin(events(spark, sf_dir), "event_type", ["event_id"], 203)


@query(_turns_sql("event_id DESC", 2503))
def round_robin_large_subset(spark, sf_dir):
    return sampling.round_robin(events(spark, sf_dir), "event_type", [F.col("event_id").desc()], 2503)


_LANG_QUOTAS = {"train": {"es": 30, "en": 200, "de": 50}, "val": {"es": 10, "en": 100, "de": 20}}
_EVENT_QUOTAS = {
    "train": {"click": 1000, "view": 1200, "error": 300},
    "val": {"click": 500, "view": 400, "error": 100},
}


def _quota_sql(quotas, frm: str, key: str, label: str) -> str:
    rows, taken = [], {}
    for split, per_class in quotas.items():
        for order, (category, n) in enumerate(per_class.items()):
            start = taken.get(category, 0)
            rows.append(f"('{split}', '{category}', {order}, {start}, {start + n})")
            taken[category] = start + n
    return f"""WITH quota(split, {label}, class_order, start, stop) AS (VALUES {', '.join(rows)}),
  ranked AS (SELECT {key}, {label}, row_number() OVER (PARTITION BY {label} ORDER BY {key}) AS class_rank FROM {frm})
  SELECT {key}, {label}, split, class_order, class_rank FROM ranked JOIN quota USING ({label})
  WHERE class_rank > start AND class_rank <= stop"""


@query(_quota_sql(_LANG_QUOTAS, "documents", "doc_id", "lang"))
def quota_split(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return sampling.quota_split(docs, "lang", ["doc_id"], _LANG_QUOTAS)


@query(_quota_sql(_EVENT_QUOTAS, "events", "event_id", "event_type"))
def quota_split_large(spark, sf_dir):
    return sampling.quota_split(events(spark, sf_dir), "event_type", ["event_id"], _EVENT_QUOTAS)


_SHORT_QUOTAS = {"train": {"en": 500, "fr": 100, "it": 5}, "val": {"en": 60000, "fr": 100000, "it": 5}}


@query("""WITH n AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang),
  quota(split, lang, start, stop) AS (VALUES ('train', 'en', 0, 500), ('train', 'fr', 0, 100), ('train', 'it', 0, 5),
    ('val', 'en', 500, 60500), ('val', 'fr', 100, 100100), ('val', 'it', 5, 10))
  SELECT split, lang, (stop - start)::BIGINT AS expected, greatest(least(coalesce(n, 0), stop) - start, 0)::BIGINT AS available
  FROM quota LEFT JOIN n USING (lang) WHERE greatest(least(coalesce(n, 0), stop) - start, 0) < stop - start""")
def quota_shortfall(spark, sf_dir):
    return sampling.quota_shortfall(table(spark, sf_dir, "documents"), "lang", _SHORT_QUOTAS)


_DIGITS = tuple(str(d) for d in (3, 1, 4, 0, 5, 9, 2, 6))


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("string").alias("label"))


@query(f"""WITH c(label, ord) AS (VALUES {', '.join(f"('{d}', {i})" for i, d in enumerate(_DIGITS))}),
  r AS (SELECT vec_id, e.label::VARCHAR AS label, ord, row_number() OVER (PARTITION BY e.label ORDER BY vec_id) AS turn
        FROM embeddings e JOIN c ON c.label = e.label::VARCHAR QUALIFY turn <= 20)
  SELECT vec_id, label, row_number() OVER (ORDER BY ord, turn) - 1 AS index FROM r""")
def stratified_limit(spark, sf_dir):
    return sampling.stratified_limit(embeddings(spark, sf_dir), "label", ["vec_id"], 20, _DIGITS)


@query("""WITH c(label, ord) AS (VALUES ('error', 0), ('view', 1)),
  r AS (SELECT event_id, event_type, ord, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS turn
        FROM events JOIN c ON label = event_type QUALIFY turn <= 1500)
  SELECT event_id, event_type, row_number() OVER (ORDER BY ord, turn) - 1 AS index FROM r""")
def stratified_limit_large(spark, sf_dir):
    return sampling.stratified_limit(events(spark, sf_dir), "event_type", ["event_id"], 1500, ("error", "view"))


@query(f"""WITH c(label) AS (VALUES {', '.join(f"('{d}')" for d in (*_DIGITS, '11'))}),
  n AS (SELECT label::VARCHAR AS label, count(*) AS n FROM embeddings GROUP BY 1)
  SELECT label, 300 - coalesce(n, 0) AS missing FROM c LEFT JOIN n USING (label) WHERE 300 - coalesce(n, 0) > 0""")
def class_shortfall(spark, sf_dir):
    return sampling.class_shortfall(embeddings(spark, sf_dir), "label", (*_DIGITS, "11"), 300)


_BASE = ("fr", "es", "de")


def _calibration_sql(total: int) -> str:
    return f"""WITH c(lang, ord) AS (VALUES ('fr', 0), ('es', 1), ('de', 2)),
  t AS (SELECT doc_id, d.lang, coalesce(ord, 3) AS ord,
          row_number() OVER (PARTITION BY coalesce(ord, 3) ORDER BY doc_id) AS turn
        FROM documents d LEFT JOIN c USING (lang)),
  picked AS (SELECT doc_id, lang, row_number() OVER (ORDER BY ord = 3, turn, ord) - 1 AS position FROM t)
  SELECT doc_id, lang, position FROM picked WHERE position < {total}"""


@query(_calibration_sql(600))
def calibration_select(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return sampling.calibration_sample(docs, "lang", ["doc_id"], 600, _BASE)


@query(f"SELECT lang, count(*) AS n FROM ({_calibration_sql(600)}) GROUP BY lang")
def calibration_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return sampling.calibration_counts(sampling.calibration_sample(docs, "lang", ["doc_id"], 600, _BASE), "lang")


@query("""SELECT lang, arg_min(doc_id, (CASE WHEN source = 'src3' THEN 0 ELSE 1 END, path)) AS doc_id,
    arg_min(source, (CASE WHEN source = 'src3' THEN 0 ELSE 1 END, path)) AS source,
    arg_min(path, (CASE WHEN source = 'src3' THEN 0 ELSE 1 END, path)) AS path
  FROM (SELECT *, '/docs/' || doc_id AS path FROM documents) GROUP BY lang""")
def pick_per_class(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        "lang", "doc_id", "source", F.concat(F.lit("/docs/"), F.col("doc_id").cast("string")).alias("path")
    )
    return sampling.pick_per_class(docs, "lang", "path", "source", "src3")


@query("""SELECT w.lang, (SELECT min(doc_id) FROM documents d WHERE d.lang = w.lang) AS first_index
  FROM (VALUES ('de'), ('es'), ('xx')) w(lang)""")
def first_index_per_label(spark, sf_dir):
    return sampling.first_index_per_label(table(spark, sf_dir, "documents"), "lang", "doc_id", ("de", "es", "xx"))


@query("SELECT c_custkey, c_name FROM customer ORDER BY md5('42:' || c_custkey), c_custkey LIMIT 100")
def seeded_sample(spark, sf_dir):
    return sampling.seeded_sample(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey", 100, 42)


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F' ORDER BY md5('7:' || o_orderkey), o_orderkey LIMIT 2500")
def seeded_sample_of_split(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return sampling.seeded_sample(orders, "o_orderkey", 2500, 7, ("o_orderstatus", "F"))


@query("""SELECT o_orderkey, row_number() OVER (ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey) - 1 AS index
  FROM orders""")
def dense_index(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    order = ["o_orderpriority", F.col("o_totalprice").desc(), "o_orderkey"]
    return sampling.reindex(orders, order).select("o_orderkey", "index")


@query("""SELECT o_orderkey, o_orderpriority,
    row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) AS rank FROM orders""")
def rank_in_class(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderdate")
    ranked = global_rank(orders, ["o_orderdate", "o_orderkey"], ["o_orderpriority"])
    return ranked.select("o_orderkey", "o_orderpriority", "rank")


@query("""WITH i AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS index FROM events)
  SELECT event_id, index, index // 64 AS batch FROM i""")
def batch_assign(spark, sf_dir):
    indexed = sampling.reindex(table(spark, sf_dir, "events").select("event_id"), ["event_id"])
    return sampling.batches(indexed, 64)


@query("SELECT event_id, event_type FROM events ORDER BY event_id LIMIT 150")
def first_rows(spark, sf_dir):
    return sampling.first_rows(events(spark, sf_dir), 150, ["event_id"])


@query("""SELECT event_type, count(*) AS n,
    round(pow(1.0 / count(*), 0.5) * CASE event_type WHEN 'error' THEN 2.0 ELSE 1.0 END, 6) AS weight
  FROM events GROUP BY event_type""")
def class_weights(spark, sf_dir):
    exponent = sampling.weight_exponent(None, "soft-balanced")
    weights = sampling.class_weights(events(spark, sf_dir), "event_type", "error", 2.0, exponent)
    return weights.withColumn("weight", F.round("weight", 6))


@query("""WITH n AS (SELECT quality, count(*) AS n FROM labels GROUP BY quality)
  SELECT doc_id, quality::VARCHAR AS quality, round(1.0 / n, 6) AS weight FROM labels JOIN n USING (quality)""")
def row_weights(spark, sf_dir):
    rows = sampling.require_labels(table(spark, sf_dir, "labels").select("doc_id", "quality"), "quality")
    weights = sampling.class_weights(rows, "quality", exponent=sampling.weight_exponent(None))
    return sampling.attach_weights(rows, weights, "quality").select("doc_id", "quality", F.round("weight", 6).alias("weight"))


def _draws_sql(frm: str, key: str, label: str, seed: int, weight: str) -> str:
    unit = "('0x' || substr(md5('{0}:' || draw), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE"
    return f"""WITH n AS (SELECT {label}, count(*) AS n, {weight} AS weight FROM {frm} GROUP BY {label}),
  mass AS (SELECT {label}, n, (sum(n * weight) OVER (ORDER BY {label}) - n * weight) / (SELECT sum(n * weight) FROM n) AS lower,
             sum(n * weight) OVER (ORDER BY {label}) / (SELECT sum(n * weight) FROM n) AS upper,
             row_number() OVER (ORDER BY {label} DESC) = 1 AS is_last FROM n),
  draws AS (SELECT range AS draw FROM range((SELECT count(*) FROM {frm}))),
  units AS (SELECT draw, {unit.format(f'{seed}:class')} AS u, {unit.format(f'{seed}:row')} AS v FROM draws),
  picks AS (SELECT draw, {label}, floor(v * n)::BIGINT + 1 AS rank FROM units JOIN mass ON u >= lower AND (u < upper OR is_last)),
  ranked AS (SELECT {key}, {label}, row_number() OVER (PARTITION BY {label} ORDER BY {key}) AS rank FROM {frm})
  SELECT draw, {key}, {label} FROM picks JOIN ranked USING ({label}, rank)"""


@query(_draws_sql("events", "event_id", "event_type", 42, "1.0 / count(*)"))
def weighted_draws(spark, sf_dir):
    return sampling.weighted_draws(events(spark, sf_dir), "event_type", ["event_id"], 42)


@query(_draws_sql("labels", "doc_id", "toxic", 5, "1.0 / count(*) * CASE toxic WHEN 1 THEN 3.0 ELSE 1.0 END"))
def weighted_draws_of_rare_class(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return sampling.weighted_draws(labels, "toxic", ["doc_id"], 5, boost_class=1, boost=3.0, rows_per_salt=4)


@query("""WITH m AS (SELECT doc_id, lang, coalesce(n_chars, 0) AS mass FROM documents),
  line AS (SELECT *, sum(mass) OVER (ORDER BY doc_id)::BIGINT AS reached FROM m),
  total AS (SELECT sum(mass)::BIGINT AS total FROM m),
  points AS (SELECT draw, least(floor(('0x' || substr(md5('11:row:' || draw), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE
      * total::DOUBLE)::BIGINT, total - 1) AS place
    FROM (SELECT range AS draw FROM range((SELECT count(*) FROM documents))), total)
  SELECT draw, doc_id, lang, mass FROM points JOIN line ON place >= reached - mass AND place < reached""")
def weighted_row_draws(spark, sf_dir):
    """Documents drawn by their length."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.coalesce("n_chars", F.lit(0)).cast("bigint").alias("mass"))
    return sampling.weighted_row_draws(docs, F.col("mass"), ["doc_id"], 11)


@query("""WITH c AS (SELECT doc_id, CASE WHEN lang <> 'en' THEN lang END AS lang FROM documents),
  n AS (SELECT lang, count(*) AS n, 1.0 / count(*) AS weight FROM c GROUP BY lang),
  mass AS (SELECT lang, n, (sum(n * weight) OVER w - n * weight) / (SELECT sum(n * weight) FROM n) AS lower,
      sum(n * weight) OVER w / (SELECT sum(n * weight) FROM n) AS upper,
      row_number() OVER (ORDER BY lang DESC NULLS LAST) = 1 AS is_last FROM n WINDOW w AS (ORDER BY lang NULLS FIRST)),
  units AS (SELECT draw, ('0x' || substr(md5('4:class:' || draw), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u,
      ('0x' || substr(md5('4:row:' || draw), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS v
    FROM (SELECT range AS draw FROM range((SELECT count(*) FROM c)))),
  picks AS (SELECT draw, lang, floor(v * n)::BIGINT + 1 AS rank FROM units JOIN mass ON u >= lower AND (u < upper OR is_last)),
  ranked AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rank FROM c)
  SELECT draw, doc_id, r.lang FROM picks p JOIN ranked r ON p.lang IS NOT DISTINCT FROM r.lang AND p.rank = r.rank""")
def weighted_draws_of_unlabelled(spark, sf_dir):
    """Draws over languages of which the largest is unknown: null is a class."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.expr("CASE WHEN lang <> 'en' THEN lang END").alias("lang"))
    return sampling.weighted_draws(docs, "lang", ["doc_id"], 4)
