"""Checks that both pass and fail: gates, deltas, ablation and verdict over event groups, fill-in of a missing class."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe import defaults
from tallyframe.operators import gates, metrics, records
from tallyframe.plans import evaluation
from tallyframe.plans import fixtures as fx
from tallyframe.plans import label_queries as lq
from tallyframe.plans import metric_queries as mq
from tallyframe.plans.registry import query, table
from tallyframe.session import materialize, scratch_path
from tallyframe.sources import conversations as readers

_CLASSES = fx.QUALITY_CLASSES
_EVENTS_SQL = """
predictions AS (
  SELECT idx, lang, source, true_label, 0.5::DOUBLE AS score,
    CASE WHEN source = 'exact' THEN true_label WHEN source = 'blind' OR idx % 9 = 0 THEN 'good'
         WHEN source = 'flat' THEN CASE idx % 3 WHEN 0 THEN 'poor' WHEN 1 THEN 'good' ELSE 'toxic' END
         ELSE true_label END AS predicted_label
  FROM (SELECT event_id AS idx, event_type AS lang,
    CASE event_id % 4 WHEN 0 THEN 'poor' WHEN 1 THEN 'good' WHEN 2 THEN 'toxic' ELSE 'missing' END AS true_label,
    CASE WHEN event_id // 4 % 50 = 7 THEN 'exact' WHEN user_id % 10 < 4 THEN 'large' WHEN user_id % 10 < 6 THEN 'middle'
         WHEN user_id % 10 < 8 THEN 'flat' ELSE 'blind' END AS source FROM events)),
classes(label, ord)"""
_BY_SOURCE_SQL = mq._BY_SOURCE_SQL.replace(fx.PREDICTIONS_SQL.split("classes(label, ord)")[0] + "classes(label, ord)", _EVENTS_SQL)


def event_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A metrics document per group: nearly right, all right and of the full size, of few classes, and blind to all but one class."""
    events = table(spark, sf_dir, "events")
    key, rest = F.col("event_id"), F.col("user_id") % 10
    group = F.when(F.floor(key / 4) % 50 == 7, "exact").when(rest < 4, "large").when(rest < 6, "middle").when(rest < 8, "flat").otherwise("blind")
    true = F.element_at(F.array(*[F.lit(c) for c in ("poor", "good", "toxic", "missing")]), (key % 4 + 1).cast("int"))
    flat = F.element_at(F.array(*[F.lit(c) for c in ("poor", "good", "toxic")]), (key % 3 + 1).cast("int"))
    rows = events.select(key.alias("index"), group.alias("source"), true.alias("true_label"), flat.alias("flat"))
    blind = (F.col("source") == "blind") | (F.col("index") % 9 == 0)
    predicted = F.when(F.col("source") == "exact", F.col("true_label")).when(blind, "good").when(F.col("source") == "flat", F.col("flat")).otherwise(F.col("true_label"))
    return metrics.compute_metrics(
        rows.withColumn("predicted_label", predicted), _CLASSES, fx.QUALITY_POSITIVE, ["source"], score_col=None
    )


_GATES_SQL = " UNION ALL ".join(
    f"SELECT '{defaults.GATE_NAMES[name]}' AS gate, * FROM ({sql})"
    for name, sql in (("run3-diagnostic", mq._EARLY_SQL), ("run4-diagnostic", mq._LATER_SQL), ("run3-full", mq._FULL_SQL))
)


def _checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = event_documents(spark, sf_dir)
    found = None
    for name in ("run3-diagnostic", "run4-diagnostic", "run3-full"):
        part = gates.gate_checks(documents, name, 200, _CLASSES, ["source"])
        found = part if found is None else found.unionByName(part)
    return found


@query(f"{_BY_SOURCE_SQL} {_GATES_SQL}")
def gates_of_events(spark, sf_dir):
    return mq.check_rows(_checks(spark, sf_dir))


@query(f"{_BY_SOURCE_SQL} SELECT source, gate, bool_and(passed) AS passed FROM ({_GATES_SQL}) GROUP BY source, gate")
def gate_results_of_events(spark, sf_dir):
    return gates.gate_result(_checks(spark, sf_dir), ["source"])


@query(f"{_BY_SOURCE_SQL} {mq._DELTA_SQL}")
def baseline_delta_of_events(spark, sf_dir):
    found = gates.baseline_delta(event_documents(spark, sf_dir), mq._BASELINE, 0.02, ["source"])
    return mq._rounded(found, "accuracy", "accuracy_delta", "macro_f1", "macro_f1_delta", "macro_f1_drop")


@query(f"""{_BY_SOURCE_SQL} SELECT source, bool_and(passed) AS passed FROM (
  SELECT source, passed FROM ({mq._EARLY_SQL}) UNION ALL SELECT source, passed FROM ({mq._DELTA_SQL})) GROUP BY source""")
def verdict_of_events(spark, sf_dir):
    documents = event_documents(spark, sf_dir)
    gate = gates.gate_result(gates.gate_checks(documents, "run3-diagnostic", 200, _CLASSES, ["source"]), ["source"])
    return gates.combined_verdict(gate, gates.baseline_delta(documents, mq._BASELINE, 0.02, ["source"]), by=["source"])


_STEP_SQL = "CASE source WHEN 'exact' THEN 1 WHEN 'large' THEN 2 WHEN 'middle' THEN 3 WHEN 'flat' THEN 4 ELSE 5 END"


@query(f"""{_BY_SOURCE_SQL} SELECT {_STEP_SQL}::BIGINT AS step, true AS found, 'run3_diagnostic' AS gate, bool_and(passed) AS gate_passed,
  bool_and(passed) AND any_value(f1) - 0.33::DOUBLE > 0.005 AND any_value(acc) - 0.52::DOUBLE > 0.005 AS better
  FROM ({mq._EARLY_SQL}) JOIN (SELECT source, macro_f1 AS f1, accuracy AS acc FROM totals) USING (source) GROUP BY source
  UNION ALL SELECT 9, false, NULL, NULL, NULL""")
def stored_gates(spark, sf_dir):
    """Documents with their gates are written, read back per step, and judged against an earlier run."""
    documents = materialize(event_documents(spark, sf_dir), "documents")
    result = gates.gate_result(gates.gate_checks(documents, "run3-diagnostic", 200, _CLASSES, ["source"]), ["source"])
    names = F.array(*[F.lit(name) for name in ("exact", "large", "middle", "flat", "blind")])
    stored = evaluation.with_results(documents, result, by=["source"])
    path = scratch_path(spark, "gates")
    step = F.array_position(names, F.col("source")).alias("step")
    document = F.to_json(F.struct(*sorted(stored.columns)), {"ignoreNullFields": "false"}).alias("value")
    stored.select(step, document).write.partitionBy("step").text(path)
    read = readers.checkpoint_metrics(spark, f"{path}/step=*", [1, 2, 3, 4, 5, 9], r"step=([0-9]+)")
    baseline = {**mq._BASELINE, "per_class_f1": {}}
    checked = gates.ablation_checks(read.where("found"), F.col("gate.passed"), baseline, 0.005, {}, ["step"])
    better = checked.groupBy("step").agg(F.bool_and("passed").alias("better"))
    return read.join(better, "step", "left").select(
        "step", "found", F.col("gate.name").alias("gate"), F.col("gate.passed").alias("gate_passed"), "better"
    )


def _without_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lq.annotated(spark, sf_dir).where("category <> 'active_tb'")


@query(f"""{lq._RECORDS} SELECT t.category FROM (VALUES ('healthy'), ('active_tb'), ('sick_but_non_tb')) t(category)
  WHERE t.category NOT IN (SELECT category FROM annotated WHERE category <> 'active_tb')""")
def missing_active(spark, sf_dir):
    return records.missing_categories(_without_active(spark, sf_dir))


@query(f"""{lq._RECORDS} SELECT DISTINCT path, split, category FROM annotated WHERE category <> 'active_tb'
  UNION ALL SELECT path, split, category FROM folders WHERE category = 'active_tb'""")
def filled_active(spark, sf_dir):
    """No annotation tells the class, so the folders do."""
    folders = records.records_from_folders(fx.document_files(spark, sf_dir), fx.ROOT)
    return records.combine_records(_without_active(spark, sf_dir), folders)[0]


@query(f"""{lq._RECORDS} SELECT DISTINCT CASE WHEN length(path) % 5 = 0 THEN 'holdout' WHEN length(path) % 5 = 1 THEN 'spare' END AS split
  FROM records WHERE length(path) % 5 < 2""")
def found_extra_splits(spark, sf_dir):
    size = F.length("path") % 5
    moved = F.when(size == 0, "holdout").when(size == 1, "spare").otherwise(F.col("split"))
    return records.extra_splits(lq.combined(spark, sf_dir).withColumn("split", moved))
