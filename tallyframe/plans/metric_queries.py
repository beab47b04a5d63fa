"""Metrics, gates, deltas and the choice of a checkpoint, over predictions from an integer rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.operators import gates, metrics
from tallyframe.plans import evaluation
from tallyframe.plans import fixtures as fx
from tallyframe.plans.registry import query, table
from tallyframe.plans.scoring_queries import METRIC_ROWS_SQL
from tallyframe.session import materialize

_CLASSES, _POSITIVE = fx.QUALITY_CLASSES, fx.QUALITY_POSITIVE
_BASE_SQL = "('poor', 'good', 'toxic', 'missing')"
_ROWS_SQL = METRIC_ROWS_SQL.replace("POSITIVE", "'toxic', 'absent'")
_ALL_SQL = f"WITH {fx.PREDICTIONS_SQL}, {_ROWS_SQL}"
_BY_SOURCE_SQL = f"WITH {fx.by_source_sql('source')}"


@query(f"{_ALL_SQL} SELECT label AS true_label, other AS predicted_label, value::BIGINT AS n FROM long WHERE metric = 'confusion'")
def confusion(spark, sf_dir):
    return metrics.confusion(fx.quality_predictions(spark, sf_dir), _CLASSES)


def _open_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as labels of their orders; every third order is taken for one of the customer before."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    guess = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_custkey") - 1).otherwise(F.col("o_custkey"))
    return orders.select(
        F.col("o_orderkey").alias("index"),
        F.col("o_custkey").cast("string").alias("true_label"),
        guess.cast("string").alias("predicted_label"),
    )


_OPEN_SQL = """WITH p AS (SELECT o_custkey::VARCHAR AS true_label,
    (CASE WHEN o_orderkey % 3 = 0 THEN o_custkey - 1 ELSE o_custkey END)::VARCHAR AS predicted_label FROM orders)"""


@query(f"{_OPEN_SQL} SELECT true_label, predicted_label, count(*) AS n FROM p GROUP BY ALL")
def sparse_confusion(spark, sf_dir):
    return metrics.sparse_confusion(_open_labels(spark, sf_dir))


@query(f"""{_OPEN_SQL}, n AS (SELECT true_label, predicted_label, count(*) AS n FROM p GROUP BY ALL)
  SELECT true_label, count(*) AS n_predicted, sum(n)::BIGINT AS n_rows FROM n GROUP BY true_label""")
def sparse_metrics_document(spark, sf_dir):
    """The rows of the matrix in the sparse document of an open label set."""
    document = metrics.compute_metrics(_open_labels(spark, sf_dir), (), (), score_col=None, sparse=True)
    rows = document.select(F.explode("confusion_matrix.matrix").alias("true_label", "cells"))
    total = F.aggregate("cells", F.lit(0).cast("bigint"), lambda held, cell: held + cell["n"])
    return rows.select("true_label", F.size("cells").cast("bigint").alias("n_predicted"), total.alias("n_rows"))


@query(f"{_ALL_SQL} SELECT label, label_order FROM stats")
def metric_labels(spark, sf_dir):
    return metrics.metric_labels(fx.quality_predictions(spark, sf_dir), "index", _CLASSES)


@query(f"""{_ALL_SQL} SELECT label, round("precision", 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
  support, predicted, tp FROM scores""")
def class_metrics(spark, sf_dir):
    return _rounded(metrics.class_metrics(fx.quality_predictions(spark, sf_dir), _CLASSES), "precision", "recall", "f1")


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    for name in columns:
        df = df.withColumn(name, F.round(name, 6))
    return df


@query(f"""{_BY_SOURCE_SQL} SELECT source, label, round("precision", 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
  support::BIGINT AS support, predicted::BIGINT AS predicted, tp::BIGINT AS tp FROM scores""")
def class_metrics_by_source(spark, sf_dir):
    found = metrics.class_metrics(fx.quality_predictions(spark, sf_dir), _CLASSES, ["source"])
    return _rounded(found, "precision", "recall", "f1")


@query(f"{_ALL_SQL} SELECT count(*) AS total_samples, round(avg((true_label = predicted_label)::INT), 6) AS accuracy FROM predictions")
def accuracy(spark, sf_dir):
    return _rounded(metrics.accuracy(fx.quality_predictions(spark, sf_dir)), "accuracy")


@query(f"{_ALL_SQL} SELECT round(value, 6) AS macro_f1 FROM long WHERE metric = 'macro_f1'")
def macro_f1(spark, sf_dir):
    return _rounded(metrics.macro_f1(fx.quality_predictions(spark, sf_dir), _CLASSES), "macro_f1")


@query(f"""WITH {fx.PREDICTIONS_SQL} SELECT lang, 'true' AS side, true_label AS label, count(*) AS n FROM predictions GROUP BY ALL
  UNION ALL SELECT lang, 'predicted', predicted_label, count(*) FROM predictions GROUP BY ALL""")
def label_distributions(spark, sf_dir):
    return metrics.label_distributions(fx.quality_predictions(spark, sf_dir), ["lang"])


def _auc_sql(group: str, positive: str, score: str, frm: str) -> str:
    part = f"PARTITION BY {group}"
    return f"""WITH r AS (SELECT {group} AS g, {positive} AS pos,
      rank() OVER ({part} ORDER BY {score}) + (count(*) OVER ({part}, {score}) - 1) / 2 AS r FROM {frm}),
    t AS (SELECT g, count(*) FILTER (WHERE pos) AS p, count(*) FILTER (WHERE NOT pos) AS n, sum(r) FILTER (WHERE pos) AS s
          FROM r GROUP BY g)
  SELECT g, round((s - p * (p + 1) / 2) / nullif(p * n, 0), 6) AS roc_auc FROM t"""


@query(f"SELECT roc_auc FROM ({_auc_sql('1', 'quality = 1', 'n_chars', 'documents JOIN labels USING (doc_id)')})")
def roc_auc(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    return _rounded(metrics.roc_auc(docs, F.col("quality") == 1, "n_chars"), "roc_auc")


@query(f"SELECT g AS source, roc_auc FROM ({_auc_sql('source', 'toxic = 1', 'n_chars % 50', 'documents JOIN labels USING (doc_id)')})")
def roc_auc_by_source(spark, sf_dir):
    """Some sources hold one class only: their value is null."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", (F.col("n_chars") % 50).alias("score"))
    joined = docs.join(table(spark, sf_dir, "labels"), "doc_id")
    return _rounded(metrics.roc_auc(joined, F.col("toxic") == 1, "score", ["source"]), "roc_auc")


@query(f"SELECT g AS o_orderstatus, roc_auc FROM ({_auc_sql('o_orderstatus', chr(39) + '1-URGENT' + chr(39) + ' = o_orderpriority', 'o_totalprice', 'orders')})")
def roc_auc_of_orders(spark, sf_dir):
    """Nearly as many distinct scores as rows."""
    orders = table(spark, sf_dir, "orders")
    found = metrics.roc_auc(orders, F.col("o_orderpriority") == "1-URGENT", "o_totalprice", ["o_orderstatus"])
    return _rounded(found, "roc_auc")


@query(f"{_ALL_SQL} SELECT metric, label, other, round(value, 6) AS value FROM long")
def metrics_document_of_documents(spark, sf_dir):
    document = metrics.compute_metrics(fx.quality_predictions(spark, sf_dir), _CLASSES, _POSITIVE)
    return _rounded(evaluation.document_rows(document), "value")


def source_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One metrics document per source, as if every source were a checkpoint."""
    found = metrics.compute_metrics(
        fx.quality_predictions(spark, sf_dir), _CLASSES, _POSITIVE, ["source"], score_col=None
    )
    return found.withColumn("step", F.substr(F.col("source"), F.lit(4)).cast("bigint"))


@query(f"""{_BY_SOURCE_SQL} SELECT source, total_samples::BIGINT AS total_samples, round(accuracy, 6) AS accuracy,
  round(macro_f1, 6) AS macro_f1 FROM totals""")
def metrics_by_source(spark, sf_dir):
    found = source_documents(spark, sf_dir).select("source", "total_samples", "accuracy", "macro_f1")
    return _rounded(found, "accuracy", "macro_f1")


_LOST_SQL = f"(SELECT count(*) FROM scores s WHERE s.source = t.source AND label IN {_BASE_SQL} AND support > 0 AND recall <= 0)"
_LOST_LABELS_SQL = (
    "(SELECT coalesce(string_agg(label, ',' ORDER BY list_position(["
    + ", ".join(f"'{c}'" for c in _CLASSES)
    + f"], label)), '') FROM scores s WHERE s.source = t.source AND label IN {_BASE_SQL} AND support > 0 AND recall <= 0)"
)
_COUNT_SQL = "(SELECT coalesce(max(predicted), 0) FROM scores s WHERE s.source = t.source AND label = {0})"


@query(f"""{_BY_SOURCE_SQL} SELECT source, {_LOST_SQL} AS lost,
  {_COUNT_SQL.format("'toxic'")}::BIGINT AS toxic, {_COUNT_SQL.format("'nothing'")}::BIGINT AS nothing FROM totals t""")
def zero_recall(spark, sf_dir):
    return source_documents(spark, sf_dir).select(
        "source",
        F.size(metrics.zero_recall_labels("per_class", _CLASSES)).cast("bigint").alias("lost"),
        metrics.prediction_count("toxic").alias("toxic"),
        metrics.prediction_count("nothing").alias("nothing"),
    )


def _check_sql(name, label, passed, actual, minimum="NULL", maximum="NULL", labels="NULL::VARCHAR") -> str:
    return (
        f"SELECT source, '{name}' AS check, {label} AS label, {labels} AS labels, {passed} AS passed, ({actual})::DOUBLE AS actual, "
        f"({minimum})::DOUBLE AS minimum, ({maximum})::DOUBLE AS maximum FROM totals t"
    )


def _count(label: str) -> str:
    return _COUNT_SQL.format(f"'{label}'")


_MONOPOLY = _check_sql("no_prediction_monopoly", "NULL", "top <= 0.8::DOUBLE * total_samples", "top", "NULL", "floor(0.8::DOUBLE * total_samples)")
_NO_ZERO = _check_sql("no_zero_recall", "NULL", f"{_LOST_SQL} = 0", _LOST_SQL, "NULL", "0", _LOST_LABELS_SQL)
_SCALED = "greatest(1, ceil(50 * total_samples / 200.0::DOUBLE))"
_EARLY_SQL = " UNION ALL ".join([
    _NO_ZERO, _MONOPOLY,
    _check_sql("poor_predictions_minimum", "'poor'", f"{_count('poor')} >= {_SCALED}", _count("poor"), _SCALED),
    _check_sql("good_predictions_nonzero", "'good'", f"{_count('good')} > 0", _count("good"), "1"),
])
_LATER_SQL = " UNION ALL ".join([_NO_ZERO, _MONOPOLY] + [
    _check_sql("minimum_predictions_per_class", f"'{c}'", f"{_count(c)} >= 50", _count(c), "50") for c in _CLASSES
])
_FULL_SQL = " UNION ALL ".join(
    [_check_sql("full_val_size", "NULL", "total_samples = 200", "total_samples", "200", "200"),
     _check_sql("macro_f1", "NULL", "macro_f1 >= 0.3", "round(macro_f1, 6)", "0.3"),
     _check_sql("accuracy", "NULL", "accuracy >= 0.5", "round(accuracy, 6)", "0.5")]
    + [_check_sql(f"{c}_predictions_range", f"'{c}'", f"{_count(c)} BETWEEN 400 AND 1000", _count(c), "400", "1000") for c in _CLASSES[1:]]
    + [_check_sql("poor_predictions_minimum", "'poor'", f"{_count('poor')} >= 50", _count("poor"), "50"), _NO_ZERO]
)


def check_rows(checks: DataFrame) -> DataFrame:
    return _rounded(checks.withColumn("labels", F.array_join("labels", ",")), "actual")


def _gate(spark, sf_dir, name: str) -> DataFrame:
    checks = gates.gate_checks(source_documents(spark, sf_dir), name, 200, _CLASSES, ["source"])
    return check_rows(checks)


@query(f"{_BY_SOURCE_SQL} SELECT 'run3_diagnostic' AS gate, * FROM ({_EARLY_SQL})")
def gate_early_diagnostic(spark, sf_dir):
    return _gate(spark, sf_dir, "run3-diagnostic")


@query(f"{_BY_SOURCE_SQL} SELECT 'run4_diagnostic' AS gate, * FROM ({_LATER_SQL})")
def gate_later_diagnostic(spark, sf_dir):
    return _gate(spark, sf_dir, "run4-diagnostic")


@query(f"{_BY_SOURCE_SQL} SELECT 'run3_full' AS gate, * FROM ({_FULL_SQL})")
def gate_full(spark, sf_dir):
    return _gate(spark, sf_dir, "run3-full")


@query(f"{_BY_SOURCE_SQL} SELECT source, 'run3_diagnostic' AS gate, bool_and(passed) AS passed FROM ({_EARLY_SQL}) GROUP BY source")
def gate_results(spark, sf_dir):
    return gates.gate_result(_gate(spark, sf_dir, "run3-diagnostic"), ["source"])


@query(f"""{_BY_SOURCE_SQL} SELECT source, greatest(1, ceil(50 * total_samples / 1800.0::DOUBLE))::BIGINT AS minimum FROM totals""")
def scaled_minimums(spark, sf_dir):
    total = F.col("total_samples")
    return source_documents(spark, sf_dir).select("source", gates.scaled_count(50, total, 1800).alias("minimum"))


_BASELINE = {"accuracy": 0.52, "macro_f1": 0.33, "per_class_f1": {"good": 0.7, "poor": 0.2, "unseen": 0.1}}
_DELTA_SQL = """SELECT source, 0.52::DOUBLE AS baseline_accuracy, round(accuracy, 6) AS accuracy, round(accuracy - 0.52::DOUBLE, 6) AS accuracy_delta,
  0.33::DOUBLE AS baseline_macro_f1, round(macro_f1, 6) AS macro_f1, round(macro_f1 - 0.33::DOUBLE, 6) AS macro_f1_delta,
  round(greatest(0, 0.33::DOUBLE - macro_f1), 6) AS macro_f1_drop, 0.02::DOUBLE AS max_allowed_drop,
  greatest(0, 0.33::DOUBLE - macro_f1) <= 0.02::DOUBLE AS passed FROM totals"""


@query(f"{_BY_SOURCE_SQL} {_DELTA_SQL}")
def baseline_delta(spark, sf_dir):
    found = gates.baseline_delta(source_documents(spark, sf_dir), _BASELINE, 0.02, ["source"])
    return _rounded(found, "accuracy", "accuracy_delta", "macro_f1", "macro_f1_delta", "macro_f1_drop")


@query(f"""{_BY_SOURCE_SQL}, base(label, baseline_f1) AS (VALUES ('good', 0.7::DOUBLE), ('poor', 0.2::DOUBLE), ('unseen', 0.1::DOUBLE))
  SELECT t.source, b.label, baseline_f1, round(coalesce(s.f1, 0), 6) AS current_f1, round(coalesce(s.f1, 0) - baseline_f1, 6) AS delta
  FROM totals t CROSS JOIN base b LEFT JOIN scores s ON s.source = t.source AND s.label = b.label""")
def class_deltas(spark, sf_dir):
    found = gates.class_deltas(source_documents(spark, sf_dir), _BASELINE, ["source"])
    return _rounded(found, "current_f1", "delta")


@query(f"""{_BY_SOURCE_SQL} SELECT source, round(accuracy, 6) AS accuracy, round(macro_f1, 6) AS macro_f1 FROM totals
  ORDER BY totals.macro_f1 DESC, substr(source, 4)::INT LIMIT 1""")
def best_checkpoint(spark, sf_dir):
    best = metrics.best_checkpoint(source_documents(spark, sf_dir))
    return _rounded(best.select("source", "accuracy", "macro_f1"), "accuracy", "macro_f1")


_TOLERANCE = {"good": 0.05, "poor": 0.02, "unseen": 0.5}
_F1_SQL = "(SELECT f1 FROM scores s WHERE s.source = t.source AND s.label = '{0}')"
_ABLATION_SQL = " UNION ALL ".join(
    [_check_sql(f"{m}_gain", "NULL", f"{m} - {_BASELINE[m]}::DOUBLE > 0.005", f"round({m} - {_BASELINE[m]}::DOUBLE, 6)", "0.005") for m in ("accuracy", "macro_f1")]
    + [_check_sql("gate_passed", "NULL", "total_samples % 2 = 0", "NULL")]
    + [_check_sql("class_drop", f"'{c}'", f"coalesce({f1}::DOUBLE - {_F1_SQL.format(c)} <= {_TOLERANCE[c]}, false)",
                  f"round({f1}::DOUBLE - {_F1_SQL.format(c)}, 6)", "NULL", f"{_TOLERANCE[c]}")
       for c, f1 in _BASELINE["per_class_f1"].items()]
)


def _ablation(spark, sf_dir) -> DataFrame:
    passed = F.col("total_samples") % 2 == 0
    return gates.ablation_checks(source_documents(spark, sf_dir), passed, _BASELINE, 0.005, _TOLERANCE, ["source"])


@query(f"{_BY_SOURCE_SQL} SELECT 'ablation' AS gate, * FROM ({_ABLATION_SQL})")
def ablation_checks(spark, sf_dir):
    return check_rows(_ablation(spark, sf_dir))


@query(f"""{_BY_SOURCE_SQL} SELECT source, bool_and(passed) AS passed FROM (
  SELECT source, passed FROM ({_EARLY_SQL}) UNION ALL SELECT source, passed FROM ({_DELTA_SQL})
  UNION ALL SELECT source, max(idx) % 3 <> 0 FROM predictions GROUP BY source) GROUP BY source""")
def combined_verdict(spark, sf_dir):
    documents = materialize(source_documents(spark, sf_dir), "documents")
    gate = gates.gate_result(gates.gate_checks(documents, "run3-diagnostic", 200, _CLASSES, ["source"]), ["source"])
    delta = gates.baseline_delta(documents, _BASELINE, 0.02, ["source"])
    answers = fx.quality_predictions(spark, sf_dir).groupBy("source").agg((F.max("index") % 3 != 0).alias("passed"))
    return gates.combined_verdict(gate, delta, None, answers, by=["source"])


@query("SELECT o_orderstatus, sum(o_totalprice::BIGINT)::BIGINT AS size_bytes, round(sum(o_totalprice::BIGINT) / 1073741824.0::DOUBLE, 6) AS size_gb FROM orders GROUP BY 1")
def sizes_in_gb(spark, sf_dir):
    # DuckDB rounds when it casts to an integer.
    sizes = table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(
        F.sum(F.bround("o_totalprice", 0).cast("bigint")).alias("size_bytes")
    )
    return sizes.withColumn("size_gb", F.round(gates.size_gb(F.col("size_bytes")), 6))


