"""Saliency maps, with the vectors as 8 x 8 activation and gradient matrices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.functions import arrays
from tallyframe.operators import saliency
from tallyframe.plans.registry import query, table


def _matrix(values: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice(values, i * 8 + 1, F.lit(8)))


def maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth sample has gradients that cancel all activations."""
    against = F.col("vec_id") % 4 == 0
    vector = F.transform("embedding", lambda x: x.cast("double"))
    size = lambda values: F.transform(values, lambda x: F.abs(x))
    act = F.when(against, size(vector)).otherwise(vector)
    back = F.reverse(vector)
    grad = F.when(against, F.transform(size(back), lambda x: -x)).otherwise(back)
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", _matrix(act).alias("activations"), _matrix(grad).alias("gradients"),
        F.struct(F.lit(2).alias("t"), F.lit(2).alias("h"), F.lit(2).alias("w")).alias("grid"),
    )


_MAPS_SQL = """
flat AS (
  SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding)::DOUBLE AS a,
    unnest(list_reverse(embedding))::DOUBLE AS g FROM embeddings),
cells AS (
  SELECT vec_id, i // 8 AS token, i % 8 AS channel, CASE WHEN vec_id % 4 = 0 THEN abs(a) ELSE a END AS a,
    CASE WHEN vec_id % 4 = 0 THEN -abs(g) ELSE g END AS g FROM flat),
weights AS (SELECT vec_id, channel, avg(g) AS w FROM cells GROUP BY ALL),
sums AS (
  SELECT vec_id, token, greatest(0, sum(a * w)) AS cam, abs(sum(a * g)) AS fallback
  FROM cells JOIN weights USING (vec_id, channel) GROUP BY ALL),
picked AS (
  SELECT vec_id, token, CASE WHEN max(cam) OVER (PARTITION BY vec_id) > 1e-8 THEN 'grad_cam' ELSE 'gradient_activation_fallback' END AS method,
    CASE WHEN max(cam) OVER (PARTITION BY vec_id) > 1e-8 THEN cam ELSE fallback END AS v FROM sums),
bounds AS (SELECT vec_id, min(v) AS low, max(v) - min(v) AS width FROM picked GROUP BY vec_id),
saliency AS (
  SELECT vec_id, token, method, CASE WHEN width <= 1e-8 THEN 0 ELSE (v - low) / width END AS score
  FROM picked JOIN bounds USING (vec_id)),
grid AS (SELECT vec_id, token % 4 AS cell, avg(score) AS v FROM saliency GROUP BY ALL),
grid_bounds AS (SELECT vec_id, min(v) AS low, max(v) - min(v) AS width FROM grid GROUP BY vec_id)"""


@query(f"WITH {_MAPS_SQL} SELECT vec_id, token, method, round(score, 6) AS score FROM saliency")
def token_saliency(spark, sf_dir):
    found = saliency.token_saliency(maps(spark, sf_dir))
    rows = found.select("vec_id", "method", F.posexplode("token_scores").alias("token", "score"))
    return rows.select("vec_id", F.col("token").cast("bigint").alias("token"), "method", F.round("score", 6).alias("score"))


@query(f"""WITH {_MAPS_SQL} SELECT vec_id, cell, round(CASE WHEN width <= 1e-8 THEN 0 ELSE (v - low) / width END, 6) AS value
  FROM grid JOIN grid_bounds USING (vec_id)""")
def grid_map(spark, sf_dir):
    found = saliency.grid_map(saliency.token_saliency(maps(spark, sf_dir)))
    rows = found.select("vec_id", F.posexplode("cells").alias("cell", "value"))
    return rows.select("vec_id", F.col("cell").cast("bigint").alias("cell"), F.round("value", 6).alias("value"))


@query("""WITH x AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS cell, unnest(embedding)::DOUBLE AS v FROM embeddings),
  b AS (SELECT vec_id, quantile_cont(v, 0.55) AS low, quantile_cont(v, 0.995) AS high FROM x GROUP BY vec_id)
  SELECT vec_id, cell, round(pow(least(greatest((v - low) / (high - low), 0), 1), 0.8::DOUBLE), 6) AS heat FROM x JOIN b USING (vec_id)""")
def percentile_normalize(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select(
        "vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("cells")
    )
    rows = saliency.heat_map(vectors).select("vec_id", F.posexplode("heat").alias("cell", "heat"))
    return rows.select("vec_id", F.col("cell").cast("bigint").alias("cell"), F.round("heat", 6).alias("heat"))


@query("""WITH x AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS cell, unnest(embedding)::DOUBLE AS v FROM embeddings),
  b AS (SELECT vec_id, quantile_cont(v, 0.55) AS low, quantile_cont(v, 0.995) AS high FROM x GROUP BY vec_id),
  u AS (SELECT vec_id, cell // 8 AS y, cell % 8 AS x, least(greatest((v - low) / (high - low), 0), 1) AS v FROM x JOIN b USING (vec_id)),
  k AS (SELECT k, exp(-k * k / (2 * 0.8 * 0.8::DOUBLE)) AS w FROM (SELECT unnest(range(-3, 4)) AS k)),
  steps AS (SELECT p, CASE WHEN (p + k + 14) % 14 < 8 THEN (p + k + 14) % 14 ELSE 14 - (p + k + 14) % 14 END AS src, w / (SELECT sum(w) FROM k) AS w
    FROM (SELECT unnest(range(8)) AS p), k),
  mask AS (SELECT p, src, sum(w) AS w FROM steps GROUP BY ALL),
  rows AS (SELECT vec_id, y, p AS x, sum(v * w) AS v FROM u JOIN mask ON x = src GROUP BY ALL),
  both_ways AS (SELECT vec_id, p AS y, x, sum(v * w) AS v FROM rows JOIN mask ON y = src GROUP BY ALL)
  SELECT vec_id, y AS row, x AS column, round(pow(least(greatest(v, 0), 1), 0.8::DOUBLE), 6) AS heat FROM both_ways""")
def smoothed_maps(spark, sf_dir):
    """Vectors as 8 x 8 maps, clipped, smoothed with a sigma of 0.8 and brightened."""
    cells = _matrix(F.transform("embedding", lambda x: x.cast("double")))
    heat = arrays.normalize_grid(cells, sigma=0.8)
    lines = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(heat).alias("row", "line"))
    rows = lines.select("vec_id", F.col("row").cast("bigint").alias("row"), F.posexplode("line").alias("column", "heat"))
    return rows.select("vec_id", "row", F.col("column").cast("bigint").alias("column"), F.round("heat", 6).alias("heat"))


@query("""SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS cell, round(CASE WHEN m = w THEN 0 ELSE (unnest(embedding)::DOUBLE - m) / (w - m) END, 6) AS value
  FROM (SELECT vec_id, embedding, list_min(embedding)::DOUBLE AS m, list_max(embedding)::DOUBLE AS w FROM embeddings)""")
def minmax_normalize(spark, sf_dir):
    values = F.transform("embedding", lambda x: x.cast("double"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(arrays.minmax_normalize(values)).alias("cell", "value"))
    return rows.select("vec_id", F.col("cell").cast("bigint").alias("cell"), F.round("value", 6).alias("value"))


@query("SELECT vec_id, 8::BIGINT AS height, 8::BIGINT AS width FROM embeddings WHERE vec_id % 10 NOT IN (0, 1, 2)")
def finite_maps(spark, sf_dir):
    """Maps with a NaN, an infinite value or rows of different lengths are left out."""
    key = F.col("vec_id")
    broken = F.transform(
        "embedding",
        lambda x, i: F.when((i == 5) & (key % 10 == 0), float("nan")).when((i == 60) & (key % 10 == 1), float("-inf")).otherwise(x),
    )
    cut = F.when(key % 10 == 2, F.slice(broken, 1, 60)).otherwise(broken)
    rows = table(spark, sf_dir, "embeddings").select("vec_id", _matrix(cut).alias("map"))
    shape = arrays.shapes({"map": (F.col("map"), 2)})["map"]
    return saliency.finite_maps(rows, "map").select(
        "vec_id", F.get(shape, F.lit(0)).alias("height"), F.get(shape, F.lit(1)).alias("width")
    )
