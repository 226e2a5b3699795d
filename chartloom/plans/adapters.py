"""Views that give the driver's tables the shape of chart tables, in Spark and, for the oracles, in DuckDB SQL.

Image ids are chosen so that images stay of one size while their number grows with the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")
    idx = (F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("int")
    p = e.select(F.floor(F.col("user_id") / 6).alias("image_id"), F.col("user_id").alias("series_id"), idx.alias("pt_idx"), F.floor("value").alias("y"))
    return p.select("image_id", "series_id", "pt_idx", (F.lit(7) * (F.col("pt_idx") + 1)).cast("long").alias("x"), F.col("y").cast("long").alias("y"))


def raw_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    x, y, q = (F.col("l_partkey") % 97).cast("double"), (F.col("l_suppkey") % 89).cast("double"), F.col("l_quantity")
    d = li.select(
        F.floor(F.col("l_orderkey") / 32).alias("image_id"), (F.col("l_partkey") % 18).cast("int").alias("class_id"), x.alias("x1"), y.alias("y1"),
        (x + q).alias("x2"), (y + q / 2 + 5).alias("y2"), (F.col("l_discount") * 10).alias("score"),
    )
    order = W.partitionBy("image_id").orderBy("x1", "y1", "x2", "y2", "score", "class_id")
    return d.withColumn("det_ord", F.row_number().over(order).cast("int"))


def axis_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    image = F.floor(F.col("o_custkey") / 5)
    k = F.col("o_orderkey")
    axis = F.when(k % 2 == 0, "x").otherwise("y")
    rn = F.row_number().over(W.partitionBy("image_id", "axis").orderBy("k"))
    base = o.select(image.alias("image_id"), axis.alias("axis"), k.alias("k")).withColumn("rn", rn)
    edge = F.when(F.col("image_id") % 10 == 9, (F.col("k") * 7919) % 1000).otherwise(37 * F.col("rn") + F.col("k") % 30)
    base = base.withColumn("edge", edge.cast("double"))
    v = (100 + 10 * F.col("rn")).cast("double")
    value = F.when(F.col("rn") % 13 == 7, None).when(F.col("rn") % (9 + F.col("image_id") % 5) == 5, v * 10).otherwise(v)
    return base.select("image_id", "axis", F.col("rn").cast("int").alias("det_ord"), "edge", F.col("edge").alias("x1"), F.col("edge").alias("y1"), (F.col("edge") + 8).alias("x2"), (F.col("edge") + 5).alias("y2"), value.alias("value"))


def charts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey")
    return c.select((F.col("c_custkey") - 1).alias("image_id"), (400 + 10 * (F.col("c_custkey") % 25)).cast("int").alias("height"), (600 + 10 * (F.col("c_custkey") % 31)).cast("int").alias("width"))


def ocr_passes(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_name", "p_type", "p_size", "p_retailprice")
    key = [F.floor(F.col("p_partkey") / 20).alias("image_id"), F.when(F.col("p_partkey") % 2 == 0, "x").otherwise("y").alias("axis"), F.col("p_partkey").cast("int").alias("label_ord"), F.lit(0).alias("cand_ord")]
    conf = lambda m: ((F.col("p_size") * m) % 10).cast("double") / 10
    price = F.concat((F.col("p_partkey") % 50).cast("string"), F.lit("."), (F.col("p_size") % 10).cast("string"))
    return {
        "sharp": p.where(F.col("p_partkey") % 7 != 3).select(*key, F.col("p_brand").alias("text"), conf(3).alias("conf")),
        "adapt": p.where(F.col("p_size") % 3 == 0).select(*key, price.alias("text"), conf(7).alias("conf")),
        "inv": p.where(F.col("p_partkey") % 7 != 3).select(*key, (F.col("p_partkey") % 50).cast("string").alias("text"), conf(1).alias("conf")),
        "dilate": p.where(F.col("p_size") % 5 == 1).select(*key, price.alias("text"), conf(9).alias("conf")),
    }


def ocr_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey")
    k = F.col("p_partkey")
    edge = ((k * 37) % 101).cast("double")
    return p.select(F.floor(k / 20).alias("image_id"), F.when(k % 2 == 0, "x").otherwise("y").alias("axis"), k.cast("int").alias("label_ord"), k.cast("int").alias("det_ord"), edge.alias("x1"), edge.alias("y1"), (edge + 8).alias("x2"), (edge + 5).alias("y2"))


def models(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "region")
    return r.select(F.lower("r_name").alias("model_key"), F.concat(F.upper(F.substring("r_name", 1, 1)), F.lower(F.expr("substring(r_name, 2)"))).alias("name"), F.concat(F.lower("r_name"), F.lit(".bin")).alias("checkpoint"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").where("n_regionkey < 3")
    r = table(spark, sf_dir, "region").where("r_regionkey % 2 = 0")
    return n.select(F.concat(F.lower("n_name"), F.lit(".bin")).alias("file_name"), F.col("n_name").alias("content")).unionByName(r.select(F.concat(F.lower("r_name"), F.lit(".bin")).alias("file_name"), F.col("r_name").alias("content")))


SQL = {
    "rp": """rp AS (
  SELECT user_id // 6 AS image_id, user_id AS series_id, idx AS pt_idx, 7 * (idx + 1) AS x, floor(value)::BIGINT AS y
  FROM (SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::INT AS idx FROM events))""",
    "det": """det AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY x1, y1, x2, y2, score, class_id)::INT AS det_ord FROM (
    SELECT l_orderkey // 32 AS image_id, (l_partkey % 18)::INT AS class_id, (l_partkey % 97)::DOUBLE AS x1, (l_suppkey % 89)::DOUBLE AS y1,
           (l_partkey % 97)::DOUBLE + l_quantity AS x2, (l_suppkey % 89)::DOUBLE + l_quantity / 2 + 5 AS y2, l_discount * 10 AS score FROM lineitem))""",
    "lab": """lab AS (
  SELECT image_id, axis, rn::INT AS det_ord, edge, edge AS x1, edge AS y1, edge + 8 AS x2, edge + 5 AS y2,
         CASE WHEN axis = 'x' THEN (edge + edge + 8) / 2 ELSE (edge + edge + 5) / 2 END AS center,
         CASE WHEN rn % 13 = 7 THEN NULL WHEN rn % (9 + image_id % 5) = 5 THEN (100 + 10 * rn)::DOUBLE * 10 ELSE (100 + 10 * rn)::DOUBLE END AS value
  FROM (SELECT *, (CASE WHEN image_id % 10 = 9 THEN (o_orderkey * 7919) % 1000 ELSE 37 * rn + o_orderkey % 30 END)::DOUBLE AS edge FROM (
    SELECT *, row_number() OVER (PARTITION BY image_id, axis ORDER BY o_orderkey) AS rn FROM (
      SELECT o_orderkey, o_custkey // 5 AS image_id, CASE WHEN o_orderkey % 2 = 0 THEN 'x' ELSE 'y' END AS axis FROM orders))))""",
    "charts": "charts AS (SELECT c_custkey - 1 AS image_id, (400 + 10 * (c_custkey % 25))::INT AS height, (600 + 10 * (c_custkey % 31))::INT AS width FROM customer)",
    "ocr": """pp AS (SELECT p_partkey // 20 AS image_id, CASE WHEN p_partkey % 2 = 0 THEN 'x' ELSE 'y' END AS axis, p_partkey::INT AS label_ord, p_partkey AS k, p_brand, p_size,
  (p_partkey % 50) || '.' || (p_size % 10) AS price FROM part),
ocr AS (
  SELECT image_id, axis, label_ord, 'sharp' AS method, 0 AS method_ord, 0 AS cand_ord, p_brand AS text, ((p_size * 3) % 10)::DOUBLE / 10 AS conf FROM pp WHERE k % 7 <> 3
  UNION ALL SELECT image_id, axis, label_ord, 'adapt', 1, 0, price, ((p_size * 7) % 10)::DOUBLE / 10 FROM pp WHERE p_size % 3 = 0
  UNION ALL SELECT image_id, axis, label_ord, 'inv', 2, 0, (k % 50)::VARCHAR, ((p_size * 1) % 10)::DOUBLE / 10 FROM pp WHERE k % 7 <> 3
  UNION ALL SELECT image_id, axis, label_ord, 'dilate', 3, 0, price, ((p_size * 9) % 10)::DOUBLE / 10 FROM pp WHERE p_size % 5 = 1)""",
    "ocrbest": """ocrbest AS (
  SELECT pp.image_id, pp.axis, pp.label_ord, coalesce(c.text, '') AS text, c.conf, c.method,
         ((pp.k * 37) % 101)::DOUBLE AS edge FROM pp LEFT JOIN (
    SELECT *, row_number() OVER (PARTITION BY image_id, axis, label_ord ORDER BY contains(text, '.') DESC, conf DESC, method_ord, cand_ord) AS rn FROM ocr) c
  ON c.rn = 1 AND c.label_ord = pp.label_ord)""",
    "models": "models AS (SELECT lower(r_name) AS model_key, upper(r_name[1]) || lower(r_name[2:]) AS name, lower(r_name) || '.bin' AS checkpoint, r_name FROM region)",
    "files": """files AS (SELECT lower(n_name) || '.bin' AS file_name, n_name AS content FROM nation WHERE n_regionkey < 3
  UNION ALL SELECT lower(r_name) || '.bin', r_name FROM region WHERE r_regionkey % 2 = 0)""",
    # resampled, ranked series with the default settings
    "ds": """ds AS (
  SELECT image_id, series_id, (pt_idx // step)::INT AS pt_idx, x, y FROM (
    SELECT *, greatest(1, count(*) OVER (PARTITION BY series_id) // 20) AS step FROM rp) WHERE pt_idx % step = 0)""",
    "means": "means AS (SELECT image_id, series_id, avg(y::DOUBLE) AS mean_y, count(*) AS n_points FROM ds GROUP BY ALL)",
    "pos": "pos AS (SELECT *, (row_number() OVER (PARTITION BY image_id ORDER BY mean_y, series_id) - 1)::INT AS series_pos FROM means)",
    # label repair
    "steps": """steps AS (SELECT * FROM (SELECT image_id, axis, edge, det_ord, value - lag(value) OVER (PARTITION BY image_id, axis ORDER BY edge, det_ord) AS step
  FROM lab WHERE value IS NOT NULL) WHERE step IS NOT NULL)""",
    "med": """med AS (SELECT image_id, axis, step AS median_step, n AS n_steps FROM (
  SELECT *, row_number() OVER (PARTITION BY image_id, axis ORDER BY step) AS rn, count(*) OVER (PARTITION BY image_id, axis) AS n FROM steps) WHERE rn = n // 2 + 1)""",
    "cons": """cons AS (SELECT m.image_id, m.axis, any_value(median_step) AS median_step, any_value(n_steps) AS n_steps,
  count(*) FILTER (WHERE abs(step - median_step) < abs(median_step) * 0.3e0) AS n_near,
  any_value(n_steps) >= 2 AND count(*) FILTER (WHERE abs(step - median_step) < abs(median_step) * 0.3e0) >= any_value(n_steps) * 0.6e0 AS passes
  FROM steps s JOIN med m ON s.image_id = m.image_id AND s.axis = m.axis GROUP BY m.image_id, m.axis)""",
    "fix": """fix AS (SELECT image_id, axis, edge, det_ord, CASE WHEN r > 8 AND r < 12 THEN value / 10 WHEN r > 0.08e0 AND r < 0.12e0 THEN value * 10 END AS fixed FROM (
  SELECT v.*, CASE WHEN (p + q) / 2 <> 0 THEN value / ((p + q) / 2) END AS r FROM (
    SELECT image_id, axis, edge, det_ord, value, lag(value) OVER w AS p, lead(value) OVER w AS q FROM lab WHERE value IS NOT NULL
    WINDOW w AS (PARTITION BY image_id, axis ORDER BY edge, det_ord)) v
  JOIN cons c ON c.image_id = v.image_id AND c.axis = v.axis AND c.passes)),
corr AS (SELECT l.* REPLACE (coalesce(f.fixed, l.value) AS value), CASE WHEN f.fixed IS NOT NULL THEN true END AS corrected
  FROM lab l LEFT JOIN fix f ON l.image_id = f.image_id AND l.axis = f.axis AND l.edge = f.edge AND l.det_ord = f.det_ord)""",
    "cal": """cal AS (SELECT image_id,
  max(CASE WHEN axis = 'x' THEN a.center END) AS x1_pixel, max(CASE WHEN axis = 'x' THEN a.value END) AS x1_value,
  max(CASE WHEN axis = 'x' THEN b.center END) AS x2_pixel, max(CASE WHEN axis = 'x' THEN b.value END) AS x2_value,
  max(CASE WHEN axis = 'y' THEN a.center END) AS y1_pixel, max(CASE WHEN axis = 'y' THEN a.value END) AS y1_value,
  max(CASE WHEN axis = 'y' THEN b.center END) AS y2_pixel, max(CASE WHEN axis = 'y' THEN b.value END) AS y2_value
  FROM (SELECT image_id, axis, arg_min(struct_pack(center := center, value := value), (edge, det_ord)) AS a,
               arg_max(struct_pack(center := center, value := value), (edge, det_ord)) AS b
        FROM corr WHERE value IS NOT NULL GROUP BY ALL HAVING count(*) >= 2) GROUP BY image_id)""",
    "top": "top AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY image_id, class_id ORDER BY score DESC, det_ord) AS rn FROM det) WHERE rn = 1)",
    "cfg": """cfg AS (SELECT c.image_id, x1_pixel AS x1_px, coalesce(p.y2, h.height * 0.9e0) AS x1_py, x1_value AS x1_val, x2_pixel AS x2_px, coalesce(p.y2, h.height * 0.9e0) AS x2_py, x2_value AS x2_val,
  coalesce(p.x1, h.width * 0.1e0) AS y1_px, y2_pixel AS y1_py, y2_value AS y1_val, coalesce(p.x1, h.width * 0.1e0) AS y2_px, y1_pixel AS y2_py, y1_value AS y2_val,
  false AS x_is_log, false AS y_is_log
  FROM cal c JOIN charts h ON c.image_id = h.image_id LEFT JOIN top p ON p.image_id = c.image_id AND p.class_id = 2
  WHERE x1_pixel IS NOT NULL AND y1_pixel IS NOT NULL)""",
}
#: What each view is built on.
NEEDS = {"ds": ["rp"], "means": ["ds"], "pos": ["means"], "steps": ["lab"], "med": ["steps"], "cons": ["med"], "fix": ["cons"], "cal": ["fix"], "top": ["det"], "cfg": ["cal", "charts", "top"], "ocrbest": ["ocr"]}


def sql(views: str, query: str) -> str:
    """``query`` with the named views, and those that they need, in front."""
    out: dict[str, str] = {}

    def add(name: str) -> None:
        for n in NEEDS.get(name, []):
            add(n)
        out[name] = SQL[name]

    for name in views.split():
        add(name)
    return "WITH RECURSIVE " + ",\n".join(out.values()) + "\n" + query if out else query
