"""Registered queries: operators over the adapted tables, each with its DuckDB equivalent."""

from __future__ import annotations

import base64
import hashlib
import os
import struct
import tempfile
import uuid
import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import detect, documents, labels, models, overlay, series
from ..sources import archives, images
from ..sources.schema import CLASSES
from ..streaming import ingest
from . import adapters as a

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
SETTINGS = series.Settings()


def query(views: str | None = None, sql: str = ""):
    """Register a function under its name, with SQL over the named views if there is any."""

    def register(f):
        QUERIES[f.__name__] = f
        if views is not None:
            ORACLES[f.__name__] = a.sql(views, sql)
        return f

    return register


# --- series


@query("rp", "SELECT image_id, series_id, pt_idx, x::BIGINT AS x, y FROM rp")
def downsample_none(spark, d):
    return series.downsample(a.raw_points(spark, d), series.Settings(downsample_mode="none"))


@query("rp", "SELECT image_id, series_id, (pt_idx // 10)::INT AS pt_idx, x::BIGINT AS x, y FROM rp WHERE pt_idx % 10 = 0")
def downsample_fixed(spark, d):
    return series.downsample(a.raw_points(spark, d), series.Settings(downsample_mode="fixed"))


@query("ds", "SELECT image_id, series_id, pt_idx, x::BIGINT AS x, y FROM ds")
def downsample_max(spark, d):
    return series.downsample(a.raw_points(spark, d), SETTINGS)


_SEG = """seg AS (SELECT *, coalesce(lag(hi) OVER w, 0) AS lo, max(hi) OVER (PARTITION BY series_id) AS total FROM (
  SELECT *, sum(len) OVER w AS hi FROM (
    SELECT *, lead(x) OVER w AS nx, lead(y) OVER w AS ny, count(*) OVER (PARTITION BY series_id) AS n,
           coalesce(sqrt(((lead(x) OVER w - x) * (lead(x) OVER w - x) + (lead(y) OVER w - y) * (lead(y) OVER w - y))::DOUBLE), 0) AS len
    FROM rp WINDOW w AS (PARTITION BY series_id ORDER BY pt_idx)) WINDOW w AS (PARTITION BY series_id ORDER BY pt_idx))
  WINDOW w AS (PARTITION BY series_id ORDER BY pt_idx))"""
a.SQL["seg"], a.NEEDS["seg"] = _SEG, ["rp"]


@query("seg", "SELECT image_id, series_id, pt_idx, round(lo, 6) AS arc FROM seg")
def arc_cumulative(spark, d):
    return series.arc_cumulative(a.raw_points(spark, d)).withColumn("arc", F.round("arc", 6))


@query(
    "seg",
    """SELECT image_id, series_id, pt_idx, x::BIGINT AS x, y FROM seg WHERE n <= 20
UNION ALL SELECT image_id, series_id, pt_idx, x, y FROM seg WHERE n > 20 AND total = 0 AND pt_idx = 0
UNION ALL SELECT image_id, series_id, k::INT, round_even(x + t * (nx - x), 0)::BIGINT, round_even(y + t * (ny - y), 0)::BIGINT FROM (
  SELECT *, CASE WHEN hi = lo THEN 0 ELSE (d - lo) / (hi - lo) END AS t FROM (
    SELECT s.*, g.k, g.d, row_number() OVER (PARTITION BY s.series_id, g.k ORDER BY s.pt_idx) AS rn
    FROM seg s JOIN (SELECT series_id, k, CASE WHEN k = 19 THEN total ELSE k * (total / 19) END AS d
                     FROM (SELECT DISTINCT series_id, total FROM seg WHERE n > 20 AND total > 0), range(0, 20) r(k)) g
    ON s.series_id = g.series_id AND s.nx IS NOT NULL AND (s.hi >= g.d OR s.pt_idx = s.n - 2)) WHERE rn = 1)""",
)
def arc_length(spark, d):
    return series.arc_length(a.raw_points(spark, d), SETTINGS.max_points)


@query("means", "SELECT image_id, series_id, round(mean_y, 9) AS mean_y, n_points FROM means")
def series_mean_y(spark, d):
    return series.mean_y(series.downsample(a.raw_points(spark, d), SETTINGS)).withColumn("mean_y", F.round("mean_y", 9))


def _ranked(spark, d, mode):
    means = series.mean_y(series.downsample(series.by_image(a.raw_points(spark, d)), SETTINGS))
    return series.ranked(means, mode).select("image_id", "series_id", "series_pos")


@query("pos", "SELECT image_id, series_id, series_pos FROM pos")
def sort_mean_y_desc(spark, d):
    return _ranked(spark, d, "mean_y_desc")


@query("means", "SELECT image_id, series_id, (row_number() OVER (PARTITION BY image_id ORDER BY mean_y DESC, series_id) - 1)::INT AS series_pos FROM means")
def sort_mean_y_asc(spark, d):
    return _ranked(spark, d, "mean_y_asc")


@query("pos", "SELECT image_id, count(*) AS n_lines, sum(n_points)::BIGINT AS total_points, string_agg(n_points::VARCHAR, ', ' ORDER BY series_pos) AS line_points FROM pos GROUP BY image_id")
def line_summary(spark, d):
    return series.line_summary(a.raw_points(spark, d), SETTINGS)


# --- detections

_CLASS = "CASE class_id " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(CLASSES)) + " END"
_DET = "image_id, class_id, det_ord, x1, y1, x2, y2, score"


@query("det", f"SELECT {_DET} FROM det WHERE score > 0.3e0")
def detect_threshold(spark, d):
    return detect.threshold(a.raw_detections(spark, d), 0.3).select(*_DET.split(", "))


@query("det", f"SELECT {_DET}, {_CLASS} AS class_name FROM det")
def detections_named(spark, d):
    return detect.named(a.raw_detections(spark, d)).select(*_DET.split(", "), "class_name")


@query("det", f"SELECT image_id, class_id, {_CLASS} AS class_name, count(*) AS n FROM det WHERE score > 0.3e0 GROUP BY ALL")
def detections_per_class(spark, d):
    return detect.per_class(detect.threshold(a.raw_detections(spark, d), 0.3)).select("image_id", "class_id", "class_name", "n")


@query("top", f"SELECT {_DET} FROM top WHERE class_id IN (2, 15, 16)")
def top_plot_area(spark, d):
    return detect.best(a.raw_detections(spark, d).where(F.col("class_id").isin(2, 15, 16))).select(*_DET.split(", "))


@query("det", "SELECT image_id, class_id, det_ord, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy FROM det")
def bbox_center(spark, d):
    return detect.center(a.raw_detections(spark, d)).select("image_id", "class_id", "det_ord", "cx", "cy")


@query(
    "det charts",
    """SELECT *, "right" <= "left" OR bottom <= top AS is_empty, CASE WHEN NOT ("right" <= "left" OR bottom <= top) AND bottom - top < 128 THEN 128::DOUBLE / (bottom - top) ELSE 1 END AS scale FROM (
  SELECT d.image_id, class_id, det_ord, greatest(0, trunc(x1)::BIGINT - 10) AS "left", greatest(0, trunc(y1)::BIGINT - 10) AS top,
         least(width, trunc(x2)::BIGINT + 10)::BIGINT AS "right", least(height, trunc(y2)::BIGINT + 10)::BIGINT AS bottom FROM det d JOIN charts c ON d.image_id = c.image_id)""",
)
def crop_boxes(spark, d):
    return detect.crops(a.raw_detections(spark, d), a.charts(spark, d))


_INTER = "greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0)"
_UNION = f"((a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - {_INTER})"


@query("det", f"SELECT a.image_id, a.class_id, a.det_ord AS a_ord, b.det_ord AS b_ord, round({_INTER} / {_UNION}, 9) AS iou FROM det a JOIN det b ON a.image_id = b.image_id AND a.class_id = b.class_id AND a.det_ord < b.det_ord AND {_INTER} > 0")
def iou_pairs(spark, d):
    return detect.overlaps(a.raw_detections(spark, d)).withColumn("iou", F.round("iou", 9))


def _nms_sql(keys: str, most: int, least: str = "", mark: str = "") -> str:
    same = " AND ".join(f"g.{k} = r.{k}" for k in keys.split(", "))
    a.SQL[f"ranked{len(keys)}{mark}"] = f"ranked{len(keys)}{mark} AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY score DESC, det_ord) AS rn FROM det {least})"
    a.NEEDS[f"ranked{len(keys)}{mark}"] = ["det"]
    inter = "greatest(least(k.x2, g.x2) - greatest(k.x1, g.x1), 0) * greatest(least(k.y2, g.y2) - greatest(k.y1, g.y1), 0)"
    name = f"{len(keys)}{mark}"
    a.SQL[f"greedy{name}"] = f"""greedy{name} AS (
  SELECT {keys}, rn, [struct_pack(det_ord := det_ord, class_id := class_id, x1 := x1, y1 := y1, x2 := x2, y2 := y2, score := score)] AS kept FROM ranked{name} WHERE rn = 1
  UNION ALL
  SELECT {", ".join(f"r.{k}" for k in keys.split(", "))}, g.rn, CASE WHEN len(list_filter(r.kept, lambda k: {inter} * 1.7e0 > 0.7e0 * ((k.x2 - k.x1) * (k.y2 - k.y1) + (g.x2 - g.x1) * (g.y2 - g.y1)))) > 0 THEN r.kept
    ELSE list_append(r.kept, struct_pack(det_ord := g.det_ord, class_id := g.class_id, x1 := g.x1, y1 := g.y1, x2 := g.x2, y2 := g.y2, score := g.score)) END
  FROM greedy{name} r JOIN ranked{name} g ON {same} AND g.rn = r.rn + 1)"""
    a.NEEDS[f"greedy{name}"] = [f"ranked{name}"]
    return f"""SELECT {_DET} FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, det_ord) AS top FROM (
  SELECT image_id, unnest(kept, recursive := true) FROM (SELECT image_id, arg_max(kept, rn) AS kept FROM greedy{name} GROUP BY {keys}))) WHERE top <= {most}"""


_AGNOSTIC, _PER_CLASS, _SCORED = _nms_sql("image_id", 1000), _nms_sql("image_id, class_id", 100), _nms_sql("image_id, class_id", 200, "WHERE score > 0.3e0", "s")


@query("greedy8", _AGNOSTIC)
def nms_agnostic(spark, d):
    return detect.nms(a.raw_detections(spark, d), most=1000).select(*_DET.split(", "))


@query("greedy18s", _SCORED)
def nms_scored(spark, d):
    return detect.batched_nms(a.raw_detections(spark, d), score=0.3).select(*_DET.split(", "))


@query("greedy18", _PER_CLASS)
def nms_per_class(spark, d):
    return detect.batched_nms(a.raw_detections(spark, d), most=100).select(*_DET.split(", "))


@query(
    "det",
    """SELECT image_id,
  arg_min(x1, (-score, det_ord)) FILTER (WHERE class_id = 2) AS plot_x1, arg_min(y2, (-score, det_ord)) FILTER (WHERE class_id = 2) AS plot_y2,
  arg_min(x1, (-score, det_ord)) FILTER (WHERE class_id = 16) AS x_axis_x1, arg_min(y2, (-score, det_ord)) FILTER (WHERE class_id = 15) AS y_axis_y2,
  count(*) FILTER (WHERE class_id = 7) AS n_x_ticks, count(*) FILTER (WHERE class_id = 8) AS n_y_ticks,
  count(*) FILTER (WHERE class_id = 4) AS n_xlabels, count(*) FILTER (WHERE class_id = 5) AS n_ylabels,
  arg_min(x1, det_ord) FILTER (WHERE class_id = 7) AS first_tick_x1, arg_max(score, det_ord) FILTER (WHERE class_id = 5) AS last_ylabel_score
FROM det WHERE score > 0.3e0 GROUP BY image_id""",
)
def axis_info(spark, d):
    i = detect.axis_info(detect.threshold(a.raw_detections(spark, d), 0.3))
    at = lambda c, k: F.get(F.col(c), F.lit(k))
    return i.select(
        "image_id", at("plot_area", 0).alias("plot_x1"), at("plot_area", 3).alias("plot_y2"), at("x_axis_area", 0).alias("x_axis_x1"), at("y_axis_area", 3).alias("y_axis_y2"),
        *(F.size(c).cast("long").alias(f"n_{c}") for c in ("x_ticks", "y_ticks", "xlabels", "ylabels")),
        F.get(F.get("x_ticks", F.lit(0)), F.lit(0)).alias("first_tick_x1"), F.get(F.try_element_at("ylabels", F.lit(-1)), F.lit(4)).alias("last_ylabel_score"),
    )


# --- labels

_PARSED = r"""try_cast(nullif(regexp_extract(translate(text, 'OolI, ', '0011.'), '[-+]?[0-9]*\.?[0-9]+([eE][-+]?[0-9]+)?'), '') AS DOUBLE)"""


@query(
    "",
    f"""SELECT src, id, {_PARSED} AS value FROM (
  SELECT 'document' AS src, doc_id AS id, text FROM documents UNION ALL SELECT 'brand', p_partkey, p_brand FROM part UNION ALL SELECT 'name', c_custkey, c_name FROM customer)""",
)
def parse_numeric(spark, d):
    parts = [("document", "documents", "doc_id", "text"), ("brand", "part", "p_partkey", "p_brand"), ("name", "customer", "c_custkey", "c_name")]
    frames = [a.table(spark, d, t).select(F.lit(src).alias("src"), F.col(k).alias("id"), scalars.parse_numeric(F.col(c)).alias("value")) for src, t, k, c in parts]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


@query("ocr", "SELECT * FROM ocr")
def ocr_union(spark, d):
    return labels.union_readings(a.ocr_passes(spark, d))


@query("ocrbest", "SELECT image_id, axis, label_ord, text, conf, method FROM ocrbest")
def ocr_best(spark, d):
    found = labels.best_reading(a.ocr_boxes(spark, d), labels.union_readings(a.ocr_passes(spark, d)))
    return found.select("image_id", "axis", "label_ord", "text", "conf", "method")


@query("ocrbest", f"SELECT image_id, axis, label_ord, {_PARSED} AS value, (row_number() OVER (PARTITION BY image_id, axis ORDER BY edge, label_ord) - 1)::INT AS pos FROM ocrbest")
def ocr_labels(spark, d):
    found = labels.best_reading(a.ocr_boxes(spark, d), labels.union_readings(a.ocr_passes(spark, d)))
    return labels.ordered(found).select("image_id", "axis", "label_ord", "value", "pos")


@query("lab", "SELECT image_id, axis, det_ord, value FROM lab WHERE axis = 'y'")
def axis_subset(spark, d):
    return labels.of_axis(a.axis_labels(spark, d), "y").select("image_id", "axis", "det_ord", "value")


@query("steps", "SELECT * FROM steps")
def axis_steps(spark, d):
    return labels.steps(a.axis_labels(spark, d))


@query("med", "SELECT * FROM med")
def upper_median_step(spark, d):
    return labels.median_step(a.axis_labels(spark, d))


@query("cons", "SELECT * FROM cons")
def axis_consistency(spark, d):
    return labels.consistency(a.axis_labels(spark, d))


@query("fix", "SELECT image_id, axis, det_ord, value, corrected FROM corr")
def axis_corrected(spark, d):
    return labels.corrected(a.axis_labels(spark, d)).select("image_id", "axis", "det_ord", "value", "corrected")


def _calibration(spark, d):
    return labels.calibration(labels.corrected(a.axis_labels(spark, d)))


def _config(spark, d):
    plot = detect.best(a.raw_detections(spark, d).where("class_id = 2"))
    return labels.axis_config(_calibration(spark, d), a.charts(spark, d), plot)


@query("cal", "SELECT * FROM cal")
def axis_calibration(spark, d):
    return _calibration(spark, d)


@query("cfg", "SELECT * FROM cfg")
def axis_config(spark, d):
    return _config(spark, d)


@query(
    "lab",
    """SELECT l.image_id, l.axis, det_ord, coalesce(value, round_even(pv + s.dv / s.dp * (center - pc), 0)) AS value FROM (
  SELECT *, lag(value) OVER w AS pv, lag(center) OVER w AS pc FROM lab WINDOW w AS (PARTITION BY image_id, axis ORDER BY edge, det_ord)) l
LEFT JOIN (SELECT image_id, axis, avg(dv) AS dv, avg(dp) AS dp FROM (
  SELECT image_id, axis, value - lag(value) OVER w AS dv, center - lag(center) OVER w AS dp FROM lab WHERE value IS NOT NULL
  WINDOW w AS (PARTITION BY image_id, axis ORDER BY edge, det_ord)) GROUP BY ALL HAVING count(dv) >= 2 AND avg(dp) <> 0) s
ON s.image_id = l.image_id AND s.axis = l.axis""",
)
def infer_scale(spark, d):
    return labels.filled(a.axis_labels(spark, d)).select("image_id", "axis", "det_ord", "value")


@query(
    "fix",
    """SELECT image_id, string_agg(part, ' | ' ORDER BY axis) AS caption FROM (
  SELECT image_id, axis, upper(axis) || ': [' || coalesce(string_agg(value::VARCHAR, ', ' ORDER BY edge, det_ord) FILTER (WHERE value IS NOT NULL), '') || ']' AS part FROM corr GROUP BY image_id, axis) GROUP BY image_id""",
)
def label_caption(spark, d):
    return labels.caption(labels.corrected(a.axis_labels(spark, d)), scalars.float_text(F.col("value")))


@query(
    "rp cfg",
    """SELECT p.image_id, series_id, pt_idx, round(x1_val + (x - x1_px) * (CASE WHEN x2_px <> x1_px THEN (x2_val - x1_val) / (x2_px - x1_px) END), 6) AS x_value,
  round(y1_val + (y - y1_py) * (CASE WHEN y2_py <> y1_py THEN (y2_val - y1_val) / (y2_py - y1_py) END), 6) AS y_value FROM rp p JOIN cfg c ON p.image_id = c.image_id""",
)
def ext_pixel_to_value(spark, d):
    return labels.to_values(a.raw_points(spark, d), _config(spark, d)).withColumns({c: F.round(c, 6) for c in ("x_value", "y_value")})


# --- documents


def _documents(spark, d):
    nested = series.nested(series.data_series(series.by_image(a.raw_points(spark, d)), SETTINGS))
    return documents.with_axes(nested, a.charts(spark, d), _config(spark, d))


a.SQL["dp"], a.NEEDS["dp"] = "dp AS (SELECT ds.*, series_pos FROM ds JOIN pos ON ds.series_id = pos.series_id)", ["pos"]
a.SQL["img"], a.NEEDS["img"] = (
    "img AS (SELECT i.image_id, h.height, h.width, c.image_id IS NOT NULL AS has_axes, n_lines, c.* EXCLUDE image_id FROM (SELECT image_id, count(*) AS n_lines FROM pos GROUP BY ALL) i LEFT JOIN charts h ON h.image_id = i.image_id LEFT JOIN cfg c ON c.image_id = i.image_id)",
    ["pos", "cfg"],
)


@query("img", "SELECT image_id, height, width, has_axes, n_lines, x1_val, y1_val FROM img")
def series_with_axes(spark, d):
    return _documents(spark, d).select("image_id", "height", "width", "has_axes", F.size("all_series").cast("long").alias("n_lines"), "x1_val", "y1_val")


@query("dp", "SELECT image_id, series_pos + 2 AS dataset_id, 'Line ' || (series_pos + 1) AS dataset_name, pt_idx + 1 AS point_id, x::DOUBLE AS x_px, y::DOUBLE AS y_px FROM dp")
def project_a_points(spark, d):
    flat = _documents(spark, d).select("image_id", F.explode(documents.datasets_a()).alias("s")).select("image_id", F.col("s.id").alias("dataset_id"), F.col("s.name").alias("dataset_name"), F.inline("s.points"))
    return flat.select("image_id", "dataset_id", "dataset_name", F.col("id").alias("point_id"), F.col("xPx").alias("x_px"), F.col("yPx").alias("y_px"))


@query(
    "img dp",
    """SELECT image_id, 1 AS dataset_id, 'dataset 1' AS dataset_name, 0::BIGINT AS n_points FROM img
UNION ALL SELECT image_id, series_pos + 2, 'Line ' || (series_pos + 1), count(*) FROM dp GROUP BY ALL""",
)
def project_a_datasets(spark, d):
    flat = _documents(spark, d).select("image_id", F.explode(documents.datasets_a()).alias("s"))
    return flat.select("image_id", F.col("s.id").alias("dataset_id"), F.col("s.name").alias("dataset_name"), F.size("s.points").cast("long").alias("n_points"))


@query("dp", "SELECT image_id, 'Dataset ' || (series_pos + 1) AS dataset_name, pt_idx AS pos, x::DOUBLE AS x, y::DOUBLE AS y FROM dp")
def project_b_points(spark, d):
    flat = _documents(spark, d).select("image_id", F.explode(documents.datasets_b()).alias("s"))
    return flat.select("image_id", F.col("s.name").alias("dataset_name"), F.posexplode("s.data").alias("pos", "p")).select("image_id", "dataset_name", "pos", "p.x", "p.y")


def _calibration_sql() -> str:
    rows = (("x1", "x1", "y1"), ("x2", "x2", "y1"), ("y1", "x1", "y1"), ("y2", "x1", "y2"))
    corner = {"x1": ("0", "height"), "x2": ("width", "height"), "y1": ("0", "height"), "y2": ("0", "0")}
    value = lambda k: f"CASE WHEN has_axes THEN {k}_val::VARCHAR ELSE '{100 if k[1] == '2' else 0}' END"
    one = "SELECT image_id, {i} AS pos, CASE WHEN has_axes THEN {k}_px ELSE {px}::DOUBLE END AS px, CASE WHEN has_axes THEN {k}_py ELSE {py}::DOUBLE END AS py, {dx} AS dx, {dy} AS dy FROM img"
    return " UNION ALL ".join(one.format(i=i, k=k, px=corner[k][0], py=corner[k][1], dx=value(dx), dy=value(dy)) for i, (k, dx, dy) in enumerate(rows))


@query("img", _calibration_sql())
def project_b_calibration(spark, d):
    flat = _documents(spark, d).select("image_id", F.posexplode(documents.calibration_b()).alias("pos", "p"))
    return flat.select("image_id", "pos", "p.px", "p.py", "p.dx", "p.dy")


TIMESTAMP = "2024-01-01T00:00:00.000Z"


def _document_sql(kind: str) -> str:
    """The same documents put together from structs and lists."""
    corner = {"x1": ("0", "height", "0"), "x2": ("width", "height", "100"), "y1": ("0", "height", "0"), "y2": ("0", "0", "100")}
    either = lambda k, field, default: f"CASE WHEN has_axes THEN {k}_{field} ELSE {default}::DOUBLE END"
    if kind == "a":
        point = lambda k: f"{k} := struct_pack(name := '{k}', value := {either(k, 'val', corner[k][2])}, coord := struct_pack(xPx := {either(k, 'px', corner[k][0])}, yPx := {either(k, 'py', corner[k][1])}))"
        axes = f"struct_pack(id := 1, name := 'XY Axes 1', {', '.join(map(point, corner))}, xIsLogScale := coalesce(x_is_log, false), yIsLogScale := coalesce(y_is_log, false), considerGraphTilt := false, pointMode := 0, isVisible := true)"
        line = """struct_pack(id := series_pos + 2, name := 'Line ' || (series_pos + 1), axisSetId := 1, points := list(struct_pack(id := pt_idx + 1, xPx := x::DOUBLE, yPx := y::DOUBLE) ORDER BY pt_idx),
    visiblePointIds := list(pt_idx + 1 ORDER BY pt_idx), manuallyAddedPointIds := []::INT[])"""
        none = "struct_pack(id := 1, name := 'dataset 1', axisSetId := 1, points := []::STRUCT(id INT, xPx DOUBLE, yPx DOUBLE)[], visiblePointIds := []::INT[], manuallyAddedPointIds := []::INT[])"
        doc = f"struct_pack(version := '1.11.2', timestamp := '{TIMESTAMP}', axisSets := [{axes}], activeAxisSetId := 1, datasets := datasets, activeDatasetId := len(datasets), canvasHandler := struct_pack(scale := 1::DOUBLE, manualMode := 0))"
    else:
        value = lambda k: f"CASE WHEN has_axes THEN {k}_val::VARCHAR ELSE '{corner[k][2]}' END"
        point = lambda k, dx, dy: f"struct_pack(px := {either(k, 'px', corner[k][0])}, py := {either(k, 'py', corner[k][1])}, dx := {value(dx)}, dy := {value(dy)}, dz := NULL)"
        points = ", ".join(point(*p) for p in (("x1", "x1", "y1"), ("x2", "x2", "y1"), ("y1", "x1", "y1"), ("y2", "x1", "y2")))
        axes = f"struct_pack(name := 'XY', type := 'XYAxes', isLogX := coalesce(x_is_log, false), isLogY := coalesce(y_is_log, false), noRotation := false, calibrationPoints := [{points}])"
        line = """struct_pack(name := 'Dataset ' || (series_pos + 1), axesName := 'XY', colorRGB := [200, 0, 0, 255], metadataKeys := []::VARCHAR[],
    data := list(struct_pack(x := x::DOUBLE, y := y::DOUBLE, value := NULL::DOUBLE) ORDER BY pt_idx), autoDetectionData := NULL::VARCHAR)"""
        none = "struct_pack(name := 'Default Dataset', axesName := 'XY', colorRGB := [200, 0, 0, 255], metadataKeys := []::VARCHAR[], data := []::STRUCT(x DOUBLE, y DOUBLE, value DOUBLE)[], autoDetectionData := NULL::VARCHAR)"
        doc = f"struct_pack(version := [4, 2], axesColl := [{axes}], datasetColl := datasets, measurementColl := []::VARCHAR[])"
    return f"""SELECT i.image_id, to_json({doc})::VARCHAR AS document FROM img i JOIN (
  SELECT image_id, list_prepend({none}, list(line ORDER BY series_pos)) AS datasets FROM (
    SELECT image_id, series_pos, {line} AS line FROM dp GROUP BY image_id, series_pos) GROUP BY image_id) l ON l.image_id = i.image_id"""


@query("img dp", _document_sql("a"))
def project_a_json(spark, d):
    return documents.document_a(_documents(spark, d), TIMESTAMP)


@query("img dp", _document_sql("b"))
def project_b_json(spark, d):
    return documents.document_b(_documents(spark, d))


@query("", "SELECT doc_id, CASE WHEN length(text) > 5000 THEN left(text, 5000) || chr(10) || '... (truncated)' ELSE text END AS preview FROM documents")
def json_preview(spark, d):
    return a.table(spark, d, "documents").select("doc_id", scalars.preview(F.col("text")).alias("preview"))


# --- overlays


@query("pos", f"SELECT image_id, series_id, series_pos, list_extract({list(overlay.MARKERS)}, series_pos % 6 + 1) AS marker FROM pos")
def overlay_markers(spark, d):
    return overlay.markers(_ranked(spark, d, "mean_y_desc"))


@query(
    "cfg",
    """SELECT image_id, axis, i, trunc(x1 + dx * i / dist)::BIGINT AS start_x, trunc(y1 + dy * i / dist)::BIGINT AS start_y,
  trunc(x1 + dx * least(i + 10, dist) / dist)::BIGINT AS end_x, trunc(y1 + dy * least(i + 10, dist) / dist)::BIGINT AS end_y FROM (
  SELECT *, unnest(range(0, dist, 15)) AS i FROM (SELECT *, greatest(1, trunc(sqrt((dx * dx + dy * dy)::DOUBLE))::BIGINT) AS dist FROM (
    SELECT *, x2 - x1 AS dx, y2 - y1 AS dy FROM (
      SELECT image_id, 'x' AS axis, trunc(x1_px)::BIGINT AS x1, trunc(x1_py)::BIGINT AS y1, trunc(x2_px)::BIGINT AS x2, trunc(x2_py)::BIGINT AS y2 FROM cfg
      UNION ALL SELECT image_id, 'y', trunc(y1_px)::BIGINT, trunc(y1_py)::BIGINT, trunc(y2_px)::BIGINT, trunc(y2_py)::BIGINT FROM cfg))))""",
)
def overlay_dashes(spark, d):
    return overlay.dashes(_config(spark, d))


@query(
    "cfg",
    " UNION ALL ".join(
        f"SELECT image_id, '{k.upper()}' AS point, '{k.upper()}=' || {k}_val::VARCHAR AS label, trunc({k}_px)::BIGINT + ({dx}) AS x, trunc({k}_py)::BIGINT + ({dy}) AS y FROM cfg"
        for k, (dx, dy) in {"x1": (15, -5), "x2": (-100, -5), "y1": (15, 20), "y2": (15, -5)}.items()
    ),
)
def overlay_labels(spark, d):
    return overlay.point_labels(_config(spark, d))


@query("det", f"SELECT image_id, class_id, det_ord, {_CLASS} || ': ' || printf('%.2f', score) AS caption, coalesce(map_extract(MAP {overlay.COLOURS}, {_CLASS})[1], '{overlay.OTHER}') AS colour, trunc(x1)::BIGINT AS x, trunc(y1)::BIGINT - 5 AS y FROM det WHERE score > 0.3e0")
def overlay_captions(spark, d):
    return overlay.box_captions(detect.named(detect.threshold(a.raw_detections(spark, d), 0.3)))


# --- models, scalars


@query("models files", "SELECT model_key, name, checkpoint FROM models WHERE checkpoint NOT IN (SELECT file_name FROM files)")
def missing_models(spark, d):
    return models.missing(a.models(spark, d), a.files(spark, d))


@query("models files", "SELECT * FROM files WHERE file_name IN (SELECT checkpoint FROM models)")
def known_models(spark, d):
    return models.known(a.files(spark, d), a.models(spark, d))


@query("models", "SELECT n_name, model_key, name, checkpoint FROM nation JOIN region ON n_regionkey = r_regionkey JOIN models ON model_key = lower(region.r_name)")
def model_checkpoint(spark, d):
    keys = a.table(spark, d, "nation").join(a.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", F.lower("r_name").alias("model_key"))
    return models.checkpoint(keys, a.models(spark, d)).select("n_name", "model_key", "name", "checkpoint")


@query("models", "SELECT model_key, 'finetune:' || model_key AS choice FROM models")
def model_choice(spark, d):
    chosen = a.models(spark, d).select(F.concat(F.lit("finetune:"), "model_key").alias("choice"))
    return chosen.select(models.key_of_choice(F.col("choice")).alias("model_key"), "choice")


@query(
    "files",
    """SELECT f.file_name, left(sha256(f.content), 16) AS prefix, coalesce(left(sha256(f.content), 16) = h.h, true) AS passes FROM files f
LEFT JOIN (SELECT lower(n_name) || '.bin' AS file_name, left(sha256(CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE 'x' END), 16) AS h FROM nation) h ON h.file_name = f.file_name""",
)
def hash_prefix_check(spark, d):
    n = a.table(spark, d, "nation")
    hashes = n.select(F.concat(F.lower("n_name"), F.lit(".bin")).alias("file_name"), scalars.hash_prefix(F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).otherwise("x")).alias("sha256_16"))
    return models.intact(a.files(spark, d), hashes)


@query("", "SELECT c_custkey, to_base64(encode(c_name)) AS payload FROM customer")
def base64_payload(spark, d):
    return a.table(spark, d, "customer").select("c_custkey", F.base64(F.col("c_name").cast("binary")).alias("payload"))


@query("", r"SELECT page_id, regexp_extract(url, '([^/]*?)(\.[^./]*)?$', 1) AS stem FROM pages")
def file_stem(spark, d):
    return a.table(spark, d, "pages").select("page_id", images.stem(F.col("url")).alias("stem"))


@query("", r"SELECT event_id, strftime(ts, 'sd-%Y%m%d-%H%M%S.zip') AS zip_name, strftime(ts, 'wpd-%Y%m%d-%H%M%S.tar') AS tar_name FROM events")
def archive_names(spark, d):
    return a.table(spark, d, "events").select("event_id", *(archives.archive_name(F.col("ts"), kind).alias(f"{kind}_name") for kind in ("zip", "tar")))


@query("", r"SELECT page_id, regexp_extract(url, '([^/]*?)(\.[^./]*)?$', 1) || '_result.png' AS name FROM pages")
def result_names(spark, d):
    return a.table(spark, d, "pages").select("page_id", images.result_name(F.col("url")).alias("name"))


@query("", "SELECT event_id, strftime(date_trunc('millisecond', ts), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS iso FROM events")
def iso_millis(spark, d):
    return a.table(spark, d, "events").select("event_id", scalars.iso_millis(F.col("ts")).alias("iso"))


# --- streams


@query(
    "",
    """SELECT strftime(time_bucket(INTERVAL 5 MINUTE, ts), '%Y-%m-%d %H:%M:%S') AS start, user_id // 6 AS image_id, user_id AS series_id, count(*) AS n_points, round(avg(floor(value)), 9) AS mean_y
FROM events GROUP BY ALL""",
)
def stream_windows(spark, d):
    """Events read as a stream of files, counted by event time."""
    kinds = a.table(spark, d, "events").schema
    events = ingest.point_stream(spark, d, kinds, "events.parquet")
    points = events.select(F.col("ts").cast("timestamp").alias("ts"), F.floor(F.col("user_id") / 6).alias("image_id"), F.col("user_id").alias("series_id"), F.floor("value").alias("y"))
    folder = f"file://{_folder(spark)}"
    ingest.latest(ingest.windowed_counts(points), f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    found = spark.read.parquet(f"{folder}/out")
    return found.select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "image_id", "series_id", "n_points", F.round("mean_y", 9).alias("mean_y"))


# --- sources and sinks


def png(height: int, width: int) -> bytes:
    """A grey image, for scans and archives."""
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = zlib.compress(b"".join(b"\x00" + b"\x80" * width for _ in range(height)))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + chunk(b"IDAT", rows) + chunk(b"IEND", b"")


def _folder(spark) -> str:
    """A new folder that all executors see, deleted with the session; only on one machine may it be a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.gettempdir()
    folder = f"{archives.local_path(base).rstrip('/')}/archives-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(f"file://{folder}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return folder


_IMAGE = png(8, 12)


def _export(spark, d, kind):
    """Archives of all images with a series, read back entry by entry."""
    images_of = documents.exportable(_documents(spark, d))
    docs = documents.document_a(images_of, TIMESTAMP) if kind == "zip" else documents.document_b(images_of)
    image = F.unbase64(F.lit(base64.b64encode(_IMAGE).decode()))
    projects = docs.select("image_id", F.concat(F.lit("chart-"), "image_id").alias("name"), image.alias("image"), "document")
    return archives.entries(archives.write(projects, _folder(spark), kind), kind)


def _entries_sql(document: str, entries: dict[str, str]) -> str:
    """``entries``: names, with # for the archive's, and SQL for their digests; JSON counts without its spaces."""
    each = ", ".join(f"struct_pack(entry := '{name}', digest := {digest})" for name, digest in entries.items())
    return f"SELECT name, replace(e.entry, '#', name) AS entry, e.digest AS digest FROM (SELECT 'chart-' || image_id AS name, unnest([{each}]) AS e FROM ({document}))"


_PICTURE = f"'{hashlib.sha256(_IMAGE).hexdigest()}'"
_INFO = "sha256('{\"version\":[4,0],\"json\":\"wpd.json\",\"images\":[\"image.png\"]}')"


@query("img dp", _entries_sql(_document_sql("a"), {"image.png": _PICTURE, "project.json": "sha256(document)"}))
def export_zip(spark, d):
    return _export(spark, d, "zip")


@query("img dp", _entries_sql(_document_sql("b"), {"#/": "''", "#/info.json": _INFO, "#/wpd.json": "sha256(document)", "#/image.png": _PICTURE}))
def export_tar(spark, d):
    return _export(spark, d, "tar")


@query("", " UNION ALL ".join(f"SELECT 'chart-{k}' AS stem, {len(png(8 + k, 12))}::BIGINT AS length, {8 + k} AS height, 12 AS width" for k in range(3)))
def scan_images(spark, d):
    """Three images among other files, one of them broken."""
    folder = _folder(spark)
    os.makedirs(folder)
    for name, data in {**{f"chart-{k}.{'png' if k else 'PNG'}": png(8 + k, 12) for k in range(3)}, "broken.png": b"no image", "notes.txt": b"notes"}.items():
        with open(f"{folder}/{name}", "wb") as f:
            f.write(data)
    scanned = images.readable(images.scan_images(spark, f"file://{folder}"))
    height, width = images.png_size(F.col("content"))
    return scanned.select("stem", "length", height.alias("height"), width.alias("width"))
