"""Schemas of the chart tables and the dimension of element classes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

CHARTS = "image_id long, path string, height int, width int, content binary"
RAW_DETECTIONS = "image_id long, class_id int, det_ord int, x1 double, y1 double, x2 double, y2 double, score double"
OCR_CANDIDATES = "image_id long, axis string, label_ord int, method string, method_ord int, cand_ord int, text string, conf double"
AXIS_LABELS = "image_id long, axis string, det_ord int, x1 double, y1 double, x2 double, y2 double, text string, value double, confidence double, corrected boolean"
RAW_POINTS = "image_id long, series_id long, pt_idx int, x long, y long"
MODELS = "model_key string, name string, checkpoint string, hf_filename string, sha256_16 string"

# Class names of the detector, by class id.
CLASSES = [
    "x_title", "y_title", "plot_area", "other", "xlabel", "ylabel", "chart_title", "x_tick", "y_tick",
    "legend_patch", "legend_label", "legend_title", "legend_area", "mark_label", "value_label",
    "y_axis_area", "x_axis_area", "tick_grouping",
]


def chart_classes(spark: SparkSession) -> DataFrame:
    """``(class_id, class_name)``: a fixed dimension, so it may be broadcast."""
    return spark.createDataFrame(list(enumerate(CLASSES)), "class_id int, class_name string")
