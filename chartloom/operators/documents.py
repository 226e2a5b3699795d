"""Project documents: nested structures of axes and series, one document an image.

Document A belongs to the zip archive, document B to the tar archive. ``series`` is nested (image_id,
series_pos, points); ``config`` is the axis configuration, joined on the left: images without one get a
default of 0 to 100 along the image's edges. Names, versions and field names are fixed values of the formats.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import float_text

_FIELDS = ("x1", "x2", "y1", "y2")
EMPTY = "array<struct<x:bigint,y:bigint>>"


def with_axes(series: DataFrame, charts: DataFrame, config: DataFrame) -> DataFrame:
    """Each image's series in order as ``all_series``, its size and its configuration, which may be null."""
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("series_pos", "points"))), lambda s: s["points"])
    images = series.groupBy("image_id").agg(in_order.alias("all_series"))
    sized = images.join(charts.select("image_id", "height", "width"), "image_id", "left")
    return sized.join(config.withColumn("has_axes", F.lit(True)), "image_id", "left").withColumn("has_axes", F.coalesce("has_axes", F.lit(False)))


def _or(name: str, default: Column) -> Column:
    return F.when(F.col("has_axes"), F.col(name)).otherwise(default.cast("double"))


def _corner(k: str) -> tuple[Column, Column, Column]:
    """Default (px, py, value) of a calibration point."""
    h, w, zero = F.col("height"), F.col("width"), F.lit(0)
    return {"x1": (zero, h, zero), "x2": (w, h, F.lit(100)), "y1": (zero, h, zero), "y2": (zero, zero, F.lit(100))}[k]


def datasets_a() -> Column:
    """An empty dataset, then one for each series; points and datasets are numbered from 1."""
    points = lambda ps: F.transform(ps, lambda p, i: F.struct((i + 1).alias("id"), p["x"].cast("double").alias("xPx"), p["y"].cast("double").alias("yPx")))
    ids = lambda ps: F.transform(ps, lambda p, i: i + 1)

    def dataset(id_: Column, name: Column, ps: Column) -> Column:
        return F.struct(id_.alias("id"), name.alias("name"), F.lit(1).alias("axisSetId"), points(ps).alias("points"), ids(ps).alias("visiblePointIds"), F.array().cast("array<int>").alias("manuallyAddedPointIds"))

    empty = dataset(F.lit(1), F.lit("dataset 1"), F.array().cast(EMPTY))
    lines = F.transform("all_series", lambda ps, i: dataset(i + 2, F.concat(F.lit("Line "), (i + 1).cast("string")), ps))
    return F.concat(F.array(empty), lines)


def document_a(images: DataFrame, timestamp: str) -> DataFrame:
    """``(image_id, document)``: the JSON of document A."""
    flag = lambda n: F.coalesce(F.col(n), F.lit(False))

    def point(k: str) -> Column:
        px, py, val = _corner(k)
        return F.struct(F.lit(k).alias("name"), _or(f"{k}_val", val).alias("value"), F.struct(_or(f"{k}_px", px).alias("xPx"), _or(f"{k}_py", py).alias("yPx")).alias("coord"))

    axes = F.struct(
        F.lit(1).alias("id"), F.lit("XY Axes 1").alias("name"), *(point(k).alias(k) for k in _FIELDS), flag("x_is_log").alias("xIsLogScale"), flag("y_is_log").alias("yIsLogScale"),
        F.lit(False).alias("considerGraphTilt"), F.lit(0).alias("pointMode"), F.lit(True).alias("isVisible"),
    )
    d = images.withColumn("datasets", datasets_a())
    doc = F.struct(
        F.lit("1.11.2").alias("version"), F.lit(timestamp).alias("timestamp"), F.array(axes).alias("axisSets"), F.lit(1).alias("activeAxisSetId"), F.col("datasets"),
        F.size("datasets").alias("activeDatasetId"), F.struct(F.lit(1.0).alias("scale"), F.lit(0).alias("manualMode")).alias("canvasHandler"),
    )
    return d.select("image_id", F.to_json(doc, {"ignoreNullFields": "false"}).alias("document"))


def calibration_b() -> Column:
    """Four points; ``dx`` and ``dy`` are texts: numbers as Python spells them, bare integers for the default."""
    value = lambda k: F.when(F.col("has_axes"), float_text(F.col(f"{k}_val"))).otherwise(F.lit("100" if k[1] == "2" else "0"))

    def point(k: str, dx: str, dy: str) -> Column:
        px, py, _ = _corner(k)
        return F.struct(_or(f"{k}_px", px).alias("px"), _or(f"{k}_py", py).alias("py"), value(dx).alias("dx"), value(dy).alias("dy"), F.lit(None).cast("string").alias("dz"))

    return F.array(point("x1", "x1", "y1"), point("x2", "x2", "y1"), point("y1", "x1", "y1"), point("y2", "x1", "y2"))


def datasets_b() -> Column:
    def dataset(name: Column, ps: Column) -> Column:
        data = F.transform(ps, lambda p: F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y"), F.lit(None).cast("double").alias("value")))
        colour = F.array(*map(F.lit, (200, 0, 0, 255)))
        return F.struct(name.alias("name"), F.lit("XY").alias("axesName"), colour.alias("colorRGB"), F.array().cast("array<string>").alias("metadataKeys"), data.alias("data"), F.lit(None).cast("string").alias("autoDetectionData"))

    lines = F.transform("all_series", lambda ps, i: dataset(F.concat(F.lit("Dataset "), (i + 1).cast("string")), ps))
    return F.concat(F.array(dataset(F.lit("Default Dataset"), F.array().cast(EMPTY))), lines)


def document_b(images: DataFrame) -> DataFrame:
    """``(image_id, document)``: the JSON of document B, nulls written out."""
    flag = lambda n: F.coalesce(F.col(n), F.lit(False))
    axes = F.struct(F.lit("XY").alias("name"), F.lit("XYAxes").alias("type"), flag("x_is_log").alias("isLogX"), flag("y_is_log").alias("isLogY"), F.lit(False).alias("noRotation"), calibration_b().alias("calibrationPoints"))
    doc = F.struct(F.array(F.lit(4), F.lit(2)).alias("version"), F.array(axes).alias("axesColl"), datasets_b().alias("datasetColl"), F.array().cast("array<string>").alias("measurementColl"))
    return images.select("image_id", F.to_json(doc, {"ignoreNullFields": "false"}).alias("document"))


def exportable(images: DataFrame) -> DataFrame:
    """Images with a series: others are not written."""
    return images.where(F.size("all_series") > 0)
