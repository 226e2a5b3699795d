"""What a renderer draws over a chart: markers, dashed calibration lines and captions, as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import float_text

# Markers in the order of lines, colours of classes (and of others), dash and gap in pixels.
MARKERS = ("cross", "diamond", "square", "triangle_up", "triangle_down", "star")
COLOURS = {
    "plot_area": "0,255,0", "x_axis_area": "255,0,0", "y_axis_area": "0,0,255", "x_tick": "255,255,0", "y_tick": "0,255,255", "xlabel": "255,0,255",
    "ylabel": "128,0,255", "x_title": "0,128,255", "y_title": "255,128,0", "chart_title": "128,255,0", "legend_area": "128,128,128",
}
OTHER = "200,200,200"
DASH, GAP = 10, 5


def markers(series: DataFrame) -> DataFrame:
    """The marker of each line, by its position."""
    return series.select("image_id", "series_id", "series_pos", F.element_at(F.array(*map(F.lit, MARKERS)), F.pmod("series_pos", F.lit(len(MARKERS))) + 1).alias("marker"))


def dashes(config: DataFrame) -> DataFrame:
    """Dashes between the two calibration points of each axis; coordinates are cut to integers."""
    cut = lambda n: F.col(n).cast("long")
    ends = [F.struct(F.lit(a).alias("axis"), *(cut(f"{a}{k}_p{c}").alias(f"{c}{k}") for k in (1, 2) for c in ("x", "y"))) for a in ("x", "y")]
    lines = config.select("image_id", F.inline(F.array(*ends)))
    d = lines.withColumns({"dx": F.col("x2") - F.col("x1"), "dy": F.col("y2") - F.col("y1")})
    d = d.withColumn("dist", F.greatest(F.lit(1), F.sqrt((F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")).cast("double")).cast("long")))
    s = d.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("dist") - 1, F.lit(DASH + GAP).cast("long"))))
    at = lambda c, i: (F.col(f"{c}1") + F.col(f"d{c}") * i / F.col("dist")).cast("long")
    end = F.least(F.col("i") + DASH, F.col("dist"))
    return s.select("image_id", "axis", "i", at("x", F.col("i")).alias("start_x"), at("y", F.col("i")).alias("start_y"), at("x", end).alias("end_x"), at("y", end).alias("end_y"))


def point_labels(config: DataFrame) -> DataFrame:
    """The text at each calibration point and where it goes."""
    offsets = {"x1": (15, -5), "x2": (-100, -5), "y1": (15, 20), "y2": (15, -5)}
    rows = [F.struct(F.lit(k.upper()).alias("point"), F.concat(F.lit(f"{k.upper()}="), float_text(F.col(f"{k}_val"))).alias("label"), (F.col(f"{k}_px").cast("long") + dx).alias("x"), (F.col(f"{k}_py").cast("long") + dy).alias("y")) for k, (dx, dy) in offsets.items()]
    return config.select("image_id", F.inline(F.array(*rows)))


def box_captions(named: DataFrame) -> DataFrame:
    """Caption and colour of each detection that has a class name."""
    pairs = [F.lit(x) for kv in COLOURS.items() for x in kv]
    colour = F.coalesce(F.element_at(F.create_map(*pairs), F.col("class_name")), F.lit(OTHER))
    return named.select("image_id", "class_id", "det_ord", F.concat("class_name", F.lit(": "), F.format_string("%.2f", "score")).alias("caption"), colour.alias("colour"), F.col("x1").cast("long").alias("x"), (F.col("y1").cast("long") - 5).alias("y"))
