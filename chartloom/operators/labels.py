"""Axis labels: readings chosen, parsed, ordered, repaired; calibration and axis configuration.

A label is known by (image_id, axis, det_ord); ``axis`` is "x" or "y". ``edge`` orders the labels of an axis:
the left edge on x, the top edge on y; ties keep detection order. All windows are by (image_id, axis).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import parse_numeric

# Reading passes in the order in which they are tried.
METHODS = ("sharp", "adapt", "inv", "dilate")
AXIS = ("image_id", "axis")


def _along():
    return W.partitionBy(*AXIS).orderBy("edge", "det_ord")


def of_axis(labels: DataFrame, which: str = "both") -> DataFrame:
    """The labels of the x axis, the y axis or both."""
    if which not in ("x", "y", "both"):
        raise ValueError("which must be x, y or both")
    return labels if which == "both" else labels.where(F.col("axis") == which)


def union_readings(passes: dict[str, DataFrame]) -> DataFrame:
    """The candidates of all passes, repeats included; each frame has (image_id, axis, label_ord, cand_ord, text, conf)."""
    parts = [passes[m].select("image_id", "axis", "label_ord", F.lit(m).alias("method"), F.lit(k).alias("method_ord"), "cand_ord", "text", "conf") for k, m in enumerate(METHODS) if m in passes]
    return reduce(DataFrame.unionByName, parts)


def best_reading(labels: DataFrame, candidates: DataFrame) -> DataFrame:
    """One reading a label: texts with a point first, then confidence, pass and order; empty if there is none."""
    key = ["image_id", "axis", "label_ord"]
    order = W.partitionBy(*key).orderBy(F.col("text").contains(".").desc(), F.col("conf").desc(), "method_ord", "cand_ord")
    first = candidates.withColumn("rn", F.row_number().over(order)).where("rn = 1").select(*key, "text", "conf", "method")
    return labels.join(first, key, "left").withColumn("text", F.coalesce("text", F.lit("")))


def edge() -> Column:
    return F.when(F.col("axis") == "x", F.col("x1")).otherwise(F.col("y1"))


def center() -> Column:
    return F.when(F.col("axis") == "x", (F.col("x1") + F.col("x2")) / 2).otherwise((F.col("y1") + F.col("y2")) / 2)


def ordered(labels: DataFrame) -> DataFrame:
    """Labels with their parsed value and position along the axis, from 0."""
    valued = labels.withColumns({"edge": edge(), "value": parse_numeric(F.col("text"))})
    return valued.withColumn("pos", (F.row_number().over(_along()) - 1).cast("int"))


def steps(labels: DataFrame) -> DataFrame:
    """Differences between neighbouring valid values, with the count ``n`` of steps and of valid values."""
    valid = labels.where(F.col("value").isNotNull())
    lagged = valid.select(*AXIS, "edge", "det_ord", "value", F.lag("value").over(_along()).alias("before"))
    return lagged.where(F.col("before").isNotNull()).select(*AXIS, "edge", "det_ord", (F.col("value") - F.col("before")).alias("step"))


def median_step(labels: DataFrame) -> DataFrame:
    """The upper median of each axis' steps: element n div 2 of the sorted steps."""
    sorted_steps = F.sort_array(F.collect_list("step"))
    return steps(labels).groupBy(*AXIS).agg(F.element_at(sorted_steps, (F.floor(F.count("*") / 2) + 1).cast("int")).alias("median_step"), F.count("*").alias("n_steps"))


def consistency(labels: DataFrame) -> DataFrame:
    """How many steps lie within 30 % of the median step, and whether that is 60 % of three valid labels' steps or more."""
    s = steps(labels).groupBy(*AXIS).agg(F.sort_array(F.collect_list("step")).alias("sorted"))
    m = s.withColumn("median_step", F.element_at("sorted", (F.floor(F.size("sorted") / 2) + 1).cast("int")))
    near = F.size(F.filter("sorted", lambda d: F.abs(d - F.col("median_step")) < F.abs(F.col("median_step")) * F.lit(0.3)))
    n = F.size("sorted")
    return m.select(*AXIS, "median_step", n.cast("long").alias("n_steps"), near.cast("long").alias("n_near"), ((n >= 2) & (near >= n * F.lit(0.6))).alias("passes"))


def corrected(labels: DataFrame) -> DataFrame:
    """Values ten times off from the mean of their valid neighbours are mended where the axis is consistent.

    Neighbours are read before any repair; the first and last valid label never change. ``corrected`` is
    true where a value changed, else null. Valid labels come first in the window's order, so that neighbours
    in it are valid ones: one partitioning and one sort serve the neighbours and the axis' median step.
    """
    along = W.partitionBy(*AXIS).orderBy(F.col("value").isNull(), "edge", "det_ord")
    around = labels.withColumns({"p": F.lag("value").over(along), "q": F.lead("value").over(along)})
    every = around.withColumn("steps", F.sort_array(F.collect_list(F.col("value") - F.col("p")).over(W.partitionBy(*AXIS))))
    n, median = F.size("steps"), F.get("steps", F.floor(F.size("steps") / 2).cast("int"))
    near = F.size(F.filter("steps", lambda d: F.abs(d - median) < F.abs(median) * F.lit(0.3)))
    passes = (n >= 2) & (near >= n * F.lit(0.6))
    expected = (F.col("p") + F.col("q")) / 2
    ratio = F.when(expected != 0, F.col("value") / expected)
    tenfold, tenth = (F.col("ratio") > 8) & (F.col("ratio") < 12), (F.col("ratio") > F.lit(0.08)) & (F.col("ratio") < F.lit(0.12))
    fixed = F.when((tenfold | tenth) & passes, F.when(tenfold, F.col("value") / 10).otherwise(F.col("value") * 10))  # the axis is judged for few labels only
    out = every.withColumn("ratio", ratio).withColumn("fixed", fixed)
    return out.select(*(F.coalesce("fixed", "value").alias(c) if c == "value" else c for c in labels.columns), F.when(F.col("fixed").isNotNull(), F.lit(True)).alias("corrected"))


def filled(labels: DataFrame) -> DataFrame:
    """Missing values continued from a valid predecessor by the axis' mean scale, rounded half to even; nothing else changes."""
    placed = labels.withColumn("center", center())
    valid = placed.where(F.col("value").isNotNull()).withColumns({"dv": F.col("value") - F.lag("value").over(_along()), "dp": F.col("center") - F.lag("center").over(_along())})
    scale = valid.groupBy(*AXIS).agg(F.avg("dv").alias("dv"), F.avg("dp").alias("dp"), F.count("dv").alias("n"))
    scaled = scale.where("n >= 2 AND dp <> 0").select(*AXIS, (F.col("dv") / F.col("dp")).alias("scale"))
    before = placed.withColumns({"pv": F.lag("value").over(_along()), "pc": F.lag("center").over(_along())})
    joined = before.join(scaled, list(AXIS), "left")
    guess = F.bround(F.col("pv") + F.col("scale") * (F.col("center") - F.col("pc")), 0)
    return joined.withColumn("value", F.coalesce("value", guess)).drop("pv", "pc", "scale", "center")


def calibration(labels: DataFrame) -> DataFrame:
    """First and last valid label of each axis with two valid labels or more: eight columns, null for an axis without."""
    valid = labels.where(F.col("value").isNotNull()).withColumn("center", center())
    at, who = F.struct("edge", "det_ord"), F.struct("center", "value")
    on = lambda axis, x: F.when(F.col("axis") == axis, x)
    found = [f(who, on(axis, at)).alias(f"{axis}{k}") for axis in ("x", "y") for k, f in ((1, F.min_by), (2, F.max_by))]
    counts = {axis: F.count(on(axis, F.lit(1))).alias(f"n_{axis}") for axis in ("x", "y")}
    ends = valid.groupBy("image_id").agg(*found, *counts.values()).where("n_x >= 2 OR n_y >= 2")
    pick = lambda axis, k, field: F.when(F.col(f"n_{axis}") >= 2, F.col(f"{axis}{k}.{field}"))
    return ends.select("image_id", *(pick(axis, k, field).alias(f"{axis}{k}_{name}") for axis in ("x", "y") for k in (1, 2) for field, name in (("center", "pixel"), ("value", "value"))))


def axis_config(calibrations: DataFrame, charts: DataFrame, plot_areas: DataFrame) -> DataFrame:
    """Calibration points of images with both axes. The lower y label becomes y1.

    ``plot_areas``: (image_id, x1, y1, x2, y2); without one, x points lie at 90 % of the height and y points at 10 %
    of the width.
    """
    both = calibrations.where(F.col("x1_pixel").isNotNull() & F.col("y1_pixel").isNotNull())
    p = plot_areas.select("image_id", F.col("x1").alias("pa_left"), F.col("y2").alias("pa_bottom"))
    j = both.join(charts.select("image_id", "height", "width"), "image_id").join(p, "image_id", "left")
    base, side = F.coalesce("pa_bottom", F.col("height") * F.lit(0.9)), F.coalesce("pa_left", F.col("width") * F.lit(0.1))
    fields = {
        "x1_px": F.col("x1_pixel"), "x1_py": base, "x1_val": F.col("x1_value"), "x2_px": F.col("x2_pixel"), "x2_py": base, "x2_val": F.col("x2_value"),
        "y1_px": side, "y1_py": F.col("y2_pixel"), "y1_val": F.col("y2_value"), "y2_px": side, "y2_py": F.col("y1_pixel"), "y2_val": F.col("y1_value"),
    }
    return j.select("image_id", *(e.alias(n) for n, e in fields.items()), F.lit(False).alias("x_is_log"), F.lit(False).alias("y_is_log"))


def caption(labels: DataFrame, text: Column) -> DataFrame:
    """Valid values of the axes in order: ``X: [..] | Y: [..]``; an axis without a label is left out."""
    listed = F.array_sort(F.collect_list(F.when(F.col("value").isNotNull(), F.struct("edge", "det_ord", text.alias("t")))))
    of_axis = labels.groupBy(*AXIS).agg(F.concat(F.upper("axis"), F.lit(": ["), F.array_join(F.transform(listed, lambda s: s["t"]), ", "), F.lit("]")).alias("part"))
    parts = F.array_sort(F.collect_list(F.struct("axis", "part")))
    return of_axis.groupBy("image_id").agg(F.array_join(F.transform(parts, lambda s: s["part"]), " | ").alias("caption"))


def to_values(points: DataFrame, config: DataFrame) -> DataFrame:
    """Points in axis units, linear on both axes; null where an axis' two points coincide. An extension."""
    j = points.join(config, "image_id")
    on = lambda p, a: F.col(f"{a}1_val") + (F.col(p) - F.col(f"{a}1_p{a}")) * F.try_divide(F.col(f"{a}2_val") - F.col(f"{a}1_val"), F.col(f"{a}2_p{a}") - F.col(f"{a}1_p{a}"))
    return j.select("image_id", "series_id", "pt_idx", on("x", "x").alias("x_value"), on("y", "y").alias("y_value"))
