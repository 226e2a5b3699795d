"""Point series: resampling, ranking and summaries, each series and each image on its own.

All windows and groups are by ``(image_id, series_id)`` or ``image_id``. ``by_image`` partitions raw points by image
once, and Spark keeps to that partitioning through the whole chain. Inputs have the columns of ``RAW_POINTS``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import half_even

KEYS = ("image_id", "series_id")


@dataclass(frozen=True)
class Settings:
    sort_mode: str = "mean_y_desc"
    downsample_mode: str = "max_points"
    fixed_step: int = 10
    max_points: int = 20


def by_image(points: DataFrame) -> DataFrame:
    """Points partitioned by image, which serves all that follows."""
    return points.repartition("image_id")


def _every(points: DataFrame, step: Column) -> DataFrame:
    kept = points.where(F.col("pt_idx") % step == 0)
    return kept.select(*KEYS, F.floor(F.col("pt_idx") / step).cast("int").alias("pt_idx"), "x", "y")


def fixed(points: DataFrame, step: int) -> DataFrame:
    """Each ``step``-th point from the first on."""
    return _every(points, F.lit(step))


def max_points(points: DataFrame, most: int) -> DataFrame:
    """All points of a series of up to ``most``, else each (n div most)-th, which may leave more than ``most``."""
    n = F.count("*").over(W.partitionBy(*KEYS))
    counted = points.withColumn("step", F.greatest(F.lit(1), F.floor(n / most)).cast("int"))
    return _every(counted, F.col("step"))


def segments(points: DataFrame) -> DataFrame:
    """Each point with the next one and the arc length at both; ``total`` is the series' length."""
    along = W.partitionBy(*KEYS).orderBy("pt_idx")
    nxt = points.withColumns({"nx": F.lead("x").over(along), "ny": F.lead("y").over(along), "n": F.count("*").over(W.partitionBy(*KEYS))})
    length = nxt.withColumn("len", F.coalesce(F.sqrt(((F.col("nx") - F.col("x")) * (F.col("nx") - F.col("x")) + (F.col("ny") - F.col("y")) * (F.col("ny") - F.col("y"))).cast("double")), F.lit(0.0)))
    hi = F.sum("len").over(along.rowsBetween(W.unboundedPreceding, W.currentRow))
    cum = length.withColumn("hi", hi)
    return cum.withColumns({"lo": F.coalesce(F.lag("hi").over(along), F.lit(0.0)), "total": F.max("hi").over(W.partitionBy(*KEYS))})


def arc_cumulative(points: DataFrame) -> DataFrame:
    """Arc length at each point."""
    return segments(points).select(*KEYS, "pt_idx", F.col("lo").alias("arc"))


def arc_length(points: DataFrame, n: int) -> DataFrame:
    """``n`` points at equal distances along the line, both ends included, rounded half to even.

    Series of up to ``n`` points stay as they are; one without length gives its first point. Each segment
    gives the targets that fall in it, so the work is points plus targets, not their product.
    """
    if n < 2:
        raise ValueError("two points at least")
    s = segments(points)
    short, still = F.col("n") <= n, (F.col("total") == 0) & (F.col("pt_idx") == 0)
    moving = (F.col("total") > 0) & F.col("nx").isNotNull()
    step = F.col("total") / (n - 1)
    last = F.col("pt_idx") == F.col("n") - 2
    low = F.greatest(F.lit(0), F.floor(F.col("lo") / step) - 1)
    high = F.when(last, F.lit(n - 1)).otherwise(F.least(F.lit(n - 1), F.ceil(F.col("hi") / step) + 1))
    itself = F.array(F.col("pt_idx").cast("long"))
    aimed = s.withColumn("k", F.explode(F.when(short | still, itself).when(moving & (low <= high), F.sequence(low.cast("long"), high.cast("long")))))
    aimed = aimed.withColumn("d", F.when(F.col("k") == n - 1, F.col("total")).otherwise(F.col("k") * step))
    begins = F.when(F.col("pt_idx") == 0, F.lit(True)).otherwise(F.col("d") > F.col("lo"))
    inside = aimed.where(short | still | (begins & (last | (F.col("d") <= F.col("hi")))))
    t = F.when(F.col("hi") == F.col("lo"), F.lit(0.0)).otherwise((F.col("d") - F.col("lo")) / (F.col("hi") - F.col("lo")))
    at = lambda a, b: F.when(short | still, F.col(a)).otherwise(half_even(F.col(a) + t * (F.col(b) - F.col(a))))
    return inside.select(*KEYS, F.col("k").cast("int").alias("pt_idx"), at("x", "nx").alias("x"), at("y", "ny").alias("y"))


def downsample(points: DataFrame, settings: Settings) -> DataFrame:
    """By ``settings.downsample_mode``; unknown modes change nothing."""
    mode = settings.downsample_mode
    if mode == "fixed":
        return fixed(points, settings.fixed_step)
    if mode == "max_points":
        return max_points(points, settings.max_points)
    if mode == "arc_length":
        return arc_length(points, settings.max_points)
    return points.select(*KEYS, "pt_idx", "x", "y")


def mean_y(points: DataFrame) -> DataFrame:
    """``(mean_y, n_points)`` of each series."""
    return points.groupBy(*KEYS).agg(F.avg(F.col("y").cast("double")).alias("mean_y"), F.count("*").alias("n_points"))


def _order(sort_mode: str) -> list[Column]:
    """Pixels grow downwards, so descending height is ascending mean; ties keep their order."""
    return [*{"mean_y_desc": [F.col("mean_y").asc()], "mean_y_asc": [F.col("mean_y").desc()]}.get(sort_mode, []), F.col("series_id").asc()]


def ranked(means: DataFrame, sort_mode: str) -> DataFrame:
    """``series_pos`` from 0."""
    return means.withColumn("series_pos", (F.row_number().over(W.partitionBy("image_id").orderBy(*_order(sort_mode))) - 1).cast("int"))


def data_series(points: DataFrame, settings: Settings) -> DataFrame:
    """Resampled points with their series' position: the cheap tail that a change of settings runs again."""
    kept = downsample(points, settings)
    means = kept.withColumn("mean_y", F.avg(F.col("y").cast("double")).over(W.partitionBy(*KEYS)))
    place = F.dense_rank().over(W.partitionBy("image_id").orderBy(*_order(settings.sort_mode))) - 1
    return means.select(*KEYS, "pt_idx", "x", "y", place.cast("int").alias("series_pos"))


def line_summary(points: DataFrame, settings: Settings) -> DataFrame:
    """Per image: lines, points, and points of each line in order."""
    r = ranked(mean_y(downsample(by_image(points), settings)), settings.sort_mode)
    in_order = F.array_sort(F.collect_list(F.struct("series_pos", "n_points")))
    counts = F.array_join(F.transform(in_order, lambda s: s["n_points"].cast("string")), ", ")
    return r.groupBy("image_id").agg(F.count("*").alias("n_lines"), F.sum("n_points").alias("total_points"), counts.alias("line_points"))


def nested(series: DataFrame) -> DataFrame:
    """One row a series: ``points`` in order."""
    point = F.struct("pt_idx", "x", "y")
    points = F.transform(F.array_sort(F.collect_list(point)), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    return series.groupBy(*KEYS, "series_pos").agg(points.alias("points"))
