"""Detections: thresholds, class names, best boxes, suppression of overlaps and axis elements.

Inputs have the columns of ``RAW_DETECTIONS``; ``det_ord`` is the order in which the detector gave the boxes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars
from ..sources import schema

# The detector's own post-processing.
IOU, SCORE, PER_IMAGE = 0.7, 0.0, 200
BOX = ("x1", "y1", "x2", "y2")


def threshold(detections: DataFrame, score: float = 0.5) -> DataFrame:
    """Boxes that score more than ``score``."""
    return detections.where(F.col("score") > F.lit(score))


def named(detections: DataFrame) -> DataFrame:
    return detections.join(F.broadcast(schema.chart_classes(detections.sparkSession)), "class_id")  # 18 rows


def per_class(detections: DataFrame) -> DataFrame:
    """Boxes of each class that is present."""
    return named(detections.groupBy("image_id", "class_id").agg(F.count("*").alias("n")))


def best(detections: DataFrame) -> DataFrame:
    """The box of the highest score of each image and class; ties keep the first."""
    first = F.min_by(F.struct(*detections.columns), F.struct(-F.col("score"), F.col("det_ord")))  # combined before the shuffle
    return detections.groupBy("image_id", "class_id").agg(first.alias("box")).select("box.*")


def center(detections: DataFrame) -> DataFrame:
    return detections.withColumns({"cx": (F.col("x1") + F.col("x2")) / 2, "cy": (F.col("y1") + F.col("y2")) / 2})


def crops(detections: DataFrame, charts: DataFrame, padding: int = 10, least_height: int = 128) -> DataFrame:
    """Integer regions to read, padded and clamped to the image; ``scale`` enlarges low ones, empty ones are marked."""
    j = detections.join(charts.select("image_id", "height", "width"), "image_id")
    lo = lambda c: F.greatest(F.lit(0), F.col(c).cast("long") - padding)
    hi = lambda c, most: F.least(F.col(most).cast("long"), F.col(c).cast("long") + padding)
    cut = j.select("image_id", "class_id", "det_ord", lo("x1").alias("left"), lo("y1").alias("top"), hi("x2", "width").alias("right"), hi("y2", "height").alias("bottom"))
    empty = (F.col("right") <= F.col("left")) | (F.col("bottom") <= F.col("top"))
    high = F.col("bottom") - F.col("top")
    scale = F.when(~empty & (high < least_height), F.lit(float(least_height)) / high).otherwise(F.lit(1.0))
    return cut.withColumns({"is_empty": empty, "scale": scale})


def overlaps(detections: DataFrame) -> DataFrame:
    """Pairs of boxes of one image and class that overlap, and their IoU."""
    box = F.struct(*BOX)
    d = detections.select("image_id", "class_id", "det_ord", box.alias("box"))
    a, b = d.alias("a"), d.alias("b")
    same = (F.col("a.image_id") == F.col("b.image_id")) & (F.col("a.class_id") == F.col("b.class_id"))
    pairs = a.join(b, same & (F.col("a.det_ord") < F.col("b.det_ord")) & (scalars.intersection(F.col("a.box"), F.col("b.box")) > 0))
    return pairs.select(F.col("a.image_id").alias("image_id"), F.col("a.class_id").alias("class_id"), F.col("a.det_ord").alias("a_ord"), F.col("b.det_ord").alias("b_ord"), scalars.iou(F.col("a.box"), F.col("b.box")).alias("iou"))


def _suppress(detections: DataFrame, keys: list[str], iou: float, score: float) -> DataFrame:
    """Greedy by score: a box stays unless it overlaps one that stays by more than ``iou``."""
    kept = detections.where(F.col("score") > score) if score > 0 else detections
    carried = [c for c in ("class_id",) if c not in keys]
    size = ((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))).alias("area")
    item = F.struct((-F.col("score")).alias("neg"), "det_ord", *BOX, *carried, size)
    ordered = kept.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("boxes"))

    def step(stay: Column, b: Column) -> Column:
        def hit(k: Column) -> Column:  # cheap comparisons first: most boxes don't meet
            meet = (k["x1"] < b["x2"]) & (b["x1"] < k["x2"]) & (k["y1"] < b["y2"]) & (b["y1"] < k["y2"])
            return meet & (scalars.intersection(k, b) * F.lit(1 + iou) > F.lit(iou) * (k["area"] + b["area"]))

        return F.when(F.exists(stay, hit), stay).otherwise(F.concat(stay, F.array(b)))

    folded = ordered.select(*keys, F.aggregate("boxes", F.slice("boxes", 1, 0), step).alias("boxes"))
    flat = folded.select(*keys, F.explode("boxes").alias("b"))
    return flat.select(*keys, *(F.col(f"b.{c}").alias(c) for c in [*carried, "det_ord", *BOX]), (-F.col("b.neg")).alias("score"))


def _capped(kept: DataFrame, most: int) -> DataFrame:
    if most <= 0:
        return kept
    by_score = W.partitionBy("image_id").orderBy(F.col("score").desc(), "det_ord")
    return kept.withColumn("rn", F.row_number().over(by_score)).where(F.col("rn") <= most).drop("rn")


def nms(detections: DataFrame, iou: float = IOU, score: float = SCORE, most: int = 0) -> DataFrame:
    """Suppression over all classes of an image."""
    return _capped(_suppress(detections, ["image_id"], iou, score), most)


def batched_nms(detections: DataFrame, iou: float = IOU, score: float = SCORE, most: int = PER_IMAGE, class_agnostic: bool = False) -> DataFrame:
    """Suppression within each class; the cap is over all classes of an image, by score."""
    if class_agnostic:
        return nms(detections, iou, score, most)
    return _capped(_suppress(detections, ["image_id", "class_id"], iou, score), most)


def axis_info(detections: DataFrame) -> DataFrame:
    """Per image: the best plot area and axis areas, ticks without scores, labels with them; null or empty if absent."""
    d = named(detections)
    box = F.array(*BOX)
    is_ = lambda c: F.col("class_name") == c
    top = lambda c: F.min_by(box, F.when(is_(c), F.struct(-F.col("score"), F.col("det_ord"))))

    def listed(c: str, *columns: str) -> Column:
        got = F.array_sort(F.collect_list(F.when(is_(c), F.struct("det_ord", F.array(*columns).alias("box")))))
        return F.transform(got, lambda s: s["box"])

    areas = {c: top(c) for c in ("plot_area", "x_axis_area", "y_axis_area")}
    lists = {"x_ticks": listed("x_tick", *BOX), "y_ticks": listed("y_tick", *BOX), "xlabels": listed("xlabel", *BOX, "score"), "ylabels": listed("ylabel", *BOX, "score")}
    return d.groupBy("image_id").agg(*(e.alias(n) for n, e in (areas | lists).items()))
