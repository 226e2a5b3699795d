"""Scans of image files, and the boundary where models plug in.

Models are functions over pandas batches. A model says that it can't use an image by a ``ValueError``; that image
then gives no rows, and ``failures`` tells which ones they were. Any other error ends the job. Filters on what a
model returns belong right behind it: Catalyst moves none through Python.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schema

# The extensions of image files.
EXTENSIONS = ("png", "jpg", "jpeg", "bmp", "tiff")
#: A glob that finds them in either case, before any file is opened.
GLOB = "*.{" + ",".join("".join(f"[{c}{c.upper()}]" for c in e) for e in EXTENSIONS) + "}"
#: How decodable files of these kinds begin, in hexadecimal digits.
HEADS = ("89504E470D0A1A0A", "FFD8FF", "424D", "49492A00", "4D4D002A")


def scan_images(spark: SparkSession, path: str) -> DataFrame:
    """``(path, stem, length, content)`` of the image files under ``path``; others are left out, as are files without a byte."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", GLOB).load(path)
    return files.select("path", stem(F.col("path")).alias("stem"), "length", "content")


def _is_image(content: Column) -> Column:
    head = F.hex(F.substring(content, 1, 8))
    return F.coalesce(reduce(lambda out, h: out | head.startswith(h), HEADS, F.lit(False)), F.lit(False))


def readable(scanned: DataFrame) -> DataFrame:
    """The files that begin as an image does; work ends here for the others, which ``unreadable`` reports."""
    return scanned.where(_is_image(F.col("content")))


def unreadable(scanned: DataFrame) -> DataFrame:
    """``(path, length)`` of the files that are no image, whatever their name."""
    return scanned.where(~_is_image(F.col("content"))).select("path", "length")


def from_bytes(spark: SparkSession, rows: list[tuple[int, bytes]]) -> DataFrame:
    """Uploaded or pasted images as a table."""
    return spark.createDataFrame(rows, "image_id long, content binary")


def stem(path: Column) -> Column:
    """The file's name without folders and last extension."""
    return F.regexp_extract(path, r"([^/]*?)(?:\.[^./]*)?$", 1)


def png_size(content: Column) -> tuple[Column, Column]:
    """``(height, width)`` from a PNG's header, null for other files."""
    is_png = F.hex(F.substring(content, 1, 8)) == "89504E470D0A1A0A"
    number = lambda at: F.conv(F.hex(F.substring(content, at, 4)), 16, 10).cast("int")
    return F.when(is_png, number(21)), F.when(is_png, number(17))


def infer(charts: DataFrame, model: Callable[[int, bytes], list[dict]], fields: str) -> DataFrame:
    """Rows that ``model(image_id, content)`` gives, with the columns ``fields``; one call an image, no order kept."""

    def work(batches: Iterator) -> Iterator:
        import pandas as pd

        names = [f.split()[0] for f in fields.split(",")]
        for pdf in batches:
            rows = []
            for image_id, content in zip(pdf["image_id"], pdf["content"], strict=True):
                try:
                    rows += model(image_id, content)
                except ValueError:  # undecodable
                    continue
            yield pd.DataFrame(rows, columns=names)

    return charts.select("image_id", "content").mapInPandas(work, fields)


def failures(charts: DataFrame, model: Callable[[int, bytes], list[dict]]) -> DataFrame:
    """``(image_id, reason)`` of the images that ``model`` can't use."""

    def reason(image_id: int, content: bytes) -> list[dict]:
        try:
            model(image_id, content)
        except ValueError as e:
            return [{"image_id": image_id, "reason": str(e)}]
        return []

    return infer(charts, reason, "image_id long, reason string")


def lines(charts: DataFrame, model: Callable[[int, bytes], list[dict]]) -> DataFrame:
    """Raw points from a line extractor; coordinates are cut to integers."""
    found = infer(charts, model, "image_id long, series_id long, pt_idx int, x double, y double")
    return found.select("image_id", "series_id", "pt_idx", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"))


def detections(charts: DataFrame, model: Callable[[int, bytes], list[dict]]) -> DataFrame:
    return infer(charts, model, schema.RAW_DETECTIONS)


def readings(crops: DataFrame, model: Callable[[int, bytes], list[dict]]) -> DataFrame:
    return infer(crops, model, schema.OCR_CANDIDATES)


def output_name(path: str, suffix: str = "_result.png") -> str:
    return PurePosixPath(path).stem + suffix


def result_name(path: Column, suffix: str = "_result.png") -> Column:
    """As ``output_name``, for a column."""
    return F.concat(stem(path), F.lit(suffix))
