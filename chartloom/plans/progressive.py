"""Results in steps, and raw results kept while settings change.

Lines come first and axes second, as two plans that are run apart. What a model gave is written once and read by
every later plan: a change of settings runs resampling, sorting and documents again, never the model. A change of
the line model drops the raw points alone; the axes stay.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators import detect, documents, labels, series


def lines_first(points: DataFrame, settings: series.Settings) -> DataFrame:
    """What can be shown as soon as there are points: lines and their points of each image."""
    return series.line_summary(points, settings)


def axes_second(axis_labels: DataFrame, charts: DataFrame, detections: DataFrame, plot_area: int = 2) -> DataFrame:
    """The axis configuration, when labels have been read; ``plot_area`` is the class of plot areas."""
    plot = detect.best(detections.where(detections["class_id"] == plot_area))
    return labels.axis_config(labels.calibration(labels.corrected(axis_labels)), charts, plot)


class Kept:
    """Raw points by model, and axes, in a folder that all executors see."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _at(self, *names: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *names]))
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _once(self, name: str, extract: Callable[[], DataFrame]) -> DataFrame:
        done, files = self._at(name, "_SUCCESS")
        if not files.exists(done):
            extract().write.mode("overwrite").parquet(f"{self.folder}/{name}")
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def points(self, model_key: str, extract: Callable[[], DataFrame]) -> DataFrame:
        """The raw points that ``extract`` gave under this model; those of other models go."""
        path, files = self._at("points")
        for entry in files.listStatus(path) if files.exists(path) else ():
            if entry.getPath().getName() != model_key:
                files.delete(entry.getPath(), True)
        return self._once(f"points/{model_key}", extract)

    def axes(self, extract: Callable[[], DataFrame], again: bool = False) -> DataFrame:
        """The axis configuration that ``extract`` gave; it is worked out once, or ``again``."""
        path, files = self._at("axes")
        if again and files.exists(path):
            files.delete(path, True)
        return self._once("axes", extract)

    def document(self, model_key: str, charts: DataFrame, settings: series.Settings) -> DataFrame:
        """Series with axes from what is kept: the part that a change of settings runs again."""
        kept = series.by_image(self.spark.read.parquet(f"{self.folder}/points/{model_key}"))
        return documents.with_axes(series.nested(series.data_series(kept, settings)), charts, self.spark.read.parquet(f"{self.folder}/axes"))
