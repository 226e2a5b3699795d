"""The small registry of models: which files are missing, known or intact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import hash_prefix


def missing(required: DataFrame, files: DataFrame) -> DataFrame:
    """Required models without a file of their name."""
    return required.join(files, required["checkpoint"] == files["file_name"], "left_anti")


def known(files: DataFrame, models: DataFrame) -> DataFrame:
    """Chosen files that are some model's."""
    return files.join(models, files["file_name"] == models["checkpoint"], "left_semi")


def checkpoint(keys: DataFrame, models: DataFrame) -> DataFrame:
    return keys.join(models, "model_key")


def intact(files: DataFrame, hashes: DataFrame) -> DataFrame:
    """Whether each file's SHA-256 begins as registered; files that are not registered pass."""
    j = files.join(hashes, "file_name", "left")
    return j.select("file_name", hash_prefix(F.col("content")).alias("prefix"), F.coalesce(hash_prefix(F.col("content")) == F.col("sha256_16"), F.lit(True)).alias("passes"))


def key_of_choice(choice: Column) -> Column:
    """The model's key in a choice such as ``finetune:key``: what follows the first colon; null without one."""
    return F.when(choice.contains(":"), F.regexp_extract(choice, r"(?s)^[^:]*:(.*)$", 1))
