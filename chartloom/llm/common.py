"""Shared helpers: stable row keys, Arrow batches of texts, and tables that cut lineage.

Conventions that every operator of this subpackage follows:

* only the id and text columns that the caller names are read, so further columns of any name are ignored;
* a null text is an empty text;
* ids are integers (other types are refused with a TypeError; the least long stands for null);
* a null id is a document of its own, sorted before all others, and is null again in the result;
* rows that repeat an id are separate rows; what is decided for an (id, text) holds for each of them.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Stands for a null id while rows are keyed; no real id is expected there.
NULL_ID = -(2**63)


def quoted(name: str) -> Column:
    """The column of just this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, made longer until ``df`` has no column like them."""
    out, taken = [], {c.lower() for c in df.columns}
    for name in names:
        while name in taken:
            name = f"_{name}"
        out.append(name)
        taken.add(name)
    return out


def hash_of(df: DataFrame, text_col: str) -> Column:
    """What tells apart rows that share an id but not a text."""
    return F.xxhash64(F.coalesce(df[text_col].cast("binary"), F.lit(b"")))


def key_of(df: DataFrame, id_col: str) -> Column:
    """The id as a long that is never null; ids must be integers."""
    kind = df.schema[id_col].dataType
    if not isinstance(kind, T.IntegralType):
        raise TypeError(f"{id_col} is {kind.simpleString()}; ids must be integers")
    return F.coalesce(df[id_col].cast("long"), F.lit(NULL_ID))


def id_of(key: str = "id") -> Column:
    """The caller's id back from ``key_of``."""
    return F.nullif(F.col(key), F.lit(NULL_ID))


def bound_batches(spark: SparkSession) -> None:
    """Let Spark send Python short batches, whatever the length of texts, unless the session says otherwise."""
    for name, default, value in (("maxRecordsPerBatch", "10000", "2000"), ("maxBytesPerBatch", None, "8m")):
        held = spark.conf.get(f"spark.sql.execution.arrow.{name}", None)
        if held == default:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", value)


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id`` (long, never null) and ``text`` (UTF-8 bytes, never null) of every row."""
    bound_batches(df.sparkSession)
    return df.select(key_of(df, id_col).alias("id"), F.coalesce(df[text_col].cast("binary"), F.lit(b"")).alias("text"))


def keyed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``texts`` with ``th``, which tells apart rows that share an id but not a text."""
    return texts(df, id_col, text_col).withColumn("th", F.xxhash64("text"))


def slices(batch: pa.RecordBatch, column: int, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose binary ``column`` holds about ``most`` bytes at most (one row at least)."""
    start, held = 0, 0
    for i, n in enumerate(pc.binary_length(batch.column(column)).to_pylist()):
        if held and held + n > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def record(names: Iterable[str], *columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns), names=list(names))


def signed(n: int) -> int:
    """An unsigned 64-bit number as the long of the same bits."""
    return n - (1 << 64) if n >> 63 else n


class Scratch:
    """Tables written to the folder that the cluster shares, so that lost executors cost no lineage.

    The folder is the session's ``spark.checkpoint.dir``; only where that is unset, as in tests on one
    machine, a temporary folder is used.
    """

    def __init__(self, spark: SparkSession, name: str):
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            base = f"file://{tempfile.gettempdir()}/chartloom-scratch"
        self.spark, self.root = spark, f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
        path = self._path(self.root)
        self._fs(path).deleteOnExit(path)

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self, path):
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def put(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return the table that was written."""
        conf, key = self.spark.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
        held = conf.get(key, "false")
        conf.set(key, "true")  # the shuffles of this write are of no use after it
        try:
            df.write.mode("overwrite").parquet(f"{self.root}/{name}")
        finally:
            conf.set(key, held)
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            path = self._path(f"{self.root}/{name}")
            self._fs(path).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
