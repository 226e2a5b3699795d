"""Line deduplication: range-partitioned hashes, secondary sort, first occurrences streamed.

A line's key is the line without ASCII white space at its ends and with A-Z lower-cased. Keys of at least
``least`` code points that two or more ids hold lose all their lines but those of the smallest such id.

The 128-bit key hashes are range-partitioned and sorted by (hash, id, position). The ranges cut by id too,
so a line that a third of all documents share is spread over many tasks. Each task streams its sorted rows
once, holding one hash at a time: the first id it meets keeps its lines. A task cannot know whether its
first hash began in an earlier range, so those rows are passed on undecided and settled by the least id
that any task saw for the hash: two rows a task.

What comes back per document is a compressed bitmap of kept lines, not text; ``apply_bitmap`` cuts a text.

Edge cases: a null or empty text is one empty line, which is kept. Null ids count as one id that sorts
first. Rows that repeat an id hold a key together: that alone makes no duplicate. An empty table gives an
empty result. Positions of a text are bounded by its own length.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, hash_of, id_of, key_of, keyed, partitions, quoted, record, slices, unused

LEAST = 10
FIELDS = ("kind", "h1", "h2", "id", "th", "pos")
SCHEMA = "kind int, h1 long, h2 long, id long, th long, pos int"
DROP, UNDECIDED, SEEN = 0, 1, 2
NAMES = ("id", "n_lines", "n_dropped", "bitmap", "kept_sha256")


def line_key(line: bytes) -> bytes:
    return line.strip().lower()  # on bytes both know ASCII only


def long_enough(key: bytes, least: int) -> bool:
    return len(key) >= least and (len(key) >= 4 * least or len(key.decode("utf-8", "replace")) >= least)


def pack(keep: np.ndarray) -> bytes:
    """A compressed bitmap of which lines stay."""
    return zlib.compress(np.packbits(keep).tobytes(), 1)


def unpack(bitmap: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(bitmap), dtype=np.uint8), count=n).astype(bool)


def apply_bitmap(text: bytes, bitmap: bytes) -> bytes:
    """The lines of ``text`` that ``bitmap`` keeps, joined by newlines."""
    lines = text.split(b"\n")
    return b"\n".join(compress(lines, unpack(bitmap, len(lines)).tolist()))


def _hashes(least: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            digests, rows, where = [], [], []
            for row, text in enumerate(b.column(1)):
                for pos, line in enumerate(text.as_py().split(b"\n")):
                    if long_enough(key := line_key(line), least):
                        digests.append(xxhash.xxh3_128_digest(key))
                        rows.append(row)
                        where.append(pos)
            h = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
            take = pa.array(rows, pa.int64())
            yield record(("h1", "h2", "id", "th", "pos"), pa.array(h[:, 0]), pa.array(h[:, 1]), b.column(0).take(take), b.column(2).take(take), pa.array(where, pa.int32()))

    return work


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (h1, h2, id, th, pos) in; lines to drop, undecided lines and the ends of the range out."""
    group, keeper, first = None, 0, True
    for b in batches:
        if not b.num_rows:
            continue
        h1, h2, ids = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        start = np.empty(len(h1), dtype=bool)
        start[0] = (h1[0], h2[0]) != group
        start[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        at = np.maximum.accumulate(np.where(start, np.arange(len(h1)), -1))
        least = np.where(at >= 0, ids[np.maximum(at, 0)], keeper)
        kind = np.where(ids != least, DROP, -1)
        if group is None:
            group = (h1[0], h2[0])
            yield _seen(h1[0], h2[0], ids[0])
            start[0] = False
        if first:
            starts = np.flatnonzero(start)
            kind[: starts[0] if len(starts) else len(kind)] = UNDECIDED
            first = not len(starts)
        group, keeper = (h1[-1], h2[-1]), least[-1]
        out = np.flatnonzero(kind >= 0)
        yield record(FIELDS, pa.array(kind[out].astype(np.int32)), *(b.column(i).take(pa.array(out)) for i in range(5)))
    if group is not None:
        yield _seen(*group, keeper)


def _seen(h1: int, h2: int, least: int) -> pa.RecordBatch:
    one = lambda v, t: pa.array([int(v)], t)
    return record(FIELDS, one(SEEN, pa.int32()), one(h1, pa.int64()), one(h2, pa.int64()), one(least, pa.int64()), one(0, pa.int64()), one(TaskContext.get().partitionId(), pa.int32()))


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, scratch: Scratch | None = None) -> DataFrame:
    """``(id, th, drops)``: the sorted positions that each (id, text) loses; rows that lose none are absent."""
    scratch = scratch or Scratch(docs.sparkSession, "lines")
    lines = scratch.put(keyed(docs, id_col, text_col).mapInArrow(_hashes(least), "h1 long, h2 long, id long, th long, pos int"), "lines")
    order = ("h1", "h2", "id", "th", "pos")
    ranged = lines.repartitionByRange(partitions(docs.sparkSession), *order).sortWithinPartitions(*order)
    decided = scratch.put(ranged.mapInArrow(_stream, SCHEMA), "decided")
    scratch.drop("lines")
    # two rows a task of the streaming step: bounded by the number of partitions
    ends = F.broadcast(decided.where(F.col("kind") == SEEN).groupBy("h1", "h2").agg(F.min("id").alias("least")))
    settled = decided.where(F.col("kind") == UNDECIDED).join(ends, ["h1", "h2"]).where("id <> least").select("id", "th", "pos")
    drops = decided.where(F.col("kind") == DROP).select("id", "th", "pos").unionByName(settled)
    return drops.groupBy("id", "th").agg(F.array_sort(F.collect_set("pos")).alias("drops"))


def _bitmaps(digest: bool):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, 1):
                n_lines, n_dropped, maps, digests = [], [], [], []
                for text, drops in zip(b.column(1), b.column(2), strict=True):
                    text = text.as_py()
                    keep = np.ones(text.count(b"\n") + 1, dtype=bool)
                    keep[drops.as_py() or []] = False
                    n_lines.append(len(keep))
                    n_dropped.append(len(keep) - int(keep.sum()))
                    maps.append(pack(keep))
                    if digest:
                        digests.append(hashlib.sha256(apply_bitmap(text, maps[-1])).hexdigest())
                yield record(NAMES[: 4 + digest], b.column(0), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(maps, pa.binary()), *([pa.array(digests, pa.string())] if digest else []))

    return work


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, digest: bool = False) -> DataFrame:
    """``(id, n_lines, n_dropped, bitmap)`` of every row; with ``digest`` also ``kept_sha256`` of the text that
    ``apply_bitmap`` leaves."""
    drops = dropped_lines(docs, id_col, text_col, least)
    rows = keyed(docs, id_col, text_col).join(drops, ["id", "th"], "left").select("id", "text", "drops")
    return rows.mapInArrow(_bitmaps(digest), "id long, n_lines long, n_dropped long, bitmap binary" + ", kept_sha256 string" * digest).withColumn("id", id_of())


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """``docs``, all columns, with the dropped lines cut from ``text_col``; a null text stays null."""
    names = unused(docs, "id", "th", "drops")
    drops = dropped_lines(docs, id_col, text_col, least).toDF(*names)
    joined = docs.withColumns({names[0]: key_of(docs, id_col), names[1]: hash_of(docs, text_col)}).join(drops, names[:2], "left")
    text, gone = quoted(text_col), F.col(names[2])
    kept = F.when(gone.isNull(), text).otherwise(_without(text.cast("binary"), gone).cast("string")).alias(text_col)
    return joined.select(*(kept if c == text_col else quoted(c) for c in docs.columns))


@F.pandas_udf(T.BinaryType())
def _without(text, drops):
    import pandas as pd

    def one(t, d):
        if t is None or d is None:
            return t
        keep = np.ones(t.count(b"\n") + 1, dtype=bool)
        keep[d] = False
        return apply_bitmap(t, pack(keep))

    return pd.Series([one(t, d) for t, d in zip(text, drops, strict=True)], dtype=object)
