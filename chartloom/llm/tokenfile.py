"""Token-id files: texts encoded, laid down in ascending id order as Simple-8b blocks, and read back.

Documents are dealt by ranges of (id, hash of the text, place in the input) and sorted, so part k of the file holds
no larger ids than part k + 1 and one id that many rows have is spread over parts; each task encodes its texts in order and closes a block at ``IDS`` ids. A block is a row of the table that
Spark's own writer commits: part, block, ids of the part before it, ids in it, the documents' ids and the
payload of ``simple8b``. So a lost executor's task is simply run again, and any store that Spark writes to
will do. Where a document starts in the whole file follows from the parts' totals, one number a part.

Edge cases: a null or empty text has the end id alone. A null id sorts first and is null again when read.
Repeated ids follow each other, ordered by
a hash of the text. An empty table gives an empty file. A document longer than
a block gets a block of its own. Malformed UTF-8 is replaced by U+FFFD.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import simple8b
from .common import id_of, keyed, partitions, record, slices
from .parts import MOST, Runs, Words, gather, starts

#: Ids at which a block is closed, and the id after each document.
IDS, END = 1 << 16, 0
#: Words that the library encodes as one text.
MANY = 200
NAMES = ("part", "block", "before", "n_ids", "ids", "payload")
SCHEMA = "part int, block int, before long, n_ids long, ids array<long>, payload binary"


class Encoder:
    """A tokenizers file whose byte-level pattern lets words be encoded apart."""

    def __init__(self, path: str, most: int = MOST):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        size = self.library.get_vocab_size()
        self.kind = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.begins = np.zeros(size, dtype=bool)  # tokens that begin with a space
        for token, i in self.library.get_vocab().items():
            self.begins[i] = token.startswith("Ġ")
        self.newline = self.library.get_vocab()["Ċ"]
        special = tuple(str(t.content) for t in self.library.get_added_tokens_decoder().values())
        self.words = Words(self.resolve, self.kind, most, special)

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, dtype=self.kind) for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _each(self, strings: list[str]) -> Runs:
        got = self._ids(strings)
        return np.array([len(g) for g in got], dtype=np.int64), np.concatenate([np.empty(0, self.kind), *got])

    def _many(self, words: list[str], spaced: bool) -> Runs:
        """The ids of words, of many encoded as one text: after the spaces they begin with, or on lines."""
        sizes, flat = [], []
        runs = [words[i : i + MANY] for i in range(0, len(words), MANY)]
        joined = ["".join(r) if spaced else "\n".join([*r, ""]) for r in runs]
        for run, text, ids in zip(runs, joined, self._ids(joined), strict=True):
            cuts = np.flatnonzero(self.begins[ids] if spaced else ids == self.newline)
            if len(cuts) != len(run) or len(text.split()) != len(run):  # some word has white space of its own
                size, ids = self._each(run)
            elif spaced:
                size = np.diff(cuts, append=len(ids))
            else:
                size, ids = np.diff(cuts, prepend=-1) - 1, np.delete(ids, cuts)
            sizes.append(size)
            flat.append(ids)
        return np.concatenate([np.empty(0, np.int64), *sizes]), np.concatenate([np.empty(0, self.kind), *flat])

    def resolve(self, asked: list[str]) -> Runs:
        """The ids of each string. Words with a space in front follow each other; those without stand on lines."""
        kinds = [0 if w[:1] == " " and len(w) > 1 and " " not in w[1:] else 1 if w and " " not in w and not w[0].isspace() else 2 for w in asked]
        where = [[i for i, k in enumerate(kinds) if k == kind] for kind in range(3)]
        spaced, bare, rest = ([asked[i] for i in at] for at in where)
        sizes, flats = zip(self._many(spaced, True), self._many(bare, False), self._each(rest), strict=True)
        size, at = np.concatenate(sizes), np.empty(len(asked), dtype=np.int64)
        at[np.concatenate([np.array(x, dtype=np.int64) for x in where])] = np.arange(len(asked))
        return size[at], gather(starts(size)[at], size[at], np.concatenate(flats))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        size, ids = self.words.texts(texts)
        return np.split(ids, np.cumsum(size)[:-1]) if texts else []


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def write(docs: DataFrame, tokenizer: str, path: str, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode ``docs`` and write the file at ``path``, a folder that all executors share."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, part = encoder(tokenizer), TaskContext.get().partitionId()
        tail = np.array([end], dtype=e.kind)
        held, keys, count, before, number = [], [], 0, 0, 0

        def close() -> pa.RecordBatch:
            ends = np.cumsum([len(x) for x in held[::2]]) + np.arange(1, len(keys) + 1)
            row = (part, number, before, count, keys, simple8b.block(np.concatenate(held), ends))
            return record(NAMES, *(pa.array([v], t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()), strict=True)))

        for whole in batches:
            for b in slices(whole, 1):
                for key, ids in zip(b.column(0).to_pylist(), e.encode([t.decode("utf-8", "replace") for t in b.column(1).to_pylist()]), strict=True):
                    if held and count + len(ids) >= IDS:
                        yield close()
                        held, keys, before, count, number = [], [], before + count, 0, number + 1
                    held += [ids, tail]
                    keys.append(key)
                    count += len(ids) + 1
        if held:
            yield close()

    # rows of one id, or without any, are told apart by their text, and equal rows by their place in the input
    rows = keyed(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id())
    order = ("id", "th", "row")
    ranged = rows.repartitionByRange(partitions(docs.sparkSession), *order).sortWithinPartitions(*order).select("id", "text")
    ranged.mapInArrow(work, SCHEMA).write.option("compression", "none").mode("overwrite").parquet(path)


def read(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """``(id, start, n_tokens, ids_crc32)`` of every document of the file; with ``with_ids`` also ``ids``."""
    file = spark.read.schema(SCHEMA).parquet(path)
    totals = sorted(file.groupBy("part").agg(F.sum("n_ids")).collect())  # one row a part
    bases = np.cumsum([0] + [n for _, n in totals]).tolist()
    starts = spark.createDataFrame([(p, b) for (p, _), b in zip(totals, bases, strict=False)], "part int, base long")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                base, keys, payload = (b.column(i)[row] for i in range(3))
                ids, ends = simple8b.parse(payload.as_py())
                begins = np.concatenate([[0], ends[:-1]])
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * z]) for a, z in zip(begins.tolist(), ends.tolist(), strict=True)]
                more = [pa.ListArray.from_arrays(pa.array(np.append(begins, ends[-1]), pa.int32()), pa.array(ids.astype(np.int64)))] if with_ids else []
                yield record(names, keys.values, pa.array(begins + base.as_py()), pa.array(ends - begins), pa.array(crc, pa.int64()), *more)

    names = ["id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids
    rows = file.join(F.broadcast(starts), "part").select((F.col("base") + F.col("before")).alias("base"), "ids", "payload")
    return rows.mapInArrow(work, "id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids).withColumn("id", id_of())
