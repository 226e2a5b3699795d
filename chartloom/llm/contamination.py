"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

Texts are lower-cased (A-Z), cut at ASCII white space and shingled by five words. A test item is found in a
document that holds ``THRESHOLD`` or more of the item's distinct shingles, wherever they stand. Items are
partitioned by their number of shingles; an item's MinHash signature is its k least shingle hashes, with k
one more than the shingles that an item of its partition's largest size may lack. So a document that holds
enough of an item holds one of its signature's shingles at least, however long the document is: the search
has no false negatives, and candidates are verified by the shingles themselves, not by hashes.

Items go to the documents in blocks of bounded bytes, one pass over the documents a block; documents are
never shuffled, and an item that a third of them hold costs one row for each. With more than one block each
pass is written before the next begins, so the driver and the workers hold one block at a time.

Edge cases: a null or empty document or item has no shingle and is in no pair. An item of fewer words than
a shingle is one shingle of all its words. Null ids stay null; repeated rows each have their pairs. Empty
tables give an empty result. Texts of any length are searched whole, in memory that grows with their length.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, id_of, record, slices, texts

SHINGLE, THRESHOLD = 5, 0.8
#: Bytes of items' texts in a block, words remembered by a worker, bytes of the longest of them.
BLOCK, WORDS, LONGEST = 8 << 20, 200_000, 64
_BASE = np.uint64(0x9E3779B97F4A7C15)
_FIELDS = ("id", "item_id", "n_shingles", "n_shared", "containment")
SCHEMA = "id long, item_id long, n_shingles long, n_shared long, containment double"


class _Hashes(dict):
    """Hash of each word met."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(word) <= LONGEST:  # so what is held is bounded in bytes, too
            if len(self) >= WORDS:
                self.clear()
            self[word] = h
        return h


_HASHES = _Hashes()


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()  # on bytes both know ASCII only


def rolling(words: list[bytes], n: int) -> np.ndarray:
    """Hash of each window of ``n`` words."""
    x = np.fromiter(map(_HASHES.__getitem__, words), dtype=np.uint64, count=len(words))
    h = x[: max(0, len(x) - n + 1)].copy()
    for k in range(1, n):
        h = h * _BASE + x[k : len(x) - n + 1 + k]
    return h ^ (h >> np.uint64(31))


def partition_size(n: int) -> int:
    """The largest size in the partition of items of ``n`` shingles."""
    return 1 << (n - 1).bit_length()


def least_shared(n: int, threshold: float) -> int:
    return max(1, ceil(threshold * n - 1e-9))


class Search:
    """The signatures of one block of items."""

    def __init__(self, items: list[tuple[int, bytes]], n: int, threshold: float):
        self.n, self.items, self.lengths = n, [], {}
        found: dict[int, dict[int, list[int]]] = {}  # words in a shingle -> hash -> items
        for key, text in items:
            words = words_of(text)
            length = min(n, len(words))
            if not length:
                continue
            hashes = rolling(words, length)
            shingles = {b" ".join(words[i : i + length]) for i in range(len(hashes))}
            distinct = np.unique(hashes)
            size = len(shingles)
            top = partition_size(size)
            k = top - least_shared(top, threshold) + 1
            for h in distinct[:k].tolist():
                found.setdefault(length, {}).setdefault(h, []).append(len(self.items))
            self.items.append((key, length, shingles, distinct, least_shared(size, threshold)))
        for length, by_hash in found.items():
            keys = np.array(sorted(by_hash), dtype=np.uint64)
            seen = np.zeros(1 << 16, dtype=bool)
            seen[(keys & np.uint64(0xFFFF)).astype(np.int64)] = True
            self.lengths[length] = (keys, seen, by_hash)

    def pairs(self, text: bytes) -> Iterator[tuple[int, int, int]]:
        """``(item, its shingles, those shared)`` of each item found in a text."""
        words = words_of(text)
        for length, (keys, seen, by_hash) in self.lengths.items():
            hashes = rolling(words, length)
            near = np.unique(hashes[seen[(hashes & np.uint64(0xFFFF)).astype(np.int64)]])
            near = near[keys[np.minimum(np.searchsorted(keys, near), len(keys) - 1)] == near]
            for i in sorted({i for h in near.tolist() for i in by_hash[h]}):
                key, _, shingles, distinct, least = self.items[i]
                at = np.flatnonzero(np.isin(hashes, distinct))
                shared = len({b" ".join(words[p : p + length]) for p in at.tolist()} & shingles)
                if shared >= least:
                    yield key, len(shingles), shared


def _blocks(spark, items: DataFrame, block: int) -> Iterator:
    """Broadcasts of (id, text) of all items, about ``block`` bytes each; each goes as the next one comes."""
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-size // block))
    for k in range(n):
        chosen = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k) if n > 1 else items
        sent = spark.sparkContext.broadcast([(r.id, bytes(r.text)) for r in chosen.collect()])
        yield sent, n == 1
        if n > 1:
            sent.destroy()


def matches(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", n: int = SHINGLE, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """``(id, item_id, n_shingles, n_shared, containment)`` of each item that a document holds."""
    spark = docs.sparkSession
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0, and 1 at most")
    documents, scratch, out = texts(docs, id_col, text_col), Scratch(spark, "contamination"), None
    for k, (sent, alone) in enumerate(_blocks(spark, texts(items, item_col, item_text), block)):

        def work(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            search = Search(sent.value, n, threshold)
            for whole in batches:
                for b in slices(whole, 1):
                    got = [(key, *p) for key, t in zip(b.column(0).to_pylist(), b.column(1), strict=True) for p in search.pairs(t.as_py())]
                    cols = [pa.array([g[i] for g in got], pa.int64()) for i in range(4)]
                    yield record(_FIELDS, *cols, pa.array([g[3] / g[2] for g in got], pa.float64()))

        part = documents.mapInArrow(work, SCHEMA)
        part = part if alone else scratch.put(part, f"block-{k}")
        out = part if out is None else out.unionByName(part)
    return out.select(id_of().alias("id"), id_of("item_id").alias("item_id"), *_FIELDS[2:])


def keep_clean(docs: DataFrame, items: DataFrame, text_col: str = "text", item_text: str = "text", n: int = SHINGLE, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no item."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "clean")
    for k, (sent, alone) in enumerate(_blocks(spark, texts(items, "item_id", item_text), block)):
        docs = docs.where(~_holds(sent, n, threshold)(F.coalesce(docs[text_col].cast("binary"), F.lit(b""))))
        if not alone:
            docs = scratch.put(docs, f"block-{k}")
            scratch.drop(f"block-{k - 1}")
    return docs


def _holds(sent, n: int, threshold: float):
    made: list[Search] = []

    @F.pandas_udf(T.BooleanType())
    def holds(text):
        import pandas as pd

        if not made:
            made.append(Search(sent.value, n, threshold))
        return pd.Series([next(made[0].pairs(t), None) is not None for t in text], dtype=bool)

    return holds
