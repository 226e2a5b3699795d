"""Removal of long repeated substrings: sampled q-gram buckets, then bucket-pointer refinement.

A byte goes if some string of ``LENGTH`` bytes that covers it also starts anywhere else. To find those
strings without sorting all suffixes:

1. Sampling. The hash of each q-gram is built by doubling from single bytes. A string's *pointer* is the
   least q-gram hash in it, so equal strings have equal pointers, and neighbouring strings mostly share
   one: a run of strings with one pointer is a row (pointer, digest of the run's bytes, place), about one
   for each 70 bytes.
2. Buckets. Rows are counted by pointer, combined before the shuffle. A pointer met once is finished. If
   all runs of a pointer hold the same bytes, all their strings are repeated, and they are finished too.
3. Refinement. The distinct runs of the other pointers are fetched (one place each) and brought together
   by pointer. In a task, initial buckets of 8-grams are refined by sorting on the bucket identifiers 8
   bytes on, then 16, 32, 64 and at last 72 bytes on, each round reusing the identifiers that the round
   before gave. Buckets of one are finished and leave. What shares a bucket at ``LENGTH`` bytes is repeated;
   this compares bytes, not hashes.
4. A pointer with over ``GROUP`` distinct runs (the edge of a passage that many documents share) is dealt
   over several tasks; each passes on one digest for each of its strings, and those met by two tasks are
   repeated too.

Places come back by document and mark the bytes to remove. Every table that a later step reads again is
written to the shared folder. Rows carry 64-bit pointers and digests; a digest only stands for bytes
within one pointer's runs, and the digests of step 4 have 128 bits.

Edge cases: null, empty and short texts lose nothing. A string that overlaps itself counts, as do
repeated rows of an id (they are further places). Null ids stay null. Texts of any length are worked on in
overlapping blocks. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, id_of, keyed, partitions, record

LENGTH, GRAM = 200, 64
#: Bytes hashed at once; distinct runs of a pointer in a task; runs refined at once.
BLOCK, GROUP, BATCH = 1 << 19, 2000, 4000
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_BYTES = np.array([xxhash.xxh64_intdigest(bytes([i]), 1) for i in range(256)], dtype=np.uint64)
_S32 = np.uint64(32)


def gram_hashes(data: np.ndarray, q: int = GRAM) -> np.ndarray:
    """A hash of the ``q`` bytes (a power of two) from each place on."""
    h, k = _BYTES[data], 1
    while k < q:
        a = h[:-k] * _A
        a += h[k:]
        a ^= a >> _S32
        a *= _B
        h, k = a, 2 * k
    return h


def sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    """The least of the ``width`` values from each place on."""
    k = 1
    while 2 * k <= width:
        h, k = np.minimum(h[:-k], h[k:]), 2 * k
    return np.minimum(h[: len(h) - (width - k)], h[width - k :]) if k < width else h


def runs(data: np.ndarray, ends: np.ndarray, length: int, q: int) -> tuple[np.ndarray, ...]:
    """``(pointer, start, strings, doubled)`` of each run in the joined bytes of texts that end at ``ends``.

    ``doubled``: the pointer is found twice in the run, so two of its own strings might be equal.
    """
    width = length - q + 1
    hashes = gram_hashes(data, q)
    least = sliding_min(hashes, width)
    n = len(least)
    owner = np.searchsorted(ends, np.arange(n), side="right")
    valid = np.arange(n) + length <= ends[owner]
    cut = np.ones(n, dtype=bool)
    cut[1:] = (least[1:] != least[:-1]) | (owner[1:] != owner[:-1])
    start = np.flatnonzero(cut)
    size = np.diff(np.append(start, n))
    if (size > width).any():  # a run that periodic text makes long is cut every ``width`` strings
        parts = -(-size // width)
        base = np.repeat(start, parts)
        nth = np.arange(len(base)) - np.repeat(np.cumsum(parts) - parts, parts)
        start = base + nth * width
        size = np.diff(np.append(start, n))
    kept = np.add.reduceat(valid.astype(np.int64), start)  # the valid strings of a run come first
    start, size = start[kept > 0], kept[kept > 0]
    pointer = least[start]
    run_of = np.repeat(np.arange(len(start)), size + width - 1)
    spot = np.arange(len(run_of)) - np.repeat(np.cumsum(size + width - 1) - (size + width - 1), size + width - 1) + start[run_of]
    found = np.bincount(run_of[hashes[spot] == pointer[run_of]], minlength=len(start))
    return pointer, start, size, found > 1


def _pieces(batch: pa.RecordBatch, length: int) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """Rows, offsets in their texts and bytes, in blocks of about ``BLOCK`` bytes; long texts in overlapping parts."""
    rows, offsets, parts, held = [], [], [], 0
    for row, text in enumerate(batch.column(1)):
        text = text.as_py()
        for at in range(0, max(0, len(text) - length + 1), BLOCK):
            part = text[at : at + BLOCK + length - 1]
            if held and held + len(part) > BLOCK + length:
                yield rows, offsets, parts
                rows, offsets, parts, held = [], [], [], 0
            rows.append(row)
            offsets.append(at)
            parts.append(part)
            held += len(part)
    if parts:
        yield rows, offsets, parts


PLACES = "pointer long, digest long, times int, id long, th long, start int, strings int"


def _places(length: int, q: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, offsets, parts in _pieces(b, length):
                joined = b"".join(parts)
                ends = np.cumsum([len(p) for p in parts])
                pointer, start, size, doubled = runs(np.frombuffer(joined, dtype=np.uint8), ends, length, q)
                if not len(start):
                    continue
                owner = np.searchsorted(ends, start, side="right")
                begin = ends - [len(p) for p in parts]
                digest = [xxhash.xxh3_64_intdigest(joined[s : s + n + length - 1]) for s, n in zip(start.tolist(), size.tolist(), strict=True)]
                take = pa.array(np.array(rows)[owner])
                local = start - begin[owner] + np.array(offsets)[owner]
                yield record(
                    ("pointer", "digest", "times", "id", "th", "start", "strings"),
                    pa.array(pointer.view(np.int64)), pa.array(np.array(digest, dtype=np.uint64).view(np.int64)), pa.array((1 + doubled).astype(np.int32)),
                    b.column(0).take(take), b.column(2).take(take), pa.array(local.astype(np.int32)), pa.array(size.astype(np.int32)),
                )

    return work


def refine(data: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each run of bytes, which of its strings start twice or more among all strings of all runs."""
    sizes = np.array([len(d) for d in data])
    joined = np.frombuffer(b"".join(data) + bytes(8), dtype=np.uint8)
    total = len(joined) - 8
    begin = np.cumsum(sizes) - sizes
    left = np.repeat(begin + sizes, sizes) - np.arange(total)  # bytes up to the run's end
    q = 8
    eight = np.zeros(total, dtype=np.uint64)
    for k in range(8):
        eight |= joined[k : k + total].astype(np.uint64) << np.uint64(8 * k)
    bucket = np.full(total + 1, -1, dtype=np.int64)  # -1: finished, or too near the end
    places = np.flatnonzero(left >= q)
    places, ids = _shared(places, eight[places])
    bucket[places] = ids
    while q < length:
        step = min(q, length - q)
        here = places[left[places] >= q + step]
        after = bucket[here + step]
        here, after = here[after >= 0], after[after >= 0]
        places, ids = _shared(here, bucket[here] * (total + 1) + after)
        bucket = np.full(total + 1, -1, dtype=np.int64)
        bucket[places] = ids
        q += step
    again = bucket[:-1] >= 0
    return [again[b : b + n - length + 1] for b, n in zip(begin.tolist(), sizes.tolist(), strict=True)]


def _shared(places: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places whose key is not theirs alone, and their keys as dense numbers."""
    if not len(places):
        return places, keys.astype(np.int64)
    _, ids, times = np.unique(keys, return_inverse=True, return_counts=True)
    stay = times[ids] > 1
    return places[stay], ids[stay]


FOUND = "pointer long, digest long, strings int, again binary, at int, w1 long, w2 long"
_FOUND = ("pointer", "digest", "strings", "again", "at", "w1", "w2")


def _refined(length: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def done(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            if not rows:
                return
            marks = refine([r[4] for r in rows], length)
            cols = [[r[0] for r in rows], [r[1] for r in rows], [len(m) for m in marks], [np.packbits(m).tobytes() for m in marks], *([None] * len(rows) for _ in range(3))]
            yield record(_FOUND, *(pa.array(c, t) for c, t in zip(cols, _TYPES, strict=True)))
            for r, m in zip(rows, marks, strict=True):
                if r[3] > 1:  # this pointer's runs are dealt over several tasks
                    w = np.frombuffer(b"".join(xxhash.xxh3_128_digest(r[4][i : i + length]) for i in range(len(m))), dtype="<i8").reshape(-1, 2)
                    n = len(w)
                    yield record(_FOUND, pa.array([r[0]] * n), pa.array([r[1]] * n), pa.array([0] * n, pa.int32()), pa.array([None] * n, pa.binary()), pa.array(np.arange(n, dtype=np.int32)), pa.array(w[:, 0]), pa.array(w[:, 1]))

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                # rows are sorted by pointer and part: a batch ends only between two of them
                if len(held) >= BATCH and (held[-1][0], held[-1][2]) != (row[0], row[2]):
                    yield from done(held)
                    held = []
                held.append(row)
        yield from done(held)

    return work


_TYPES = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.int64(), pa.int64())


def _cut_runs(length: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text, wanted in zip(b.column(0), b.column(1), strict=True):
                text, wanted = text.as_py(), wanted.as_py()
                cols = [[w[k] for w in wanted] for k in ("pointer", "digest")]
                cut = [text[w["start"] : w["start"] + w["strings"] + length - 1] for w in wanted]
                yield record(("pointer", "digest", "bytes"), *(pa.array(c, pa.int64()) for c in cols), pa.array(cut, pa.binary()))

    return work


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, q: int = GRAM, scratch: Scratch | None = None) -> DataFrame:
    """``(id, th, spans)``: for each (id, text) the runs ``(start, strings, again)`` that hold a repeated string.

    ``again`` is a bitmap of the run's strings, null if all are repeated.
    """
    if q & (q - 1) or not 8 <= q <= length:
        raise ValueError("q must be a power of two, from 8 to the length")
    scratch = scratch or Scratch(docs.sparkSession, "substrings")
    rows = keyed(docs, id_col, text_col)
    places = scratch.put(rows.mapInArrow(_places(length, q), PLACES), "places")
    of_pointer = places.groupBy("pointer").agg(F.sum("times").alias("n"), (F.min("digest") != F.max("digest")).alias("mixed"), F.max("times").alias("most"))
    shared = scratch.put(of_pointer.where("n > 1").select("pointer", (F.col("mixed") | (F.col("n") == F.col("most"))).alias("mixed")), "shared")
    met = scratch.put(places.join(shared, "pointer").select("pointer", "digest", "id", "th", "start", "strings", "mixed"), "met")
    scratch.drop("places", "shared")
    mixed = met.where("mixed")
    distinct = scratch.put(mixed.groupBy("pointer", "digest").agg(F.count("*").alias("n"), F.min(F.struct("id", "th", "start", "strings")).alias("first")), "distinct")
    groups = scratch.put(distinct.groupBy("pointer").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("parts")), "groups")
    wanted = distinct.groupBy(F.col("first.id").alias("id"), F.col("first.th").alias("th")).agg(F.collect_list(F.struct("pointer", "digest", "first.start", "first.strings")).alias("wanted"))
    # a text that is found on several rows is cut once
    cut = rows.join(wanted, ["id", "th"]).select("text", "wanted").mapInArrow(_cut_runs(length), "pointer long, digest long, bytes binary")
    bytes_of = scratch.put(cut, "bytes").dropDuplicates(["pointer", "digest"])
    dealt = bytes_of.join(groups, "pointer").select("pointer", "digest", F.pmod("digest", "parts").cast("int").alias("part"), "parts", "bytes")
    sorted_runs = dealt.repartition(partitions(docs.sparkSession), "pointer", "part").sortWithinPartitions("pointer", "part")
    found = scratch.put(sorted_runs.mapInArrow(_refined(length), FOUND), "found")
    scratch.drop("bytes", "groups")
    strings = found.where("at IS NOT NULL")
    twice = strings.groupBy("w1", "w2").agg(F.count("*").alias("n")).where("n > 1").select("w1", "w2")
    across = strings.join(twice, ["w1", "w2"]).groupBy("pointer", "digest").agg(F.collect_list("at").alias("more"))
    marks = scratch.put(found.where("at IS NULL").select("pointer", "digest", "again").join(across, ["pointer", "digest"], "left"), "marks")
    often = distinct.select("pointer", "digest", (F.col("n") > 1).alias("whole"))
    verdicts = scratch.put(often.join(marks, ["pointer", "digest"]), "verdicts")
    some = mixed.join(verdicts, ["pointer", "digest"]).select("id", "th", "start", "strings", F.when(~F.col("whole"), F.col("again")).alias("again"), F.when(~F.col("whole"), F.col("more")).alias("more"))
    none = F.lit(None)
    whole = met.where(~F.col("mixed")).select("id", "th", "start", "strings", none.cast("binary").alias("again"), none.cast("array<int>").alias("more"))
    return whole.unionByName(some).groupBy("id", "th").agg(F.collect_set(F.struct("start", "strings", "again", "more")).alias("spans"))


def removed(n: int, spans: list[dict] | None, length: int = LENGTH) -> np.ndarray:
    """Which of a text's ``n`` bytes go."""
    edge = np.zeros(n + 1, dtype=np.int64)
    for s in spans or ():
        if s["again"] is None:
            edge[s["start"]] += 1
            edge[s["start"] + s["strings"] + length - 1] -= 1
            continue
        again = np.unpackbits(np.frombuffer(s["again"], dtype=np.uint8), count=s["strings"]).astype(bool)
        again[s["more"] or []] = True
        at = s["start"] + np.flatnonzero(again)
        edge[at] += 1
        edge[at + length] -= 1
    return np.cumsum(edge[:-1]) > 0


def remove_repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, q: int = GRAM, keep: bool = False) -> DataFrame:
    """``(id, n_bytes, n_removed, n_spans, kept_sha256)`` of every row; with ``keep`` also ``kept``, the bytes that stay."""
    spans = repeated(docs, id_col, text_col, length, q)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in range(4 + keep)]
            for text, marks in zip(b.column(1), b.column(2), strict=True):
                text = text.as_py()
                gone = removed(len(text), marks.as_py(), length)
                kept = np.frombuffer(text, dtype=np.uint8)[~gone].tobytes()
                row = (len(text), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum() + gone[:1].sum()), hashlib.sha256(kept).hexdigest(), kept)
                for c, v in zip(out, row, strict=False):
                    c.append(v)
            yield record(names, b.column(0), *(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3], pa.string()), *([pa.array(out[4], pa.binary())] if keep else []))

    names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * keep
    rows = keyed(docs, id_col, text_col).join(spans, ["id", "th"], "left").select("id", "text", "spans")
    return rows.mapInArrow(work, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep).withColumn("id", id_of())
