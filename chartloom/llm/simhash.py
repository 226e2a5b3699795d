"""SimHash near-duplicates by multi-index hashing.

A text's fingerprint has a bit where over half of its shingles' XXH64 values have it. Texts with the same
fingerprint are collapsed first, so a group of copies costs one row. To find fingerprints that differ in at
most ``distance`` bits, each is cut into ``segments`` parts: at least one part differs in at most
``distance // segments`` bits. Every fingerprint is therefore stored once per part and probes with the
small Hamming ball around each of its parts; whole distances are verified inside the join, so its output
is links, not candidates. A task passes on those of its links that join what it has not seen joined yet, so a
cluster of near copies costs a number of links that grows with its fingerprints, not with their pairs.

Edge cases: a null or empty text has no shingle and fingerprint zero, linked like any other; fewer words
than a shingle make one shingle of all words; repeated rows share a fingerprint. A null id takes part and
stays null; a component's id is its least id that is not null. An empty table gives an empty result. Texts of
any length are read whole, their shingles in runs of bounded length. Ties do not arise: a bit with exactly half
of the shingles is not set, and a group's first row by (id, hash of the text) is the one that ``keep_one`` keeps.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, Scratch, hash_of, id_of, key_of, keyed, quoted, record, signed, unused
from .components import components

SHINGLE, SEED, DISTANCE, SEGMENTS = 3, 42, 3, 2
#: Shingles whose bits are held at once; longer texts are summed in runs of this many.
RUN = 1 << 16
#: Fingerprints that a task remembers while it passes on links; parts of a hot (id, text).
NODES, SALTS = 1 << 18, 64


def fingerprint(text: bytes, n: int = SHINGLE, seed: int = SEED) -> int:
    """The unsigned 64-bit fingerprint of one text."""
    words = text.lower().split()  # on bytes both know ASCII only: A-Z, and the six white-space bytes
    if not words:
        return 0
    shingles = zip(*(words[i:] for i in range(n)), strict=False) if len(words) >= n else [words]
    hashes = np.fromiter((xxhash.xxh64_intdigest(b" ".join(s), seed) for s in shingles), dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), RUN):
        ones += np.unpackbits(hashes[i : i + RUN].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = SHINGLE) -> DataFrame:
    """``(id, th, fp)`` of every row; ``fp`` is the fingerprint as a signed long."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = pa.array([signed(fingerprint(t.as_py(), n)) for t in b.column(1)], pa.int64())
            yield record(("id", "th", "fp"), b.column(0), b.column(2), fps)

    return keyed(docs, id_col, text_col).mapInArrow(work, "id long, th long, fp long")


def ball(width: int, radius: int) -> list[int]:
    """Masks of all numbers of ``width`` bits with at most ``radius`` bits set."""
    return [sum(1 << i for i in bits) for k in range(radius + 1) for bits in combinations(range(width), k)]


def links(fps: DataFrame, distance: int = DISTANCE, segments: int = SEGMENTS) -> DataFrame:
    """Pairs ``(u, v)``, u < v, of the distinct longs in ``fps.fp`` that differ in 1 to ``distance`` bits.

    A pair appears once for each segment that finds it.
    """
    edges = [64 * i // segments for i in range(segments + 1)]
    if max(comb(b - a, distance // segments) for a, b in zip(edges, edges[1:], strict=False)) > 1 << 16:
        raise ValueError("more segments are needed for this distance")
    part = [F.shiftrightunsigned("fp", a).bitwiseAND((1 << (b - a)) - 1) if segments > 1 else F.col("fp") for a, b in zip(edges, edges[1:], strict=False)]
    stored = fps.select(F.col("fp").alias("v"), F.posexplode(F.array(*part)).alias("segment", "part"))

    def around(p: Column, width: int) -> Column:
        return F.transform(F.array(*(F.lit(signed(m)).cast("long") for m in ball(width, distance // segments))), lambda m: p.bitwiseXOR(m))

    probes = F.array(*(around(p, b - a) for p, a, b in zip(part, edges, edges[1:], strict=False)))
    probing = fps.select(F.col("fp").alias("u"), F.posexplode(probes).alias("segment", "near")).select("u", "segment", F.explode("near").alias("part"))
    near = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= distance
    return probing.join(stored, (probing.segment == stored.segment) & (probing.part == stored.part) & (F.col("u") < F.col("v")) & near).select("u", "v")


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links that join what the links before them left apart: they connect the same nodes as all links."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while (up := parent[x]) != top:
            parent[x], x = top, up
        return top

    for b in batches:
        keep = []
        for u, v in zip(*(c.to_pylist() for c in b.columns), strict=True):
            a, z = root(u), root(v)
            keep.append(a != z)
            parent[a] = z
        yield b.filter(pa.array(keep, pa.bool_()))
        if len(parent) > NODES:  # passing on more links than needed does no harm
            parent.clear()


def _grouped(rows: DataFrame, scratch: Scratch, distance: int, segments: int) -> DataFrame:
    """``(fp, component_id, root)`` of each fingerprint."""
    classes = scratch.put(rows.groupBy("fp").agg(F.min(id_of()).alias("least")), "classes")
    linked = scratch.put(links(classes.select("fp"), distance, segments).mapInArrow(_forest, "u long, v long"), "links")
    member = classes.join(components(linked, scratch), F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    of_root = member.groupBy("root").agg(F.min("least").alias("component_id"))
    return scratch.put(member.join(of_root, "root").select("fp", "component_id", "root"), "components")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = SHINGLE, distance: int = DISTANCE, segments: int = SEGMENTS) -> DataFrame:
    """``(id, fp, component_id)`` of every row: the least id reachable over links between fingerprints."""
    scratch = Scratch(docs.sparkSession, "simhash")
    rows = scratch.put(fingerprints(docs, id_col, text_col, n).drop("th"), "rows")
    return rows.join(_grouped(rows, scratch, distance, segments), "fp").select(id_of().alias("id"), "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = SHINGLE, distance: int = DISTANCE, segments: int = SEGMENTS) -> DataFrame:
    """One row of ``docs``, all columns, of each group of near-duplicates: that of the least id.

    A row without an id is kept only where its group has no other. Of rows that share id and text any one may stay.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    rows = scratch.put(fingerprints(docs, id_col, text_col, n), "rows")
    group = _grouped(rows, scratch, distance, segments).select("fp", "root")
    distinct = rows.groupBy("fp", "id", "th").agg(F.count("*").alias("n"))
    first = F.min(F.struct((F.col("id") == F.lit(NULL_ID)).alias("unnamed"), "id", "th", "n")).alias("first")
    kept = scratch.put(distinct.join(group, "fp").groupBy("root").agg(first).select("first.*"), "kept")
    names = unused(docs, "id", "th", "salt")
    keyed_docs = docs.withColumns({names[0]: key_of(docs, id_col), names[1]: hash_of(docs, text_col)})
    out = keyed_docs.join(kept.where("n = 1").select(F.col("id").alias(names[0]), F.col("th").alias(names[1])), names[:2], "left_semi").select(*map(quoted, docs.columns))
    again = kept.where("n > 1")
    if again.isEmpty():
        return out
    # copies under one id, however many, are dealt by their place in the input before one of them is taken
    dealt = keyed_docs.withColumn(names[2], F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    salted = again.select(F.col("id").alias(names[0]), F.col("th").alias(names[1]), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias(names[2]))
    row = F.struct(*map(quoted, docs.columns)).alias("row")
    few = dealt.join(salted, names, "left_semi").groupBy(*names).agg(F.first(row).alias("row"))
    return out.unionByName(few.groupBy(*names[:2]).agg(F.first("row").alias("row")).select("row.*"))
