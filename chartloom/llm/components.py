"""Connected components of a large graph of long-valued nodes, by alternating stars.

Each round runs a large-star and a small-star step (Kiveris et al., "Connected Components in MapReduce and
Beyond"): a node's larger neighbours, then its smaller ones, are hooked to the least node it knows. The
least neighbour is a ``min`` that Spark combines before the shuffle and that is written before it is joined
back, so both sides of the join are plain exchanges that adaptive execution may split at a hub. No node's
neighbours are ever gathered in one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _star(edges: DataFrame, large: bool, scratch: Scratch, name: str) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = both if large else both.where("v < u")
    least = scratch.put(near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), f"{name}-least")
    moved = (both.where("v > u") if large else near).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        moved = moved.unionByName(least.select("u", F.col("m").alias("v")))
    return scratch.put(moved.where("u <> v").distinct(), name)


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``(node, root)`` for each node that has an edge; ``root`` is the least node of its component.

    ``edges`` has long columns ``u`` and ``v``; loops, repeated edges and either direction are allowed. An
    empty table of edges gives an empty result.
    """
    edges = scratch.put(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges-0")
    before, i, last = None, 0, "edges-0"
    while True:
        i += 1
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
        large = _star(edges, True, scratch, f"large-{i}")
        edges = _star(large, False, scratch, f"edges-{i}")
        scratch.drop(last, f"large-{i}", f"large-{i}-least", f"edges-{i}-least")
        last = f"edges-{i}"
    # at the fixed point every node hangs from the least node of its component
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
