"""Connected components by alternating large and small stars (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from mailsieve.functions.shared import buckets, cut, drop

MOST_ROUNDS = 60
EDGES_PER_FILE = 200_000


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` of every node of ``edges(a, b)``: the smallest node it reaches.

    Neighbours are never gathered: a node's smallest one is a min that is combined before the
    shuffle, so a node with very many links is no hot group.  Each round is cut.
    """
    pairs = edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    now = cut(pairs.distinct(), "edges")
    state = _state(now)
    for _ in range(MOST_ROUNDS):
        files = buckets(state[0], EDGES_PER_FILE)  # few edges in many files would cost more to open than to read
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut(large.distinct().coalesce(files), "large")
        root = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(root, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = cut(small.unionByName(root.select("u", F.col("m").alias("v"))).distinct().coalesce(files), "edges")
        then = _state(after)
        drop(large)
        drop(now)
        now = after
        if then == state:
            break
        state = then
    else:
        raise RuntimeError("components did not settle")
    roots = now.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
