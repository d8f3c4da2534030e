"""A Merkle manifest of a table as a content-addressed DAG, and proofs read by descent.

Every group's rows, in order, are the leaves of a binary tree; the groups' tops are the leaves
of one more tree, whose top is the root.  The store keeps records ``digest -> children``: one
for each block of up to 2^8 consecutive nodes, filed by its height in steps of 8 levels, and
equal subtrees are one record.  A request is a leaf's place in its group.  Requests go down
from the root together, one record at a time: the next eight bits of the place choose the
child, the children not chosen on the way are noted, and at the leaf what was noted is turned
round.  A record is read once for all requests below it, so the root is no hot key, and the
number of joins is the logarithm of the rows to the base 256.

Digests are lower-case hex SHA-256; a node's is that of its children's hex texts, joined.
Everything is a Spark built-in function.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from mailsieve.functions.shared import cut

BITS = 8  # levels in one record
_ROWS = (1 << 33) - 1  # a monotonically increasing id holds the row's place in its partition here
STEP = "array<struct<left:string,right:string>>"


def digest_of(*columns: Column) -> Column:
    """Digest of fields: ``-`` for null, else the UTF-8 byte count, ``:`` and the value."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def group_key(column: Column) -> Column:
    """A text that sorts null first and then bytewise."""
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit(""))


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows(tree, ...)`` with ``rank``, the place in the tree, and ``n``, the tree's size.

    Rows are sorted by ranges, so a tree of any size is spread; equal rows are told apart by
    where they lie in the table.  Offsets come from one count a partition.
    """
    at = rows.withColumn("_tie", F.monotonically_increasing_id())
    keys = ["tree", *order, "_tie"]
    placed = cut(at.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_id", F.monotonically_increasing_id()).drop("_tie"), "ranked")
    placed = placed.withColumns({"_part": F.shiftright("_id", 33), "_row": F.col("_id").bitwiseAND(F.lit(_ROWS))})
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    numbered = placed.join(offsets, "_part").withColumn("_at", F.col("_before") + F.col("_row"))
    sizes = numbered.groupBy("tree").agg(F.count("*").alias("n"), F.min("_at").alias("_first"))
    return numbered.join(sizes, "tree").withColumn("rank", F.col("_at") - F.col("_first")).drop("_id", "_part", "_row", "_before", "_at", "_first")


def _levels(n: Column) -> Column:
    """How many times two nodes become one until one is left."""
    return F.when(n > 1, F.length(F.bin(n - 1))).otherwise(0)


def _upwards(children: Column, levels: Column) -> Column:
    """The nodes of each level of a block, children first, its top last."""

    def above(level: Column) -> Column:
        pairs = F.sequence(F.lit(0), F.shiftright(F.size(level) - 1, 1))
        return F.transform(pairs, lambda j: F.sha2(F.concat(F.get(level, j * 2), F.coalesce(F.get(level, j * 2 + 1), F.lit(""))), 256))

    return F.aggregate(F.sequence(F.lit(1), levels), F.array(children), lambda got, _: F.concat(got, F.array(above(F.element_at(got, -1)))))


def build(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The store, a table ``(digest, levels, children)`` for each height from the leaves on, and
    ``(tree, n, digest)``, the tops, of ``nodes(tree, n, rank, digest)``."""
    store, tops = [], None
    left = nodes.select("tree", F.col("n").alias("size"), "n", "rank", "digest")
    while True:
        done = left.where("n <= 1").select("tree", F.col("size").alias("n"), "digest")
        tops = done if tops is None else tops.unionByName(done)
        left = left.where("n > 1")
        if left.isEmpty():
            return store, cut(tops, "tops")
        blocks = left.groupBy("tree", "size", "n", F.shiftright("rank", BITS).alias("rank")).agg(
            F.sort_array(F.collect_list(F.struct("rank", "digest"))).alias("_nodes")
        ).select("tree", "size", "n", "rank", F.col("_nodes.digest").alias("children"), F.least(_levels(F.col("n")), F.lit(BITS)).alias("levels"))
        top = F.element_at(F.element_at(_upwards(F.col("children"), F.col("levels")), -1), 1)
        records = cut(blocks.withColumn("digest", top), f"records{len(store)}")
        store.append(records.groupBy("digest").agg(F.first("levels").alias("levels"), F.first("children").alias("children")))
        left = records.select("tree", "size", F.ceil(F.col("n") / (1 << BITS)).cast("bigint").alias("n"), "rank", "digest")


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value worked out once a row: a plain column would be copied into the lambdas
    below it and worked out for every element."""
    return F.get(F.transform(F.array(value), body), 0)


def _noted(all_levels: Column, levels: Column, digit: Column) -> Column:
    """The children not chosen from a record's top down to the child ``digit``, by side."""

    def step(level: Column) -> Column:
        at = F.call_function("shiftright", digit, level)  # the Python function takes a number only
        nodes = F.get(all_levels, level)
        odd = at.bitwiseAND(F.lit(1)) == 1
        return F.struct(
            F.when(odd, F.get(nodes, at - 1)).otherwise("").alias("left"),
            F.when(odd, "").otherwise(F.coalesce(F.get(nodes, at + 1), F.lit(""))).alias("right"),
        )

    return F.transform(F.sequence(levels - 1, F.lit(0), F.lit(-1)), step)


def descend(store: list[DataFrame], tops: DataFrame, requests: DataFrame) -> DataFrame:
    """``requests(tree, rank, ...)`` with ``top``, ``found`` (the leaf's digest in the store) and
    ``proof``: from the leaf to the root, the digests left and right of the way.

    ``tops(tree, n, digest, path)`` says where to begin; ``path`` is what was noted above.
    """
    carried = [c for c in requests.columns if c not in ("tree", "rank")]
    requests = requests.select("tree", "rank", F.struct(*carried).alias("_row"))
    height = ((_levels(F.col("n")) + BITS - 1) / BITS).cast("int").alias("height")
    begins = tops.select("tree", height, F.lit(0).cast("bigint").alias("prefix"), F.col("digest").alias("top"), "digest", "path")
    # trees of one leaf have no record: the top is the leaf
    found = requests.join(begins.where("height = 0"), "tree").select("_row", "top", F.col("digest").alias("found"), "path")
    at = begins.where("height < 0")
    for height in range(len(store) - 1, -1, -1):
        at = at.unionByName(begins.where(F.col("height") == height + 1))
        digit = F.shiftright("rank", BITS * height).bitwiseAND(F.lit((1 << BITS) - 1)).cast("int").alias("digit")
        wanted = requests.select("tree", F.shiftright("rank", BITS * (height + 1)).alias("prefix"), digit, *([] if height else ["_row"]))
        wanted = wanted.distinct() if height else wanted
        wanted = wanted.groupBy("tree", "prefix").agg(F.collect_list(F.struct("digit", *([] if height else ["_row"]))).alias("_wanted"))
        opened = at.drop("height").join(store[height], "digest").join(wanted, ["tree", "prefix"])
        below = _once(_upwards(F.col("children"), F.col("levels")), lambda nodes: F.transform("_wanted", lambda w: F.struct(
            w.alias("w"), F.get("children", w["digit"]).alias("digest"),
            F.concat("path", _noted(nodes, F.col("levels"), w["digit"])).alias("path"),
        )))
        rows = opened.select("tree", "prefix", "top", F.explode(below).alias("_b"))
        if height:
            at = rows.select("tree", F.lit(height).alias("height"), (F.shiftleft("prefix", BITS) + F.col("_b.w.digit")).alias("prefix"), "top", "_b.digest", "_b.path")
        else:
            found = found.unionByName(rows.select("_b.w._row", "top", F.col("_b.digest").alias("found"), "_b.path"))
    return found.select("_row.*", "top", "found", F.reverse("path").alias("proof"))


@dataclass
class Manifest:
    """Ranked leaves, the store of the groups' trees, their tops with the way to the root, and the root."""

    leaves: DataFrame
    store: list[DataFrame]
    tops: DataFrame
    root: str | None


def manifest(leaves: DataFrame, order: list[str]) -> Manifest:
    """Of ``leaves(tree, digest, ...)``; a tree's leaves come by ``order``, trees by their key.

    Nulls come first in an order.  An empty table has no root.
    """
    placed = cut(ranked(leaves, order), "leaves")
    store, tops = build(placed)
    groups = ranked(tops.select(F.col("tree").alias("key"), F.lit("").alias("tree"), "digest", F.col("n").alias("size")), ["key"])
    groups = cut(groups, "groups")
    upper, last = build(groups)
    first = last.withColumn("path", F.array().cast(STEP))
    ways = descend(upper, first, groups.select("tree", "rank", "key", "size"))
    tops = ways.select(F.col("key").alias("tree"), F.col("size").alias("n"), F.col("found").alias("digest"), F.reverse("proof").alias("path"))
    root = last.first()
    return Manifest(placed, store, cut(tops, "tops"), root and root["digest"])


def prove(made: Manifest, requests: DataFrame | None = None) -> DataFrame:
    """``requests(tree, rank, ...)``, by default all leaves, with ``top``, ``found`` and ``proof``."""
    return descend(made.store, made.tops, made.leaves.drop("n") if requests is None else requests)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and the digests beside its way give."""
    return F.aggregate(proof, leaf, lambda got, step: F.sha2(F.concat(step["left"], got, step["right"]), 256))


def siblings(proof: Column) -> Column:
    """Digest of a proof's digests, from leaf to root, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda step: F.concat(step["left"], step["right"])), ""), 256)
