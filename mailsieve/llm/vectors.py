"""Near-duplicate vectors by sorted projection passes.

In each pass every vector gets a string of sign bits of random projections; in the order of
these strings each vector is compared with a bounded number of neighbours, by exact cosine.
How crowded a vector's strings are is measured; crowded vectors go through more passes among
themselves, and where that costs more than comparing them all, they are compared block by block.
Links of all passes together give the components, and the vectors of a component are then
compared block by block, so that links count in full and no group size is a limit.  Equal
vectors are compared once.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import acos, ceil, erf, log, log2, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from mailsieve.functions.shared import cut, ship
from mailsieve.llm.links import components
from mailsieve.llm.tokens import column

COSINE = 0.9
WINDOW = 128
BITS = 48
MISSED = 0.002  # of pairs just at the threshold, after all passes
TILE = 2048
ROUNDS, ROUND_PASSES = 8, 32  # of passes at most, before all that are left are compared
HOT_PARTS = 1000  # a vector with more than this part of all rows is joined by broadcast
FLAT = "vec_id bigint, size int, data binary"


def passes(rows: int, *, cosine: float = COSINE, window: int = WINDOW, missed: float = MISSED) -> int:
    """Passes after which a pair at the threshold has met but for a share of ``missed``.

    A pair meets where its strings agree for as many bits as leave about ``window`` vectors.
    """
    bits = max(1.0, log2(max(2, rows) / window))
    meet = (1 - acos(cosine) / pi) ** bits
    return max(4, ceil(log(missed) / log(1 - meet)))


def _planes(size: int, number: int) -> np.ndarray:
    return np.random.default_rng([size, number]).standard_normal((size, BITS))


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id`` and the components as 8-byte numbers of vectors that can link at all.

    One vector for each vec_id: of repeated ids the smallest that is not null.  Null, empty
    and zero vectors and those with null or non-finite components are left out.
    """
    ship(vectors.sparkSession)
    one = vectors.where("vec_id is not null").groupBy(F.col("vec_id").cast("bigint").alias("vec_id")).agg(
        F.min(F.col("embedding").cast("array<double>")).alias("embedding"))

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes, data = [], [], []
            for vec_id, values in zip(column(batch, "vec_id").to_pylist(), column(batch, "embedding").to_pylist()):
                if not values or None in values:
                    continue
                v = np.array(values, "<f8")
                # scaled by a power of two, so that no square runs out of range
                top = np.abs(v).max()
                if np.isfinite(top) and top > 0:
                    ids.append(vec_id)
                    sizes.append(len(v))
                    data.append(np.ldexp(v, -int(np.frexp(top)[1])).tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(sizes, pa.int32()), pa.array(data, pa.binary())], ["vec_id", "size", "data"])

    return one.mapInArrow(flat, FLAT)


def _matrix(data: list[bytes], size: int) -> np.ndarray:
    return np.frombuffer(b"".join(data), "<f8").reshape(len(data), size)


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest place that each of ``n`` reaches over the pairs."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        after = root.copy()
        np.minimum.at(after, a, low)
        np.minimum.at(after, b, low)
        after = after[after]
        if (after == root).all():
            return root
        root = after


def _shared_bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return BITS - np.frexp((a ^ b).astype(float))[1]


def needed_bits(bits: np.ndarray, window: int, cut_before: bool, cut_after: bool) -> np.ndarray:
    """So many leading bits must a vector share with another for both to be within the window.

    ``bits`` are one pass's strings in order; what lies behind a cut counts as like the last before it.
    """
    n, at = len(bits), np.arange(len(bits))
    before = np.maximum(at - window - 1, 0)
    after = np.minimum(at + window + 1, n - 1)
    left = np.where((at > window) | cut_before, _shared_bits(bits, bits[before]) + 1, 0)
    right = np.where((at + window < n - 1) | cut_after, _shared_bits(bits, bits[after]) + 1, 0)
    return np.maximum(left, right)


def neighbour_links(rows: DataFrame, number: int, *, first_pass: int = 0, cosine: float = COSINE, window: int = WINDOW) -> DataFrame:
    """Spanning links ``a, b`` of the pairs found within the windows of ``number`` passes, and for
    each pass and vector ``a`` a row with ``miss``: the logarithm of the chance that the pass does
    not bring a pair at the threshold together.

    The order of a pass is cut into even ranges, and a window does not reach over the cut.
    """
    margins = np.linspace(0, 8, 4001)
    normal = np.log([0.5 + 0.5 * erf(x / 2**0.5) for x in margins])
    steep = cosine / max(1e-9, 1 - cosine * cosine) ** 0.5

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = 1 << np.arange(BITS, dtype=np.int64)[::-1]
        for whole in batches:
            for low in range(0, whole.num_rows, 1000):
                batch = whole.slice(low, 1000)
                sizes = column(batch, "size").to_numpy()
                for size in np.unique(sizes):
                    part = pa.RecordBatch.from_arrays(batch.columns, batch.schema.names).filter(pa.array(sizes == size))
                    v = _matrix(column(part, "data").to_pylist(), int(size))
                    for p in range(first_pass, first_pass + number):
                        bits = (v @ _planes(int(size), p) > 0) @ weights
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(v), p, np.int32)), pa.array(bits), *part.columns],
                            ["pass", "bits", "vec_id", "size", "data"])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail, seen = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            at_pass, at_size = column(batch, "pass").to_numpy(), column(batch, "size").to_numpy()
            # by a vector's distance from each plane: the chance that one at the threshold, any way from it, is on the same side
            together = np.zeros((batch.num_rows, BITS + 1), np.float32)
            for p, size in set(zip(at_pass.tolist(), at_size.tolist())):
                at = np.flatnonzero((at_pass == p) & (at_size == size))
                v = _matrix(column(batch, "data").take(pa.array(at)).to_pylist(), size)
                far = np.abs(v @ _planes(size, p)) / np.linalg.norm(v, axis=1, keepdims=True)
                together[at, 1:] = np.interp(steep * far, margins, normal).cumsum(1)
            seen.append((*(column(batch, c).to_numpy() for c in ("vec_id", "pass", "size", "bits")), together))
            table = pa.Table.from_batches([batch]) if tail is None else pa.concat_tables([tail, pa.Table.from_batches([batch])])
            tail = table.slice(max(0, table.num_rows - window))
            ids, numbers = table["vec_id"].to_numpy(), table["pass"].to_numpy()
            sizes = table["size"].to_numpy()
            width = int(sizes.max()) if len(sizes) else 0
            v = np.zeros((len(ids), width))
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                v[at, :size] = _matrix(table["data"].take(pa.array(at)).to_pylist(), int(size))
            v /= np.linalg.norm(v, axis=1, keepdims=True)
            first, second = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for step in range(1, min(window, len(ids) - 1) + 1):
                near = np.einsum("ij,ij->i", v[:-step], v[step:]) >= cosine
                near &= (numbers[:-step] == numbers[step:]) & (sizes[:-step] == sizes[step:])
                at = np.flatnonzero(near)
                first.append(at)
                second.append(at + step)
            root = _roots(len(ids), np.concatenate(first), np.concatenate(second))
            far = np.flatnonzero(root != np.arange(len(ids)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[far]), pa.array(ids[root[far]]), pa.nulls(len(far), pa.float64())], ["a", "b", "miss"])
        if not seen:
            return
        ids, numbers, sizes, bits, together = (np.concatenate(x) for x in zip(*seen))
        ends = np.flatnonzero((np.diff(numbers) != 0) | (np.diff(sizes) != 0)) + 1
        for low, high in zip([0, *ends], [*ends, len(ids)]):
            needed = needed_bits(bits[low:high], window, low == 0, high == len(ids))
            meet = np.exp(together[np.arange(low, high), np.minimum(needed, BITS)].astype(float)) * (needed <= BITS)
            miss = np.log(np.maximum(1 - meet, 1e-40))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[low:high]), pa.nulls(high - low, pa.int64()), pa.array(miss)], ["a", "b", "miss"])

    order = ["pass", "size", "bits", "vec_id"]
    dealt = rows.mapInArrow(keyed, f"pass int, bits bigint, {FLAT}").repartitionByRange(*order).sortWithinPartitions(*order)
    return dealt.mapInArrow(compared, "a bigint, b bigint, miss double")


def all_links(rows: DataFrame, count: int, *, cosine: float = COSINE, tile: int = TILE) -> DataFrame:
    """Spanning links ``a, b`` of all pairs of ``rows``, tile against tile."""
    tiles = max(1, ceil(count / tile))
    rows = rows.withColumn("tile", F.pmod(F.xxhash64("vec_id"), F.lit(tiles)).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))
    rows = rows.select("vec_id", "size", "data", "tile", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"))

    def links(table: pa.Table) -> pa.Table:
        ids, tiles = table["vec_id"].to_numpy(), table["tile"].to_numpy()
        v = _matrix(table["data"].to_pylist(), table["size"][0].as_py())
        v = v / np.linalg.norm(v, axis=1, keepdims=True)
        a, b = np.flatnonzero(tiles == table["low"][0].as_py()), np.flatnonzero(tiles == table["high"][0].as_py())
        root = np.arange(len(ids))
        for at in range(0, len(a), 512):
            x, y = np.nonzero(v[a[at : at + 512]] @ v[b].T >= cosine)
            old = np.flatnonzero(root != np.arange(len(ids)))
            root = _roots(len(ids), np.concatenate([a[at + x], old]), np.concatenate([b[y], root[old]]))
        far = np.flatnonzero(root != np.arange(len(ids)))
        return pa.table({"a": ids[far], "b": ids[root[far]]})

    return rows.groupBy("size", "low", "high").applyInArrow(links, "a bigint, b bigint")


def links(rows: DataFrame, *, cosine: float = COSINE, window: int = WINDOW, missed: float = MISSED) -> DataFrame:
    """Links ``a, b`` that span the components of ``rows(vec_id, size, data)``, no two of them equal.

    A pair at the threshold is missed with a chance of at most ``missed`` as measured: a pair
    counts as met once one of its two has, so only vectors that have not go on, among
    themselves, with as many passes as the slow tenth of them needs.  Once comparing all
    that are left is cheaper, or after ``ROUNDS``, that is done and misses nothing; the first
    passes go over all vectors, however few.
    """
    spark, found, done = rows.sparkSession, [], 0
    rest, count = rows.select("vec_id", "size", "data", F.lit(0.0).alias("missed")), rows.count()
    number = passes(count, cosine=cosine, window=window, missed=missed)
    for turn in range(ROUNDS):
        if not count or turn and count <= 4 * window * number:
            break
        number = min(number, ROUND_PASSES)
        got = cut(neighbour_links(rest.drop("missed"), number, first_pass=done, cosine=cosine, window=window), "links")
        done += number
        found.append(got.where("b is not null").select("a", "b"))
        sums = got.where("b is null").groupBy(F.col("a").alias("vec_id")).agg(F.sum("miss").alias("more"))
        rest = rest.join(sums, "vec_id").withColumn("missed", F.col("missed") + F.col("more")).drop("more")
        rest = cut(rest.where(F.col("missed") > log(missed)), "rest")
        count, slow = rest.agg(F.count("*"), F.percentile_approx("missed", 0.9)).first()
        number = max(4, ceil((log(missed) - slow) / (slow / done))) if count else 4
    if count:
        found.append(all_links(rest, count, cosine=cosine))
    out = spark.createDataFrame([], "a bigint, b bigint")
    for more in found:
        out = out.unionByName(more)
    return out


def link_counts(members: DataFrame, *, cosine: float = COSINE, tile: int = TILE) -> DataFrame:
    """``vec_id, n_links`` from comparing all of a component of ``members(component, vec_id, size, data, copies)``.

    A vector stands for so many equal ones as ``copies`` says.  A component is dealt into tiles; each pair of tiles is one block, and only counts leave it.
    """
    sizes = members.groupBy("component").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"))
    rows = members.join(sizes, "component").withColumn("tile", F.pmod(F.xxhash64("vec_id"), F.col("tiles")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    rows = rows.select("component", "vec_id", "size", "data", "copies", "tile",
                       F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"))

    def count(table: pa.Table) -> pa.Table:
        ids, tiles = table["vec_id"].to_numpy(), table["tile"].to_numpy()
        low, high = table["low"][0].as_py(), table["high"][0].as_py()
        v = _matrix(table["data"].to_pylist(), table["size"][0].as_py())
        v = v / np.linalg.norm(v, axis=1, keepdims=True)
        copies, found = table["copies"].to_numpy(), np.zeros(len(ids), np.int64)
        a, b = np.flatnonzero(tiles == low), np.flatnonzero(tiles == high)
        for at in range(0, len(a), 512):
            near = v[a[at : at + 512]] @ v[b].T >= cosine
            found[a[at : at + 512]] += near @ copies[b]
            if low != high:
                found[b] += copies[a[at : at + 512]] @ near
        if low == high:
            found -= 1  # itself
        return pa.table({"vec_id": ids, "n": found})

    return rows.groupBy("component", "low", "high").applyInArrow(count, "vec_id bigint, n bigint").groupBy("vec_id").agg(
        F.sum("n").alias("n_links"))


def near_duplicates(vectors: DataFrame, *, cosine: float = COSINE, window: int = WINDOW) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors(vec_id, embedding)``.

    Vectors that cannot link (see ``usable``), and vectors of other lengths, link with
    nothing.  A repeated vec_id has one row for each of its rows, all alike.  A null vec_id
    has no links and a null component and is kept.
    """
    rows = cut(usable(vectors), "vectors")
    alike = rows.groupBy("size", "data").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"))
    alike = cut(alike, "distinct")
    edges = cut(links(alike.drop("copies"), cosine=cosine, window=window), "links")
    found = cut(components(edges), "components")
    members = alike.join(found, F.col("vec_id") == F.col("node")).select("component", "vec_id", "size", "data", "copies")
    counts = link_counts(members, cosine=cosine).withColumnRenamed("vec_id", "node")
    linked = found.join(counts, "node")
    key = F.sha2("data", 256).alias("key")
    told = cut(alike.join(linked, F.col("vec_id") == F.col("node"), "left").select(
        key, "copies", F.coalesce("component", "vec_id").alias("component"),
        F.coalesce("n_links", F.col("copies") - 1).alias("n_links")), "told")
    hot = F.col("copies") > rows.count() / HOT_PARTS
    keyed, few = rows.select("vec_id", key), F.broadcast(told.where(hot).drop("copies"))  # less than HOT_PARTS rows
    each = keyed.join(few, "key").unionByName(
        keyed.join(few.select("key"), "key", "left_anti").join(told.where(~hot).drop("copies"), "key"))
    each = each.select(F.col("vec_id").alias("node"), "component", "n_links")
    final = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id")).join(each, F.col("vec_id") == F.col("node"), "left")
    component = F.coalesce("component", "vec_id")
    return final.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
