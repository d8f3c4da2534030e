"""Near-duplicates by improved consistent weighted sampling over TF-IDF shingles.

A shingle is five words, lower-cased and without signs; its weight is its count in the text
times the mean inverse document frequency of its words.  (The frequency of whole shingles
would weigh down just what copies share.)  Samples (Ioffe, 2010) are banded; texts that share
a band are compared by the exact weighted Jaccard similarity, and linked from 0.8 on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from mailsieve.functions.shared import cut, drop, ship, unused
from mailsieve.llm.links import components
from mailsieve.llm.tokens import column

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 10, 4
DF_BITS = 16
HASH_BITS = 44
TILE = 512
PLAUSIBLE = 0.5  # share of common samples below which a pair is not compared; 0.8 falls short by chance once in 10^5
SLICE_BYTES = 2 << 20
CHUNK = 1 << 15

_LUT = np.array([b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)], np.uint8)
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_P_BACK = np.uint64(pow(int(_P), -1, 1 << 64))
_Q = np.uint64(0xC2B2AE3D27D4EB4F)
_POWERS: list[np.ndarray] = []


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _powers(n: int) -> list[np.ndarray]:
    """The powers of the hash base and of its inverse, by place."""
    made = lambda size: [np.multiply.accumulate(np.r_[np.uint64(1), np.full(size, base)]) for base in (_P, _P_BACK)]
    if n > SLICE_BYTES + 2:  # one very long text: not kept
        return made(n)
    if not _POWERS:
        _POWERS[:] = made(SLICE_BYTES + 1)
    return _POWERS


def words(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices of a text column: first row, rows, row and hash of every word, in order."""
    texts = pc.utf8_lower(pc.fill_null(texts, "")).cast(pa.large_string())
    sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    begin = 0
    while begin < len(texts):
        before = sizes[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(sizes, before + SLICE_BYTES, "right")))
        part = texts.slice(begin, end - begin)
        bounds = np.frombuffer(part.buffers()[1], np.int64)[part.offset : part.offset + len(part) + 1]
        raw = part.buffers()[2]
        data = _LUT[np.frombuffer(raw, np.uint8)[bounds[0] : bounds[-1]]] if raw else np.zeros(0, np.uint8)
        bounds = bounds - bounds[0]
        inside = data != 32
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        at = bounds[:-1][bounds[:-1] < len(data)]
        first[at] = inside[at]
        last = inside.copy()
        last[:-1] &= ~inside[1:] | first[1:]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        powers, back = _powers(len(data) + 1)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(data * powers[: len(data)], dtype=np.uint64)])
        hashes = _mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))
        rows = np.searchsorted(bounds, starts, "right") - 1
        yield begin, end - begin, rows.astype(np.int64), hashes
        begin = end


def shingles(rows: np.ndarray, hashes: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash and weight of each text's distinct shingles, by row and hash.

    A text of fewer than five words has one shingle, all of its words.
    """
    empty = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.float32)
    if not len(rows):
        return empty
    value = idf[(hashes >> np.uint64(64 - DF_BITS)).astype(np.int64)]
    begin = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
    count = np.diff(np.r_[begin, len(rows)])
    size = np.minimum(count, WORDS)
    windows = count - size + 1
    at = np.repeat(begin - (np.cumsum(windows) - windows), windows) + np.arange(windows.sum())
    width = np.repeat(size, windows)
    whole, weight = np.zeros(len(at), np.uint64), np.zeros(len(at))
    for i in range(WORDS):
        there = width > i
        whole[there] = whole[there] * _Q + hashes[at[there] + i]
        weight[there] += value[at[there] + i]
    key = (rows[at].astype(np.uint64) << np.uint64(HASH_BITS)) | (_mix(whole) >> np.uint64(64 - HASH_BITS))
    order = np.argsort(key, kind="stable")
    key, weight = key[order], (weight / width)[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    times = np.diff(np.r_[first, len(key)])
    key = key[first]
    return ((key >> np.uint64(HASH_BITS)).astype(np.int64), key & np.uint64((1 << HASH_BITS) - 1),
            (weight[first] * times).astype(np.float32))


def _gamma_table(size: int) -> np.ndarray:
    """Quantiles of Gamma(2, 1)."""
    grid = np.linspace(0, 40, 400_001)
    return np.interp((np.arange(size) + 0.5) / size, 1 - (1 + grid) * np.exp(-grid), grid)


class Sampler:
    """One sample per hash function: the shingle, and its quantised weight, with the least value."""

    def __init__(self, samples: int = BANDS * ROWS):
        self.scale = _gamma_table(1 << 12).astype(np.float32)
        self.level = np.log(_gamma_table(1 << 16)).astype(np.float32)
        self.odd = _mix(np.arange(1, samples + 1, dtype=np.uint64)) | np.uint64(1)

    def sample(self, rows: np.ndarray, hashes: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows that have shingles, and their samples, one line a row."""
        begin = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        bounds = np.r_[begin, len(rows)]
        out = np.zeros((len(begin), len(self.odd)), np.uint32)
        low = 0
        while low < len(begin):
            high = max(low + 1, int(np.searchsorted(bounds, bounds[low] + CHUNK, "right")) - 1)
            part = slice(bounds[low], bounds[high])
            mixed, log_weight = _mix(hashes[part]), np.log(weights[part])
            cuts = begin[low:high] - bounds[low]
            sizes = np.diff(np.r_[cuts, len(mixed)])
            owner = np.repeat(np.arange(high - low), sizes)
            for k, odd in enumerate(self.odd):
                bits = mixed * odd
                scale = self.scale[bits >> np.uint64(52)]
                shift = ((bits >> np.uint64(20)) & np.uint64(0xFFFF)).astype(np.float32) / np.float32(65536)
                step = np.floor(log_weight / scale + shift)
                value = self.level[(bits >> np.uint64(36)) & np.uint64(0xFFFF)] - scale * (step - shift + 1)
                best = np.flatnonzero(value == np.minimum.reduceat(value, cuts)[owner])
                best = best[np.r_[True, owner[best][1:] != owner[best][:-1]]]
                out[low:high, k] = _mix(mixed[best] + step[best].astype(np.int64).astype(np.uint64) * _Q) >> np.uint64(32)
            low = high
        return rows[begin], out


def frequencies(docs: DataFrame) -> np.ndarray:
    """Inverse document frequency by bucket of word hashes, over all documents.

    ``1 + ln((N + 1) / (df + 1))``; the driver gets one number a bucket, 2^16 in all.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, total = np.zeros(1 << DF_BITS, np.int64), 0
        for batch in batches:
            total += batch.num_rows
            for _, _, rows, hashes in words(column(batch, "text")):
                pairs = np.unique((rows << DF_BITS) | (hashes >> np.uint64(64 - DF_BITS)).astype(np.int64))
                found += np.bincount(pairs & ((1 << DF_BITS) - 1), minlength=1 << DF_BITS)
        some = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.r_[some, -1].astype(np.int32)), pa.array(np.r_[found[some], total])], ["bucket", "n"])

    rows = docs.select("text").mapInArrow(count, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    bucket, n = rows["bucket"].to_numpy(), rows["n"].to_numpy()
    found = np.zeros(1 << DF_BITS)
    found[bucket[bucket >= 0]] = n[bucket >= 0]
    total = n[bucket < 0].sum()
    return (1 + np.log((total + 1) / (found + 1))).astype(np.float32)


def sketch(docs: DataFrame, idf: np.ndarray) -> DataFrame:
    """``doc_id, text_key, samples, bands``: a digest of the text, its samples as 4-byte numbers,
    and a hash for each band; the last two null without words."""

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler()
        for batch in batches:
            texts = column(batch, "text")
            for begin, n, rows, hashes in words(texts):
                bands: list = [None] * n
                kept: list = [None] * n
                if len(rows):
                    owners, samples = sampler.sample(*shingles(rows, hashes, idf))
                    mixed = np.zeros((len(owners), BANDS), np.uint64)
                    for i in range(ROWS):
                        mixed = _mix(mixed * _Q + samples[:, i::ROWS][:, :BANDS])
                    for row, keys, line in zip(owners, mixed.astype(np.int64).tolist(), samples):
                        bands[row], kept[row] = keys, line.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [*[column(batch, c).slice(begin, n) for c in ("doc_id", "text_key")], pa.array(kept, pa.binary()),
                     pa.array(bands, pa.list_(pa.int64()))],
                    ["doc_id", "text_key", "samples", "bands"])

    rows = docs.select("doc_id", F.md5(F.col("text")).alias("text_key"), "text")
    return rows.mapInArrow(sketched, "doc_id bigint, text_key string, samples binary, bands array<bigint>")


def shapes_of(docs: DataFrame, idf: np.ndarray, wanted: DataFrame) -> DataFrame:
    """``node`` and the hashes and weights of its text's shingles as 8- and 4-byte numbers, for
    ``wanted(node, doc_id, text_key)``.

    A text is drawn from the document that stands for it; where that row is repeated, a task
    draws it once, so a node may come once from every partition.  ``wanted`` grows with the
    documents, so it is never broadcast, at any size.
    """

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for whole in batches:
            nodes = column(whole, "node").to_pylist()
            new = [n not in seen and not seen.add(n) for n in nodes]
            batch = whole.filter(pa.array(new, pa.bool_()))
            for begin, n, rows, hashes in words(column(batch, "text")):
                owner, shingle, weight = shingles(rows, hashes, idf)
                cuts = np.searchsorted(owner, np.arange(n + 1))
                parts = [(shingle[a:b].tobytes(), weight[a:b].tobytes()) for a, b in zip(cuts[:-1], cuts[1:])]
                yield pa.RecordBatch.from_arrays(
                    [column(batch, "node").slice(begin, n), pa.array([p[0] for p in parts], pa.binary()), pa.array([p[1] for p in parts], pa.binary())],
                    ["node", "hashes", "weights"])

    keyed = docs.where("text is not null").select("doc_id", F.md5(F.col("text")).alias("text_key"), "text")
    same = (keyed.text_key == wanted.text_key) & keyed.doc_id.eqNullSafe(wanted.doc_id)
    return keyed.join(wanted.hint("merge"), same).select("node", "text").mapInArrow(made, "node bigint, hashes binary, weights binary")


def plausible(members: DataFrame, least: float) -> DataFrame:
    """The members ``set, node, samples`` that share ``least`` of all samples with another of their set."""

    def close(table: pa.Table) -> pa.Table:
        lines = np.frombuffer(b"".join(table["samples"].to_pylist()), np.uint32).reshape(table.num_rows, -1)
        keep = np.zeros(len(lines), bool)
        for i in range(len(lines) - 1):
            near = (lines[i + 1 :] == lines[i]).mean(1) >= least
            keep[i] |= near.any()
            keep[i + 1 :] |= near
        return table.select(["set", "node"]).filter(pa.array(keep))

    return members.select("set", "node", "samples").groupBy("set").applyInArrow(close, "set string, node bigint")


def linked(ids: list[int], hashes: list[bytes], weights: list[bytes], label: list[int], similarity: float) -> list[tuple[int, int]]:
    """Links that join what ``label`` does not join yet: a spanning set of all links among these texts.

    Each text is compared with all that it is not yet joined to, through the shared shingles'
    postings, until no two texts apart are similar.
    """
    n = len(ids)
    sizes = np.array([len(h) // 8 for h in hashes])
    shingle = np.frombuffer(b"".join(hashes), np.uint64)
    weight = np.frombuffer(b"".join(weights), np.float32).astype(np.float64)
    owner = np.repeat(np.arange(n), sizes)
    begins = np.cumsum(sizes) - sizes
    total = np.bincount(owner, weight, minlength=n)
    order = np.argsort(shingle, kind="stable")
    sorted_shingle, sorted_owner, sorted_weight = shingle[order], owner[order], weight[order]
    group = np.unique(np.array(label), return_inverse=True)[1]
    out = []
    for i in range(n):
        if (group == group[i]).all():
            break
        mine = slice(begins[i], begins[i] + sizes[i])
        low = np.searchsorted(sorted_shingle, shingle[mine], "left")
        many = np.searchsorted(sorted_shingle, shingle[mine], "right") - low
        at = np.repeat(low - (np.cumsum(many) - many), many) + np.arange(many.sum())
        shared = np.bincount(sorted_owner[at], np.minimum(sorted_weight[at], np.repeat(weight[mine], many)), minlength=n)
        alike = shared >= similarity * (total + total[i] - shared) - 1e-9
        for j in np.flatnonzero(alike & (group != group[i])):
            if group[j] != group[i]:
                out.append((ids[i], ids[j]))
                group[group == group[j]] = group[i]
    return out


def _compare(members: DataFrame, shapes: DataFrame, similarity: float) -> DataFrame:
    """Links within each group of ``members(set, node, label)``."""

    def links(table: pa.Table) -> pa.Table:
        ids = table["node"].to_pylist()
        found = linked(ids, table["hashes"].to_pylist(), table["weights"].to_pylist(), table["label"].to_pylist(), similarity)
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return members.join(shapes, "node").groupBy("set").applyInArrow(links, "a bigint, b bigint")


def grouped(docs: DataFrame, *, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """Of ``docs(doc_id, text)``: every row's ``doc_id`` and ``text_key``, and for every distinct text
    ``text_key, class_id, kept_id, kept_key``.

    The nodes of the links are texts, so different texts under one doc_id are told apart and
    equal ones under different ids, or none, are one.  ``class_id`` is the smallest doc_id of a
    class, null if none of its rows has one; ``kept_id`` and ``kept_key`` name the document that
    stands for it: that id's, and of several texts that with the smallest digest.
    """
    ship(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    idf = frequencies(docs)
    rows = cut(sketch(docs, idf), "sketches")
    # equal texts are one from here on; the number is drawn once, when the table is written
    texts = cut(rows.where("text_key is not null").groupBy("text_key").agg(
        F.min("doc_id").alias("doc_id"), F.first("samples").alias("samples"), F.first("bands").alias("bands")
    ).withColumn("node", F.monotonically_increasing_id()), "texts")
    nodes = texts.where("bands is not null")
    banded = nodes.select("node", F.posexplode("bands").alias("band", "key"))
    sets = banded.groupBy("band", "key").agg(
        F.count("*").alias("n"), F.min("node").alias("leader"), F.bit_xor(F.xxhash64("node")).alias("x"),
        F.sum(F.shiftright(F.xxhash64(F.lit(7), "node"), 24)).alias("s")).where("n > 1")
    # the same texts often meet in several bands: one of these is enough
    sets = sets.groupBy("n", "leader", "x", "s").agg(F.min(F.struct("band", "key")).alias("b"))
    sets = sets.select("b.band", "b.key", "n", "leader", F.ceil(F.col("n") / TILE).cast("int").alias("tiles"))
    members = cut(banded.join(sets, ["band", "key"]).join(nodes.select("node", "samples"), "node").withColumn(
        "tile", F.pmod(F.xxhash64(F.lit(11), "node"), F.col("tiles")).cast("int")), "members")
    # every tile with its set's leader; tiles of the same set meet in it
    name = lambda *c: F.concat_ws(":", "band", "key", *c)
    small = plausible(members.where("tiles = 1").withColumn("set", name("tile")), PLAUSIBLE)
    wide = members.where("tiles > 1").drop("samples")
    first = wide.where("node != leader").select(name("tile").alias("set"), "node")
    leaders = wide.where("node != leader").select(name("tile").alias("set"), F.col("leader").alias("node")).distinct()
    first = cut(small.unionByName(first).unionByName(leaders), "sets")
    needed = cut(nodes.select("node", "doc_id", "text_key").join(first.select("node").distinct(), "node", "left_semi"), "needed")
    shapes = cut(shapes_of(docs, idf, needed), "shapes")
    edges = cut(_compare(first.withColumn("label", F.col("node")), shapes, similarity), "links")
    found = cut(components(edges), "components")
    drop(first)
    drop(edges)
    # sets of many tiles that are not one component yet: tiles against tiles
    wide = wide.join(found.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"), "left").withColumn("label", F.coalesce("component", "node")).drop("_n")
    apart = wide.groupBy("band", "key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low != high")
    if not apart.isEmpty():
        wide = wide.join(apart.select("band", "key"), ["band", "key"])
        pairs = wide.select("band", "key", "node", "label", "tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("with"))
        pairs = pairs.where("tile != with").select(
            name(F.least("tile", "with"), F.greatest("tile", "with")).alias("set"), "node", "label")
        more = cut(_compare(pairs, shapes, similarity), "links")
        stars = found.where("node != component").select(F.col("node").alias("a"), F.col("component").alias("b"))
        found = cut(components(stars.unionByName(more)), "components")
    for done in (members, needed, shapes):
        drop(done)
    # the name of each class of several texts; any other text is a class of its own
    keys = texts.select("node", "doc_id", "text_key")
    several = found.join(keys, "node")
    best = several.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("b"))
    named = several.select("node", "component").join(best, "component").select("node", F.col("b.doc_id").alias("_id"), F.col("b.text_key").alias("_key"))
    joined = keys.join(named, "node", "left")
    alone = F.col("_key").isNull()
    kept_id = F.when(alone, F.col("doc_id")).otherwise(F.col("_id"))
    classes_ = joined.select("text_key", kept_id.alias("class_id"), kept_id.alias("kept_id"), F.coalesce("_key", "text_key").alias("kept_key"))
    return rows.select("doc_id", "text_key"), cut(classes_, "classes")


def classes(docs: DataFrame, *, similarity: float = SIMILARITY) -> DataFrame:
    """``doc_id, class_id, kept`` for every row of ``docs(doc_id, text)``.

    ``class_id`` is the smallest doc_id of the texts that links lead to, null if none of them has
    an id; ``kept`` tells whether the row is the document that stands for the class, one text
    under one id (rows that repeat both are all marked).  Texts that are equal are one class;
    empty and wordless texts link with nothing but equal ones.  Null texts are kept, each a
    class of its own under its id.
    """
    rows, found = grouped(docs, similarity=similarity)
    joined = rows.join(found, "text_key", "left")
    kept = F.col("text_key").isNull() | ((F.col("text_key") == F.col("kept_key")) & F.col("doc_id").eqNullSafe(F.col("kept_id")))
    class_id = F.when(F.col("text_key").isNull(), F.col("doc_id")).otherwise(F.col("class_id"))
    return joined.select("doc_id", class_id.alias("class_id"), kept.alias("kept"))


def unique(docs: DataFrame, *, similarity: float = SIMILARITY) -> DataFrame:
    """One row of ``docs`` for each class, with all its columns; rows with a null text all stay.

    What goes is looked up, so rows that stay are not shuffled unless they are repeated: of
    rows with the same doc_id and text, any one stays.
    """
    rows, found = grouped(docs, similarity=similarity)
    joined = rows.where("text_key is not null").groupBy("text_key", "doc_id").agg(F.count("*").alias("_times")).join(found, "text_key")
    stands = (F.col("text_key") == F.col("kept_key")) & F.col("doc_id").eqNullSafe(F.col("kept_id"))
    key, own = unused(docs, "_key"), unused(docs, "_id")
    verdict = cut(joined.select(F.col("text_key").alias(key), F.col("doc_id").alias(own), stands.alias("stands"), "_times"), "verdict")
    same = (F.md5(F.col("text")) == F.col(key)) & F.col("doc_id").cast("bigint").eqNullSafe(F.col(own))
    kept = docs.join(verdict.where("NOT stands").select(key, own), same, "left_anti")
    repeated = verdict.where("stands AND _times > 1").select(key, own)
    once = kept.join(repeated, same, "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(repeated, same, "left_anti").unionByName(once)
