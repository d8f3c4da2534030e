"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts stand against texts without a label.  The risk of a classifier on clean
text is what it costs on unlabelled text less the toxic share of it, and this difference is
kept from going below zero (Kiryo et al., 2017).  Features are hashed runs of five and of eight
bytes, each in two steps: that a text has it, and that it has it twice or more.  The model is a
logistic one over the features that lean to toxic text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from mailsieve.functions.shared import cut, ship
from mailsieve.llm.tokens import column

GRAMS = (5, 8)
BITS = 24
TWICE = 1 << BITS  # added to a bucket found twice or more
COARSE = 6  # bits left out of a bucket in the first look at whether the model knows it
SLICE_BYTES = 1 << 20
POSITIVES, UNLABELLED = 2_500, 7_500
# features in the model: in so many toxic texts, by so large a log-likelihood ratio (Poisson) more
# than unlabelled text has, and with so large a toxic share among their texts, by Bayes' rule
LEAST_DOCS, LEAST_LEAN, LEAST_SHARE = 5, 12.0, 0.5
STEPS, RATE, DECAY, ASCENT = 400, 0.05, 1e-4, 1.0
THRESHOLD = 0.7
_MIX = np.uint64(0x9E3779B97F4A7C15)
_LETTERS = np.array([b if b >= 128 or chr(b).isalpha() else 32 for b in range(256)], np.uint8)


def grams(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices of a text column: first row, number of rows, row and bucket of every run of bytes.

    Lower-cased; everything but letters counts as a space.  Whole texts; null counts as empty.
    """
    texts = pc.utf8_lower(pc.fill_null(texts, "")).cast(pa.large_string())
    sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    begin = 0
    while begin < len(texts):
        before = sizes[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(sizes, before + SLICE_BYTES, "right")))
        part = texts.slice(begin, end - begin)
        bounds = np.frombuffer(part.buffers()[1], np.int64)[part.offset : part.offset + len(part) + 1]
        data = _LETTERS[np.frombuffer(part.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]] if part.buffers()[2] else []
        bounds = bounds - bounds[0]
        rows, buckets = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
        owner = np.repeat(np.arange(len(part), dtype=np.int32), np.diff(bounds))
        value, width = np.asarray(data, np.uint8).astype(np.uint64), 1
        for size in GRAMS:
            n = len(data) - size + 1
            if n < 1:
                break
            value = value[:n]
            for i in range(width, size):
                value = (value << np.uint64(8)) | data[i : i + n]
            width = size
            row = owner[:n]
            inside = np.arange(size, size + n) <= bounds[1:][row]
            rows.append(row[inside])
            buckets.append(((value[inside] * (_MIX + np.uint64(2 * size))) >> np.uint64(64 - BITS)).astype(np.int32))
        yield begin, end - begin, np.concatenate(rows), np.concatenate(buckets)
        begin = end


def features(row: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and feature of each text's buckets, by row: each bucket, and again where it is found twice."""
    pairs = row.astype(np.int64)
    pairs <<= BITS + 1
    pairs |= bucket
    pairs.sort()
    first = np.ones(len(pairs), bool)
    np.not_equal(pairs[1:], pairs[:-1], out=first[1:])
    twice = pairs[1:][~first[1:] & first[:-1]]
    pairs = np.concatenate([pairs[first], twice + TWICE])
    pairs.sort()
    return pairs >> (BITS + 1), pairs & (2 * TWICE - 1)


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3))


class Model:
    """``keys``: the features it knows, in order, and their ``weights``; ``bias`` None stands for
    a model without positives."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray, bias: float | None):
        self.keys, self.weights, self.bias = keys, weights, bias

    def scores(self, texts: pa.Array) -> np.ndarray:
        out = np.full(len(texts), 0.0)
        if self.bias is None:
            return out
        known = np.unique(self.keys % TWICE)
        coarse = np.zeros(TWICE >> COARSE, bool)
        coarse[known >> COARSE] = True
        for begin, n, row, bucket in grams(texts):
            hit = coarse[bucket >> COARSE]
            row, bucket = row[hit], bucket[hit]
            hit = np.isin(bucket, known)
            at, feature = features(row[hit], bucket[hit])
            place = np.minimum(np.searchsorted(self.keys, feature), max(0, len(self.keys) - 1))
            there = self.keys[place] == feature if len(self.keys) else np.zeros(0, bool)
            sums = np.bincount(at[there], self.weights[place[there]], minlength=n)
            out[begin : begin + n] = 1 / (1 + np.exp(-np.clip(sums + self.bias, -500, 500)))
        return out


def leaning(count: np.ndarray, seen: np.ndarray, positives: int, unlabelled: int, prior: float) -> np.ndarray:
    """Which features the model takes, by the toxic and the unlabelled sample texts that have them."""
    expected = (seen + 0.5) * positives / unlabelled
    lean = (count > expected) & (count * np.log(np.maximum(count, 1) / expected) - count + expected >= LEAST_LEAN)
    return (count >= LEAST_DOCS) & lean & (prior * count >= LEAST_SHARE * expected)


def train(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float) -> Model:
    """The non-negative risk estimator with logistic loss, by full-batch Adam steps."""
    none = np.zeros(0, np.int64)
    if not positive or not unlabelled or not 0 < prior < 1:
        return Model(none, none, None)
    keys, count = np.unique(np.concatenate(positive), return_counts=True)
    def places(doc: np.ndarray) -> np.ndarray:
        if not len(keys):
            return none
        at = np.minimum(np.searchsorted(keys, doc), len(keys) - 1)
        return at[keys[at] == doc]

    seen = np.zeros(len(keys))
    for doc in unlabelled:
        seen[places(doc)] += 1
    keys = keys[leaning(count, seen, len(positive), len(unlabelled), prior)]

    def matrix(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, int]:
        kept = [places(d) for d in docs]
        return np.repeat(np.arange(len(docs)), [len(k) for k in kept]), np.concatenate(kept).astype(np.int64), len(docs)

    sets = matrix(positive), matrix(unlabelled)
    w = np.zeros(len(keys) + 1)
    w[-1] = np.log(prior / (1 - prior))
    first, second = np.zeros_like(w), np.zeros_like(w)

    def gradient(data, slopes: np.ndarray) -> np.ndarray:
        row, at, _ = data
        return np.append(np.bincount(at, slopes[row], minlength=len(keys)), slopes.sum())

    for step in range(1, STEPS + 1):
        z_p, z_u = (np.bincount(r, w[a], minlength=n) + w[-1] for r, a, n in sets)
        s_p, s_u = (1 / (1 + np.exp(-np.clip(z, -500, 500))) for z in (z_p, z_u))
        clean = np.logaddexp(0, z_u).mean() - prior * np.logaddexp(0, z_p).mean()
        as_toxic = gradient(sets[0], prior * (s_p - 1) / len(z_p))
        as_clean = gradient(sets[1], s_u / len(z_u)) - gradient(sets[0], prior * s_p / len(z_p))
        g = as_toxic + as_clean if clean >= 0 else -ASCENT * as_clean
        g[:-1] += DECAY * w[:-1]
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        w -= RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return Model(keys.astype(np.int64), w[:-1], float(w[-1]))


def fit(docs: DataFrame, labels: DataFrame, *, positives: int = POSITIVES, unlabelled: int = UNLABELLED,
        prior: float | None = None) -> Model:
    """Learns from ``labels(doc_id, toxic)`` and texts of the folds 0 and 2.

    The sample is at most ``positives`` toxic and ``unlabelled`` other texts, those whose ids
    hash lowest.  Features are counted and chosen on Spark, and only each text's chosen ones
    come to the driver.  ``prior`` is the toxic share of all texts; by
    default that of the labelled ones of these folds.  A document with a toxic label and
    another counts as toxic; null ids, null labels and labels without a document do not count.
    """
    ship(docs.sparkSession)
    marked = labels.where((fold(F.col("doc_id")) != 1) & F.col("toxic").isNotNull())
    marked = marked.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    if prior is None:
        prior = marked.agg(F.avg("toxic")).first()[0] or 0.0
    lowest = lambda ids, n: ids.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    chosen = lowest(marked.where("toxic = 1"), positives).withColumn("positive", F.lit(1)).unionByName(
        lowest(docs.where(fold(F.col("doc_id")) != 1), unlabelled).withColumn("positive", F.lit(0)))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = column(batch, "positive").to_numpy()
            for begin, _, row, bucket in grams(column(batch, "text")):
                at, feature = features(row, bucket)
                found, place = np.unique(feature, return_inverse=True)
                toxic = np.bincount(place, kinds[begin + at], minlength=len(found)).astype(np.int64)
                every = np.bincount(place, minlength=len(found))
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(toxic), pa.array(every - toxic)], ["feature", "n_toxic", "n_other"])

    some = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most positives + unlabelled rows
    some = cut(some.dropDuplicates(["doc_id", "positive"]).select("positive", "text"), "sample")
    sizes = {r["positive"]: r["n"] for r in some.groupBy("positive").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2 or not 0 < prior < 1:
        return train([], [], float(prior))

    def leans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic, other = (column(batch, c).to_numpy() for c in ("n_toxic", "n_other"))
            yield batch.select(["feature"]).filter(pa.array(leaning(toxic, other, sizes[1], sizes[0], float(prior))))

    counts = some.mapInArrow(counted, "feature bigint, n_toxic bigint, n_other bigint").groupBy("feature").agg(
        F.sum("n_toxic").alias("n_toxic"), F.sum("n_other").alias("n_other"))
    often = counts.where(F.col("n_toxic") >= LEAST_DOCS).mapInArrow(leans, "feature bigint")
    keys = docs.sparkSession.sparkContext.broadcast(np.sort(often.toArrow()["feature"].to_numpy()))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = column(batch, "positive")
            for begin, n, row, bucket in grams(column(batch, "text")):
                at, feature = features(row, bucket)
                known = np.isin(feature, keys.value)
                at, feature = at[known], feature[known]
                ends = np.searchsorted(at, np.arange(n + 1)).astype(np.int32)
                found = pa.ListArray.from_arrays(pa.array(ends), pa.array(feature.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([kinds.slice(begin, n), found], ["positive", "grams"])

    got = some.mapInArrow(sets, "positive int, grams array<int>").toArrow()
    kinds = got["positive"].to_numpy()
    rows = [a for chunk in got["grams"].chunks for a in np.split(chunk.flatten().to_numpy(), chunk.offsets.to_numpy()[1:-1] - chunk.offsets[0].as_py())] if len(got) else []
    return train([r for r, k in zip(rows, kinds) if k], [r for r, k in zip(rows, kinds) if not k], float(prior))


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """All columns of ``docs`` and the model's score of the whole ``text``, from 0 to 1.

    Null and empty texts have the score of a text without any run.  A column ``name`` of
    ``docs`` is replaced.
    """
    ship(docs.sparkSession)
    docs = docs.drop(name)
    keep = docs.columns

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array(model.scores(column(batch, "text")), pa.float64())
            yield pa.RecordBatch.from_arrays([*[column(batch, c) for c in keep], found], [*keep, name])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(scored, f"{fields}, `{name}` double")
