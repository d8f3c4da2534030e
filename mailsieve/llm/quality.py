"""Quality rules: base measures, and a hashed n-gram log-likelihood ratio.

Words and word pairs are hashed into a fixed number of buckets.  Two multinomials over the
buckets, one of trusted documents and one of all, give each bucket a log ratio; a document's
score is the mean over its n-grams, and a fixed threshold decides.  All of it is column
expressions: a document's words never leave its row.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, functions as F

BUCKETS = 1 << 16
SMOOTHING = 1.0
TARGET_DOCS = 20_000
THRESHOLD = -0.1
LEAST_WORDS, MOST_REPEATED = 50, 50

# fixed values: what parts words, and the signs counted as symbols
SPACE = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


def _words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def _bucket(*grams: Column) -> Column:
    return F.pmod(F.xxhash64(*grams), F.lit(BUCKETS)).cast("int")


def _grams(words: Column) -> Column:
    """Buckets of all words and of all pairs of neighbours."""
    pairs = F.transform(words, lambda w, i: _bucket(w, F.get(words, i + 1)))
    return F.concat(F.transform(words, lambda w: _bucket(w)), F.slice(pairs, 1, F.greatest(F.size(words) - 1, F.lit(0))))


def measures(docs: DataFrame) -> DataFrame:
    """``doc_id``, the base measures, and ``words``.

    A null text has no words.  Words are runs without white space; all counts are of code
    points and words of the whole text.  A three-word window is one integer, the high bits of
    its hash over its place; sorted, equal windows are neighbours.  At least 40 bits of hash
    are left for texts of up to 16 million words.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), _words(text).alias("words"))
    lines = F.filter(F.split("text", "\n"), lambda line: F.translate(line, SPACES, "") != "")
    without = lambda signs: F.length(F.translate("text", signs, ""))
    words = F.col("words")
    hashes = F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))
    rows = rows.select(
        "doc_id", "words",
        F.size("words").cast("bigint").alias("n_words"),
        without(SPACES).cast("bigint").alias("word_chars"),
        (F.length("text") - without(SYMBOLS)).cast("bigint").alias("n_symbols"),
        lines.alias("lines"),
        F.slice(hashes, 1, F.greatest(F.size("words") - 2, F.lit(0))).alias("windows"),
        F.expr("shiftleft(1L, length(bin(size(words)))) - 1").alias("mask"),
    )
    high = F.bitwise_not(F.col("mask"))
    packed = F.sort_array(F.transform("windows", lambda h, i: h.bitwiseAND(high).bitwiseOR(i.cast("bigint"))))
    rows = rows.withColumn("windows", packed)
    same = lambda x, y: x.bitwiseAND(high) == y.bitwiseAND(high)
    windows = F.col("windows")
    twice = F.filter(windows, lambda x, i: same(x, F.get(windows, i - 1)) | same(x, F.get(windows, i + 1)))
    places = F.sort_array(F.transform(twice, lambda x: x.bitwiseAND(F.col("mask"))))
    zero = F.lit(0).cast("bigint")
    covered = F.aggregate(
        places,
        F.struct(zero.alias("sum"), zero.alias("end")),
        lambda a, p: F.struct((a["sum"] + p + 3 - F.greatest(p, a["end"])).alias("sum"), (p + 3).alias("end")),
        lambda a: a["sum"],
    )
    return rows.select(
        "doc_id", "words", "n_words", "word_chars", "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
    )


def log_ratios(docs: DataFrame, trusted: DataFrame, *, target_docs: int = TARGET_DOCS) -> list[float]:
    """Log of target over raw probability for each bucket.

    Raw counts cover all of ``docs``.  The target is the documents in ``trusted(doc_id)``, at
    most ``target_docs`` of them, those whose id hashes lowest.  The counts that reach the
    driver are one row a bucket.
    """
    ids = trusted.where(F.col("doc_id").isNotNull()).select("doc_id").distinct()
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(target_docs)
    words = docs.select("doc_id", _words(F.coalesce(F.col("text"), F.lit(""))).alias("words"))
    marked = words.join(F.broadcast(ids.withColumn("target", F.lit(1))), "doc_id", "left")  # at most target_docs rows
    grams = marked.select(F.coalesce("target", F.lit(0)).alias("target"), F.explode(_grams(F.col("words"))).alias("bucket"))
    counts = grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("target").alias("target"))
    found = {r["bucket"]: (r["raw"], r["target"]) for r in counts.collect()}
    raw_all, target_all = (sum(c[i] for c in found.values()) for i in (0, 1))
    if not target_all:
        return [0.0] * BUCKETS
    share = target_all / raw_all
    pairs = (found.get(b, (0, 0)) for b in range(BUCKETS))
    # counts against what the raw share would give, both with the same addition: 0 where little is known
    return [round(log(t + SMOOTHING) - log(r * share + SMOOTHING), 4) for r, t in pairs]


def judge(docs: DataFrame, trusted: DataFrame, *, threshold: float = THRESHOLD, target_docs: int = TARGET_DOCS) -> DataFrame:
    """Base measures, ``base_failed``, ``score`` and ``kept`` for every row of ``docs(doc_id, text)``.

    Texts without words score 0; without trusted documents every score is 0.  Every document
    is judged by the same fixed threshold, repeated rows each on their own.
    """
    ratios = log_ratios(docs, trusted, target_docs=target_docs)
    # one folded literal: a short decimal a bucket
    table = F.split(F.lit(",".join(map(str, ratios))), ",").cast("array<double>")
    total = F.aggregate(_grams(F.col("words")), F.lit(0.0), lambda a, b: a + F.get(table, b))
    failed = (F.col("n_words") < LEAST_WORDS) | (F.lit(100) * F.col("n_repeat_words") > F.lit(MOST_REPEATED) * F.col("n_words"))
    rows = measures(docs).withColumn("base_failed", failed)
    score = total / F.greatest(2 * F.col("n_words") - 1, F.lit(1))
    return rows.withColumn("score", score).drop("words").withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))
