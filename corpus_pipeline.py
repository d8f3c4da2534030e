"""From raw documents to packed sequences, stage by stage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from mailsieve.functions.shared import new_path, unused
from mailsieve.llm import mixing, neardup, packing, secrets, toxicity
from mailsieve.llm.queries import SHARES


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on these documents, does not call toxic.

    Null and empty texts score like texts without any feature and stay; a null doc_id and repeated
    rows are judged by their texts alone.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = toxicity.fit(docs, labels)
    score = unused(docs, "score")
    return toxicity.score(docs, model, score).where(F.col(score) < toxicity.THRESHOLD).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of exact and near copies: that with the smallest doc_id.

    Classes are of texts, so different texts under one doc_id stay, and of rows that repeat both
    one stays; a copy without a doc_id goes like any other.  Documents without a text all stay.
    """
    return neardup.unique(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret replaced by its kind in brackets; a null text stays null."""
    import public_tokenizers

    found = secrets.scan(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    masked = secrets.redact(found)
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.when(F.size("spans") > 0, F.length("text").cast(docs.schema["n_chars"].dataType))
                                   .otherwise(F.col("n_chars")))
    return masked.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mix; those without a source are one source."""
    return mixing.mix(docs, SHARES).orderBy("mix_slot", "mix_place").select(*docs.columns)


def _ordered(docs: DataFrame, place: str, row: str) -> DataFrame:
    """``docs`` with two columns to sort by: file and row of what is read from files, in which the
    stage before wrote it.  Rows of no file have no order; they are mixed here."""
    try:
        read = docs.metadataColumn("_metadata")
        return docs.withColumns({place: read["file_name"], row: read["row_index"]})
    except AnalysisException:
        return mixing.mix(docs, SHARES).withColumnsRenamed({"mix_slot": place, "mix_place": row})


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in the sequences, which follow the rows as the mix wrote them."""
    import public_tokenizers

    order = unused(docs, "place"), unused(docs, "row")
    pieces = packing.cut_documents(_ordered(docs, *order), public_tokenizers.path("byte_bpe_50k.json"), end_id=0, carry=order)
    shown = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    pieces = pieces.withColumn("ids_crc32", F.crc32("ids")).select(*shown, *order)
    return packing.place(pieces, order=(*order, "start")).select(*shown, "class", "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near-duplicates", drop_copies),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: The classifier, the samples and the vocabularies are beyond SQL; tests hold each stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage is written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
