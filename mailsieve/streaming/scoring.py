"""Scoring mails as they arrive: each micro-batch goes through the batch plan."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from mailsieve.plans.scoring import score_emails
from mailsieve.streaming.batches import Handle


def read(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """A folder of Parquet files, oldest first."""
    source = spark.readStream.schema(spark.read.parquet(path).schema)
    return source.option("maxFilesPerTrigger", files_per_batch).parquet(path)


def scored(
    as_of: datetime,
    *,
    emails: Callable[[DataFrame], DataFrame] | None = None,
    listed: DataFrame | None = None,
    semantic: DataFrame | None = None,
    **options,
) -> Handle:
    """For ``batches.run``; ``emails`` makes the e-mail table from a batch, ``listed`` may have any size."""

    def handle(rows: DataFrame, batch: int) -> DataFrame:
        mails = emails(rows) if emails else rows
        return score_emails(mails, as_of=as_of, listed=listed, semantic=semantic, **options)

    return handle
