"""Where results go: nested JSON verdicts, audit rows, quarantined requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from mailsieve.operators import validate
from mailsieve.plans import reports, scoring
from mailsieve.sources.parts import Parts


class LiveTable:
    """The output of a live job, by kind, with a part for each batch and kind.

    A batch is seen whole or not at all: its files are marked once all of them are there, and a
    repeated batch takes the place of its first try.  ``form`` is parquet or json.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, form: str = "parquet"):
        self.parts = Parts(spark, path, schema, form)

    def put(self, rows: DataFrame, batch: int, kind: Column | str = "all") -> None:
        """``kind``: a name for all rows, or a column of names; all kinds are written in one job."""
        named = F.lit(kind) if isinstance(kind, str) else kind
        self.parts.put(rows.withColumn("part", F.concat(named, F.lit(f"_{batch}"))), batch)

    def read(self, kind: str = "all") -> DataFrame:
        return self.parts.read([n for n in self.parts.versions() if n.rpartition("_")[0] == kind])


def write_responses(scored: DataFrame, path: str, mode: str = "append") -> None:
    scoring.response(scored).write.mode(mode).json(path)


def write_audit(emails: DataFrame, scored: DataFrame, path: str, mode: str = "append") -> None:
    reports.audit_request(emails).write.mode(mode).parquet(f"{path}/requests")
    reports.audit_verdict(scored).write.mode(mode).parquet(f"{path}/verdicts")


def split_invalid(requests: DataFrame, quarantine: str, mode: str = "append") -> DataFrame:
    """Write refused requests with their reasons; return the valid ones."""
    validate.rejected(requests).write.mode(mode).json(quarantine)
    return validate.valid(requests)
