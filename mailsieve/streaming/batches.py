"""Micro-batches through batch plans.

Every live job here is ``foreachBatch``: a batch is an ordinary table, so the batch plans score
it with feeds and verdicts of any size.  A batch writes its own folder and is written anew when
it is repeated, so a restart neither loses nor doubles rows.  State is a table in parts (see
``sources.parts``), of which a batch reads and writes those it touches; the number of the batch
is the version, so a repeated batch finds the state that it found first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from mailsieve.functions.shared import new_path
from mailsieve.sources.parts import Parts

Handle = Callable[[DataFrame, int], DataFrame]


def day_part(ts: str) -> Column:
    """The name of a day's part: its number since 1970."""
    return F.unix_date(F.col(ts).cast("date")).cast("string")


def days_of(rows: DataFrame, ts: str = "ts") -> list[int]:
    """The days that the rows of a batch lie in; rows without a time have none."""
    return sorted(int(r[0]) for r in rows.where(f"{ts} IS NOT NULL").select(day_part(ts)).distinct().collect())


def oldest_kept(state: Parts, keep_days: int | None, batch: int) -> int | None:
    """The oldest day that a batch still finds, ``keep_days`` behind the newest before it; what is older goes.

    Asked at the beginning of a batch, so that a repeated batch finds the same.
    """
    before = [int(name) for name, versions in state.versions().items() if versions[0] < batch]
    if keep_days is None or not before:
        return None
    oldest = max(before) - keep_days
    state.drop([str(day) for day in before if day < oldest])
    return oldest


def work_folder(spark: SparkSession) -> str:
    """A new folder for one run, under the shared checkpoint folder."""
    return new_path(spark, "run")


def run(stream: DataFrame, handle: Handle, folder: str | None = None, *, once: bool = True):
    """Starts the job.  With ``once``, what there is is processed and the output comes back as
    a table; otherwise the running query is returned and writes ``<folder>/out``."""
    spark = stream.sparkSession
    folder = folder or work_folder(spark)

    def step(rows: DataFrame, batch: int) -> None:
        handle(rows, batch).write.mode("overwrite").parquet(f"{folder}/out/batch={batch}")

    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/log")
    if not once:
        return writer.start()
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out").drop("batch")


def append(rows: DataFrame, folder: str, *, once: bool = True):
    """A stream of finished rows, written to ``<folder>/out`` as they come out; with ``once`` until
    all there is has been taken in."""
    writer = rows.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/log").option("path", f"{folder}/out")
    query = (writer.trigger(availableNow=True) if once else writer).start()
    if once:
        query.awaitTermination()
    return query
