"""Intermediate tables in the folder that all machines share, and exact numbering of rows."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

BUCKET_ROWS = 20_000


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; one of our own only where none is set.

    Without the setting the default file system is used.  A local default file system is
    fine for a single machine only, so a cluster without either is an error.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        jvm = context._jvm
        files = jvm.org.apache.hadoop.fs.FileSystem.get(context._jsc.hadoopConfiguration())
        if files.getScheme() != "file":
            folder = f"{files.getHomeDirectory()}/mailsieve"
        elif context.master.startswith("local["):
            folder = f"file://{jvm.System.getProperty('java.io.tmpdir')}/mailsieve"
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


def files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def new_path(spark: SparkSession, name: str) -> str:
    """An unused path in the shared folder; what is written there goes when the application ends."""
    base = f"{shared_folder(spark)}/mailsieve-{spark.sparkContext.applicationId}"
    system, target = files(spark, base)
    system.deleteOnExit(target)
    return f"{base}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """``df`` written in the shared folder and read back: no lineage, survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Deletes the files of a table that ``cut`` gave, once nothing reads it any more."""
    for path in {file.rpartition("/")[0] for file in df.inputFiles()}:
        system, target = files(df.sparkSession, path)
        system.delete(target, True)


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front of it until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def numbered(df: DataFrame, group: list[str], order: list[Column], bucket: Column, name: str = "idx") -> DataFrame:
    """``df`` with ``name``: 0, 1, 2 ... within ``group``, by bucket and then by ``order``.

    ``bucket`` is a non-negative integer that spreads the rows of a group evenly, so that no
    window holds more than one bucket; a group's offsets come from one count per bucket.
    The columns of ``group`` hold no nulls.
    ``df`` is read twice: cut it before if it is costly.
    """
    at, offset, part, n = (unused(df, c) for c in ("_at", "_offset", "_bucket", "_n"))
    rows = df.withColumn(part, bucket)
    counts = rows.groupBy(*group, part).agg(F.count("*").alias(n))
    before = Window.partitionBy(*group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*group, part, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(offset))
    inside = F.row_number().over(Window.partitionBy(*group, part).orderBy(*order)) - 1
    return rows.withColumn(at, inside).join(offsets, [*group, part]).withColumn(name, F.col(at) + F.col(offset)).drop(part, at, offset)


def buckets(rows: int, per: int = BUCKET_ROWS) -> int:
    return max(1, -(-rows // per))


def ship(spark: SparkSession) -> None:
    """Gives the workers this package, once per application, so that they can import it."""
    import os
    import tempfile
    import zipfile

    context = spark.sparkContext
    if getattr(context, "_mailsieve_shipped", False):
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    handle, path = tempfile.mkstemp(suffix=".zip")
    with os.fdopen(handle, "wb") as out, zipfile.ZipFile(out, "w") as bundle:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    bundle.write(full, os.path.relpath(full, os.path.dirname(package)))
    context.addPyFile(path)
    context._mailsieve_shipped = True
