"""Tables that grow in named parts, each part in numbered versions.

A write puts new versions of the parts it touches into a folder of its own, in one job, and
then marks each of them with an empty file; readers see marked versions only, so a broken write
is invisible and a repeated one takes the place of its first try.  A reader names the parts it
needs and, if it wants the table as it was, a version: with the number of a micro-batch as the
version, a repeated batch reads what its first try read.  A listing of the marks is all that is
done on the driver.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from mailsieve.functions.shared import files


class Parts:
    """``schema`` has no column ``part``; names of parts hold letters, digits, ``-`` and ``_``."""

    def __init__(self, spark: SparkSession, path: str, schema: str, form: str = "parquet"):
        self.spark, self.path, self.schema, self.form = spark, path, schema, form

    def versions(self) -> dict[str, list[int]]:
        """The marked versions of every part, oldest first."""
        system, folder = files(self.spark, f"{self.path}/marks")
        found: dict[str, list[int]] = {}
        if system.exists(folder):
            for status in system.listStatus(folder):
                name, _, version = status.getPath().getName().rpartition(".")
                found.setdefault(name, []).append(int(version))
        return {name: sorted(got) for name, got in found.items()}

    def _newest(self, names: Iterable[str] | None, before: int | None) -> dict[str, int]:
        marked = self.versions()
        wanted = marked if names is None else [n for n in names if n in marked]
        usable = {n: [v for v in marked[n] if before is None or v < before] for n in wanted}
        return {n: v[-1] for n, v in usable.items() if v}

    def read(self, names: Iterable[str] | None = None, before: int | None = None) -> DataFrame:
        """The newest version of the named parts, or of all; with ``before``, the newest below that number."""
        paths = [f"{self.path}/data/{v}/part={n}" for n, v in self._newest(names, before).items()]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).format(self.form).load(paths)

    def put(self, rows: DataFrame, version: int, names: Iterable[str] | None = None) -> None:
        """Versions of the parts that the column ``part`` of ``rows`` names.

        ``names`` are parts that get the version even without a row.  The newest version before
        stays for a repeated try; older ones go.
        """
        target = f"{self.path}/data/{version}"
        rows.write.mode("overwrite").partitionBy("part").format(self.form).save(target)
        system, folder = files(self.spark, target)
        written = {s.getPath().getName().partition("=")[2] for s in system.listStatus(folder) if s.isDirectory()}
        touched = written | set(names or ())
        for name in touched - written:
            system.mkdirs(files(self.spark, f"{target}/part={name}")[1])
        before = self._newest(touched, version)
        for name in sorted(touched):
            system.create(files(self.spark, f"{self.path}/marks/{name}.{version}")[1], True).close()
        self._drop(before)

    def drop(self, names: Iterable[str]) -> None:
        """Parts that are no longer wanted, in all versions."""
        self._drop({n: None for n in names})

    def _drop(self, below: dict[str, int | None]) -> None:
        """Versions below the given one go, marks first."""
        marked = self.versions()
        for name, version in below.items():
            for old in [v for v in marked.get(name, []) if version is None or v < version]:
                for path in (f"{self.path}/marks/{name}.{old}", f"{self.path}/data/{old}/part={name}"):
                    system, target = files(self.spark, path)
                    system.delete(target, True)
