"""First contact between a sender and a recipient on a live stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from mailsieve.functions.shared import cut, files
from mailsieve.operators import temporal
from mailsieve.sources.parts import Parts
from mailsieve.streaming.batches import Handle

PAIRS = "sender string, recipient string"
BUCKET_PAIRS = 200_000


class PairStore:
    """All pairs so far, in 2^level buckets by hash, each a part of the level's table.

    A batch reads and writes the buckets of its own pairs.  When the buckets it wrote hold more
    than ``bucket_pairs`` pairs on average, all are split in two into the table of the next level,
    so what a batch of so many pairs reads is bounded whatever has been stored before; the
    splitting is paid off by the doubling.
    """

    def __init__(self, spark: SparkSession, path: str, bucket_pairs: int = BUCKET_PAIRS):
        self.spark, self.path, self.bucket_pairs = spark, path, bucket_pairs

    def parts(self, level: int) -> Parts:
        return Parts(self.spark, f"{self.path}/{level}", PAIRS)

    def level(self, batch: int) -> int:
        """The last level that was whole before the batch; the levels below it go."""
        system, folder = files(self.spark, self.path)
        if not system.exists(folder):
            return 0
        levels = sorted(int(s.getPath().getName()) for s in system.listStatus(folder))
        whole = [at for at in levels if at == 0 or sum(v[0] < batch for v in self.parts(at).versions().values()) == 1 << at]
        level = max(whole, default=0)
        for at in levels:
            if at < level:
                system.delete(files(self.spark, f"{self.path}/{at}")[1], True)
        return level

    @staticmethod
    def _bucket(level: int) -> Column:
        return F.xxhash64("sender", "recipient").bitwiseAND(F.lit((1 << level) - 1)).cast("string")

    def known(self, pairs: DataFrame, batch: int) -> tuple[int, list[str], DataFrame]:
        """The level, the buckets of ``pairs`` and what they held before the batch."""
        level = self.level(batch)
        names = sorted(r[0] for r in pairs.select(self._bucket(level)).distinct().collect())
        return level, names, self.parts(level).read(names, batch)

    def put(self, level: int, names: list[str], rows: DataFrame, batch: int) -> None:
        """The buckets ``names`` as they are after the batch."""
        parts = self.parts(level)
        parts.put(rows.withColumn("part", self._bucket(level)), batch, names)
        if names and parts.read(names).count() > self.bucket_pairs * len(names):
            finer = [str(i) for i in range(2 << level)]
            self.parts(level + 1).put(parts.read().withColumn("part", self._bucket(level + 1)), batch, finer)


def first_contacts(pairs: PairStore | Parts, *, history: DataFrame | None = None, internal_domains: list[str] | None = None) -> Handle:
    """For ``batches.run`` over ``(email_id, sender, recipient, ts)``: the batch operator against the
    earlier pairs, of earlier batches and of ``history``.  New pairs go to the store."""
    store = pairs if isinstance(pairs, PairStore) else PairStore(pairs.spark, pairs.path)

    def handle(rows: DataFrame, batch: int) -> DataFrame:
        level, names, known = store.known(rows.select("sender", "recipient"), batch)
        before = known if history is None else known.unionByName(history.select("sender", "recipient"))
        found = cut(temporal.first_contacts(rows, history=before, internal_domains=internal_domains), "found")
        store.put(level, names, known.unionByName(found.select("sender", "recipient")), batch)
        return found

    return handle
