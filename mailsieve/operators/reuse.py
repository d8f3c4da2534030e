"""Reusing model verdicts by content: same body, same findings, same model, same verdict."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F

from mailsieve import fixed_values as V
from mailsieve.functions.dates import ntz
from mailsieve.functions.sql import lit
from mailsieve.operators.lookup import BROADCAST_BYTES, lookup
from mailsieve.operators.replies import VERDICT
from mailsieve.sources.parts import Parts

_SEP = "\u0001"
_SUB = "\u0002"
_PAIR = "\u0003"


def finding_text(f: str) -> str:
    """Everything that makes two findings equal; neither id nor place in the list."""
    pairs = (
        f"transform(array_sort(map_entries({f}.evidence)), "
        "e -> concat(e.key, '=', coalesce(e.value, '')))"
    )
    return (
        f"concat_ws({lit(_SUB)}, {f}.type, {f}.severity, {f}.description, "
        f"array_join({pairs}, {lit(_PAIR)}))"
    )


def key(body: str, findings: str, model: str) -> str:
    """Content key; the findings are sorted, so their order does not matter."""
    texts = f"array_join(array_sort(transform({findings}, f -> {finding_text('f')})), {lit(_SEP)})"
    return (
        f"concat({lit(V.REUSE_PREFIX)}, "
        f"sha2(concat_ws({lit(_SEP)}, {body}, {texts}, {model}), 256))"
    )


def fresh(store: DataFrame, as_of: datetime) -> DataFrame:
    """The newest verdict per key that is younger than the time to live; of several of one time the
    greatest, field by field, so that the order of rows does not matter."""
    now = ntz(as_of)
    alive = store.where(
        f"produced_at > {now} - INTERVAL {V.REUSE_HOURS} HOURS AND produced_at <= {now}"
    )
    newest = alive.groupBy("key").agg(F.expr("max(struct(produced_at, verdict)) AS _n"))
    return newest.select("key", "_n.verdict", "_n.produced_at")


def hits(keyed: DataFrame, store: DataFrame, as_of: datetime, *, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Mails whose verdict is already known.  Copies of one body share a key, so the
    join splits hot keys unless the store is small."""
    return lookup(keyed, fresh(store, as_of), "key", "inner", limit=limit)


def misses(keyed: DataFrame, store: DataFrame, as_of: datetime) -> DataFrame:
    """Each unknown key once, with one mail to ask about (the smallest id).

    Aggregating before the anti join leaves unique keys on both sides: no hot key.
    """
    wanted = keyed.groupBy("key").agg(
        F.min("email_id").alias("email_id"), F.count("*").alias("mails")
    )
    return wanted.join(fresh(store, as_of).select("key"), "key", "left_anti")


class VerdictStore:
    """Verdicts by key, in parts by the day they were given and the round that asked for them.

    A round's part is written anew when the round is repeated, so a replay leaves the store as it
    was.  Fallbacks are never stored.  Reads touch the two days that a live verdict can lie in.
    """

    def __init__(self, spark: SparkSession, path: str):
        schema = f"key string, verdict {VERDICT}, produced_at timestamp_ntz"
        self.rounds, self.merged = Parts(spark, f"{path}/rounds", schema), Parts(spark, f"{path}/merged", schema)

    def put(self, verdicts: DataFrame, round_no: int) -> None:
        """The valid ones of ``verdicts(key, verdict, attempt_used, produced_at)``."""
        rows = verdicts.where("attempt_used IS NOT NULL AND produced_at IS NOT NULL")
        self.rounds.put(rows.selectExpr("key", "verdict", "produced_at", f"concat(date_format(produced_at, 'yyyyMMdd'), '_{round_no}') AS part"), round_no)

    def _live(self, parts: Parts, as_of: datetime) -> list[str]:
        days = {f"{as_of - timedelta(days=d):%Y%m%d}" for d in range(1 + -(-V.REUSE_HOURS // 24))}
        return [name for name in parts.versions() if name.partition("_")[0] in days]

    def read(self, as_of: datetime) -> DataFrame:
        """Rows of the days of live verdicts; a key may have several (see :func:`fresh`)."""
        return self.merged.read(self._live(self.merged, as_of)).unionByName(self.rounds.read(self._live(self.rounds, as_of)))

    def compact(self, as_of: datetime) -> None:
        """One part a live day, with the newest verdict of a key; what has expired goes.

        The merged parts are marked before the rounds they hold go, so a reader always finds
        every verdict, at worst twice.
        """
        known, merged = self.rounds.versions(), self.merged.versions()
        newest = self.read(as_of).groupBy("key", F.date_format("produced_at", "yyyyMMdd").alias("part")).agg(
            F.expr("max(struct(produced_at, verdict)) AS _n")
        )
        number = max((v[-1] for v in merged.values()), default=0) + 1
        self.merged.put(newest.select("key", "_n.verdict", "_n.produced_at", "part"), number)
        self.rounds.drop(known)
        self.merged.drop(set(merged) - set(self._live(self.merged, as_of)))


def append(verdicts: DataFrame, path: str) -> None:
    """Store valid verdicts (``key, verdict, attempt_used, produced_at``) by day, without rounds:
    for loads that are never repeated.

    Fallbacks are not stored; the newest row per key wins on read.
    """
    keep = verdicts.where("attempt_used IS NOT NULL")
    rows = keep.selectExpr("key", "verdict", "produced_at", "to_date(produced_at) AS day")
    rows.write.mode("append").partitionBy("day").parquet(path)


def read(spark: SparkSession, path: str, as_of: datetime) -> DataFrame:
    """What ``append`` stored; only the two days a live verdict can lie in are scanned."""
    day = f"DATE '{as_of.date()}'"
    return spark.read.parquet(path).where(f"day BETWEEN date_sub({day}, 1) AND {day}").drop("day")
