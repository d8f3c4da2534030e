"""Passing a content key once per 24 hours; copies within that time are held back.

In the order of arrival (batches, then time, then id) a row passes unless a row of its key that
has passed is less than 24 hours away, before or after.  Within a batch that is a chain: from a
key's first open row to the next that is 24 hours on, and so on.  Each row knows its successor,
and the rows on the chain are found by pointer doubling, in as many rounds as the logarithm of
the longest chain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from mailsieve import fixed_values as V
from mailsieve.functions.shared import cut
from mailsieve.streaming.batches import Handle, Parts, day_part, days_of, oldest_kept

STATE = "key string, ts timestamp_ntz"
PIECES = 24  # a horizon is cut into so many pieces of time; rows of one key and piece are sorted in one task


def _micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def _open(points: DataFrame, passed: DataFrame, width: int) -> DataFrame:
    """Points of no passed row less than ``width`` away: an equi-join on slots of that width, of
    which a key's passed rows fill each at most once."""
    held = passed.select("key", _micros("ts").alias("p")).withColumn("slot", F.explode(F.array(*[F.floor(F.col("p") / width) + d for d in (-1, 0, 1)])))
    near = F.expr(f"a.key = h.key AND a.slot = h.slot AND abs(a.t - h.p) < {width}")
    return points.withColumn("slot", F.floor(F.col("t") / width)).alias("a").join(held.alias("h"), near, "left_anti").drop("slot")


def _successors(points: DataFrame, width: int) -> DataFrame:
    """``(key, t, n)``: for each of ``points(key, t)`` the key's next point at least ``width`` on, if there is one.

    A row looks into the piece of time that lies ``width`` on, and else takes the first point of
    a later piece.  So no window holds more than one key's points of a piece, or its pieces.
    """
    piece = width // PIECES
    placed = points.select("key", "t", F.floor(F.col("t") / piece).alias("piece"))
    asked = placed.select("key", (F.col("piece") + PIECES).alias("piece"), (F.col("t") + width).alias("at"), F.col("t").alias("own"), F.lit(None).cast("bigint").alias("point"))
    there = placed.select("key", "piece", F.col("t").alias("at"), F.lit(None).cast("bigint").alias("own"), F.col("t").alias("point"))
    down = Window.partitionBy("key", "piece").orderBy(F.desc("at"), F.col("point").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    inside = asked.unionByName(there).withColumn("n", F.last("point", ignorenulls=True).over(down)).where("own IS NOT NULL")
    # the first point of any later piece, worked out once a key and piece
    firsts = placed.groupBy("key", "piece").agg(F.min("t").alias("first"))
    wanted = placed.select("key", (F.col("piece") + PIECES).alias("piece"), F.lit(None).cast("bigint").alias("first")).distinct()
    over = Window.partitionBy("key").orderBy(F.desc("piece"), F.col("first").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    later = firsts.unionByName(wanted).withColumn("later", F.last("first", ignorenulls=True).over(over)).where("first IS NULL").drop("first")
    return inside.join(later, ["key", "piece"]).select("key", F.col("own").alias("t"), F.coalesce("n", "later").alias("n")).where("n IS NOT NULL")


def _chains(points: DataFrame, width: int, rounds: list[int] | None = None) -> DataFrame:
    """Of ``points(key, t)`` those met by going from a key's first point from successor to successor."""
    met = points.groupBy("key").agg(F.min("t").alias("t"))
    hop = cut(_successors(points, width), "hop")
    while True:
        new = cut(met.join(hop, ["key", "t"]).select("key", F.col("n").alias("t")), "met")
        if rounds is not None:
            rounds.append(1)
        if new.isEmpty():
            return met
        met = met.unionByName(new)
        on = hop.select("key", F.col("t").alias("n"), F.col("n").alias("m"))
        hop = cut(hop.join(on, ["key", "n"]).select("key", "t", F.col("m").alias("n")), "hop")


def pass_once(rows: DataFrame, passed: DataFrame, hours: int = V.REUSE_HOURS, rounds: list[int] | None = None) -> DataFrame:
    """The rows of ``rows(id, key, ts)`` that pass, with ``passed(key, ts)`` of earlier batches.

    Rows without a key or a time have nothing to be compared with and pass.  Copies at one time
    are one point, combined before the shuffle, so copies that are a third of all mail are no
    hot group.
    """
    width = hours * 3_600_000_000
    whole = "key IS NOT NULL AND ts IS NOT NULL"
    points = rows.where(whole).groupBy("key", "ts").agg(F.min("id").alias("id")).withColumn("t", _micros("ts"))
    left = cut(_open(points, passed, width), "open")
    chain = _chains(left.select("key", "t"), width, rounds)
    through = left.join(chain, ["key", "t"]).select("id", "key", "ts")
    return rows.where(f"NOT ({whole})").select("id", "key", "ts").unionByName(through)


def first_within(state: Parts, hours: int = V.REUSE_HOURS, keep_days: int | None = None) -> Handle:
    """For ``batches.run`` over ``(id, key, ts)``: what passes.

    The state is every passed time, in a part a day; a batch reads the days its rows reach and
    writes its own days anew, so neither grows with the days that have gone by.  Days more than
    ``keep_days`` behind the newest are dropped if that is set; what arrives for them later passes.
    """

    def handle(rows: DataFrame, batch: int) -> DataFrame:
        oldest_kept(state, keep_days, batch)
        rows = cut(rows.select("id", "key", "ts"), "arrived")
        days, reach = days_of(rows.where("key IS NOT NULL")), -(-hours // 24)
        around = sorted({day + k for day in days for k in range(-reach, reach + 1)})
        passed = cut(pass_once(rows, state.read(map(str, around), batch), hours), "passed")
        own = [str(day) for day in days]
        dated = passed.where("key IS NOT NULL AND ts IS NOT NULL").select("key", "ts")
        state.put(state.read(own, batch).unionByName(dated).withColumn("part", day_part("ts")), batch, own)
        return passed

    return handle
