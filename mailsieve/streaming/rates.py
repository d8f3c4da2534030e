"""Request limits and bucket totals on a live log."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from mailsieve import fixed_values as V
from mailsieve.functions.shared import cut
from mailsieve.operators import limits
from mailsieve.streaming.batches import Handle, Parts, day_part, days_of, oldest_kept


def decisions(
    counts: Parts,
    *,
    per_minute: int = V.REQUESTS_PER_MINUTE,
    per_day: int = V.REQUESTS_PER_DAY,
    keep_days: int | None = None,
) -> Handle:
    """For ``batches.run`` over ``(request_id, user_id, ts)``: a decision for every request.

    Within a batch requests come by time and id, after all of earlier batches; late ones meet the
    counters of their own day and minute, however old.  ``counts`` holds a counter for each user
    and minute, in a part a day; a batch reads and writes the days of its requests only.  Days
    more than ``keep_days`` behind the newest are dropped if that is set, and what arrives for
    them later is refused with the window ``expired``: it cannot pass a limit it has used up.
    """

    def handle(rows: DataFrame, batch: int) -> DataFrame:
        oldest = oldest_kept(counts, keep_days, batch)
        placed = cut(limits.positions(rows), "placed")
        expired = F.lit(False) if oldest is None else F.unix_date(F.col("_day").cast("date")) < oldest
        known = counts.read(map(str, days_of(placed, "_day")), batch)
        now = placed.where(~expired).groupBy("_user", "_day", "_minute").agg(F.count("*").alias("_n"))
        total = known.unionByName(now).groupBy("_user", "_day", "_minute").agg(F.sum("_n").alias("_n"))
        counts.put(total.withColumn("part", day_part("_day")), batch)
        before = known.groupBy("_user", "_day").agg(F.sum("_n").alias("_before_day"))
        minutes = known.select("_user", "_minute", F.col("_n").alias("_before_minute"))
        moved = placed.join(before, ["_user", "_day"], "left").join(minutes, ["_user", "_minute"], "left").withColumns({
            "_in_day": F.col("_in_day") + F.coalesce("_before_day", F.lit(0)),
            "_in_minute": F.col("_in_minute") + F.coalesce("_before_minute", F.lit(0)),
        })
        live = limits.decide(moved.where(~expired), per_minute, per_day)
        late = moved.where(expired).select("request_id", "user_id", "ts", F.lit(True).alias("rejected"), F.lit("expired").alias("window"))
        return live.unionByName(late)

    return handle


def window_counts(log: DataFrame, width: str = "1 minute", lateness: str = "1 day") -> DataFrame:
    """Totals per user and bucket of a stream ``(user_id, ts)``, for append mode.

    A bucket comes out once the newest time is ``lateness`` past its end, and leaves the state
    then; what arrives for it later is not counted.  Requests without a time have no bucket.
    """
    dated = log.where("ts IS NOT NULL").withWatermark("ts", lateness)
    return limits.bucket_counts(dated, width)
