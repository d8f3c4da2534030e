"""Request limits per user: 60 per minute and 1000 per day, in tumbling buckets.

A request's place in its day is its place among the requests of its second, plus a count of
the seconds before; its place in its minute is the difference to the minute's first request.
No window holds more than one second of one user, whatever the limits are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from mailsieve import fixed_values as V
from mailsieve.functions.shared import cut, numbered

COUNTS = "_user string, _day timestamp_ntz, _minute timestamp_ntz, _n bigint"


def minute_bucket(ts: Column) -> Column:
    return F.date_trunc("minute", ts)


def day_bucket(ts: Column) -> Column:
    return F.date_trunc("day", ts)


def positions(log: DataFrame) -> DataFrame:
    """``log(request_id, user_id, ts)`` with ``_in_minute`` and ``_in_day``, from 0, by time and id.

    Requests without a user, and those without a time, are counted as one user's or at one time.
    """
    ts = F.coalesce(F.col("ts").cast("timestamp_ntz"), F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'"))
    rows = cut(log.select("request_id", "user_id", "ts").withColumns({
        "_user": F.coalesce(F.col("user_id").cast("string"), F.lit("")),
        "_day": day_bucket(ts).cast("timestamp_ntz"),
        "_minute": minute_bucket(ts).cast("timestamp_ntz"),
    }), "log")
    second = F.coalesce(F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts"), F.lit(0))
    order = [F.col("ts"), F.col("request_id")]
    placed = cut(numbered(rows, ["_user", "_day"], order, second, "_in_day"), "placed")
    first = placed.groupBy("_user", "_minute").agg(F.min("_in_day").alias("_first"))
    return placed.join(first, ["_user", "_minute"]).withColumn("_in_minute", F.col("_in_day") - F.col("_first")).drop("_first")


def decide(placed: DataFrame, per_minute: int, per_day: int) -> DataFrame:
    """Decisions from places; refused requests still count; the minute is checked before the day."""
    window = F.when(F.col("_in_minute") >= per_minute, "minute").when(F.col("_in_day") >= per_day, "day")
    return placed.select("request_id", "user_id", "ts", window.isNotNull().alias("rejected"), window.alias("window"))


def decisions(
    log: DataFrame,
    *,
    per_minute: int = V.REQUESTS_PER_MINUTE,
    per_day: int = V.REQUESTS_PER_DAY,
) -> DataFrame:
    """``log(request_id, user_id, ts)`` with ``rejected`` and ``window``."""
    return decide(positions(log), per_minute, per_day)


def bucket_counts(log: DataFrame, width: str = "1 minute") -> DataFrame:
    """Requests per user and bucket; the same on a stream with a watermark on ``ts``."""
    return (
        log.groupBy(F.window("ts", width).alias("w"), "user_id")
        .agg(F.count("*").alias("requests"))
        .select(F.col("w.start").alias("bucket_start"), "user_id", "requests")
    )
