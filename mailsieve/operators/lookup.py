"""Joins against side tables whose size is not known in advance.

``bounded`` measures a side with one aggregate job; only a side proven small is
broadcast.  Beyond the bound both sides shuffle, and hot keys of the big side, those with more
than ``HOT_ROWS`` rows and more than one row in ``MOST_HOT``, are split over ``SALTS`` tasks; there
are less than ``MOST_HOT`` of them however large the table is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from mailsieve.functions.shared import shared_folder

BROADCAST_BYTES = 64 * 1024 * 1024
HOT_ROWS = 1_000_000
MOST_HOT = 1_000
SALTS = 64


def measured_bytes(df: DataFrame) -> int:
    """Bytes of text in ``df`` plus a fixed cost per field, by a partial aggregate."""
    row = F.lit(16 * (len(df.columns) + 1))
    for field in df.schema.fields:
        text = F.col(field.name) if field.dataType.simpleString() == "string" else F.to_json(
            F.struct(F.col(field.name))
        )
        row = row + F.coalesce(F.octet_length(text), F.lit(0))
    total = df.agg(F.sum(row.cast("bigint")).alias("bytes")).first()["bytes"]
    return int(total or 0)


def bounded(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    return measured_bytes(df) <= limit


def hot_keys(df: DataFrame, key: str, rows: int = HOT_ROWS) -> DataFrame:
    """Keys with more than ``rows`` rows and more than one row in ``MOST_HOT``: less than ``MOST_HOT`` keys."""
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"))
    return counts.where(F.col("_n") > max(rows, df.count() // MOST_HOT)).select(key)


def lookup(
    big: DataFrame,
    side: DataFrame,
    key: str,
    how: str = "inner",
    *,
    row_id: str = "email_id",
    limit: int = BROADCAST_BYTES,
    hot_rows: int = HOT_ROWS,
    salts: int = SALTS,
) -> DataFrame:
    """``big`` joined with ``side`` (unique by ``key``); ``how`` is inner or left.

    ``row_id`` tells rows of ``big`` apart; the salt comes from it, so a recomputed task
    puts every row where it was.
    """
    if bounded(side, limit):
        return big.join(F.broadcast(side), key, how)
    # `big` is read twice from here on (hot keys, join): cut its lineage first
    big = cut_lineage(big)
    hot = F.broadcast(hot_keys(big, key, hot_rows).withColumn("_hot", F.lit(True)))
    spread = F.pmod(F.xxhash64(row_id), F.lit(salts)).cast("int")
    left = big.join(hot, key, "left").withColumn("_salt", F.when(F.col("_hot") | F.col(key).isNull(), spread).otherwise(0))
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    right = side.join(hot, key, "left").withColumn("_salt", F.explode(copies)).drop("_hot")
    return left.drop("_hot").join(right, [key, "_salt"], how).drop("_salt")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint in the shared folder; survives the loss of executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
