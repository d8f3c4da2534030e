"""Mixing sources to target weights by Pfair scheduling.

A source with weight w gets a release time floor(i / w) and a deadline ceil((i + 1) / w) for
its i-th block; earliest deadline first puts every block between the two, so no source is a
whole block away from its target at any point.  With weights as whole shares of a period the
schedule repeats, so one period, worked out once, places every block by division.  When a
source runs out, the others go on with their weights scaled up: no document is dropped.
"""

from __future__ import annotations

import heapq
from math import gcd

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from mailsieve.functions.shared import buckets, numbered, ship

BLOCK_DOCS = 16
OTHER = "(other)"
LONGEST_PERIOD = 100_000
MOST_SLOTS = 4_000_000


def one_period(shares: dict[str, int]) -> dict[str, np.ndarray]:
    """The slots of each source in one period of ``sum(shares)`` slots."""
    period = sum(shares.values())
    releases = sorted((i * period // n, -(-(i + 1) * period // n), s) for s, n in shares.items() for i in range(n))
    slots: dict[str, list[int]] = {s: [] for s in shares}
    ready: list[tuple[int, str]] = []
    at = 0
    for slot in range(period):
        while at < len(releases) and releases[at][0] <= slot:
            heapq.heappush(ready, releases[at][1:])
            at += 1
        slots[heapq.heappop(ready)[1]].append(slot)
    return {s: np.array(v, np.int64) for s, v in slots.items()}


def schedule(blocks: dict[str, int], shares: dict[str, int]) -> dict[str, list[tuple[int, int, int, np.ndarray]]]:
    """For each source its phases: first block, first slot, period, slots in a period.

    A phase ends when a source has run out; there are at most as many phases as sources.
    """
    left = {s: n for s, n in blocks.items() if n}
    phases: dict[str, list] = {s: [] for s in left}
    start = 0
    while left:
        divisor = gcd(*(shares[s] for s in left))
        slots = one_period({s: shares[s] // divisor for s in left})
        period = sum(map(len, slots.values()))
        end = min((n - 1) // len(slots[s]) * period + int(slots[s][(n - 1) % len(slots[s])]) for s, n in left.items()) + 1
        for s in list(left):
            phases[s].append((blocks[s] - left[s], start, period, slots[s]))
            left[s] -= end // period * len(slots[s]) + int(np.searchsorted(slots[s], end % period))
            if not left[s]:
                del left[s]
        start += end
    return phases


def mix(docs: DataFrame, shares: dict[str, int], *, other: int = 1, block_docs: int = BLOCK_DOCS, seed: int = 0) -> DataFrame:
    """``docs`` with ``mix_source``, ``mix_block`` (number within the source), ``mix_slot`` (the
    block's place in the mix) and ``mix_place`` (the document's place in the block); columns of
    these names are replaced.

    ``shares`` are whole numbers; all other sources share ``other`` equally, each with blocks,
    release times and deadlines of its own, null among them as ``(other)``.  The period, the sum
    of all weights as whole numbers, is at most ``LONGEST_PERIOD``, which bounds the number of
    sources; so are all periods together at most ``MOST_SLOTS``.  Within a source documents come
    in an order that hashes of ``seed`` and doc_id give; equal rows are taken in any order.  The
    last block of a source may be short.
    """
    if other < 1 or any(n < 1 for n in shares.values()):
        raise ValueError("shares are at least 1")
    ship(docs.sparkSession)
    docs = docs.drop("mix_source", "mix_block", "mix_slot", "mix_place")
    rows = docs.withColumn("mix_source", F.coalesce("source", F.lit(OTHER)))
    counts = {r["mix_source"]: r["n"] for r in rows.groupBy("mix_source").agg(F.count("*").alias("n")).limit(LONGEST_PERIOD + 1).collect()}
    unnamed = [s for s in counts if s not in shares]
    parts = max(1, len(unnamed))
    weights = {s: n * parts for s, n in shares.items()} | {s: other for s in unnamed}
    if sum(weights.values()) > LONGEST_PERIOD:
        raise ValueError("the weights of all sources are more than LONGEST_PERIOD in all")
    blocks = {s: -(-n // block_docs) for s, n in counts.items()}
    phases = schedule(blocks, weights)
    if sum(len(p[3]) for found in phases.values() for p in found) > MOST_SLOTS:
        raise ValueError("the periods of all phases are more than MOST_SLOTS in all")
    order = F.xxhash64(F.lit(seed), F.col("doc_id"))
    spread = F.pmod(order, F.lit(buckets(sum(counts.values())))).cast("int")
    rows = numbered(rows, ["mix_source"], [order, F.col("doc_id")], spread, "mix_block")

    @F.pandas_udf("bigint")
    def slot(source: pd.Series, block: pd.Series) -> pd.Series:
        out = np.zeros(len(block), np.int64)
        for name, at in source.groupby(source).indices.items():
            wanted = block.to_numpy()[at]
            firsts = np.array([p[0] for p in phases[name]])
            phase = np.searchsorted(firsts, wanted, "right") - 1
            for i in np.unique(phase):
                first, start, period, slots = phases[name][i]
                turn, rest = np.divmod(wanted[phase == i] - first, len(slots))
                out[at[phase == i]] = start + turn * period + slots[rest]
        return pd.Series(out)

    return (
        rows.withColumn("mix_place", F.pmod(F.col("mix_block"), F.lit(block_docs)))
        .withColumn("mix_block", F.floor(F.col("mix_block") / block_docs))
        .withColumn("mix_slot", slot("mix_source", "mix_block"))
    )
