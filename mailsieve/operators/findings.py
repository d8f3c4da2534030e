"""Building, merging and unfolding findings.

Array form: one ``array<struct>`` column per analyzer next to the e-mail.  No
shuffle, so it works on batches and streams alike.  Long form: one row per finding.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame, types as T

from mailsieve import fixed_values as V
from mailsieve.functions.sql import case, lit
from mailsieve.schema import FINDING

#: a finding before its place in the e-mail's list is known
RAW = T.StructType([f for f in FINDING.fields if f.name != "ordinal"])
NONE = f"CAST(array() AS array<{RAW.simpleString()}>)"


def weight(severity: str) -> str:
    """Points of a severity; unknown names weigh nothing."""
    return case(*[(f"{severity} = {lit(s)}", str(w)) for s, w in V.SEVERITY_WEIGHT.items()], otherwise="0")


def severity_rank(severity: str) -> str:
    """0 for the worst; unknown names rank with LOW."""
    ranks = [(f"upper({severity}) = {lit(s)}", str(i)) for i, s in enumerate(V.SEVERITIES)]
    return case(*ranks, otherwise=str(len(V.SEVERITIES) - 1))


def finding(
    hit: str, analyzer: str, signal: str, kind: str, severity: str, description: str,
    evidence: dict[str, str],
) -> str:
    """The finding where ``hit`` holds, else null.

    ``severity`` is a name or an expression; ``description`` and the values of
    ``evidence`` are expressions.
    """
    if severity in V.SEVERITY_WEIGHT:
        points, severity = str(V.SEVERITY_WEIGHT[severity]), lit(severity)
    else:
        points = weight(severity)
    pairs = "".join(f", {lit(k)}, CAST({v} AS STRING)" for k, v in evidence.items())
    built = (
        f"named_struct('analyzer', {lit(analyzer)}, 'signal', {lit(signal)}, 'type', {lit(kind)}, "
        f"'severity', {severity}, 'weight', {points}, 'description', {description}, "
        f"'evidence', map('signal', {lit(signal)}{pairs}))"
    )
    return case((hit, built))


def collect(findings: Iterable[str]) -> str:
    """Those that fired, in the order given."""
    return f"CAST(array_compact(array({', '.join(findings)})) AS array<{RAW.simpleString()}>)"


def merge(arrays: Iterable[str]) -> str:
    """One list per e-mail, each finding with its place in it."""
    whole = "concat(" + ", ".join(f"coalesce({a}, {NONE})" for a in arrays) + ")"
    fields = ", ".join(f"'{n}', f.{n}" for n in RAW.names)
    return f"transform({whole}, (f, i) -> named_struct({fields}, 'ordinal', i))"


def finding_id(email_id: str, signal: str, ordinal: str) -> str:
    """Stable across re-runs, unlike a random UUID."""
    return (
        f"sha2(concat_ws({lit(chr(1))}, CAST({email_id} AS STRING), {signal}, "
        f"CAST({ordinal} AS STRING)), 256)"
    )


def unfold(df: DataFrame, findings: str, keep: Iterable[str] = ("email_id",)) -> DataFrame:
    """Long form of one array column.

    Not ``explode`` and not ``inline``: for these Catalyst infers "the list is not empty",
    pushes that below the projections and so builds every list twice.  The outer form
    gives the same rows once its all-null row for an empty list is dropped.
    """
    return df.selectExpr(*keep, f"inline_outer({findings})").where("signal IS NOT NULL")


def union_all(parts: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
