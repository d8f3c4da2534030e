"""Analyzers of the user's own, next to the built-in ones.

SQL analyzers stay on the JVM.  Python analyzers get Arrow batches; a row that makes
one fail loses that analyzer's findings only, and says so.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from mailsieve import fixed_values as V
from mailsieve.functions.dates import ntz
from mailsieve.operators.findings import RAW, collect

Rule = Callable[[dict], list]


def sql_analyzer(rules: list[str]) -> Callable[[DataFrame, str], DataFrame]:
    """An analyzer of finding expressions (see ``findings.finding``)."""

    def add(df: DataFrame, to: str) -> DataFrame:
        return df.selectExpr(*df.columns, f"{collect(rules)} AS {to}")

    return add


_OUT = T.StructType(
    [T.StructField("findings", T.ArrayType(RAW)), T.StructField("error", T.StringType())]
)


def _run(name: str, rule: Rule, mail: dict) -> tuple[list, str | None]:
    try:
        found = rule(mail)
        if not isinstance(found, list):
            return [], f"unexpected result type: {type(found).__name__}"
        out = []
        for f in found:
            evidence = {k: v if isinstance(v, str) else json.dumps(v) for k, v in f.get("evidence", {}).items()}
            signal = evidence.setdefault("signal", name)
            out.append((
                name, signal, f["type"], f["severity"], V.SEVERITY_WEIGHT.get(f["severity"], 0),
                f["description"], evidence,
            ))
        return out, None
    except Exception as exc:        # any failure is this row's and this analyzer's alone
        return [], f"{type(exc).__name__}: {exc}"


def python_analyzer(
    name: str, rule: Rule, fields: list[str], *, errors_to: str | None = None
) -> Callable[[DataFrame, str], DataFrame]:
    """``rule`` maps a dict of ``fields`` to a list of dicts
    ``type, severity, description, evidence``."""
    names = RAW.names

    @F.pandas_udf(_OUT)
    def apply(mails: pd.DataFrame) -> pd.DataFrame:
        done = [_run(name, rule, row) for row in mails.to_dict("records")]
        return pd.DataFrame(
            {
                "findings": [[dict(zip(names, f)) for f in found] for found, _ in done],
                "error": [error for _, error in done],
            }
        )

    def add(df: DataFrame, to: str) -> DataFrame:
        kept = df.columns
        ran = df.withColumn("_ran", apply(F.struct(*fields)))
        cols = [F.col("_ran.findings").alias(to)]
        if errors_to:
            cols.append(F.col("_ran.error").alias(errors_to))
        return ran.select(*kept, *cols)

    return add


Answer = Callable[[list[dict]], str]
ANSWERS = "key string, attempt int, raw_response string, error string"


def model_port(setup: Callable[[], Answer], model: str, as_of: datetime) -> Callable[[DataFrame], DataFrame]:
    """A model called from the workers: ``setup`` opens it, once for each task, and gives a function from
    messages (dicts of ``role`` and ``content``) to the raw answer.

    The port turns ``(key, attempt, messages)`` into ``(key, attempt, model, produced_at,
    raw_response, error)``.  Rows come in batches, so a task holds one batch at a time.  A call that
    fails has a null answer and says why; it fails no other row.
    """

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        answer = setup()
        for rows in batches:
            out = []
            for key, attempt, messages in zip(rows["key"], rows["attempt"], rows["messages"]):
                try:
                    out.append((key, attempt, answer([{"role": m["role"], "content": m["content"]} for m in messages]), None))
                except Exception as exc:        # the call's failure is this row's alone
                    out.append((key, attempt, None, f"{type(exc).__name__}: {exc}"))
            yield pd.DataFrame(out, columns=["key", "attempt", "raw_response", "error"])

    def port(asked: DataFrame) -> DataFrame:
        told = asked.select("key", F.col("attempt").cast("int").alias("attempt"), "messages").mapInPandas(call, ANSWERS)
        return told.selectExpr("key", "attempt", f"'{model}' AS model", f"{ntz(as_of)} AS produced_at", "raw_response", "error")

    return port
