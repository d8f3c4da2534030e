"""Asking a model about the mails that need it: two plans around a call made elsewhere.

``begin`` scores mails, gates them, and gives one question for each content that is in the gray
zone and has no verdict yet, however many mails share it.  Somebody asks a model and lands the
raw answers; ``retries`` says what to ask once more.  ``finish`` checks the answers, stores the
valid ones for reuse, and spreads the verdicts over all mails of a content.  Mails outside the
gray zone are never sanitised, hashed or joined.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from mailsieve import fixed_values as V
from mailsieve.functions import sanitise
from mailsieve.functions.shared import cut
from mailsieve.functions.sql import case, lit
from mailsieve.operators import replies, reuse
from mailsieve.operators.lookup import BROADCAST_BYTES, lookup
from mailsieve.plans import scoring


@dataclass
class Round:
    """``scored``: every mail with ``key``, null outside the gray zone.  ``asks(key, email_id, mails,
    model, prompt_version, prompt)``: one row a question, on behalf of ``mails`` mails."""

    scored: DataFrame
    asks: DataFrame


def keyed(analyzed: DataFrame, model: str) -> DataFrame:
    """``analyzed(email_id, body, findings, ...)``, all findings there are, with ``rule_score``,
    ``gate_reason``, ``sanitised`` and ``key``, the last two in the gray zone only.

    The mails are analysed once and written, without their bodies.
    """
    kept = [c for c in analyzed.columns if c != "body"]
    gated = scoring.with_gate(analyzed)
    body = case(("gate_reason IS NULL", "coalesce(body, '')"))
    safe = sanitise.add(gated.selectExpr(*[c for c in gated.columns if c != "body"], f"{body} AS body"))
    gray = {"sanitised": "sanitised", "key": reuse.key("sanitised", "findings", lit(model))}
    shown = [f"{case(('gate_reason IS NULL', value))} AS {name}" for name, value in gray.items()]
    return cut(safe.selectExpr(*kept, "rule_score", "gate_reason", *shown), "keyed")


def questions(scored: DataFrame, store: reuse.VerdictStore, as_of: datetime, model: str) -> Round:
    """One question for each content of the gray zone without a live verdict in the store.

    Of the mails of one content the smallest id is asked for; that is a min-aggregate, combined
    before the shuffle, so a content that a third of all mails share is no hot key.
    """
    wanted = scored.where("key IS NOT NULL").groupBy("key").agg(
        F.min("email_id").alias("email_id"), F.count("*").alias("mails"), F.expr("min_by(struct(findings, sanitised), email_id) AS _m")
    )
    known = reuse.fresh(store.read(as_of), as_of).select("key")
    asks = wanted.join(known, "key", "left_anti").selectExpr(
        "key", "email_id", "mails", f"{lit(model)} AS model", f"{lit(V.PROMPT_VERSION)} AS prompt_version",
        f"{replies.prompt('_m.findings', '_m.sanitised')} AS prompt",
    )
    return Round(scored.drop("sanitised"), cut(asks, "asks"))


def begin(analyzed: DataFrame, store: reuse.VerdictStore, as_of: datetime, model: str) -> Round:
    return questions(keyed(analyzed, model), store, as_of, model)


def retries(asked: Round, answers: DataFrame) -> DataFrame:
    """What to ask once more, ``(key, attempt, reason, messages)``: the question, the refused answer
    and the correction, for contents whose only landed answer so far is refused.  A call that failed,
    which has no answer, is not repeated.

    ``answers(key, attempt, model, produced_at, raw_response)``.
    """
    landed = replies.check(answers).groupBy("key").agg(
        F.count("*").alias("n"), F.expr("min_by(struct(attempt, reason, raw_response), attempt) AS _a")
    )
    refused = landed.where("n = 1 AND _a.attempt = 0 AND _a.reason IS NOT NULL AND _a.raw_response IS NOT NULL")
    talk = ", ".join(
        f"named_struct('role', {lit(role)}, 'content', {content})"
        for role, content in (("user", "prompt"), ("assistant", "coalesce(_a.raw_response, '')"), ("user", lit(V.RETRY_INSTRUCTION)))
    )
    return asked.asks.join(refused, "key").selectExpr("key", "_a.attempt + 1 AS attempt", "_a.reason", f"array({talk}) AS messages")


def ask(asked: Round, port: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """All questions put to a model on the spot (see ``custom.model_port``), refused answers once more.

    Both passes are written, so no question is asked again when a plan is run twice.
    """
    one = "array(named_struct('role', 'user', 'content', prompt))"
    first = cut(port(asked.asks.selectExpr("key", "0 AS attempt", f"{one} AS messages")), "answers")
    return first.unionByName(cut(port(retries(asked, first.drop("error"))), "answers"))


def finish(
    asked: Round, answers: DataFrame, store: reuse.VerdictStore, as_of: datetime, round_no: int, *, limit: int = BROADCAST_BYTES
) -> DataFrame:
    """Every mail with its verdict, as ``scoring.verdicts`` gives them, and ``key`` and ``origin``:
    ``asked``, ``reused`` or ``fallback``, null without a verdict.

    A content none of whose answers is valid gets the fallback, which is not stored; one without
    any answer took the failed path.  Only the gray zone is joined, its hot contents split.
    """
    picked = cut(replies.pick(replies.check(answers), key="key", attempts=V.REPLY_ATTEMPTS), "picked")
    store.put(picked, round_no)
    asks = asked.asks.select("key")
    now = picked.join(asks, "key", "left_semi").selectExpr("key", "verdict", "CASE WHEN attempt_used IS NULL THEN 'fallback' ELSE 'asked' END AS origin")
    before = reuse.fresh(store.read(as_of), as_of).join(asks, "key", "left_anti").selectExpr("key", "verdict", "'reused' AS origin")
    known = now.unionByName(before).withColumnRenamed("verdict", "_v")
    gray = lookup(asked.scored.where("key IS NOT NULL"), known, "key", "left", limit=limit)
    rest = asked.scored.where("key IS NULL").selectExpr("*", f"CAST(NULL AS {replies.VERDICT}) AS _v", "CAST(NULL AS STRING) AS origin")
    kept = [c for c in asked.scored.columns if c not in ("rule_score", "gate_reason")]
    return scoring.fused(gray.unionByName(rest), [*kept, "origin"])
