"""From e-mails to explained verdicts in one pass over the bodies.

All rules are expressions on the row, so up to the optional join with model verdicts
the plan has no shuffle, and bodies are dropped as soon as they have been read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from datetime import datetime

from pyspark.sql import DataFrame

from mailsieve import fixed_values as V
from mailsieve.functions.sql import case, lit
from mailsieve.functions.text import registrable, sender_domain
from mailsieve.operators import attachments, content, domains, headers, reputation, score, temporal
from mailsieve.operators.findings import finding_id, merge
from mailsieve.operators.lookup import BROADCAST_BYTES, lookup

#: analyzers per profile, in the order their findings are listed
PROFILES = {
    "full": ["headers", "domains", "attachments", "content", "temporal", "reputation"],
    "wired": ["attachments", "content", "temporal", "reputation"],
}

Extra = Callable[[DataFrame, str], DataFrame]


def analyze(
    emails: DataFrame,
    as_of: datetime,
    *,
    listed: DataFrame | None = None,
    profile: str = "full",
    keep: Iterable[str] = ("email_id",),
    extras: dict[str, Extra] | None = None,
    feed_limit: int = BROADCAST_BYTES,
    max_urls: int | None = V.MAX_URLS,
) -> DataFrame:
    """``keep`` plus ``findings``, the ordered list of all findings of each mail.

    ``emails(email_id, sender, body, headers, attachments[, registered_date])``.
    ``extras`` are further analyzers: functions that add the named array column.
    """
    keep = list(keep)
    names = PROFILES[profile]
    wanted = ["email_id", "sender", "body", "headers", "attachments"]
    wanted += [c for c in ("registered_date", "sender_domain") if c in emails.columns]
    df = emails if extras else emails.select(*dict.fromkeys([*wanted, *keep]))
    for name, add in (extras or {}).items():
        df = add(df, f"{name}_findings")
    df = content.add(df)
    if listed is not None:
        df = reputation.with_urls(df)
    # from here on the body is gone, unless the caller asked for it
    df = df.select(*[c for c in df.columns if c != "body" or "body" in keep])
    df = attachments.add(df)
    df = temporal.add(df, as_of)
    if "headers" in names:
        df = headers.add(df)
    if "domains" in names:
        df = domains.add(df, as_of.date())
    slim = keep + [f"{n}_findings" for n in [*names, *(extras or {})] if n != "reputation"]
    if listed is not None:
        slim = slim + ["_urls"] + (["email_id"] if "email_id" not in keep else [])
    df = df.select(*slim)
    df = reputation.add(df, listed, limit=feed_limit, max_urls=max_urls)
    order = [*names, *(extras or {})]
    return df.selectExpr(*keep, f"{merge(f'{n}_findings' for n in order)} AS findings")


def with_registration(emails: DataFrame, dates: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Add ``registered_date`` from a table ``registrable_domain, registered_date``.

    Big providers are hot keys here, hence the join that splits them.
    """
    domain = registrable(f"lower({sender_domain('sender')})")
    keyed = emails.selectExpr("*", f"{domain} AS registrable_domain")
    return lookup(keyed, dates, "registrable_domain", "left", limit=limit).drop("registrable_domain")


NO_VERDICT = "CAST(NULL AS struct<semantic_score:int,rationale:string>)"


def with_gate(analyzed: DataFrame, has_model: bool = True) -> DataFrame:
    """Add ``rule_score`` and ``gate_reason``, null in the gray zone."""
    scored = analyzed.selectExpr("*", f"{score.rule_score('findings')} AS rule_score")
    return scored.selectExpr("*", f"{score.gate_reason('rule_score', str(has_model).lower())} AS gate_reason")


def fused(joined: DataFrame, kept: Iterable[str]) -> DataFrame:
    """Fused score, band, warning and explanation of gated rows with the model's verdict in ``_v``, null if it has none."""
    flagged = joined.selectExpr(
        *kept, "rule_score", "gate_reason",
        "gate_reason IS NOT NULL AS llm_gated",
        "gate_reason IS NULL AND _v IS NOT NULL AS llm_available",
        "CASE WHEN gate_reason IS NULL THEN _v END AS llm_result",
    )
    final = case(
        ("llm_available", score.fuse("rule_score", "llm_result.semantic_score")),
        otherwise="CAST(rule_score AS DECIMAL(6,2))",
    )
    return flagged.selectExpr(
        *kept, "rule_score", "gate_reason", "llm_gated", "llm_available", "llm_result",
        f"{score.one_decimal('rule_score')} AS deterministic_score",
        f"{score.one_decimal(final)} AS final_score",
        f"{score.risk_level(final, 'llm_available')} AS risk_level",
        "size(findings) AS finding_count",
        f"{score.warning('llm_gated', 'llm_available')} AS semantic_warning",
        f"{score.explanation('llm_result.rationale', 'llm_gated', 'llm_available')} AS explanation",
    )


def verdicts(analyzed: DataFrame, semantic: DataFrame | None = None) -> DataFrame:
    """Add score, gate, fused score, band, warning and explanation.

    ``semantic(email_id, verdict)`` holds one checked model verdict per mail.  Without
    the table every mail is gated; a gray-zone mail without a row took the failed path.
    ``plans.exchange`` asks the model itself and joins the gray zone only.
    """
    gated = with_gate(analyzed, semantic is not None)
    if semantic is None:
        return fused(gated.selectExpr("*", f"{NO_VERDICT} AS _v"), analyzed.columns)
    return fused(gated.join(semantic.selectExpr("email_id", "verdict AS _v"), "email_id", "left"), analyzed.columns)


def score_emails(
    emails: DataFrame,
    *,
    as_of: datetime,
    listed: DataFrame | None = None,
    semantic: DataFrame | None = None,
    profile: str = "full",
    keep: Iterable[str] = ("email_id",),
    extras: dict[str, Extra] | None = None,
    feed_limit: int = BROADCAST_BYTES,
    max_urls: int | None = V.MAX_URLS,
) -> DataFrame:
    """The whole way from mails to verdicts, for a table or a micro-batch of any size.

    ``max_urls`` links of a mail are looked up; None looks up all, at the price of a shuffle.
    """
    analyzed = analyze(
        emails, as_of, listed=listed, profile=profile, keep=keep, extras=extras,
        feed_limit=feed_limit, max_urls=max_urls,
    )
    return verdicts(analyzed, semantic)


def response(scored: DataFrame) -> DataFrame:
    """Verdicts in the nested shape that is written out as JSON."""

    shown = (
        f"named_struct('id', {finding_id('email_id', 'f.signal', 'f.ordinal')}, 'type', f.type, "
        "'severity', f.severity, 'description', f.description, 'evidence', f.evidence, "
        "'source', f.signal, 'analyzer', f.analyzer)"
    )
    names = {f.name for f in scored.schema["llm_result"].dataType.fields}
    indicators = (
        "llm_result.social_engineering_indicators"
        if "social_engineering_indicators" in names
        else "CAST(array() AS array<struct<category:string>>)"
    )
    llm = case((
        "llm_available",
        "named_struct('score', llm_result.semantic_score, 'semantic_score', llm_result.semantic_score, "
        f"'risk_level', '', 'rational', llm_result.rationale, 'findings', {indicators})",
    ))
    return scored.selectExpr(
        "email_id", "final_score", "risk_level", "deterministic_score",
        f"transform(findings, f -> {shown}) AS deterministic_findings",
        "llm_available", "llm_gated", f"{llm} AS llm_result", "semantic_warning", "explanation",
        f"{lit(V.RESPONSE_SCHEMA_VERSION)} AS schema_version",
    )
