"""Tables over verdicts and findings: audit rows, risk report, lists for display."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from mailsieve import fixed_values as V
from mailsieve.functions.sql import case, listing
from mailsieve.functions.text import sender_domain
from mailsieve.operators.findings import severity_rank


def audit_request(emails: DataFrame) -> DataFrame:
    """What may be logged about a request: sizes and the sender domain, no content."""
    return emails.selectExpr(
        "email_id",
        f"{sender_domain('sender')} AS sender_domain",
        "length(subject) AS subject_length",
        "length(body) AS body_length",
        "cardinality(headers) AS header_count",
        "size(attachments) AS attachment_count",
    )


def audit_verdict(scored: DataFrame) -> DataFrame:
    return scored.select(
        "email_id", "final_score", "risk_level", "llm_available", "llm_gated", "finding_count"
    )


def risk_report(scored: DataFrame) -> DataFrame:
    """Mails per band and gate reason, with exact sums and a rounded mean."""
    return scored.groupBy("risk_level", F.expr("coalesce(gate_reason, 'none') AS gate_reason")).agg(
        F.expr("count(*) AS emails"),
        F.expr("CAST(sum(final_score) AS DECIMAL(20,1)) AS sum_score"),
        F.expr("CAST(round(sum(final_score) / count(*), 2) AS DECIMAL(10,2)) AS avg_score"),
        F.expr("sum(finding_count) AS findings"),
    )


def shown_severity(severity: str) -> str:
    """Upper case; unknown or missing counts as LOW."""
    upper = f"upper({severity})"
    return case((f"{upper} IN ({listing(V.SEVERITIES)})", upper), otherwise="'LOW'")


def by_severity(findings: DataFrame) -> DataFrame:
    """Findings per mail and severity, one column each."""
    named = findings.selectExpr("email_id", f"{shown_severity('severity')} AS _s")
    return named.groupBy("email_id").agg(
        *[F.expr(f"count(CASE WHEN _s = '{s}' THEN 1 END) AS {s.lower()}") for s in V.SEVERITIES]
    )


def display_order(findings: str) -> str:
    """The list worst first, otherwise in list order."""
    ranked = (
        f"array_sort(transform({findings}, f -> named_struct("
        f"'r', {severity_rank('f.severity')}, 'o', f.ordinal)))"
    )
    return f"transform({ranked}, r -> element_at({findings}, r.o + 1))"
