"""Rule score, gate, fusion and risk band, as SQL expressions.

Points are integers and the fused score an exact decimal, so no result depends on
floating-point order.
"""

from __future__ import annotations

from mailsieve import fixed_values as V
from mailsieve.functions.sql import case, lit


def rule_score(findings: str) -> str:
    """Sum of the weights, capped; 0 without findings."""
    return f"least(aggregate({findings}, 0, (acc, f) -> acc + coalesce(f.weight, 0)), {V.SCORE_CAP})"


def rule_score_long(weight: str) -> str:
    """The same as an aggregate over the long form."""
    return f"CAST(least(coalesce(sum({weight}), 0), {V.SCORE_CAP}) AS INT)"


def gate_reason(score: str, has_model: str = "true") -> str:
    """Why no model verdict is wanted; null if one is."""
    return case(
        (f"NOT {has_model}", "'no_llm_provider'"),
        (f"{score} < {V.GRAY_ZONE_LOW}", "'below_lower_threshold'"),
        (f"{score} > {V.GRAY_ZONE_HIGH}", "'above_upper_threshold'"),
    )


def fuse(score: str, model_score: str) -> str:
    whole = f"({score} * {V.RULES_PERCENT} + {model_score} * {V.MODEL_PERCENT})"
    return f"CAST(least(CAST({whole} AS DECIMAL(10,0)) / 100, {V.SCORE_CAP}) AS DECIMAL(6,2))"


def one_decimal(score: str) -> str:
    return f"CAST(round(CAST({score} AS DECIMAL(6,2)), 1) AS DECIMAL(6,1))"


def _ladder(score: str, bands: list[tuple[int, str]]) -> str:
    return case(*[(f"{score} >= {floor}", lit(band)) for floor, band in bands], otherwise="'benign'")


def risk_level(score: str, fused: str) -> str:
    """Band of the unrounded score; the top band needs a model score."""
    return case((fused, _ladder(score, V.FUSED_BANDS)), otherwise=_ladder(score, V.RULES_ONLY_BANDS))


def explanation(rationale: str, gated: str, available: str) -> str:
    return case(
        (gated, lit(V.STATUS_SKIPPED)),
        (available, f"concat(coalesce({rationale}, ''), {lit(V.STATUS_DONE)})"),
        otherwise=lit(V.STATUS_FAILED),
    )


def warning(gated: str, available: str) -> str:
    return case((gated, lit(V.WARNING_GATED)), (available, "''"), otherwise=lit(V.WARNING_FAILED))
