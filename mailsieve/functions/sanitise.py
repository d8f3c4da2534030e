"""Making a body safe to embed in a prompt."""

from __future__ import annotations

from pyspark.sql import DataFrame

from mailsieve import fixed_values as V
from mailsieve.functions.sql import case, lit
from mailsieve.functions.text import nfkc, translate_by, utf8_cut


def strip_zero_width(body: str) -> str:
    return f"translate({body}, {lit(V.ZERO_WIDTH)}, '')"


def replace_confusables(normal: str) -> str:
    return translate_by(normal, V.BODY_CONFUSABLES)


def neutralise_roles(text: str) -> str:
    for token, safe in V.ROLE_TOKENS:
        text = f"replace({text}, {lit(token)}, {lit(safe)})"
    return text


def truncate(text: str, max_bytes: int = V.MAX_PROMPT_BYTES) -> str:
    """Cut at a character boundary within ``max_bytes`` and say so."""
    cut = f"concat({utf8_cut(text, max_bytes)}, {lit(V.CUT_MARKER)})"
    return case((f"octet_length({text}) > {max_bytes}", cut), otherwise=text)


def add(
    df: DataFrame,
    body: str = "body",
    *,
    to: str = "sanitised",
    mutations: str | None = None,
    max_bytes: int = V.MAX_PROMPT_BYTES,
) -> DataFrame:
    """Add the sanitised body and, if asked for, the list of changes made to it."""
    kept = df.columns
    source = f"coalesce({body}, '')"
    stripped = df.selectExpr(*kept, f"{source} AS _s0", f"{strip_zero_width(source)} AS _s1")
    normal = stripped.selectExpr(*kept, "_s0", "_s1", f"{nfkc('_s1')} AS _s2")
    mapped = normal.selectExpr(*kept, "_s0", "_s1", "_s2", f"{replace_confusables('_s2')} AS _s3")
    ready = mapped.selectExpr(*kept, "_s0", "_s1", "_s2", "_s3", f"{neutralise_roles('_s3')} AS _s4")
    out = [f"{truncate('_s4', max_bytes)} AS {to}"]
    if mutations:
        out.append(f"{_mutations(max_bytes)} AS {mutations}")
    return ready.selectExpr(*kept, *out)


def _mutations(max_bytes: int) -> str:
    tail = lit(f"_chars_to_{max_bytes}_bytes")
    flags = [
        case(("length(_s1) != length(_s0)", lit("zero_width_chars_stripped"))),
        case(("_s3 != _s2", lit("homograph_chars_replaced"))),
        # no replacement makes or breaks another token, so one text serves all tests
        *[
            case((f"contains(_s3, {lit(token)})", lit(f"role_token_neutralized:{token!r}")))
            for token, _safe in V.ROLE_TOKENS
        ],
        case((
            f"octet_length(_s4) > {max_bytes}",
            f"concat('truncated:', CAST(length(_s0) AS STRING), {tail})",
        )),
    ]
    return f"array_compact(array({', '.join(flags)}))"
