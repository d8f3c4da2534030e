"""SPF, DKIM and DMARC results as the receiving server recorded them: three findings per mail."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame

from mailsieve import fixed_values as V
from mailsieve.functions.sql import case, lit, literal_map
from mailsieve.functions.text import clip, header, ignore_case, strip
from mailsieve.operators.findings import collect, finding

NAME = "headers"
KIND = "AUTHENTICATION_FAILURE"
SIGNALS = ["spf", "dkim", "dmarc"]
_TEXTS = {"spf": V.SPF_TEXT, "dkim": V.DKIM_TEXT, "dmarc": V.DMARC_TEXT}


def _result(text: str, pattern: str) -> str:
    return f"nullif(lower(regexp_extract({text}, {lit(ignore_case(pattern))}, 1)), '')"


def detail(check: str, result: str) -> str:
    """Human text of a result; the words of ``unknown`` for anything else."""
    texts = _TEXTS[check]
    return f"coalesce(try_element_at({literal_map(texts)}, {result}), {lit(texts['unknown'])})"


def results(df: DataFrame) -> DataFrame:
    """Add the header texts (``_ar, _rs, _sig``) and the results parsed from them."""
    kept = df.columns
    read = df.selectExpr(
        *kept,
        f"coalesce({header('headers', 'authentication-results')}, '') AS _ar",
        f"{strip('coalesce(' + header('headers', 'received-spf') + ', ' + lit('') + ')')} AS _rs",
        f"{header('headers', 'dkim-signature')} AS _sig",
    )
    return read.selectExpr(
        *kept, "_ar", "_rs", "_sig",
        f"{_result('_ar', r'\bspf=(' + '|'.join(V.SPF_RESULTS) + ')')} AS _spf",
        f"{_result('_rs', '^(' + '|'.join(V.SPF_RESULTS) + ')')} AS _spf2",
        f"{_result('_ar', r'\bdkim=(' + '|'.join(V.DKIM_RESULTS) + ')')} AS _dkim",
        f"{_result('_ar', r'\bdmarc=(' + '|'.join(V.DMARC_RESULTS) + ')')} AS _dmarc",
    )


def _rules() -> dict[str, tuple[str, str, str, str]]:
    """Result, severity, text and source header per check."""
    raw = clip("_ar", V.RAW_HEADER_CHARS)
    spf = "coalesce(_spf, _spf2)"
    return {
        "spf": (
            f"coalesce({spf}, 'none')",
            case((f"{spf} = 'fail'", "'HIGH'"), (f"{spf} = 'softfail'", "'MEDIUM'"), otherwise="'LOW'"),
            case((f"{spf} IS NULL", lit(V.TEXT_SPF_MISSING)), otherwise=detail("spf", spf)),
            case(("_spf IS NOT NULL", raw), ("_spf2 IS NOT NULL", clip("_rs", V.RAW_HEADER_CHARS)),
                 otherwise="''"),
        ),
        "dkim": (
            "coalesce(_dkim, 'none')",
            case(("_dkim IN ('fail', 'permerror')", "'HIGH'"), otherwise="'LOW'"),
            case(("_dkim IS NOT NULL", detail("dkim", "_dkim")),
                 ("_sig IS NOT NULL", lit(V.TEXT_DKIM_UNVERIFIED)), otherwise=lit(V.TEXT_DKIM_MISSING)),
            case(("_dkim IS NOT NULL", raw), ("_sig IS NOT NULL", clip("_sig", V.RAW_SIGNATURE_CHARS)),
                 otherwise="''"),
        ),
        "dmarc": (
            "coalesce(_dmarc, 'none')",
            case(("_dmarc = 'fail'", "'HIGH'"), ("_dmarc IS NULL OR _dmarc = 'none'", "'MEDIUM'"),
                 otherwise="'LOW'"),
            case(("_dmarc IS NULL", lit(V.TEXT_DMARC_MISSING)), otherwise=detail("dmarc", "_dmarc")),
            case(("_dmarc IS NOT NULL", raw), otherwise="''"),
        ),
    }


def add(df: DataFrame, *, only: Iterable[str] | None = None, to: str = "headers_findings") -> DataFrame:
    wanted = set(SIGNALS if only is None else only)
    out = [
        finding("true", NAME, name, KIND, severity, text, {"result": result, "raw_header": source})
        for name, (result, severity, text, source) in _rules().items()
        if name in wanted
    ]
    return results(df).selectExpr(*df.columns, f"{collect(out)} AS {to}")
