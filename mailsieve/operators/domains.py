"""Sender-domain rules: age, homographs, typosquatting, brand names as subdomains.

The brand list is a small constant, so every comparison happens inside the row
(`filter` over a literal array).  There is no join with the brands and no shuffle by
domain, hence a provider that sends a third of all mail is no hot spot.
"""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date

from pyspark.sql import DataFrame

from mailsieve import fixed_values as V
from mailsieve.functions.dates import iso_date
from mailsieve.functions.sql import case, fill, listing, lit
from mailsieve.functions.text import NON_ASCII, fold_domain, registrable, sender_domain, strip
from mailsieve.operators.findings import RAW, collect, finding

NAME = "domains"
KIND = "DOMAIN_LOOKALIKE"
SIGNALS = ["domain_age", "homograph", "typosquatting", "subdomain_abuse"]
BRANDS = f"array({listing(V.BRANDS)})"


def _label(brand: str) -> str:
    return f"substring_index({brand}, '.', 1)"


def prepare(df: DataFrame, as_of: date) -> DataFrame:
    """Add the working columns every domain rule reads.

    The domain is ``sender_domain`` if the mail has that column, else it is cut
    from ``sender``.
    """
    kept = df.columns
    source = "sender_domain" if "sender_domain" in kept else sender_domain("sender")
    registered = "registered_date" if "registered_date" in kept else "CAST(NULL AS STRING)"
    named = df.selectExpr(
        *kept, f"lower({strip(source)}) AS _domain", f"{iso_date(registered)} AS _born"
    )
    # the NFKC step is non-deterministic to Spark, which keeps this projection apart:
    # the folded name is computed once, however many rules use it
    folded = named.selectExpr(*kept, "_domain", "_born", f"{fold_domain('_domain')} AS _folded")
    return folded.selectExpr(
        *kept, "_domain", "_born", "_folded",
        f"{registrable('_folded')} AS _folded_reg",
        f"{registrable('_domain')} AS _reg",
        f"datediff(DATE '{as_of}', _born) AS _age",
    )


def typosquats(folded_registrable: str) -> str:
    """``array<struct<brand, edits>>`` of brands one or two edits away, in list order."""
    scored = (
        f"transform({BRANDS}, b -> named_struct('brand', b, "
        f"'edits', levenshtein({folded_registrable}, b, {V.MAX_EDITS})))"
    )
    # beyond the threshold the distance is -1, an exact match is 0: neither counts
    return f"filter({scored}, s -> s.edits >= 1)"


def prefix_abuse(domain: str, reg: str) -> str:
    """Brands that the domain starts with although it belongs to somebody else."""
    return f"filter({BRANDS}, b -> startswith({domain}, concat(b, '.')) AND {reg} != b)"


def label_abuse(domain: str, reg: str) -> str:
    """Brands whose first label is a label of a foreign domain."""
    return (
        f"filter({BRANDS}, b -> contains(concat('.', {domain}, '.'), concat('.', {_label('b')}, '.')) "
        f"AND {reg} != b AND {reg} != concat({_label('b')}, '.com') "
        f"AND NOT endswith({domain}, concat('.', b)))"
    )


def _age() -> str:
    young, recent = f"_age < {V.YOUNG_DAYS}", f"_age < {V.RECENT_DAYS}"
    parts = {"domain": "_domain", "date": "_born", "days": "_age"}
    severity = case(("_born IS NULL OR _age < 0", "'LOW'"), (young, "'HIGH'"), otherwise="'MEDIUM'")
    text = case(
        ("_born IS NULL", fill(V.TEXT_AGE_UNKNOWN, **parts)),
        ("_age < 0", fill(V.TEXT_AGE_FUTURE, **parts)),
        (young, fill(V.TEXT_AGE_YOUNG, **parts)),
        otherwise=fill(V.TEXT_AGE_RECENT, **parts),
    )
    return finding(
        f"_born IS NULL OR {recent}", NAME, "domain_age", KIND, severity, text,
        {"domain": "_domain", "matched_brand": "''"},
    )


def _homograph(brand: str = f"array_contains({BRANDS}, _folded_reg)") -> str:
    text = case(
        (brand, fill(V.TEXT_HOMOGRAPH_BRAND, domain="_domain", brand="_folded_reg")),
        otherwise=fill(V.TEXT_HOMOGRAPH, domain="_domain"),
    )
    return finding(
        f"rlike(_domain, {lit(NON_ASCII)})", NAME, "homograph", KIND,
        case((brand, "'HIGH'"), otherwise="'MEDIUM'"), text,
        {"domain": "_domain", "matched_brand": case((brand, "_folded_reg"), otherwise="''")},
    )


def _typosquat(near: str = typosquats("_folded_reg")) -> str:
    one = finding(
        "true", NAME, "typosquatting", KIND, case(("s.edits = 1", "'HIGH'"), otherwise="'MEDIUM'"),
        fill(V.TEXT_TYPOSQUAT, domain="_domain", edits="s.edits", brand="s.brand"),
        {"domain": "_domain", "matched_brand": "s.brand"},
    )
    return f"transform({near}, s -> {one})"


def _subdomain() -> str:
    """One brand per domain: a prefix before a label, then the smallest name."""
    brand = "coalesce(_prefix, _label)"
    text = case(
        ("_prefix IS NOT NULL",
         fill(V.TEXT_SUBDOMAIN_PREFIX, domain="_domain", brand="_prefix", registrable="_reg")),
        otherwise=fill(V.TEXT_SUBDOMAIN_LABEL, domain="_domain", label=_label("_label"), registrable="_reg"),
    )
    return finding(
        f"{brand} IS NOT NULL", NAME, "subdomain_abuse", KIND,
        case(("_prefix IS NOT NULL", "'HIGH'"), otherwise="'MEDIUM'"), text,
        {"domain": "_domain", "matched_brand": brand},
    )


def best_subdomain(ready: DataFrame) -> DataFrame:
    """Add ``_prefix`` and ``_label``, the brand each of the two rules would name."""
    return ready.selectExpr(
        *ready.columns,
        f"array_min({prefix_abuse('_domain', '_reg')}) AS _prefix",
        f"array_min({label_abuse('_domain', '_reg')}) AS _label",
    )


def add(
    df: DataFrame, as_of: date, *, only: Iterable[str] | None = None, to: str = "domains_findings"
) -> DataFrame:
    wanted = set(SIGNALS if only is None else only)
    ready = prepare(df, as_of)
    if "subdomain_abuse" in wanted:
        ready = best_subdomain(ready)
    build = {
        "domain_age": lambda: collect([_age()]),
        "homograph": lambda: collect([_homograph()]),
        "typosquatting": _typosquat,
        "subdomain_abuse": lambda: collect([_subdomain()]),
    }
    lists = ", ".join(build[s]() for s in SIGNALS if s in wanted)
    return ready.selectExpr(
        *df.columns, f"CAST(concat({lists}) AS array<{RAW.simpleString()}>) AS {to}"
    )


def found(ready: DataFrame, kept: Iterable[str], to: str = "domains_findings") -> DataFrame:
    """The findings of rows from ``prepare`` whose brands are known already: in ``_exact``, ``_typos``,
    ``_prefix`` and ``_label``, null where there is none."""
    near = "coalesce(_typos, CAST(array() AS array<struct<brand:string,edits:int>>))"
    lists = [collect([_age()]), collect([_homograph("coalesce(_exact, false)")]), _typosquat(near), collect([_subdomain()])]
    return ready.selectExpr(*kept, f"CAST(concat({', '.join(lists)}) AS array<{RAW.simpleString()}>) AS {to}")
