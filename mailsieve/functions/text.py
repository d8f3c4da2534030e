"""Text helpers: SQL expressions in, SQL expressions out; everything stays on the JVM."""

from __future__ import annotations

import re

from mailsieve import fixed_values as V
from mailsieve.functions.sql import case, either, let, lit

NON_ASCII = r"[^\x00-\x7F]"
# what Python's str.strip() removes; Spark's one-argument trim removes spaces only
WHITESPACE = (
    "\t\n\u000b\f\r\u001c\u001d\u001e\u001f \u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004"
    "\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip(c: str) -> str:
    return f"trim(BOTH {lit(WHITESPACE)} FROM {c})"


def clip(c: str, n: int) -> str:
    return f"substring({c}, 1, {n})"


def ignore_case(pattern: str) -> str:
    return "(?iU)" + pattern


def unicode(pattern: str) -> str:
    return "(?U)" + pattern


def nfkc(c: str) -> str:
    """NFKC by the ICU library Spark ships for collations.

    Only rows with a non-ASCII character pay for it (ASCII is its own NFKC form),
    and no row leaves the JVM.
    """
    icu = f"reflect('com.ibm.icu.text.Normalizer', 'compose', {c}, true)"
    return case((f"rlike({c}, {lit(NON_ASCII)})", icu), otherwise=c)


def translate_by(c: str, table: dict[str, str]) -> str:
    return f"translate({c}, {lit(''.join(table))}, {lit(''.join(table.values()))})"


def utf8_cut(c: str, max_bytes: int) -> str:
    """First ``max_bytes`` bytes of the UTF-8 form, without a broken last character."""
    cut = f"CAST(substring(encode({c}, 'UTF-8'), 1, {max_bytes}) AS STRING)"
    broken = lit("\\x{FFFD}\\z")
    return case(
        (f"is_valid_utf8({cut})", cut),
        otherwise=f"regexp_replace(make_valid_utf8({cut}), {broken}, '')",
    )


def first_match(c: str, pattern: str, gate: str | None = None) -> str:
    """Text of the first match, '' or null without one; the gate spares the regex."""
    found = f"regexp_extract({c}, {lit(pattern)}, 0)"
    return case((gate, found)) if gate else found


def match_start(c: str, pattern: str) -> str:
    """0-based character (not UTF-16) position of the first match."""
    flags = re.match(r"\(\?(\w+)\)", pattern)
    head = flags.group(0) if flags else ""
    rest = pattern[len(head):]
    return f"length(regexp_extract({c}, {lit(f'{head}^((?s:.*?))(?:{rest})')}, 1))"


def start_of(c: str, match: str, pattern: str) -> str:
    """As :func:`match_start`, given the matched text.

    The first place where that text stands is the match unless the pattern's word
    boundaries fail there.  One more regex on just that text and its two neighbours
    decides; only if it fails is the whole text searched again.  Not for patterns that
    look further than one character around their match.
    """
    window = f"substring({c}, if(at > 1, at - 1, 1), length({match}) + if(at > 1, 2, 1))"
    here = f"regexp_extract({window}, {lit(pattern)}, 0) = {match}"
    return let("at", f"instr({c}, {match})", case((here, "at - 1"), otherwise=match_start(c, pattern)))


# ---- addresses and domains --------------------------------------------------

_DISPLAY_NAME = r"(?U)^(?:\"[^\"]+\"|[^\"(),:;<>@\[\]\\]*)\s*<\s*([^<>]+?)\s*>$"


def bare_address(sender: str) -> str:
    """Address without display name, its domain in lower case."""
    inner = f"regexp_extract({sender}, {lit(_DISPLAY_NAME)}, 1)"
    plain = f"coalesce(nullif({inner}, ''), {sender})"
    domain = "substring_index(a, '@', -1)"
    lowered = f"concat(substring(a, 1, length(a) - length({domain})), lower({domain}))"
    return let("a", plain, case(("contains(a, '@')", lowered), otherwise="a"))


def sender_domain(sender: str) -> str:
    return case((f"contains({sender}, '@')", f"substring_index({sender}, '@', -1)"), otherwise="'unknown'")


def registrable(domain: str) -> str:
    """Last two labels; a name without a dot is returned as it is."""
    bare = f"trim(TRAILING '.' FROM {domain})"
    return case((f"contains({bare}, '.')", f"substring_index({bare}, '.', -2)"), otherwise=domain)


def fold_domain(domain: str) -> str:
    """Confusable folding: NFKC, look-alike characters, then the bigrams in order."""
    folded = translate_by(nfkc(domain), V.DOMAIN_CONFUSABLES)
    for pair, letter in V.DOMAIN_BIGRAMS:
        folded = f"replace({folded}, {lit(pair)}, {lit(letter)})"
    return folded


# ---- headers ----------------------------------------------------------------


def header(headers: str, name: str, *, last: bool = True, trimmed: bool = False) -> str:
    """Case-insensitive look-up; of several spellings the last or the first counts."""
    key = strip("k") if trimmed else "k"
    same = f"map_filter({headers}, (k, v) -> lower({key}) = {lit(name)})"
    return f"try_element_at(map_values({same}), {-1 if last else 1})"


def recipient(headers: str) -> str:
    """First non-empty recipient header, without display name; '' if there is none."""
    tried = ", ".join(
        f"nullif(try_element_at({headers}, {lit(k)}), '')" for k in V.RECIPIENT_HEADERS
    )
    inner = "trim(TRAILING '>' FROM substring_index(r, '<', -1))"
    shown = case(("contains(r, '<') AND contains(r, '>')", inner), otherwise="r")
    return let("r", f"coalesce({tried}, '')", strip(shown))


# ---- attachments ------------------------------------------------------------


def extension(filename: str) -> str:
    return case(
        (f"contains({filename}, '.')", f"lower(substring_index({filename}, '.', -1))"), otherwise="''"
    )


def mime(value: str) -> str:
    return f"lower({strip(f'''substring_index({value}, ';', 1)''')})"


# ---- links ------------------------------------------------------------------


def urls(body: str, limit: int | None = None) -> str:
    """Distinct links in order of first appearance: all, or the first ``limit`` of them."""
    found = f"regexp_extract_all({body}, {lit(ignore_case(V.URL))}, 0)"
    bare = f"transform({found}, u -> trim(TRAILING {lit(V.URL_TRAILING)} FROM u))"
    return case(
        (f"contains({body}, '://')", f"array_distinct({bare})" if limit is None else f"slice(array_distinct({bare}), 1, {limit})"),
        otherwise="CAST(array() AS array<string>)",
    )


# letters outside ASCII that a case-insensitive match takes for i or s; a text with one
# of them passes every substring test (lower() maps the fourth, the Kelvin sign)
_TWINS = "ıİſ"


def has_twins(text: str) -> str:
    return either(f"contains({text}, {lit(letter)})" for letter in _TWINS)
