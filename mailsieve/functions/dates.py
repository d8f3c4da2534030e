"""RFC 2822 dates as SQL expressions.

Times are ``timestamp_ntz`` in UTC, so results do not depend on the session zone.
"""

from __future__ import annotations

from datetime import datetime

from mailsieve import fixed_values as V
from mailsieve.functions.sql import case, let, lit, literal_map
from mailsieve.functions.text import strip

MONTHS = (
    "january february march april may june july august september october november december"
).split()

# optional week day, then day-month-year, time, optional zone, optional comment
_RFC2822 = (
    r"(?i)^(?:[a-z]+(?:,\s*|\s+))?(?:([a-z]+)[\s-]+(\d{1,2})|(\d{1,2})[\s-]+([a-z]+))"
    r",?[\s-]+(\d{2,4})\s+(\d{1,2})[:.](\d{1,2})(?:[:.](\d{1,2}))?"
    r"(?:\s*([+-]?\d{4}|[a-z]+))?(?:\s.*|\(.*)?$"
)
# the C library's order, year after the time, is put right first
_YEAR_LAST = (
    r"(?i)^(?:[a-z]+(?:,\s*|\s+))?(?:([a-z]+)\s+(\d{1,2})|(\d{1,2})\s+([a-z]+)),?\s+"
    r"(\d{1,2}[:.]\d{1,2}(?:[:.]\d{1,2})?)\s+(\d{2,4})(\s.*)?$"
)
_SEP = "\u0001"


def ntz(moment: datetime) -> str:
    """A UTC instant as a literal."""
    return f"TIMESTAMP_NTZ '{moment:%Y-%m-%d %H:%M:%S.%f}'"


def parse_date(value: str) -> str:
    """Struct ``utc, local, offset_minutes``; null if missing or unparseable.

    A missing, unknown or ``-0000`` zone counts as UTC.
    """
    usual = f"regexp_replace({strip(value)}, {lit(_YEAR_LAST)}, '$2$3 $1$4 $6 $5$7')"
    flat = f"regexp_replace({usual}, {lit(_RFC2822)}, {lit(_SEP.join(f'${i}' for i in range(1, 10)))})"
    months = {name: i for i, name in enumerate(MONTHS, 1)}
    months |= {name[:3]: i for i, name in enumerate(MONTHS, 1)}
    year = let(
        "y", "try_cast(p[4] AS INT)",
        case(("y >= 100", "y"), ("y > 68", "y + 1900"), otherwise="y + 2000"),
    )
    second = "coalesce(try_cast(p[7] AS INT), 0)"
    local = case((
        f"{second} < 60",
        f"try_make_timestamp_ntz({year}, "
        f"try_element_at({literal_map(months)}, lower(concat(p[0], p[3]))), "
        f"try_cast(concat(p[1], p[2]) AS INT), try_cast(p[5] AS INT), try_cast(p[6] AS INT), "
        f"CAST({second} AS DECIMAL(16,6)))",
    ))
    hhmm = (
        f"coalesce(try_cast(p[8] AS INT), "
        f"try_element_at({literal_map(V.ZONE_OFFSETS)}, lower(p[8])), 0)"
    )
    minutes = let(
        "z", hhmm, "CAST(signum(z) AS INT) * (CAST(floor(abs(z) / 100) AS INT) * 60 + abs(z) % 100)"
    )
    read = case(("size(p) = 9", f"named_struct('local', {local}, 'minutes', {minutes})"))
    whole = case((
        "r.local IS NOT NULL",
        "named_struct('utc', r.local - make_dt_interval(0, 0, r.minutes), "
        "'local', r.local, 'offset_minutes', r.minutes)",
    ))
    return let("r", let("p", f"split({flat}, {lit(_SEP)})", read), whole)


def iso_utc(ts: str) -> str:
    return f"""date_format({ts}, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")"""


def offset_text(minutes: str, *, zero: str) -> str:
    """``+hh:mm``; ``zero`` for no offset."""
    text = (
        f"format_string('%s%02d:%02d', if({minutes} < 0, '-', '+'), "
        f"CAST(floor(abs({minutes}) / 60) AS INT), CAST(abs({minutes}) % 60 AS INT))"
    )
    return case((f"{minutes} = 0", lit(zero)), otherwise=text)


def iso_date(value: str) -> str:
    """Date of an ISO string, looking at its first ten characters only."""
    head = f"substring(CAST({value} AS STRING), 1, 10)"
    return case(
        (f"rlike({head}, {lit(r'^[0-9]{4}-[0-9]{2}-[0-9]{2}$')})", f"try_to_date({head}, 'yyyy-MM-dd')"),
        (f"rlike({head}, {lit(r'^[0-9]{8}$')})", f"try_to_date({head}, 'yyyyMMdd')"),
    )
