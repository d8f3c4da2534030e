"""Rules on the ``Date`` header, and first contact between two addresses."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from mailsieve import fixed_values as V
from mailsieve.functions.dates import iso_utc, ntz, offset_text, parse_date
from mailsieve.functions.sql import case, fill, listing, lit
from mailsieve.functions.text import fold_domain, header, registrable, sender_domain
from mailsieve.operators.findings import collect, finding

NAME = "temporal"
KIND = "SUSPICIOUS_CONTENT"
SIGNALS = [
    "missing_or_invalid_date_header",
    "off_hours_send",
    "future_dated_email",
    "stale_email",
]
_MINUTE = 60_000_000        # microseconds
_DAY = 86_400_000_000


def with_date(df: DataFrame) -> DataFrame:
    """Add ``_sent``: the parsed header (first spelling wins), null if unusable."""
    value = header("headers", "date", last=False, trimmed=True)
    return df.selectExpr(*df.columns, f"{parse_date(value)} AS _sent")


def _rules(as_of: datetime) -> dict[str, str]:
    utc, local, minutes = "_sent.utc", "_sent.local", "_sent.offset_minutes"
    skew = f"(CAST(_skew AS DECIMAL(30,6)) / {_MINUTE})"
    age_days = f"CAST(floor(-_skew / CAST({_DAY} AS DECIMAL(20,0))) AS BIGINT)"
    now_text = lit(f"{as_of:%Y-%m-%dT%H:%M:%S}+00:00")
    zone = f"concat('UTC', {offset_text(minutes, zero='')})"
    clock = f"date_format({local}, \"yyyy-MM-dd'T'HH:mm:ss\")"
    sent = {"send_time_utc": iso_utc(utc)}
    return {
        "missing_or_invalid_date_header": finding(
            "_sent IS NULL", NAME, "missing_or_invalid_date_header", KIND, "LOW", lit(V.TEXT_NO_DATE), {}
        ),
        "off_hours_send": finding(
            f"hour({utc}) >= {V.OFF_HOURS_FROM} AND hour({utc}) < {V.OFF_HOURS_TO}",
            NAME, "off_hours_send", KIND, "MEDIUM",
            fill(V.TEXT_OFF_HOURS, utc=f"date_format({utc}, 'HH:mm')",
                 local=f"date_format({local}, 'HH:mm')", zone=zone),
            {**sent,
             "send_time_local": f"concat({clock}, {offset_text(minutes, zero='+00:00')})",
             "hour_utc": f"hour({utc})", "off_hours_window": lit(V.OFF_HOURS_WINDOW)},
        ),
        "future_dated_email": finding(
            f"_skew > {V.FUTURE_SKEW_MINUTES * _MINUTE}L",
            NAME, "future_dated_email", KIND, "HIGH",
            fill(V.TEXT_FUTURE, minutes=f"CAST(bround({skew}, 0) AS BIGINT)"),
            {**sent, "current_time_utc": now_text,
             "skew_minutes": f"CAST(round({skew}, 1) AS DECIMAL(20,1))"},
        ),
        "stale_email": finding(
            f"_skew < -{V.STALE_DAYS * _DAY}L",
            NAME, "stale_email", KIND, "MEDIUM",
            fill(V.TEXT_STALE, days=age_days, date=f"date_format({utc}, 'yyyy-MM-dd')"),
            {**sent, "current_time_utc": now_text, "age_days": age_days},
        ),
    }


def add(
    df: DataFrame, as_of: datetime, *, only: Iterable[str] | None = None, to: str = "temporal_findings"
) -> DataFrame:
    wanted = set(SIGNALS if only is None else only)
    out = [rule for signal, rule in _rules(as_of).items() if signal in wanted]
    dated = with_date(df)
    # exact difference in microseconds, so that the strict limits stay strict
    timed = dated.selectExpr(
        *dated.columns, f"timestampdiff(MICROSECOND, {ntz(as_of)}, _sent.utc) AS _skew"
    )
    return timed.selectExpr(*df.columns, f"{collect(out)} AS {to}")


def first_contacts(
    emails: DataFrame, *, history: DataFrame | None = None, internal_domains: list[str] | None = None
) -> DataFrame:
    """The mails that open a sender → recipient relation; off by default in scoring.

    ``emails(email_id, sender, recipient, ts)``; ``history(sender, recipient)`` holds
    earlier relations.  The earliest mail per pair is a min-aggregate, which combines
    before the shuffle, so a pair with a third of all mail is no hot spot.
    MEDIUM, or HIGH if the sender domain only looks like one of ``internal_domains``.
    """
    first = (
        emails.groupBy("sender", "recipient")
        .agg(F.expr("min(struct(ts IS NULL AS n, ts, email_id))").alias("m"))
        .select("m.email_id", "sender", "recipient", "m.ts")
    )
    if history is not None:
        first = first.join(history.select("sender", "recipient"), ["sender", "recipient"], "left_anti")
    own = f"CAST(array({listing(internal_domains or [])}) AS array<string>)"
    domain = f"lower({sender_domain('sender')})"
    folded = first.selectExpr("*", f"{domain} AS _d", f"{fold_domain(domain)} AS _f")
    near = f"exists({own}, o -> levenshtein({registrable('_f')}, o, {V.MAX_EDITS}) >= 0)"
    fake = f"{near} AND NOT array_contains({own}, {registrable('_d')})"
    return folded.selectExpr(
        "email_id", "sender", "recipient",
        "'first_contact_sender' AS signal",
        f"{case((fake, lit('HIGH')), otherwise=lit('MEDIUM'))} AS severity",
        f"{fill(V.TEXT_FIRST_CONTACT, sender='sender')} AS description",
    )
