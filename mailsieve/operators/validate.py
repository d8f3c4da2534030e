"""Input checks: every request gets the list of reasons it is refused for."""

from __future__ import annotations

from pyspark.sql import DataFrame

from mailsieve import fixed_values as V
from mailsieve.functions.sql import case, lit

# syntactic address check: dotted atom, @, dotted host whose last label ends in a letter
_ADDRESS = (
    r"^[^\s@\"(),:;<>\[\]\\.]+(?:\.[^\s@\"(),:;<>\[\]\\.]+)*"
    r"@(?:[\p{L}\p{N}](?:[\p{L}\p{N}-]{0,61}[\p{L}\p{N}])?\.)+"
    r"[\p{L}\p{N}](?:[\p{L}\p{N}-]{0,61}[\p{L}])?$"
)
_RESERVED = r"(?i)[@.](?:arpa|invalid|local|localhost|onion|test)$"
_MAX_LOCAL_CHARS = 64
_MAX_ADDRESS_CHARS = 254


def sender_ok(sender: str) -> str:
    return (
        f"coalesce(rlike({sender}, {lit(_ADDRESS)}) AND NOT rlike({sender}, {lit(_RESERVED)}) "
        f"AND length({sender}) <= {_MAX_ADDRESS_CHARS} "
        f"AND length(substring_index({sender}, '@', 1)) <= {_MAX_LOCAL_CHARS}, false)"
    )


def subject_ok(subject: str) -> str:
    return f"length({subject}) <= {V.MAX_SUBJECT_CHARS}"


def body_ok(body: str) -> str:
    return f"octet_length({body}) <= {V.MAX_BODY_BYTES}"


def header_count_ok(headers: str) -> str:
    return f"cardinality({headers}) <= {V.MAX_HEADERS}"


def header_size_ok(headers: str) -> str:
    return f"NOT exists(map_values({headers}), v -> octet_length(v) > {V.MAX_HEADER_VALUE_BYTES})"


def attachment_count_ok(attachments: str) -> str:
    return f"size({attachments}) <= {V.MAX_ATTACHMENTS}"


def errors(sender: str, subject: str, body: str, headers: str, attachments: str) -> str:
    """Reasons in the order of the fields; an empty array means valid."""
    oversized = f"map_filter({headers}, (k, v) -> octet_length(v) > {V.MAX_HEADER_VALUE_BYTES})"
    count = header_count_ok(headers)
    checks = [
        (sender_ok(sender), lit("value is not a valid email address")),
        (subject_ok(subject), lit(f"String should have at most {V.MAX_SUBJECT_CHARS} characters")),
        (body_ok(body),
         lit(f"Email body exceeds the maximum allowed size of {V.MAX_BODY_BYTES // 1024} KB.")),
        (count,
         f"concat('Too many headers: ', cardinality({headers}), ' (maximum {V.MAX_HEADERS}).')"),
        (f"NOT ({count}) OR {header_size_ok(headers)}",
         f"concat('Header \\'', map_keys({oversized})[0], "
         f"'\\' value exceeds the maximum allowed size of {V.MAX_HEADER_VALUE_BYTES // 1024} KB.')"),
        (attachment_count_ok(attachments),
         f"concat('Too many attachments: ', size({attachments}), ' (maximum {V.MAX_ATTACHMENTS}).')"),
    ]
    flags = ", ".join(case((f"NOT ({ok})", reason)) for ok, reason in checks)
    return f"array_compact(array({flags}))"


def checked(requests: DataFrame) -> DataFrame:
    """Cleaned requests with their ``errors``."""
    found = errors("from_address", "subject", "body", "headers", "attachment_metadata")
    return requests.selectExpr(*requests.columns, f"{found} AS errors")


def valid(requests: DataFrame) -> DataFrame:
    return checked(requests).where("size(errors) = 0").drop("errors")


def rejected(requests: DataFrame) -> DataFrame:
    """Refused requests with their reasons, for the quarantine path."""
    return checked(requests).where("size(errors) > 0")
