"""Attachment metadata rules.

A mail has at most a few attachments, so the rules run inside the array: no explode,
no regrouping.  The extension tables are small constants.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame

from mailsieve import fixed_values as V
from mailsieve.functions.sql import case, either, fill, listing, lit
from mailsieve.functions.text import extension, ignore_case, mime, strip
from mailsieve.operators.findings import NONE, collect, finding

NAME = "attachments"
SIGNALS = [
    "always_suspicious_mime",
    "mime_extension_mismatch",
    "dangerous_extension",
    "double_extension",
    "lure_filename",
    "zero_byte_attachment",
    "large_attachment",
]
_EXPECTED = (
    "map("
    + ", ".join(f"{lit(ext)}, array({listing(sorted(m))})" for ext, m in V.EXTENSION_MIMES.items())
    + ")"
)


def prepare(attachments: str) -> str:
    """Trimmed names, normalised type, extension, size with 0 for missing; blank names dropped."""
    trimmed = (
        f"transform({attachments}, a -> named_struct("
        f"'filename', {strip('''coalesce(a.filename, '')''')}, "
        f"'mime_type', {strip('''coalesce(a.mime_type, '')''')}, 'size_bytes', a.size_bytes))"
    )
    facts = (
        f"transform(filter({trimmed}, a -> a.filename != ''), a -> named_struct("
        f"'filename', a.filename, 'mime_type', a.mime_type, 'mime', {mime('a.mime_type')}, "
        f"'ext', {extension('a.filename')}, 'size', coalesce(a.size_bytes, 0L), "
        f"'size_bytes', a.size_bytes))"
    )
    return (
        f"transform({facts}, a -> named_struct('filename', a.filename, 'mime_type', a.mime_type, "
        f"'mime', a.mime, 'ext', a.ext, 'size', a.size, 'size_bytes', a.size_bytes, "
        f"'dangerous', a.ext IN ({listing(V.DANGEROUS_EXTENSIONS)}), "
        f"'bad_mime', a.mime_type != '' AND a.mime IN ({listing(V.ALWAYS_BAD_MIMES)}), "
        f"'expected', try_element_at({_EXPECTED}, a.ext), "
        f"'word', regexp_extract(a.filename, {lit(ignore_case(V.LURE_WORDS))}, 0)))"
    )


def _rule(signal: str) -> str:
    name, ext, word = "a.filename", "a.ext", "a.word"
    size = {"size_bytes": "a.size_bytes"}
    plain = "nullif(a.mime_type, '')"
    if signal == "always_suspicious_mime":
        return finding(
            "a.bad_mime", NAME, signal, "MALWARE", "CRITICAL",
            fill(V.TEXT_BAD_MIME, filename=name, mime="a.mime"),
            {"filename": name, "mime_type": "a.mime", **size},
        )
    if signal == "mime_extension_mismatch":
        executable = either(f"contains(a.mime, {lit(part)})" for part in V.EXECUTABLE_MIME_PARTS)
        return finding(
            "a.mime_type != '' AND NOT a.bad_mime AND a.expected IS NOT NULL "
            "AND NOT array_contains(a.expected, a.mime)",
            NAME, signal, "MALWARE", case((executable, "'CRITICAL'"), otherwise="'HIGH'"),
            fill(V.TEXT_MIME_MISMATCH, filename=name, ext=ext, mime="a.mime", expected="a.expected[0]"),
            {"filename": name, "extension": ext, "declared_mime": "a.mime",
             "expected_mimes": "array_join(a.expected, ',')", **size},
        )
    if signal == "dangerous_extension":
        return finding(
            "a.dangerous", NAME, signal, "MALWARE",
            case((f"a.ext IN ({listing(V.CRITICAL_EXTENSIONS)})", "'CRITICAL'"), otherwise="'HIGH'"),
            fill(V.TEXT_DANGEROUS, filename=name, ext=ext),
            {"filename": name, "extension": ext, "mime_type": plain, **size},
        )
    if signal == "double_extension":
        decoy = "lower(coalesce(try_element_at(split(a.filename, '[.]'), -2), ''))"
        return finding(
            f"a.dangerous AND rlike(a.filename, {lit(V.DOUBLE_EXTENSION)})",
            NAME, signal, "MALWARE", "CRITICAL",
            fill(V.TEXT_DOUBLE, filename=name, decoy=decoy, real=ext),
            {"filename": name, "decoy_extension": decoy, "real_extension": ext, **size},
        )
    if signal == "lure_filename":
        return finding(
            "a.word != ''", NAME, signal, "SUSPICIOUS_CONTENT",
            case(("a.dangerous", "'HIGH'"), otherwise="'MEDIUM'"),
            case(
                ("a.dangerous", fill(V.TEXT_LURE_DANGEROUS, filename=name, word=word, ext=ext)),
                otherwise=fill(V.TEXT_LURE, filename=name, word=word),
            ),
            {"filename": name, "matched_keyword": word, "extension": "nullif(a.ext, '')", **size},
        )
    if signal == "zero_byte_attachment":
        return finding(
            "a.size = 0", NAME, signal, "SUSPICIOUS_CONTENT", "LOW",
            fill(V.TEXT_ZERO_BYTE, filename=name),
            {"filename": name, "mime_type": plain, "size_bytes": "'0'"},
        )
    # one decimal, ties to even
    megabytes = "format_string('%.1f', bround(a.size / 1048576.0D, 1))"
    return finding(
        f"a.size > {V.LARGE_ATTACHMENT_BYTES}", NAME, signal, "SUSPICIOUS_CONTENT", "LOW",
        fill(V.TEXT_LARGE, filename=name, megabytes=megabytes),
        {"filename": name, "mime_type": plain, "size_bytes": "a.size"},
    )


def add(df: DataFrame, *, only: Iterable[str] | None = None, to: str = "attachments_findings") -> DataFrame:
    wanted = set(SIGNALS if only is None else only)
    rules = collect(_rule(s) for s in SIGNALS if s in wanted)
    found = f"flatten(transform({prepare('attachments')}, a -> {rules}))"
    return df.selectExpr(*df.columns, f"coalesce({found}, {NONE}) AS {to}")


def explode(df: DataFrame) -> DataFrame:
    """One row per named attachment, with its place in the mail."""
    placed = (
        f"transform({prepare('attachments')}, (a, i) -> named_struct('position', i, "
        "'filename', a.filename, 'mime_type', a.mime_type, 'mime', a.mime, 'ext', a.ext, 'size', a.size))"
    )
    return df.selectExpr("email_id", f"inline({placed})")
