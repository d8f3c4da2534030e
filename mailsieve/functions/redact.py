"""Masking personal data and secrets in text, maps and whole rows, as SQL expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, types as T

from mailsieve import fixed_values as V
from mailsieve.functions.sql import case, lit
from mailsieve.functions.text import ignore_case, unicode


def _mask(text: str, pattern: str, mask: str) -> str:
    return f"regexp_replace({text}, {lit(pattern)}, {lit(mask)})"


def redact_prompt(text: str) -> str:
    """E-mail, US phone and SSN masks for prompt audit logs, in that order."""
    for pattern, no_case, mask in V.PROMPT_PII:
        text = _mask(text, ignore_case(pattern) if no_case else unicode(pattern), mask)
    return text


def redact_email(text: str) -> str:
    return _mask(text, unicode(V.LOG_EMAIL), V.PII_MASK)


def redact_phone(text: str) -> str:
    return _mask(text, unicode(V.LOG_PHONE), V.PII_MASK)


def redact_ssn(text: str) -> str:
    return _mask(text, unicode(V.LOG_SSN), V.PII_MASK)


def redact_card(text: str) -> str:
    return _mask(text, unicode(V.LOG_CARD), V.PII_MASK)


def redact_ipv4(text: str) -> str:
    """Only the last octet goes."""
    return _mask(text, unicode(V.LOG_IPV4), "$1." + V.SECRET_MASK)


def redact_log(text: str) -> str:
    """All five log masks, in order."""
    for mask in (redact_email, redact_phone, redact_ssn, redact_card, redact_ipv4):
        text = mask(text)
    return text


def redact_map(column: str, value: str = "v") -> str:
    """A text map: secrets by key, personal data by value."""
    secret = f"rlike(k, {lit(ignore_case(V.SECRET_KEYS))})"
    masked = case((secret, lit(V.SECRET_MASK)), otherwise=redact_log(value))
    return f"transform_values({column}, (k, v) -> {masked})"


def _value(c: str, dtype: T.DataType, depth: int = 0) -> str:
    """Redact one value by its type, all the way down."""
    x, k = f"x{depth}", f"k{depth}"
    if isinstance(dtype, T.StringType):
        return redact_log(c)
    if isinstance(dtype, T.ArrayType):
        return f"transform({c}, {x} -> {_value(x, dtype.elementType, depth + 1)})"
    if isinstance(dtype, T.MapType):
        secret = f"rlike({k}, {lit(ignore_case(V.SECRET_KEYS))})"
        inner = _value(x, dtype.valueType, depth + 1)
        # the mask is text, so a map of something else becomes a map of texts
        if isinstance(dtype.valueType, (T.ArrayType, T.MapType, T.StructType)):
            inner = f"to_json({inner})"
        elif not isinstance(dtype.valueType, T.StringType):
            inner = f"CAST({inner} AS STRING)"
        return f"transform_values({c}, ({k}, {x}) -> {case((secret, lit(V.SECRET_MASK)), otherwise=inner)})"
    if isinstance(dtype, T.StructType):
        fields = ", ".join(
            f"{lit(f.name)}, {_field(f'{c}.`{f.name}`', f, depth)}" for f in dtype.fields
        )
        return case((f"{c} IS NOT NULL", f"named_struct({fields})"))
    return c


def _secret_name(name: str) -> bool:
    return any(word in name.lower() for word in V.SECRET_KEYS.strip("()").split("|"))


def _field(c: str, field: T.StructField, depth: int = 0) -> str:
    return lit(V.SECRET_MASK) if _secret_name(field.name) else _value(c, field.dataType, depth)


def redact_rows(df: DataFrame, message: str = "event") -> DataFrame:
    """Redact a log table: the message text, then every other field by name and type."""
    cols = []
    for field in df.schema.fields:
        c = f"`{field.name}`"
        value = _value(c, field.dataType) if field.name == message else _field(c, field)
        cols.append(f"{value} AS {c}")
    return df.selectExpr(*cols)
