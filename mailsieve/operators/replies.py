"""Landed model answers: find the JSON, check it, retry, fall back, normalise.

The answers are data (a table of raw text), checked on VARIANT so that the *reason* of
a refusal survives: ``55``, ``55.0`` and ``"55"`` are told apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from mailsieve import fixed_values as V
from mailsieve.functions.sql import case, listing, lit
from mailsieve.functions.text import strip

INDICATOR = "struct<category:string,severity:string,evidence_quote:string,explanation:string>"
VERDICT = (
    "struct<schema_version:string,semantic_score:int,verdict:string,confidence:string,"
    f"social_engineering_indicators:array<{INDICATOR}>,rationale:string,"
    "recommended_user_action:string,uncertainty_notes:string>"
)
_QUOTE = lit("'")


def extract_json(raw: str) -> str:
    """The JSON object in an answer: bare, in a code fence, or between prose; else null."""
    text = strip(raw)
    fence = lit(r"(?sU)```(?:json)?\s*(\{.*?\})\s*```")
    brace = lit(r"(?s)\{.*\}")
    return case(
        (f"startswith({text}, '{{')", text),
        otherwise=f"coalesce(nullif(regexp_extract({text}, {fence}, 1), ''), "
        f"nullif(regexp_extract({text}, {brace}, 0), ''))",
    )


def _get(v: str, path: str, kind: str) -> str:
    return f"try_variant_get({v}, {lit(path)}, {lit(kind)})"


def _type(v: str, path: str) -> str:
    """SQL type of a member; null if the member is missing, VOID for JSON null."""
    return f"schema_of_variant({_get(v, path, 'variant')})"


def _text(v: str, path: str) -> str:
    return case((f"{_type(v, path)} = 'STRING'", _get(v, path, "string")))


def _shown(v: str, path: str) -> str:
    """A member as it appears in a reason."""
    raw = f"to_json({_get(v, path, 'variant')})"
    kind = _type(v, path)
    return case(
        (f"{kind} = 'STRING'", f"concat({_QUOTE}, {_get(v, path, 'string')}, {_QUOTE})"),
        (f"{kind} = 'VOID'", "'None'"),
        (f"{kind} = 'BOOLEAN'", f"initcap({raw})"),
        otherwise=raw,
    )


def _among(v: str, path: str, values: list[str]) -> str:
    return f"coalesce({_text(v, path)} IN ({listing(values)}), false)"


def _listed(values: list[str]) -> str:
    return "[" + ", ".join(f"'{x}'" for x in sorted(values)) + "]"


def missing_fields(v: str) -> str:
    """Required fields that are not there, sorted."""
    present = ", ".join(
        case((f"{_type(v, '$.' + f)} IS NOT NULL", lit(f))) for f in V.REPLY_FIELDS
    )
    return f"array_except(array({listing(sorted(V.REPLY_FIELDS))}), array_compact(array({present})))"


def _unknown_keys(json: str, known: list[str]) -> str:
    return f"size(array_except(json_object_keys({json}), array({listing(known)}))) > 0"


def _too_long(v: str, path: str, cap: int) -> str:
    """Also true for anything but text."""
    return f"coalesce(length({_text(v, path)}) > {cap}, true)"


def _indicator_error(x: str, i: str, strict: bool) -> str:
    name = f"concat('social_engineering_indicators[', CAST({i} AS STRING), ']')"

    def say(rest: str) -> str:
        return f"concat({name}, {lit(rest)})"

    checks = [(f"NOT startswith(schema_of_variant({x}), 'OBJECT')", say(" must be an object."))]
    for field in V.INDICATOR_FIELDS:
        checks.append((f"{_type(x, '$.' + field)} IS NULL", say(f" missing field '{field}'.")))
    for field, values in (("category", V.INDICATOR_CATEGORIES), ("severity", V.INDICATOR_SEVERITIES)):
        path = f"$.{field}"
        checks.append((
            f"NOT {_among(x, path, values)}",
            f"concat({name}, {lit(f'.{field} invalid: ')}, {_shown(x, path)}, '.')",
        ))
    if strict:
        checks.append((_unknown_keys(f"to_json({x})", V.INDICATOR_FIELDS), say(" has unknown fields.")))
        for field, cap in (("evidence_quote", V.MAX_QUOTE_CHARS), ("explanation", V.MAX_EXPLANATION_CHARS)):
            checks.append((_too_long(x, f"$.{field}", cap), say(f".{field} exceeds {cap} characters.")))
    return case(*checks)


def _indicators(v: str) -> str:
    return _get(v, "$.social_engineering_indicators", "array<variant>")


def reason(json: str, v: str, *, strict: bool = False) -> str:
    """First reason for refusal, null for a valid answer.

    ``strict`` adds what the JSON schema asks for beyond the parser: no unknown
    fields, caps on the indicator texts, and no boolean as a score.
    """
    score_kind = _type(v, "$.semantic_score")
    whole = f"({score_kind} = 'BIGINT' AND {_get(v, '$.semantic_score', 'bigint')} BETWEEN 0 AND 100)"
    if not strict:      # a boolean is an integer to the parser
        whole = f"({whole} OR {score_kind} = 'BOOLEAN')"
    missing = missing_fields(v)
    errors = f"array_compact(transform({_indicators(v)}, (x, i) -> {_indicator_error('x', 'i', strict)}))"
    missing_text = (
        f"concat({lit('Missing required fields: [')}, {_QUOTE}, "
        f"array_join({missing}, {lit(chr(39) + ', ' + chr(39))}), {_QUOTE}, ']')"
    )

    def wrong(path: str, before: str, after: str) -> str:
        return f"concat({lit(before)}, {_shown(v, path)}, {lit(after)})"

    def one_of(path: str, values: list[str]) -> tuple[str, str]:
        before, after = f"Invalid {path[2:]}: ", f". Must be one of {_listed(values)}."
        return f"NOT {_among(v, path, values)}", wrong(path, before, after)

    checks = [
        (f"{json} IS NULL", lit("No JSON object found in LLM response.")),
        (f"{v} IS NULL", lit("JSON decode error.")),
        (f"NOT startswith(schema_of_variant({v}), 'OBJECT')", lit("Expected a JSON object.")),
        (f"size({missing}) > 0", missing_text),
        (f"NOT {_among(v, '$.schema_version', [V.REPLY_SCHEMA_VERSION])}",
         wrong("$.schema_version", "Invalid schema_version: ", f". Expected '{V.REPLY_SCHEMA_VERSION}'.")),
        (f"NOT coalesce({whole}, false)",
         wrong("$.semantic_score", "semantic_score must be an integer 0–100, got ", ".")),
        one_of("$.verdict", V.REPLY_VERDICTS),
        one_of("$.confidence", V.REPLY_CONFIDENCES),
        (f"NOT {_among(v, '$.recommended_user_action', V.REPLY_ACTIONS)}",
         wrong("$.recommended_user_action", "Invalid recommended_user_action: ", ".")),
        (f"{_indicators(v)} IS NULL", lit("social_engineering_indicators must be an array.")),
        (f"size({errors}) > 0", f"try_element_at({errors}, 1)"),
        (_too_long(v, "$.rationale", V.MAX_RATIONALE_CHARS),
         lit(f"rationale exceeds {V.MAX_RATIONALE_CHARS} characters.")),
        (_too_long(v, "$.uncertainty_notes", V.MAX_NOTES_CHARS),
         lit(f"uncertainty_notes exceeds {V.MAX_NOTES_CHARS} characters.")),
    ]
    if strict:
        checks.append((_unknown_keys(json, V.REPLY_FIELDS), lit("Unknown fields in the answer.")))
    return case(*checks)


def _indicator_structs(array: str) -> str:
    fields = ", ".join(f"{lit(f)}, {_get('x', '$.' + f, 'string')}" for f in V.INDICATOR_FIELDS)
    return f"transform({array}, x -> named_struct({fields}))"


def _verdict(values: dict[str, str]) -> str:
    fields = ", ".join(f"{lit(name)}, {values[name]}" for name in V.REPLY_FIELDS)
    return f"CAST(named_struct({fields}) AS {VERDICT})"


def _parsed(v: str) -> str:
    values = {f: _get(v, f"$.{f}", "string") for f in V.REPLY_FIELDS}
    values["semantic_score"] = case(
        (f"{_type(v, '$.semantic_score')} = 'BOOLEAN'",
         f"CAST({_get(v, '$.semantic_score', 'boolean')} AS INT)"),
        otherwise=_get(v, "$.semantic_score", "int"),
    )
    values["social_engineering_indicators"] = _indicator_structs(_indicators(v))
    return _verdict(values)


def check(replies: DataFrame, *, strict: bool = False) -> DataFrame:
    """Add ``json``, ``reason`` (null = valid) and ``verdict`` (null = invalid)."""
    kept = replies.columns
    found = replies.selectExpr(*kept, f"{extract_json('raw_response')} AS json")
    # parsed once in a projection of its own, then looked into by every check
    opened = found.selectExpr(*kept, "json", "try_parse_json(json) AS _v")
    judged = opened.selectExpr(*kept, "json", "_v", f"{reason('json', '_v', strict=strict)} AS reason")
    return judged.selectExpr(
        *kept, "json", "reason", f"{case(('reason IS NULL', _parsed('_v')))} AS verdict"
    )


def fallback(score: str = str(V.FALLBACK_SCORE)) -> str:
    return _verdict({
        "schema_version": lit(V.REPLY_SCHEMA_VERSION),
        "semantic_score": score,
        "verdict": lit(V.FALLBACK_VERDICT),
        "confidence": lit(V.FALLBACK_CONFIDENCE),
        "social_engineering_indicators": f"CAST(array() AS array<{INDICATOR}>)",
        "rationale": lit(V.FALLBACK_RATIONALE),
        "recommended_user_action": lit(V.FALLBACK_ACTION),
        "uncertainty_notes": lit(V.FALLBACK_NOTES),
    })


def pick(checked: DataFrame, key: str = "email_id", attempts: int | None = None) -> DataFrame:
    """One verdict per mail: the first valid of all landed attempts, else the fallback.

    ``attempts`` limits how many count; a set limit is the caller's choice, none is built in.

    A min-by aggregate, combined before the shuffle; ``attempt_used`` is null for the
    fallback, and such rows must never be stored for reuse.
    """
    usable = checked if attempts is None else checked.where(F.col("attempt") < attempts)
    order = "CASE WHEN reason IS NULL THEN attempt END"
    best = usable.groupBy(key).agg(
        F.expr(f"min({order}) AS attempt_used"),
        F.expr(f"min_by(struct(verdict, model, produced_at), {order}) AS _b"),
    )
    return best.selectExpr(
        key, "attempt_used", f"coalesce(_b.verdict, {fallback()}) AS verdict",
        "_b.model AS model", "_b.produced_at AS produced_at",
    )


def normalise(answers: DataFrame, json: str) -> DataFrame:
    """Free-form answer objects (JSON text) as the fixed set of fields used downstream."""
    kept = answers.columns
    opened = answers.selectExpr(*kept, f"try_parse_json({json}) AS _v")

    def text(names: list[str], default: str) -> str:
        tried = ", ".join(_get("_v", f"$.{n}", "string") for n in names)
        return f"coalesce({tried}, {lit(default)})"

    score = f"coalesce({_get('_v', '$.semantic_score', 'int')}, {_get('_v', '$.score', 'int')}, 0)"
    listed = f"coalesce({_indicators('_v')}, CAST(array() AS array<variant>))"
    return opened.selectExpr(
        *kept,
        f"{score} AS score",
        f"{score} AS semantic_score",
        f"{text(['verdict'], 'suspicious')} AS verdict",
        f"{text(['confidence'], 'low')} AS confidence",
        f"{text(['risk_level'], '')} AS risk_level",
        f"{text(['rationale', 'rational'], '')} AS rational",
        f"{text(['rationale', 'rational'], '')} AS rationale",
        f"{text(['recommended_user_action'], '')} AS recommended_user_action",
        f"{text(['uncertainty_notes'], '')} AS uncertainty_notes",
        f"{text(['schema_version'], '1.0')} AS schema_version",
        f"{_indicator_structs(listed)} AS findings",
    )


def indicators(verdicts: DataFrame, keep: list[str]) -> DataFrame:
    """One row per social-engineering indicator."""
    return verdicts.selectExpr(*keep, "inline(verdict.social_engineering_indicators)")


def prompt(findings: str, sanitised: str) -> str:
    """The message a model is asked with: evidence, metadata note, sanitised body."""
    shown = (
        "named_struct('type', f.type, 'severity', f.severity, "
        "'description', f.description, 'evidence', f.evidence)"
    )
    evidence = f"to_json(transform({findings}, f -> {shown}), map('pretty', 'true'))"
    middle = (
        "\n</DETERMINISTIC_EVIDENCE>\n\n<EMAIL_METADATA>\n" + V.METADATA_NOTE
        + "\n</EMAIL_METADATA>\n\n<UNTRUSTED_EMAIL>\n"
    )
    head, tail = lit("<DETERMINISTIC_EVIDENCE>\n"), lit("\n</UNTRUSTED_EMAIL>")
    return f"concat({head}, {evidence}, {lit(middle)}, {sanitised}, {tail})"
