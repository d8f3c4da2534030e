"""Body rules: urgency wording, tracking pixels, hidden text.

Scanning bodies is the bulk of all work, so each regex sits behind a plain
substring test that must hold whenever the regex matches.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from mailsieve import fixed_values as V
from mailsieve.functions.sql import case, either, fill, lit
from mailsieve.functions.text import clip, first_match, has_twins, ignore_case, match_start, start_of
from mailsieve.operators.findings import collect, finding

KIND = "SUSPICIOUS_CONTENT"
NAME = "content"


@dataclass(frozen=True)
class BodyRule:
    signal: str
    severity: str
    patterns: tuple[str, ...]       # the first that matches wins
    # per pattern: groups of lower-case words; any match contains one word of each group
    words: tuple[tuple[tuple[str, ...], ...], ...]
    text: str
    evidence_key: str
    evidence_chars: int
    label: str | None = None
    far: bool = False               # looks beyond the neighbours of its match


# one entry per urgency rule: words of which every match contains at least one
_URGENCY_WORDS = [
    ("account",),
    ("verify",),
    ("unusual",),
    ("immediately",),
    ("required", "urgent"),
    ("now", "immediately"),
    ("expire", "limited", "deadline"),
    ("within", "next"),
    ("account",),
    ("failure",),
    ("legal", "enforcement"),
    ("confirm",),
    ("update",),
]

# words of which every tracking URL has one, per pattern
_TRACKING_WORDS = [
    ("track", "pixel", "beacon", "open", "click", "analytics", "trk", "t.co"),
    (".gif", ".png", ".jpg"),
    ("/track",),
]

RULES: list[BodyRule] = [
    BodyRule(
        "urgency_cue", severity, (ignore_case(pattern),), ((words,),), V.TEXT_URGENCY,
        "matched_text", 200, label=label,
    )
    for (label, severity, pattern), words in zip(V.URGENCY_RULES, _URGENCY_WORDS, strict=True)
] + [
    BodyRule("tracking_pixel_1x1_img", "MEDIUM", ("(?iUs)" + V.PIXEL_IMG,), ((("<img",),),),
             V.TEXT_PIXEL_IMG, "matched_tag", 300),
    BodyRule("tracking_url_pattern", "MEDIUM", tuple(ignore_case(p) for p in V.TRACKING_URLS),
             tuple((("://",), words) for words in _TRACKING_WORDS),
             V.TEXT_TRACKING_URL, "matched_url", 300),
    BodyRule("hidden_text_zero_font", "HIGH", (ignore_case(V.ZERO_FONT),), ((("font-size",),),),
             V.TEXT_ZERO_FONT, "matched_css", 200),
    BodyRule("hidden_text_display_none", "HIGH", (ignore_case(V.HIDDEN_DISPLAY),),
             ((("display", "visibility"), ("none", "hidden")),),
             V.TEXT_HIDDEN_DISPLAY, "matched_css", 200),
    BodyRule("hidden_text_color_match", "HIGH", (ignore_case(V.SAME_COLOUR),),
             ((("background",), ("color",)),), V.TEXT_SAME_COLOUR, "matched_css", 200),
    BodyRule("hidden_text_html_comment", "MEDIUM", ("(?Us)" + V.OPEN_COMMENT,), ((("<!--",),),),
             V.TEXT_OPEN_COMMENT, "snippet", 200, far=True),
]
SIGNALS = list(dict.fromkeys(r.signal for r in RULES))


def _gate(groups: tuple[tuple[str, ...], ...]) -> str:
    words = " AND ".join(either(f"contains(_low, {lit(w)})" for w in group) for group in groups)
    return f"_twins OR ({words})"


def add(df: DataFrame, *, only: Iterable[str] | None = None, to: str = "content_findings") -> DataFrame:
    """Add the list of content findings; ``only`` restricts it to some signals."""
    wanted = set(only) if only is not None else set(SIGNALS)
    rules = [r for r in RULES if r.signal in wanted]
    kept = df.columns
    body = "coalesce(body, '')"
    gated = df.selectExpr(
        *kept, f"{body} AS _body", f"lower({body}) AS _low", f"{has_twins(body)} AS _twins"
    )
    matched = gated.selectExpr(
        *kept, "_body",
        *[
            f"{first_match('_body', pattern, _gate(rule.words[j]))} AS _m{i}_{j}"
            for i, rule in enumerate(rules)
            for j, pattern in enumerate(rule.patterns)
        ],
    )
    return matched.selectExpr(*kept, f"{collect(_finding(i, r) for i, r in enumerate(rules))} AS {to}")


def _finding(i: int, rule: BodyRule) -> str:
    tried = [(f"_m{i}_{j} != ''", f"_m{i}_{j}", p) for j, p in enumerate(rule.patterns)]
    match = case(*[(here, m) for here, m, _ in tried])
    start = case(*[
        (here, match_start("_body", p) if rule.far else start_of("_body", m, p)) for here, m, p in tried
    ])
    evidence = {"label": lit(rule.label)} if rule.label else {}
    evidence[rule.evidence_key] = clip(match, rule.evidence_chars)
    evidence["match_start"] = start
    text = fill(rule.text, label=lit(rule.label), text=clip(match, 120))
    hit = either(here for here, _, _ in tried)
    return finding(hit, NAME, rule.signal, KIND, rule.severity, text, evidence)
