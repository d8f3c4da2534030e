"""DuckDB SQL for every query that standard SQL can express, on the same tables.

Written from the rules' definitions, apart from the fixed texts and lists.  Regexes are
RE2 here: back-references, look-around and long repeats are restated by other means.
"""

from __future__ import annotations

import re

from mailsieve import fixed_values as V
from mailsieve.catalog import views as W

D = W.DUCKDB
ORACLE: dict[str, str] = {}


def q(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def qs(values: list[str]) -> str:
    return ", ".join(q(v) for v in values)


def say(template: str, **parts: str) -> str:
    pieces = re.split(r"\{(\w+)\}", template)
    return "(" + " || ".join(
        f"CAST({parts[p]} AS VARCHAR)" if i % 2 else q(p) for i, p in enumerate(pieces) if i % 2 or p
    ) + ")"


# ---- building blocks, pulled in by name -------------------------------------

CTES: dict[str, str] = {
    "emails": W.emails_sql(D),
    "html_mails": W.html_mails_sql(D),
    "urlhaus": W.malware_feed_sql(D),
    "phishtank": W.phish_feed_sql(D),
    "replies": W.replies_sql(D),
    "files": (
        "SELECT e.email_id, CAST(row_number() OVER (PARTITION BY e.email_id ORDER BY t.pos) - 1 AS INTEGER) AS position, "
        "trim(t.name) AS filename, trim(t.mime) AS mime_type, "
        "lower(trim(split_part(t.mime, ';', 1))) AS mime, "
        "CASE WHEN position('.' IN t.name) > 0 THEN lower(regexp_extract(t.name, '[^.]*$')) ELSE '' END AS ext, "
        "CAST(coalesce(t.size, 0) AS BIGINT) AS size, CAST(t.size AS BIGINT) AS size_bytes "
        f"FROM emails e JOIN (VALUES {W.attachments_values()}) t(kind, pos, name, mime, size) "
        "ON t.kind = e.attach_kind WHERE trim(t.name) <> ''"
    ),
    "dom": (
        "SELECT email_id, dom AS domain, folded, registered_date, "
        "CASE WHEN position('.' IN rtrim(dom, '.')) > 0 "
        "THEN regexp_extract(rtrim(dom, '.'), '[^.]*[.][^.]*$') ELSE dom END AS reg, "
        "CASE WHEN position('.' IN rtrim(folded, '.')) > 0 "
        "THEN regexp_extract(rtrim(folded, '.'), '[^.]*[.][^.]*$') ELSE folded END AS folded_reg "
        "FROM (SELECT *, replace(replace(replace(replace(translate(dom, "
        f"{q(''.join(V.DOMAIN_CONFUSABLES))}, {q(''.join(V.DOMAIN_CONFUSABLES.values()))}), "
        "'rn', 'm'), 'vv', 'w'), 'cl', 'd'), 'li', 'h') AS folded FROM ("
        "SELECT email_id, registered_date, lower(CASE WHEN sender LIKE '%@%' "
        "THEN regexp_extract(sender, '[^@]*$') ELSE 'unknown' END) AS dom FROM emails))"
    ),
    "brands": f"SELECT unnest([{qs(V.BRANDS)}]) AS brand",
    "auth": (
        "SELECT email_id, h_auth AS ar, coalesce(trim(h_received_spf), '') AS rs, h_dkim_signature AS sig, "
        f"nullif(lower(regexp_extract(h_auth, '(?i)\\bspf=({'|'.join(V.SPF_RESULTS)})', 1)), '') AS spf1, "
        f"nullif(lower(regexp_extract(coalesce(trim(h_received_spf), ''), '(?i)^({'|'.join(V.SPF_RESULTS)})', 1)), '') AS spf2, "
        f"nullif(lower(regexp_extract(h_auth, '(?i)\\bdkim=({'|'.join(V.DKIM_RESULTS)})', 1)), '') AS dkim, "
        f"nullif(lower(regexp_extract(h_auth, '(?i)\\bdmarc=({'|'.join(V.DMARC_RESULTS)})', 1)), '') AS dmarc "
        "FROM emails"
    ),
    # the instant itself is a column of the view: the header was written from it
    "sent": (
        "SELECT email_id, send_ts AS utc, CASE WHEN n_chars % 2 = 1 THEN 120 ELSE 0 END AS off, "
        f"date_diff('second', {W.AS_OF_SQL}, send_ts) AS skew FROM emails"
    ),
    "links": (
        "SELECT email_id, CAST(row_number() OVER (PARTITION BY email_id ORDER BY first_at) - 1 AS INTEGER) AS position, url "
        "FROM (SELECT email_id, url, min(pos0) AS first_at FROM ("
        "SELECT email_id, rtrim(u, '.,;:!?)') AS url, pos0 FROM ("
        "SELECT email_id, unnest(l) AS u, generate_subscripts(l, 1) AS pos0 FROM ("
        "SELECT email_id, regexp_extract_all(body, "
        + q("(?i)https?://[^\\s\"'<>\\]\\[)(\\{\\}]{4,1000}")
        + ") AS l FROM emails))) GROUP BY email_id, url) QUALIFY row_number() OVER (PARTITION BY email_id ORDER BY first_at) <= 10"
    ),
}

PARTS: dict[str, str] = {}      # findings per rule: email_id, type, severity, description, evidence


def _body_match(view: str, patterns: list[str]) -> str:
    """First pattern that matches: text and 0-based start."""
    m = [f"regexp_extract(body, {q(p)})" for p in patterns]
    starts = []
    for p in patterns:
        flags = re.match(r"\(\?(\w+)\)", p).group(0)
        starts.append(f"length(regexp_extract(body, {q(flags + '^((?s:.*?))(?:' + p[len(flags):] + ')')}, 1))")
    text = "CASE " + " ".join(f"WHEN {x} <> '' THEN {x}" for x in m) + " END"
    start = "CASE " + " ".join(f"WHEN {x} <> '' THEN {s}" for x, s in zip(m, starts)) + " END"
    return f"(SELECT email_id, {text} AS m, {start} AS pos0 FROM {view} WHERE {' OR '.join(f'{x} <> {q(str())}' for x in m)})"


def _body_part(view: str, patterns: list[str], kind: str, severity: str, template: str,
               name: str, chars: int, label: str | None = None) -> str:
    extra = f", {q(label)} AS label" if label else ""
    return (
        f"SELECT email_id, {q(kind)} AS signal, 'SUSPICIOUS_CONTENT' AS type, {q(severity)} AS severity, "
        f"{say(template, label=q(label), text='m[1:120]')} AS description{extra}, m[1:{chars}] AS {name}, "
        f"CAST(pos0 AS VARCHAR) AS match_start FROM {_body_match(view, patterns)}"
    )


def _urgency(view: str) -> str:
    return "\nUNION ALL ".join(
        _body_part(view, ["(?i)" + p], "urgency_cue", s, V.TEXT_URGENCY, "matched_text", 200, label)
        for label, s, p in V.URGENCY_RULES
    )


_COLOURS = ["#ffffff", "#fff", "#000000", "#000", "white", "black"]
# the colour rule without its back-reference: one alternative per colour
_SAME_COLOUR = "(?i)(?:" + "|".join(
    rf"color\s*:\s*{c}\b[^;\"']{{0,80}}background(?:-color)?\s*:\s*{c}" for c in _COLOURS
) + ")"


def _comment(view: str) -> str:
    """First `<!--` after the last `-->`, with at least 200 characters after it."""
    tail = "length(body) - coalesce(nullif(strpos(reverse(body), '>--'), 0), length(body) + 1) + 1"
    at = f"(strpos(substr(body, {tail} + 1), '<!--') + {tail} - 1)"
    return (
        "SELECT email_id, 'hidden_text_html_comment' AS signal, 'SUSPICIOUS_CONTENT' AS type, 'MEDIUM' AS severity, "
        f"{q(V.TEXT_OPEN_COMMENT)} AS description, substr(body, pos0 + 1, 200) AS snippet, "
        f"CAST(pos0 AS VARCHAR) AS match_start FROM (SELECT email_id, body, {at} AS pos0, "
        f"strpos(substr(body, {tail} + 1), '<!--') AS found FROM {view}) "
        "WHERE found > 0 AND length(body) - (pos0 + 4) >= 200"
    )


def _content(view: str) -> dict[str, str]:
    return {
        "con_urgency": _urgency(view),
        "con_pixel_img": _body_part(view, ["(?is)" + V.PIXEL_IMG], "tracking_pixel_1x1_img", "MEDIUM",
                                    V.TEXT_PIXEL_IMG, "matched_tag", 300),
        "con_pixel_url": _body_part(view, ["(?i)" + p for p in V.TRACKING_URLS], "tracking_url_pattern",
                                    "MEDIUM", V.TEXT_TRACKING_URL, "matched_url", 300),
        "con_hidden_zero_font": _body_part(view, ["(?i)" + V.ZERO_FONT], "hidden_text_zero_font", "HIGH",
                                           V.TEXT_ZERO_FONT, "matched_css", 200),
        "con_hidden_display": _body_part(view, ["(?i)" + V.HIDDEN_DISPLAY], "hidden_text_display_none",
                                         "HIGH", V.TEXT_HIDDEN_DISPLAY, "matched_css", 200),
        "con_hidden_color": _body_part(view, [_SAME_COLOUR], "hidden_text_color_match", "HIGH",
                                       V.TEXT_SAME_COLOUR, "matched_css", 200),
        "con_hidden_comment": _comment(view),
    }


def _file_part(signal: str, kind: str, severity: str, template: str, where: str, **evidence: str) -> str:
    parts = {
        "filename": "filename", "mime": "mime", "ext": "ext", "real": "ext",
        "decoy": "lower(split_part(filename, '.', -2))", "word": f"regexp_extract(filename, {q('(?i)' + V.LURE_WORDS)})",
        "expected": "(SELECT expected[1] FROM exts x WHERE x.e = ext)",
        "megabytes": "printf('%.1f', size / 1048576.0)",
    }
    evidence.setdefault("x_size_bytes", "CAST(size_bytes AS VARCHAR)")
    used = "".join(f", {v} AS {k}" for k, v in evidence.items())
    return (
        f"SELECT email_id, {q(signal)} AS signal, {q(kind)} AS type, {severity} AS severity, "
        f"{say(template, **parts)} AS description, filename{used} FROM files WHERE {where}"
    )


CTES["exts"] = "SELECT * FROM (VALUES " + ", ".join(
    f"({q(e)}, [{qs(sorted(m))}])" for e, m in V.EXTENSION_MIMES.items()
) + ") t(e, expected)"
_DANGEROUS = f"ext IN ({qs(V.DANGEROUS_EXTENSIONS)})"
_BAD = f"mime IN ({qs(V.ALWAYS_BAD_MIMES)})"
_WORD = f"regexp_extract(filename, {q('(?i)' + V.LURE_WORDS)})"
_SIZE = "CAST(size_bytes AS VARCHAR)"
_ATTACHMENTS = {
    "att_bad_mime": _file_part("always_suspicious_mime", "MALWARE", "'CRITICAL'", V.TEXT_BAD_MIME, _BAD,
                               mime_type="mime", size_bytes=_SIZE),
    "att_mime_mismatch": _file_part(
        "mime_extension_mismatch", "MALWARE",
        "CASE WHEN mime LIKE '%executable%' OR mime LIKE '%msdownload%' OR mime LIKE '%dosexec%' "
        "THEN 'CRITICAL' ELSE 'HIGH' END", V.TEXT_MIME_MISMATCH,
        f"mime <> '' AND NOT {_BAD} AND EXISTS (SELECT 1 FROM exts x WHERE x.e = ext AND NOT list_contains(x.expected, mime))",
        extension="ext", declared_mime="mime",
        expected_mimes="(SELECT array_to_string(expected, ',') FROM exts x WHERE x.e = ext)"),
    "att_dangerous_ext": _file_part(
        "dangerous_extension", "MALWARE",
        f"CASE WHEN ext IN ({qs(V.CRITICAL_EXTENSIONS)}) THEN 'CRITICAL' ELSE 'HIGH' END",
        V.TEXT_DANGEROUS, _DANGEROUS, extension="ext", mime_type="nullif(mime_type, '')"),
    "att_double_ext": _file_part(
        "double_extension", "MALWARE", "'CRITICAL'", V.TEXT_DOUBLE,
        f"regexp_matches(filename, {q(V.DOUBLE_EXTENSION)}) AND {_DANGEROUS}",
        decoy_extension="lower(split_part(filename, '.', -2))", real_extension="ext"),
    "att_lure_name": (
        _file_part("lure_filename", "SUSPICIOUS_CONTENT", "'HIGH'", V.TEXT_LURE_DANGEROUS,
                   f"{_WORD} <> '' AND {_DANGEROUS}", matched_keyword=_WORD, extension="nullif(ext, '')")
        + "\nUNION ALL "
        + _file_part("lure_filename", "SUSPICIOUS_CONTENT", "'MEDIUM'", V.TEXT_LURE,
                     f"{_WORD} <> '' AND NOT {_DANGEROUS}", matched_keyword=_WORD, extension="nullif(ext, '')")
    ),
    "att_zero_byte": _file_part("zero_byte_attachment", "SUSPICIOUS_CONTENT", "'LOW'", V.TEXT_ZERO_BYTE,
                                "size = 0", mime_type="nullif(mime_type, '')", size_bytes="'0'"),
    "att_large": _file_part("large_attachment", "SUSPICIOUS_CONTENT", "'LOW'", V.TEXT_LARGE,
                            "size > 10485760", mime_type="nullif(mime_type, '')", size_bytes="CAST(size AS VARCHAR)"),
}


def _texts(table: dict[str, str], value: str) -> str:
    whens = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in table.items())
    return f"CASE {value} {whens} ELSE {q(table['unknown'])} END"


_AUTH = "SELECT email_id, {signal} AS signal, 'AUTHENTICATION_FAILURE' AS type, {severity} AS severity, {text} AS description, {result} AS result, {raw} AS raw_header FROM auth"
_HEADERS = {
    "hdr_spf": _AUTH.format(
        signal="'spf'", result="coalesce(spf1, spf2, 'none')",
        severity="CASE coalesce(spf1, spf2) WHEN 'fail' THEN 'HIGH' WHEN 'softfail' THEN 'MEDIUM' ELSE 'LOW' END",
        text=f"CASE WHEN coalesce(spf1, spf2) IS NULL THEN {q(V.TEXT_SPF_MISSING)} ELSE {_texts(V.SPF_TEXT, 'coalesce(spf1, spf2)')} END",
        raw="CASE WHEN spf1 IS NOT NULL THEN ar[1:500] WHEN spf2 IS NOT NULL THEN rs[1:500] ELSE '' END"),
    "hdr_dkim": _AUTH.format(
        signal="'dkim'", result="coalesce(dkim, 'none')",
        severity="CASE WHEN dkim IN ('fail', 'permerror') THEN 'HIGH' ELSE 'LOW' END",
        text=f"CASE WHEN dkim IS NOT NULL THEN {_texts(V.DKIM_TEXT, 'dkim')} WHEN sig IS NOT NULL THEN {q(V.TEXT_DKIM_UNVERIFIED)} ELSE {q(V.TEXT_DKIM_MISSING)} END",
        raw="CASE WHEN dkim IS NOT NULL THEN ar[1:500] WHEN sig IS NOT NULL THEN sig[1:200] ELSE '' END"),
    "hdr_dmarc": _AUTH.format(
        signal="'dmarc'", result="coalesce(dmarc, 'none')",
        severity="CASE WHEN dmarc = 'fail' THEN 'HIGH' WHEN dmarc IS NULL OR dmarc = 'none' THEN 'MEDIUM' ELSE 'LOW' END",
        text=f"CASE WHEN dmarc IS NULL THEN {q(V.TEXT_DMARC_MISSING)} ELSE {_texts(V.DMARC_TEXT, 'dmarc')} END",
        raw="CASE WHEN dmarc IS NOT NULL THEN ar[1:500] ELSE '' END"),
}

_DOM = "SELECT email_id, {signal} AS signal, 'DOMAIN_LOOKALIKE' AS type, {severity} AS severity, {text} AS description, domain, {brand} AS matched_brand FROM {source}"
_BORN = f"(SELECT *, try_cast(registered_date AS DATE) AS born, date_diff('day', try_cast(registered_date AS DATE), DATE '{W.AS_OF.date()}') AS age FROM dom)"
_PREFIX = "(SELECT * FROM dom, brands WHERE starts_with(domain, brand || '.') AND reg <> brand)"
_LABEL = (
    "(SELECT *, split_part(brand, '.', 1) AS label FROM dom, brands "
    "WHERE list_contains(string_split(domain, '.'), split_part(brand, '.', 1)) AND reg <> brand "
    "AND reg <> split_part(brand, '.', 1) || '.com' AND NOT ends_with(domain, '.' || brand))"
)
_DOMAINS = {
    "dom_age": _DOM.format(
        signal="'domain_age'", brand="''", source=f"{_BORN} WHERE born IS NULL OR age < 180",
        severity="CASE WHEN born IS NULL OR age < 0 THEN 'LOW' WHEN age < 30 THEN 'HIGH' ELSE 'MEDIUM' END",
        text="CASE WHEN born IS NULL THEN " + say(V.TEXT_AGE_UNKNOWN, domain="domain")
        + " WHEN age < 0 THEN " + say(V.TEXT_AGE_FUTURE, domain="domain", date="born")
        + " WHEN age < 30 THEN " + say(V.TEXT_AGE_YOUNG, domain="domain", date="born", days="age")
        + " ELSE " + say(V.TEXT_AGE_RECENT, domain="domain", date="born", days="age") + " END"),
    "dom_homograph": _DOM.format(
        signal="'homograph'", brand="coalesce(brand, '')",
        source="(SELECT dom.*, brand FROM dom LEFT JOIN brands ON folded_reg = brand WHERE strlen(domain) <> length(domain))",
        severity="CASE WHEN brand IS NOT NULL THEN 'HIGH' ELSE 'MEDIUM' END",
        text="CASE WHEN brand IS NOT NULL THEN " + say(V.TEXT_HOMOGRAPH_BRAND, domain="domain", brand="brand")
        + " ELSE " + say(V.TEXT_HOMOGRAPH, domain="domain") + " END"),
    "dom_typosquat": _DOM.format(
        signal="'typosquatting'", brand="brand",
        source="(SELECT *, levenshtein(folded_reg, brand) AS edits FROM dom, brands) WHERE edits BETWEEN 1 AND 2",
        severity="CASE WHEN edits = 1 THEN 'HIGH' ELSE 'MEDIUM' END",
        text=say(V.TEXT_TYPOSQUAT, domain="domain", edits="edits", brand="brand")),
    "dom_subdomain_best": "SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY email_id ORDER BY severity, matched_brand) AS r FROM ("
    + _DOM.format(signal="'subdomain_abuse'", brand="brand", source=_PREFIX, severity="'HIGH'",
                  text=say(V.TEXT_SUBDOMAIN_PREFIX, domain="domain", brand="brand", registrable="reg"))
    + " UNION ALL "
    + _DOM.format(signal="'subdomain_abuse'", brand="brand", source=_LABEL, severity="'MEDIUM'",
                  text=say(V.TEXT_SUBDOMAIN_LABEL, domain="domain", label="label", registrable="reg"))
    + ")) WHERE r = 1",
}

_TIME = "SELECT email_id, {signal} AS signal, 'SUSPICIOUS_CONTENT' AS type, {severity} AS severity, {text} AS description{evidence} FROM sent WHERE {where}"
_ISO = "strftime({x}, '%Y-%m-%dT%H:%M:%S')"
_UTC = _ISO.format(x="utc") + " || '+00:00'"
_NOW = q(f"{W.AS_OF:%Y-%m-%dT%H:%M:%S}+00:00")
_LOCAL = "utc + to_minutes(off)"
_TEMPORAL = {
    "tmp_missing": _TIME.format(signal="'missing_or_invalid_date_header'", severity="'LOW'",
                                text=q(V.TEXT_NO_DATE), evidence="", where="utc IS NULL"),
    "tmp_off_hours": _TIME.format(
        signal="'off_hours_send'", severity="'MEDIUM'",
        text=say(V.TEXT_OFF_HOURS, utc="strftime(utc, '%H:%M')", local=f"strftime({_LOCAL}, '%H:%M')",
                 zone="CASE off WHEN 0 THEN 'UTC' ELSE 'UTC+02:00' END"),
        evidence=f", {_UTC} AS send_time_utc, {_ISO.format(x=_LOCAL)} || CASE off WHEN 0 THEN '+00:00' ELSE '+02:00' END AS send_time_local, CAST(hour(utc) AS VARCHAR) AS hour_utc, {q(V.OFF_HOURS_WINDOW)} AS x_off_hours_window",
        where="hour(utc) IN (2, 3, 4)"),
    "tmp_future": _TIME.format(
        signal="'future_dated_email'", severity="'HIGH'",
        text=say(V.TEXT_FUTURE, minutes="CAST(round_even(CAST(skew AS DOUBLE) / 60, 0) AS BIGINT)"),
        evidence=f", {_UTC} AS send_time_utc, CAST(CAST(round(CAST(skew AS DECIMAL(18,4)) / 60, 1) AS DECIMAL(20,1)) AS VARCHAR) AS skew_minutes, {_NOW} AS x_current_time_utc",
        where="skew > 900"),
    "tmp_stale": _TIME.format(
        signal="'stale_email'", severity="'MEDIUM'",
        text=say(V.TEXT_STALE, days="(-skew // 86400)", date="strftime(utc, '%Y-%m-%d')"),
        evidence=f", {_UTC} AS send_time_utc, CAST(-skew // 86400 AS VARCHAR) AS age_days, {_NOW} AS x_current_time_utc",
        where="skew < -2592000"),
}

_LISTED = "(SELECT url, coalesce(threat, 'malware_download') AS threat, coalesce(url_status, 'unknown') AS status, coalesce(tag_text, '') AS tags, id FROM urlhaus WHERE query_status = 'is_listed')"
_PHISH = "(SELECT url, coalesce(phish_id, 'unknown') AS phish_id, phish_detail_page AS page, CASE WHEN verified THEN 'True' ELSE 'False' END AS verified FROM phishtank WHERE in_database AND valid)"
_LINKS = {
    "rep_malware_feed": "SELECT email_id, position, 'urlhaus_listed' AS signal, 'MALWARE' AS type, 'CRITICAL' AS severity, "
    + say(V.TEXT_MALWARE_URL, url="url[1:200]", threat="threat", status="status")
    + f" AS description, url[1:500] AS url, threat AS x_threat, status AS x_url_status, tags AS x_tags, id AS x_urlhaus_id FROM links JOIN {_LISTED} USING (url)",
    "rep_phish_feed": "SELECT email_id, position, 'phishtank_listed' AS signal, 'PHISHING' AS type, 'CRITICAL' AS severity, "
    + say(V.TEXT_PHISH_URL, url="url[1:200]", phish_id="phish_id")
    + f" AS description, url[1:500] AS url, phish_id AS x_phish_id, page[1:300] AS x_phish_detail_url, verified AS x_verified FROM links JOIN {_PHISH} USING (url)",
}

# every finding with its place: analyzers in order, rules in order inside
_ORDER: list[tuple[str, str, int, str]] = []
for _i, (_name, _rules) in enumerate([
    ("headers", _HEADERS), ("domains", _DOMAINS), ("attachments", _ATTACHMENTS),
    ("content", _content("emails")), ("temporal", _TEMPORAL), ("reputation", _LINKS),
]):
    for _j, (_key, _sql) in enumerate(_rules.items()):
        _ORDER.append((_name, _key, _i * 100 + _j, _sql))


def _place(name: str, key: str, rank: int) -> str:
    """Sort key inside a mail, as SQL over the rule's own columns."""
    if name == "attachments":
        return "filename"
    if name == "reputation":
        return "CAST(position AS VARCHAR)"
    if key == "dom_typosquat":
        return "CAST(list_position([" + qs(V.BRANDS) + "], matched_brand) + 100 AS VARCHAR)"
    if key == "con_urgency":
        return "CAST(list_position([" + qs([r[0] for r in V.URGENCY_RULES]) + "], label) + 100 AS VARCHAR)"
    return "''"


def _rank(name: str, rank: int) -> str:
    # attachments list all rules of one file before the next file; links both feeds per link
    return str(rank - rank % 100) if name in ("attachments", "reputation") else str(rank)


CTES["findings"] = "\nUNION ALL ".join(
    f"SELECT email_id, {q(name)} AS analyzer, signal, type, severity, "
    f"CASE severity WHEN 'CRITICAL' THEN 40 WHEN 'HIGH' THEN 25 WHEN 'MEDIUM' THEN 12 ELSE 4 END AS weight, "
    f"{_rank(name, rank)} AS r1, {_place(name, key, rank)} AS r2, {rank} AS r3 FROM ({sql})"
    for name, key, rank, sql in _ORDER
)
#: the evidence of each rule's findings, in order; columns that the flat query does not show begin with ``x_``
_EVIDENCE = {
    "con_urgency": "label matched_text match_start", "con_pixel_img": "matched_tag match_start", "con_pixel_url": "matched_url match_start",
    "con_hidden_zero_font": "matched_css match_start", "con_hidden_display": "matched_css match_start",
    "con_hidden_color": "matched_css match_start", "con_hidden_comment": "snippet match_start",
    "att_bad_mime": "filename mime_type size_bytes", "att_mime_mismatch": "filename extension declared_mime expected_mimes x_size_bytes",
    "att_dangerous_ext": "filename extension mime_type x_size_bytes", "att_double_ext": "filename decoy_extension real_extension x_size_bytes",
    "att_lure_name": "filename matched_keyword extension x_size_bytes", "att_zero_byte": "filename mime_type size_bytes",
    "att_large": "filename mime_type size_bytes", "tmp_missing": "",
    "tmp_off_hours": "send_time_utc send_time_local hour_utc x_off_hours_window",
    "tmp_future": "send_time_utc x_current_time_utc skew_minutes", "tmp_stale": "send_time_utc x_current_time_utc age_days",
    "rep_malware_feed": "url x_threat x_url_status x_tags x_urlhaus_id", "rep_phish_feed": "url x_phish_id x_phish_detail_url x_verified",
    **{key: "result raw_header" for key in _HEADERS}, **{key: "domain matched_brand" for key in _DOMAINS},
}


def _pairs(key: str) -> list[tuple[str, str]]:
    return [("signal", "signal"), *((c.removeprefix("x_"), c) for c in _EVIDENCE[key].split())]


def _json_evidence(key: str) -> str:
    parts = [f"{q(chr(10) + '    ' + chr(34) + k + chr(34) + ' : ')} || coalesce(to_json({c})::VARCHAR, 'null')" for k, c in _pairs(key)]
    return " || ',' || ".join(parts)


def _text_evidence(key: str) -> str:
    return " || chr(3) || ".join(f"{q(k + '=')} || coalesce({c}, '')" for k, c in sorted(_pairs(key)))


CTES["told"] = "\nUNION ALL ".join(
    f"SELECT email_id, {_rank(name, rank)} AS r1, {_place(name, key, rank)} AS r2, {rank} AS r3, "
    f"type || chr(2) || severity || chr(2) || description || chr(2) || {_text_evidence(key)} AS t, "
    """'{\n  "type" : ' || to_json(type)::VARCHAR || ',\n  "severity" : ' || to_json(severity)::VARCHAR || ',\n  "description" : ' """
    f"""|| to_json(description)::VARCHAR || ',\n  "evidence" : {{' || {_json_evidence(key)} || '\n  }}\n}}' AS js FROM ({sql})"""
    for name, key, rank, sql in _ORDER
)
CTES["scores"] = (
    "SELECT e.email_id, CAST(least(coalesce(sum(f.weight), 0), 100) AS INTEGER) AS rule_score, "
    "CAST(count(f.email_id) AS INTEGER) AS finding_count "
    "FROM emails e LEFT JOIN findings f ON f.email_id = e.email_id GROUP BY e.email_id"
)

# ---- model replies ----------------------------------------------------------

CTES["found"] = (
    "SELECT *, CASE WHEN starts_with(trim(raw_response), '{') THEN trim(raw_response) "
    "ELSE coalesce(nullif(regexp_extract(raw_response, "
    + q("(?s)```(?:json)?\\s*(\\{.*?\\})\\s*```")
    + ", 1), ''), nullif(regexp_extract(raw_response, " + q("(?s)\\{.*\\}") + "), '')) END AS js FROM replies"
)
_REQUIRED = sorted(V.REPLY_FIELDS)
CTES["judged"] = (
    "SELECT email_id, attempt, js, list_filter([" + qs(_REQUIRED) + "], lambda f: NOT list_contains(json_keys(js), f)) AS missing, "
    "json_extract_string(js, '$.schema_version') AS version, json_extract_string(js, '$.semantic_score') AS score_text, "
    "json_type(js, '$.semantic_score') AS score_type, json_extract_string(js, '$.verdict') AS verdict, "
    "json_extract_string(js, '$.confidence') AS confidence, json_extract_string(js, '$.recommended_user_action') AS action, "
    "json_extract_string(js, '$.rationale') AS rationale, "
    "json_extract_string(js, '$.social_engineering_indicators[*].category') AS cats "
    "FROM found WHERE js IS NOT NULL"
)
_MISSING_TEXT = "'Missing required fields: [''' || array_to_string(missing, ''', ''') || ''']'"
_VERDICT_LIST = "[" + ", ".join(f"'{v}'" for v in sorted(V.REPLY_VERDICTS)) + "]"
CTES["reasons"] = (
    "SELECT f.email_id, f.attempt, CASE WHEN f.js IS NULL THEN 'No JSON object found in LLM response.' "
    f"WHEN len(missing) > 0 THEN {_MISSING_TEXT} "
    "WHEN version <> '1.0' THEN 'Invalid schema_version: ''' || version || '''. Expected ''1.0''.' "
    "WHEN score_type NOT IN ('UBIGINT', 'BIGINT') THEN 'semantic_score must be an integer 0–100, got ' || "
    "CASE score_type WHEN 'VARCHAR' THEN '''' || score_text || '''' ELSE rtrim(rtrim(score_text, '0'), '.') END || '.' "
    "WHEN CAST(score_text AS INTEGER) NOT BETWEEN 0 AND 100 THEN 'semantic_score must be an integer 0–100, got ' || score_text || '.' "
    f"WHEN verdict NOT IN ({qs(V.REPLY_VERDICTS)}) THEN 'Invalid verdict: ''' || verdict || '''. Must be one of ' || {q(_VERDICT_LIST)} || '.' "
    f"WHEN len(list_filter(cats, lambda c: c NOT IN ({qs(V.INDICATOR_CATEGORIES)}))) > 0 THEN "
    f"'social_engineering_indicators[' || CAST(list_position(list_transform(cats, lambda c: c IN ({qs(V.INDICATOR_CATEGORIES)})), false) - 1 AS VARCHAR) "
    f"|| '].category invalid: ''' || list_filter(cats, lambda c: c NOT IN ({qs(V.INDICATOR_CATEGORIES)}))[1] || '''.' "
    "WHEN length(rationale) > 600 THEN 'rationale exceeds 600 characters.' END AS reason "
    "FROM found f LEFT JOIN judged j ON j.email_id = f.email_id AND j.attempt = f.attempt"
)
CTES["picked"] = (
    "SELECT m.email_id, m.attempt AS attempt_used, coalesce(CAST(j.score_text AS INTEGER), 40) AS semantic_score, "
    "coalesce(j.verdict, 'suspicious') AS verdict, "
    f"coalesce(j.rationale, {q(V.FALLBACK_RATIONALE)}) AS rationale "
    "FROM (SELECT email_id, min(CASE WHEN reason IS NULL THEN attempt END) AS attempt FROM reasons GROUP BY email_id) m "
    "LEFT JOIN judged j ON j.email_id = m.email_id AND j.attempt = m.attempt"
)


def _band(score: str, bands: list[tuple[int, str]]) -> str:
    return "CASE " + " ".join(f"WHEN {score} >= {n} THEN {q(b)}" for n, b in bands) + " END"


CTES["verdicts"] = (
    "SELECT *, CAST(round(final, 1) AS DECIMAL(6,1)) AS final_score, "
    f"CASE WHEN llm_available THEN {_band('final', V.FUSED_BANDS)} ELSE {_band('final', V.RULES_ONLY_BANDS)} END AS risk_level "
    "FROM (SELECT s.email_id, rule_score, finding_count, semantic_score, rationale, "
    "rule_score < 10 OR rule_score > 90 AS llm_gated, "
    "rule_score BETWEEN 10 AND 90 AND semantic_score IS NOT NULL AS llm_available, "
    "CASE WHEN rule_score < 10 THEN 'below_lower_threshold' WHEN rule_score > 90 THEN 'above_upper_threshold' END AS gate_reason, "
    "CASE WHEN rule_score BETWEEN 10 AND 90 AND semantic_score IS NOT NULL "
    "THEN least(CAST((rule_score * 45 + semantic_score * 55) AS DECIMAL(10,2)) / 100, 100)::DECIMAL(6,2) "
    "ELSE CAST(rule_score AS DECIMAL(6,2)) END AS final "
    "FROM scores s LEFT JOIN picked p ON p.email_id = s.email_id)"
)
_WARNING = f"CASE WHEN llm_gated THEN {q(V.WARNING_GATED)} WHEN llm_available THEN '' ELSE {q(V.WARNING_FAILED)} END"
_EXPLANATION = (
    f"CASE WHEN llm_gated THEN {q(V.STATUS_SKIPPED)} WHEN llm_available THEN coalesce(rationale, '') || {q(V.STATUS_DONE)} "
    f"ELSE {q(V.STATUS_FAILED)} END"
)

# ---- reuse ------------------------------------------------------------------


def _roles(text: str) -> str:
    for token, safe in V.ROLE_TOKENS:
        text = f"replace({text}, {q(token)}, {q(safe)})"
    return text


def _mapped(text: str) -> str:
    return f"translate({text}, {q(''.join(V.BODY_CONFUSABLES))}, {q(''.join(V.BODY_CONFUSABLES.values()))})"


def _stripped(text: str) -> str:
    return f"translate({text}, {q(V.ZERO_WIDTH)}, '')"


def _cut(text: str, n: int) -> str:
    tries = ", ".join(f"try(decode(encode(t)[1:{n - k}]))" for k in range(4))
    return (
        f"(SELECT CASE WHEN strlen(t) > {n} THEN coalesce({tries}) || {q(V.CUT_MARKER)} ELSE t END "
        f"FROM (SELECT {text} AS t))"
    )


CTES["sanitised"] = f"SELECT email_id, n_chars, {_cut(_roles(_mapped(_stripped('body'))), V.MAX_PROMPT_BYTES)} AS safe FROM emails"
CTES["keyed"] = (
    f"SELECT s.email_id, s.n_chars, {q(V.REUSE_PREFIX)} || sha256(safe || chr(1) || coalesce(texts, '') || chr(1) || {q(W.MODEL)}) AS key "
    "FROM sanitised s LEFT JOIN (SELECT email_id, string_agg(t, chr(1) ORDER BY encode(t)) AS texts FROM ("
    "SELECT email_id, type || chr(2) || severity || chr(2) || description || chr(2) || 'label=' || label || chr(3) || "
    "'match_start=' || match_start || chr(3) || 'matched_text=' || matched_text || chr(3) || 'signal=urgency_cue' AS t "
    f"FROM ({_urgency('emails')})) GROUP BY email_id) f ON f.email_id = s.email_id"
)
CTES["fresh"] = (
    "SELECT key, arg_max(score, produced_at) AS semantic_score FROM ("
    "SELECT key, CAST(email_id % 101 AS INTEGER) AS score, TIMESTAMP '2024-01-25 11:00:00' - to_hours(CAST(n_chars % 3 AS INTEGER) * 20) "
    "- to_seconds(email_id % 1000) AS produced_at FROM keyed WHERE email_id % 3 = 0) "
    f"WHERE produced_at > {W.AS_OF_SQL} - INTERVAL '24' HOUR AND produced_at <= {W.AS_OF_SQL} GROUP BY key"
)


# ---- asking the model -------------------------------------------------------

CTES["gray"] = (
    f"SELECT s.email_id, s.n_chars, {q(V.REUSE_PREFIX)} || sha256(safe || chr(1) || coalesce(texts, '') || chr(1) || {q(W.MODEL)}) AS key, "
    "'<DETERMINISTIC_EVIDENCE>' || chr(10) || coalesce(shown, '[ ]') || chr(10) || '</DETERMINISTIC_EVIDENCE>' || chr(10) || chr(10) || '<EMAIL_METADATA>' "
    f"|| chr(10) || {q(V.METADATA_NOTE)} || chr(10) || '</EMAIL_METADATA>' || chr(10) || chr(10) || '<UNTRUSTED_EMAIL>' || chr(10) || safe || chr(10) "
    "|| '</UNTRUSTED_EMAIL>' AS prompt FROM sanitised s JOIN scores c ON c.email_id = s.email_id AND c.rule_score BETWEEN 10 AND 90 "
    "LEFT JOIN (SELECT email_id, string_agg(t, chr(1) ORDER BY encode(t)) AS texts, '[ ' || string_agg(js, ', ' ORDER BY r1, r2, r3) || ' ]' AS shown "
    "FROM told GROUP BY email_id) f ON f.email_id = s.email_id"
)
CTES["earlier"] = (
    "SELECT key, arg_max(score, produced_at) AS semantic_score, max(produced_at) AS produced_at FROM ("
    "SELECT key, CAST(email_id % 101 AS INTEGER) AS score, TIMESTAMP '2024-01-25 11:00:00' - to_hours(CAST(n_chars % 3 AS INTEGER) * 20) "
    "- to_seconds(email_id) AS produced_at FROM gray WHERE email_id % 3 = 0) "
    f"WHERE produced_at > {W.AS_OF_SQL} - INTERVAL '24' HOUR AND produced_at <= {W.AS_OF_SQL} GROUP BY key"
)
CTES["asks"] = (
    "SELECT g.key, g.email_id, g.prompt, mails FROM gray g JOIN (SELECT key, min(email_id) AS email_id, count(*) AS mails FROM gray "
    "WHERE key NOT IN (SELECT key FROM earlier) GROUP BY key) m ON m.email_id = g.email_id"
)
CTES["given"] = (
    "SELECT a.key, 'earlier' AS origin, NULL AS email_id, semantic_score, NULL::VARCHAR AS rationale, NULL::INT AS attempt_used, produced_at FROM earlier a "
    "UNION ALL SELECT a.key, 'now', a.email_id, p.semantic_score, p.rationale, p.attempt_used, r.produced_at FROM asks a JOIN picked p ON p.email_id = a.email_id "
    "LEFT JOIN replies r ON r.email_id = p.email_id AND r.attempt = p.attempt_used"
)


# ---- assembling -------------------------------------------------------------


def _needs(sql: str) -> list[str]:
    """Building blocks a statement reads, in the order they must be defined."""
    seen: list[str] = []
    reads = {n: set(re.findall(r"(?:FROM|JOIN|(?<=dom),)\s+\(*(\w+)", text)) for n, text in CTES.items()}

    def visit(names: set[str]) -> None:
        for name in CTES:
            if name in names and name not in seen:
                visit(reads[name] - {name})
                seen.append(name)

    visit(set(re.findall(r"(?:FROM|JOIN|(?<=dom),)\s+\(*(\w+)", sql)))
    return seen


def put(name: str, sql: str) -> None:
    ctes = ",\n".join(f"{n} AS ({CTES[n]})" for n in _needs(sql))
    ORACLE[name] = f"WITH {ctes}\n{sql}" if ctes else sql


def _shown(sql: str) -> str:
    """Without the evidence that only the whole finding shows."""
    return f"SELECT COLUMNS(lambda c: NOT starts_with(c, 'x_')) FROM ({sql})"


def rule(name: str, sql: str) -> None:
    """A rule's findings without the columns the flat query does not show."""
    put(name, _shown(f"SELECT * EXCLUDE (signal, type) FROM ({sql})"))


_HTML = _content("html_mails")
for _key in ("con_pixel_img", "con_hidden_zero_font", "con_hidden_display", "con_hidden_color", "con_hidden_comment"):
    rule(_key, _HTML[_key])
for _key in ("con_urgency", "con_pixel_url"):
    rule(_key, _content("emails")[_key])
for _group in (_ATTACHMENTS, _HEADERS, _DOMAINS, _TEMPORAL):
    for _key, _sql in _group.items():
        rule(_key, _sql)
for _key, _sql in _LINKS.items():
    put(_key, _shown(_sql))
put("rep_both_feeds", " UNION ALL ".join(map(_shown, _LINKS.values())))

_SUBJECT = "CASE WHEN n_chars % 17 <> 14 THEN subject ELSE '' END"
_HEADER_COUNT = (
    "(CASE WHEN h_date IS NULL THEN 0 ELSE 1 END + 1 + 1 + CASE WHEN h_received_spf IS NULL THEN 0 ELSE 1 END "
    "+ CASE WHEN h_dkim_signature IS NULL THEN 0 ELSE 1 END)"
)
_FILE_COUNT = "CAST((SELECT count(*) FROM (VALUES " + W.attachments_values() + ") t(kind, pos, n, m, s) WHERE t.kind = attach_kind) AS INTEGER)"
_SENDER_OK = (
    "(regexp_matches(sender, '^[^@]+@([\\p{L}\\p{N}-]+[.])+[\\p{L}\\p{N}-]*\\p{L}$') "
    "AND NOT regexp_matches(sender, '[@.](arpa|invalid|local|localhost|onion|test)$'))"
)
put("src_emails", f"SELECT email_id, sender AS from_address, {_SUBJECT} AS subject, CAST(length(trim(body, ' ' || chr(10))) AS INTEGER) AS body_chars, "
    f"{_HEADER_COUNT} AS header_count, {_FILE_COUNT} AS attachment_count FROM emails")
put("extract_message", "SELECT email_id, sender AS from_address, subject, CAST(least(length(body), 500000) AS INTEGER) AS body_chars, "
    "coalesce(h_to, '') AS h_to, coalesce(strftime(send_ts, '%a, %d %b %Y %H:%M:%S') || ' GMT', '') AS h_date, '' AS h_reply_to, "
    f"{_FILE_COUNT} AS attachment_count FROM emails")
put("audit_request", "SELECT email_id, CASE WHEN sender LIKE '%@%' THEN regexp_extract(sender, '[^@]*$') ELSE 'unknown' END AS sender_domain, "
    "CAST(length(subject) AS INTEGER) AS subject_length, CAST(length(body) AS INTEGER) AS body_length, "
    f"{_HEADER_COUNT} AS header_count, {_FILE_COUNT} AS attachment_count FROM emails")
put("audit_verdict", "SELECT email_id, final_score, risk_level, llm_available, llm_gated, finding_count FROM verdicts")
put("verdict_dto", "SELECT v.email_id, final_score, risk_level, CAST(rule_score AS DECIMAL(6,1)) AS deterministic_score, finding_count, "
    "'spf' AS first_source, sha256(CAST(v.email_id AS VARCHAR) || chr(1) || 'spf' || chr(1) || '0') AS first_id, "
    "llm_available, llm_gated, CASE WHEN llm_available THEN semantic_score END AS llm_score, "
    f"CASE WHEN llm_available THEN rationale END AS llm_rational, {_WARNING} AS semantic_warning, "
    f"{_EXPLANATION} AS explanation, '1.0' AS schema_version FROM verdicts v")
put("reject_quarantine", "SELECT email_id, array_to_string(list_filter(["
    f"CASE WHEN NOT {_SENDER_OK} THEN 'value is not a valid email address' END, "
    f"CASE WHEN length({_SUBJECT}) > 998 THEN 'String should have at most 998 characters' END"
    f"], lambda x: x IS NOT NULL), '; ') AS reasons FROM emails WHERE NOT {_SENDER_OK} OR length({_SUBJECT}) > 998")
put("src_json", "SELECT CASE WHEN email_id % 29 <> 7 THEN email_id END AS email_id, CASE WHEN email_id % 29 = 7 THEN 'unparseable' WHEN email_id % 23 = 5 THEN 'wrong_type' "
    "WHEN len(found) > 0 THEN 'refused' ELSE 'valid' END AS outcome, CASE WHEN email_id % 29 = 7 THEN 'not JSON' WHEN email_id % 23 = 5 THEN 'not of the schema' "
    "ELSE array_to_string(found, '; ') END AS reasons, email_id % 29 = 7 OR email_id % 23 = 5 AS raw_kept FROM (SELECT email_id, list_filter(["
    f"CASE WHEN NOT {_SENDER_OK} THEN 'value is not a valid email address' END, "
    f"CASE WHEN length({_SUBJECT}) > 998 THEN 'String should have at most 998 characters' END], lambda x: x IS NOT NULL) AS found FROM emails)")
ORACLE["src_json_stream"] = ORACLE["src_json"]
put("str_verdict_dto", "SELECT s.email_id, CAST(rule_score AS DECIMAL(6,1)) AS final_score, "
    f"{_band('rule_score', V.RULES_ONLY_BANDS)} AS risk_level, CAST(rule_score AS DECIMAL(6,1)) AS deterministic_score, finding_count, "
    f"'spf' AS first_source, true AS llm_gated, {q(V.WARNING_GATED)} AS semantic_warning, '1.0' AS schema_version FROM scores s")
put("val_sender", f"SELECT email_id, {_SENDER_OK} AS ok FROM emails")
put("val_subject_len", "SELECT email_id, length(subject) <= 998 AS ok FROM emails")
put("val_body_bytes", "SELECT email_id, strlen(body) * CASE WHEN email_id % 100 = 7 THEN 400 ELSE 1 END <= 1048576 AS ok FROM emails")
put("val_header_count", f"SELECT email_id, {_HEADER_COUNT} <= 100 AS ok FROM emails")
put("val_header_size", "SELECT email_id, coalesce(strlen(h_date) * CASE WHEN email_id % 40 = 3 THEN 300 ELSE 1 END <= 8192, true) AS ok FROM emails")
put("val_attachment_count", f"SELECT email_id, {_FILE_COUNT} <= 50 AS ok FROM emails")
put("prj_recipient", "SELECT email_id, coalesce(regexp_extract(h_to, '<([^<>]*)>$', 1), h_delivered_to) AS recipient FROM emails")
put("prj_sender_domain", "SELECT email_id, CASE WHEN sender LIKE '%@%' THEN regexp_extract(sender, '[^@]*$') ELSE 'unknown' END AS sender_domain FROM emails")
put("prj_header_lookup", "SELECT email_id, h_auth AS auth_results, h_date AS date_header FROM emails")
put("prj_registrable", "SELECT email_id, reg AS registrable FROM dom")
put("prj_extension", "SELECT email_id, position, filename, ext FROM files")
put("prj_mime", "SELECT email_id, position, mime_type, mime FROM files")
put("att_explode", "SELECT email_id, position, filename, mime_type, size FROM files")
put("prj_urls", "SELECT e.email_id, coalesce(string_agg(url, ' ' ORDER BY position), '') AS urls, CAST(count(url) AS INTEGER) AS n "
    "FROM emails e LEFT JOIN links l ON l.email_id = e.email_id GROUP BY e.email_id")
put("rep_url_explode", "SELECT email_id, position, url FROM links")
for _name in ("prj_urls", "rep_url_explode"):
    ORACLE[f"{_name}_all"] = ORACLE[_name].replace(" QUALIFY row_number() OVER (PARTITION BY email_id ORDER BY first_at) <= 10", "")
put("hdr_detail", f"SELECT email_id, {_texts(V.SPF_TEXT, 'spf1')} AS spf_text, {_texts(V.DKIM_TEXT, 'dkim')} AS dkim_text, {_texts(V.DMARC_TEXT, 'dmarc')} AS dmarc_text FROM auth")
put("dom_registration", "SELECT email_id, severity, description FROM ("
    + _DOMAINS["dom_age"].replace(_BORN, "(SELECT *, date_diff('day', born, DATE '2024-01-25') AS age FROM (SELECT *, "
    "CASE WHEN length(reg) % 3 <> 0 THEN CAST(DATE '2024-01-20' - to_days(CAST(length(reg) * 9 AS INTEGER)) AS DATE) END AS born FROM dom))") + ")")
put("dom_fold", "SELECT email_id, domain, folded, folded_reg AS folded_registrable FROM dom")
put("dom_subdomain_prefix", f"SELECT email_id, domain, brand FROM {_PREFIX}")
put("dom_subdomain_label", f"SELECT email_id, domain, brand FROM {_LABEL}")
_LAST_TWO = "CASE WHEN position('.' IN rtrim(dom, '.')) > 0 THEN regexp_extract(rtrim(dom, '.'), '[^.]*[.][^.]*$') ELSE dom END"
_FOLDED = (
    f"replace(replace(replace(replace(translate(dom, {q(''.join(V.DOMAIN_CONFUSABLES))}, {q(''.join(V.DOMAIN_CONFUSABLES.values()))}), "
    "'rn', 'm'), 'vv', 'w'), 'cl', 'd'), 'li', 'h')"
)
CTES["many_brands"] = W.brands_sql(D)
_HOST = "lower(regexp_extract(url, '://([^/]+)', 1))"
CTES["hosts"] = (
    f"SELECT *, {_LAST_TWO.replace('dom', 'folded')} AS folded_reg FROM (SELECT *, {_FOLDED.replace('dom', 'domain')} AS folded FROM ("
    f"SELECT DISTINCT domain, {_LAST_TWO.replace('dom', 'domain')} AS reg FROM (SELECT {_HOST} AS domain FROM pages WHERE {_HOST} <> '' UNION ALL SELECT domain FROM dom)))"
)
put("dom_brand_near", "SELECT name, brand, CAST(levenshtein(name, brand) AS INTEGER) AS edits FROM (SELECT DISTINCT folded_reg AS name FROM hosts) h "
    "JOIN many_brands b ON levenshtein(name, brand) BETWEEN 1 AND 2")
_FOREIGN = "reg <> brand AND reg <> split_part(brand, '.', 1) || '.com' AND NOT ends_with(domain, '.' || brand)"
put("dom_brand_prefix", "SELECT domain, brand FROM hosts JOIN many_brands b ON starts_with(domain, brand || '.') AND reg <> brand")
put("dom_brand_label", f"SELECT domain, brand FROM hosts JOIN many_brands b ON list_contains(string_split(domain, '.'), split_part(brand, '.', 1)) AND {_FOREIGN}")
_MANY = {
    key: sql.replace(" brands ", " many_brands ").replace(", brands", ", many_brands") for key, sql in _DOMAINS.items()
}
put("dom_brand_findings", " UNION ALL ".join(f"SELECT email_id, signal, severity, description, matched_brand FROM ({sql})" for sql in _MANY.values()))
put("tmp_parse_date", f"SELECT email_id, {_UTC} AS sent_utc, CASE WHEN utc IS NOT NULL THEN CAST(off AS INTEGER) END AS offset_minutes FROM sent")
_PAIR = "SELECT email_id, sender, coalesce(regexp_extract(h_to, '<([^<>]*)>$', 1), h_delivered_to) AS recipient, send_ts FROM emails"
put("tmp_first_contact", "SELECT p.email_id, sender, recipient, 'first_contact_sender' AS signal, "
    "CASE WHEN levenshtein(folded_reg, 'paypal.com') <= 2 AND reg <> 'paypal.com' THEN 'HIGH' ELSE 'MEDIUM' END AS severity, "
    f"{say(V.TEXT_FIRST_CONTACT, sender='sender')} AS description FROM (SELECT * FROM ({_PAIR}) "
    "QUALIFY row_number() OVER (PARTITION BY sender, recipient ORDER BY send_ts IS NULL, send_ts, email_id) = 1) p "
    "JOIN dom ON dom.email_id = p.email_id")

_SCORE_OF = "CAST(least(coalesce(sum(f.weight) FILTER ({0}), 0), 100) AS INTEGER)"
put("rep_unavailable", f"SELECT e.email_id, {_SCORE_OF.format(chr(102) + '.analyzer <> ' + q('reputation'))} AS rule_score, "
    f"CAST(count(f.email_id) FILTER (f.analyzer <> 'reputation') AS INTEGER) AS finding_count, "
    f"{_SCORE_OF.format('f.signal <> ' + q('urlhaus_listed'))} AS with_one_feed FROM emails e LEFT JOIN findings f ON f.email_id = e.email_id GROUP BY e.email_id")
put("set_union_findings", "SELECT email_id, analyzer, signal, type, severity, weight FROM findings")
put("agg_det_score", "SELECT email_id, rule_score FROM scores")
put("agg_finding_count", "SELECT email_id, count(*) AS finding_count FROM findings GROUP BY email_id")
put("agg_by_severity", "SELECT email_id, " + ", ".join(
    f"count(*) FILTER (severity = '{s}') AS {s.lower()}" for s in V.SEVERITIES) + " FROM findings GROUP BY email_id")
put("agg_findings_list", "SELECT email_id, string_agg(analyzer || ':' || signal || ':' || severity, ' ' ORDER BY r1, r2, r3) AS listed FROM findings GROUP BY email_id")
put("srt_findings", "SELECT email_id, string_agg(severity || ':' || signal, ' ' ORDER BY -weight, r1, r2, r3) AS shown FROM findings GROUP BY email_id")
put("fus_gate", "SELECT email_id, rule_score, CASE WHEN rule_score < 10 THEN 'below_lower_threshold' WHEN rule_score > 90 THEN 'above_upper_threshold' END AS gate_reason, "
    "'no_llm_provider' AS without_model FROM scores")
_FUSED = "CAST((n_chars % 101) * 45 + (email_id % 101) * 55 AS DECIMAL(10,2)) / 100"
put("fus_fuse", f"SELECT email_id, CAST({_FUSED} AS DECIMAL(6,2)) AS fused, CAST(round(CAST({_FUSED} AS DECIMAL(6,2)), 1) AS DECIMAL(6,1)) AS shown FROM emails")
put("fus_verdict", "SELECT email_id, rule_score, CAST(rule_score AS DECIMAL(6,1)) AS deterministic_score, final_score, risk_level, llm_available, llm_gated, "
    f"{_WARNING} AS semantic_warning FROM verdicts")
put("fus_risk_level", f"SELECT email_id, {_band('n_chars % 101', V.FUSED_BANDS)} AS with_model, {_band('n_chars % 101', V.RULES_ONLY_BANDS)} AS rules_only FROM emails")
put("fus_explanation", f"SELECT email_id, {_EXPLANATION} AS explanation FROM verdicts")
put("report_risk", "SELECT risk_level, coalesce(gate_reason, 'none') AS gate_reason, count(*) AS emails, CAST(sum(final_score) AS DECIMAL(20,1)) AS sum_score, "
    "CAST(round(CAST(sum(final_score) AS DECIMAL(20,6)) / count(*), 2) AS DECIMAL(10,2)) AS avg_score, CAST(sum(finding_count) AS BIGINT) AS findings "
    "FROM verdicts GROUP BY ALL")
put("str_score", "SELECT email_id, rule_score, "
    f"{_band('rule_score', V.RULES_ONLY_BANDS)} AS risk_level, 'no_llm_provider' AS gate_reason, finding_count FROM scores")

_LIMIT = " QUALIFY row_number() OVER (PARTITION BY email_id ORDER BY first_at) <= 10"
ORACLE["set_union_findings_all"] = ORACLE["set_union_findings"].replace(_LIMIT, "")
put("fus_verdict_all", "SELECT email_id, rule_score, final_score, risk_level, llm_available, llm_gated, finding_count FROM verdicts")
ORACLE["fus_verdict_all"] = ORACLE["fus_verdict_all"].replace(_LIMIT, "")
put("san_zero_width", f"SELECT email_id, md5({_stripped('body')}) AS cleaned FROM emails")
put("san_homograph", f"SELECT email_id, md5({_mapped('body')}) AS mapped FROM emails")
put("san_role_tokens", "SELECT conv_id, turn, md5(" + _roles("role || ': ' || text || chr(10) || 'Human: </EMAIL_METADATA>'") + ") AS neutral FROM conversations")
put("san_truncate", f"SELECT email_id, md5({_cut('body', 1001)}) AS cut, CAST(strlen({_cut('body', 16384)}) AS INTEGER) AS bytes FROM emails")
_FLAGS = [
    "CASE WHEN s1 <> body THEN 'zero_width_chars_stripped' END",
    "CASE WHEN s2 <> s1 THEN 'homograph_chars_replaced' END",
    *[f"CASE WHEN contains(s2, {q(t)}) THEN {q(f'role_token_neutralized:{t!r}')} END" for t, _s in V.ROLE_TOKENS],
    "CASE WHEN strlen(s3) > 16384 THEN 'truncated:' || length(body) || '_chars_to_16384_bytes' END",
]
put("san_mutations", "SELECT email_id, CAST(len(f) AS INTEGER) AS n, array_to_string(f, ' ') AS mutations FROM ("
    f"SELECT email_id, list_filter([{', '.join(_FLAGS)}], lambda x: x IS NOT NULL) AS f FROM ("
    f"SELECT *, {_roles('s2')} AS s3 FROM (SELECT *, {_mapped('s1')} AS s2 FROM (SELECT *, {_stripped('body')} AS s1 FROM emails))))")


def _sub(text: str, pattern: str, mask: str, flags: str = "g") -> str:
    return f"regexp_replace({text}, {q(pattern)}, {q(mask)}, {q(flags)})"


_prompt = "text"
for _pattern, _no_case, _mask in V.PROMPT_PII:
    _prompt = _sub(_prompt, _pattern, _mask, "gi" if _no_case else "g")
put("pii_prompt", f"SELECT doc_id, md5({_prompt}) AS redacted FROM documents")
# RE2 takes only ASCII letters for word characters.  An ASCII mark on both sides of each
# accented letter makes its boundaries the Unicode ones; the marks go away at the end.
_MARK = "qZq"
_MARKED = _sub("text", "([À-ÖØ-öø-ʯͰ-ԯ]+)", f"{_MARK}\\1{_MARK}")


def _masked(pattern: str, mask: str) -> str:
    return f"md5(replace({_sub(_MARKED, pattern, mask)}, {q(_MARK)}, ''))"


put("pii_log_parts", f"SELECT doc_id, {_masked(V.LOG_EMAIL, V.PII_MASK)} AS email, {_masked(V.LOG_SSN, V.PII_MASK)} AS ssn, "
    f"{_masked(V.LOG_CARD, V.PII_MASK)} AS card, {_masked(V.LOG_IPV4, chr(92) + '1.' + V.SECRET_MASK)} AS ipv4 FROM documents")
# the phone rule looks at its neighbours; here they are captured and put back, twice because two numbers may share one
_PHONE = "(^|[^0-9])" + V.LOG_PHONE.removeprefix("(?<!\\d)").removesuffix("(?!\\d)") + "($|[^0-9])"


def _log_masked(text: str) -> str:
    out = _sub(text, "([À-ÖØ-öø-ʯͰ-ԯ]+)", f"{_MARK}\\1{_MARK}")
    out = _sub(out, V.LOG_EMAIL, V.PII_MASK)
    for _ in range(2):
        out = _sub(out, _PHONE, f"\\1{V.PII_MASK}\\2")
    for pattern in (V.LOG_SSN, V.LOG_CARD):
        out = _sub(out, pattern, V.PII_MASK)
    return f"replace({_sub(out, V.LOG_IPV4, chr(92) + '1.' + V.SECRET_MASK)}, {q(_MARK)}, '')"


put("pii_log", f"SELECT doc_id, md5({_log_masked('text')}) AS redacted FROM documents")
_MASKED_SENDER = _log_masked("sender")
_MASKED_EVENT = _log_masked("'mail from ' || sender")
put("pii_event_rows", f"SELECT email_id, {_MASKED_EVENT} AS event, {_MASKED_SENDER} AS user_name, {q(V.SECRET_MASK)} AS api_key, "
    f"{q(V.SECRET_MASK)} AS password, {_MASKED_SENDER} AS note FROM emails")
put("pii_secret_keys", "SELECT email_id, '[REDACTED]' AS token, '[REDACTED]' AS auth, 'call 10.20.30.[REDACTED]' AS note, subject FROM emails")

put("llm_extract_json", "SELECT email_id, attempt, js AS json FROM found")
put("llm_parse_ok", "SELECT email_id, attempt, coalesce(js IS NOT NULL AND json_valid(js) AND json_type(js) = 'OBJECT', false) AS is_object FROM found")
put("llm_missing_fields", "SELECT f.email_id, f.attempt, array_to_string(missing, ',') AS missing FROM found f "
    "LEFT JOIN judged j ON j.email_id = f.email_id AND j.attempt = f.attempt")
put("llm_validate", "SELECT email_id, attempt, reason FROM reasons")
put("llm_fallback", "SELECT r.email_id, r.attempt, CASE WHEN reason IS NULL THEN CAST(score_text AS INTEGER) ELSE 40 END AS semantic_score, "
    "CASE WHEN reason IS NULL THEN verdict ELSE 'suspicious' END AS verdict, CASE WHEN reason IS NULL THEN confidence ELSE 'low' END AS confidence, "
    "CASE WHEN reason IS NULL THEN action ELSE 'verify_via_separate_channel' END AS action, "
    f"CASE WHEN reason IS NULL THEN rationale ELSE {q(V.FALLBACK_RATIONALE)} END AS rationale "
    "FROM reasons r LEFT JOIN judged j ON j.email_id = r.email_id AND j.attempt = r.attempt")
put("llm_retry_pick", "SELECT email_id, attempt_used, semantic_score, verdict FROM picked")
put("llm_normalise", "SELECT email_id, CAST(CAST(score_text AS DOUBLE) AS INTEGER) AS score, verdict, coalesce(confidence, 'low') AS confidence, rationale, version AS schema_version, "
    "CAST(len(cats) AS INTEGER) AS finding_count FROM judged WHERE attempt = 0")
put("llm_indicators", "SELECT category, 'high' AS severity, count(*) AS n FROM (SELECT unnest(cats) AS category FROM picked p "
    "JOIN judged j ON j.email_id = p.email_id AND j.attempt = p.attempt_used) GROUP BY category")
put("llm_prompt", f"SELECT email_id, {q(V.PROMPT_VERSION)} AS prompt_version, prompt FROM asks")
put("sem_to_ask", f"SELECT key, email_id, mails, {q(W.MODEL)} AS model FROM asks")
put("sem_retry", "SELECT a.key, 1 AS attempt, r.reason, 'user: ' || a.prompt || chr(10) || 'assistant: ' || f.raw_response || chr(10) || 'user: ' || "
    f"{q(V.RETRY_INSTRUCTION)} AS talk FROM asks a JOIN reasons r ON r.email_id = a.email_id AND r.attempt = 0 AND r.reason IS NOT NULL "
    "JOIN replies f ON f.email_id = a.email_id AND f.attempt = 0")
_SEM_FINAL = ("CASE WHEN semantic_score IS NULL THEN CAST(rule_score AS DECIMAL(6,2)) ELSE "
              "least(CAST((rule_score * 45 + semantic_score * 55) AS DECIMAL(10,2)) / 100, 100)::DECIMAL(6,2) END")
put("sem_verdicts", "SELECT email_id, key, origin, rule_score, gate_reason, semantic_score IS NOT NULL AS llm_available, "
    "CAST(round(final, 1) AS DECIMAL(6,1)) AS final_score, "
    f"CASE WHEN semantic_score IS NOT NULL THEN {_band('final', V.FUSED_BANDS)} ELSE {_band('final', V.RULES_ONLY_BANDS)} END AS risk_level, finding_count, "
    f"CASE WHEN gate_reason IS NOT NULL THEN {q(V.STATUS_SKIPPED)} WHEN semantic_score IS NULL THEN {q(V.STATUS_FAILED)} "
    f"ELSE coalesce(rationale, {q(V.FALLBACK_RATIONALE)}) || {q(V.STATUS_DONE)} END AS explanation "
    f"FROM (SELECT s.email_id, g.key, rule_score, finding_count, v.semantic_score, v.rationale, {_SEM_FINAL} AS final, "
    "CASE WHEN rule_score < 10 THEN 'below_lower_threshold' WHEN rule_score > 90 THEN 'above_upper_threshold' END AS gate_reason, "
    "CASE WHEN v.origin = 'earlier' THEN 'reused' WHEN v.origin = 'now' AND v.attempt_used IS NULL THEN 'fallback' WHEN v.origin = 'now' THEN 'asked' END AS origin "
    "FROM scores s LEFT JOIN gray g ON g.email_id = s.email_id LEFT JOIN given v ON v.key = g.key)")
put("sem_store", "SELECT key, semantic_score, strftime(produced_at, '%Y-%m-%d %H:%M:%S') AS produced, 1::BIGINT AS parts FROM given "
    f"WHERE (origin = 'earlier' OR attempt_used IS NOT NULL) AND produced_at > {W.AS_OF_SQL} - INTERVAL '24' HOUR AND produced_at <= {W.AS_OF_SQL}")
_CHARS = "length(prompt)"
put("udf_semantic", "SELECT email_id, origin, semantic_score, CAST(round(final, 1) AS DECIMAL(6,1)) AS final_score, "
    f"CASE WHEN semantic_score IS NOT NULL THEN {_band('final', V.FUSED_BANDS)} ELSE {_band('final', V.RULES_ONLY_BANDS)} END AS risk_level "
    f"FROM (SELECT *, {_SEM_FINAL} AS final FROM (SELECT s.email_id, s.rule_score, CASE WHEN a.key IS NULL THEN NULL WHEN failed THEN 'fallback' ELSE 'asked' END AS origin, "
    "CASE WHEN a.key IS NULL THEN NULL WHEN failed THEN 40 ELSE chars % 101 END::INTEGER AS semantic_score FROM scores s LEFT JOIN gray g ON g.email_id = s.email_id "
    f"LEFT JOIN (SELECT key, {_CHARS} AS chars, {_CHARS} % 7 = 0 OR {_CHARS} % 6 = 0 AS failed FROM gray "
    "QUALIFY row_number() OVER (PARTITION BY key ORDER BY email_id) = 1) a ON a.key = g.key))")
put("cac_key", "SELECT email_id, key FROM keyed")
put("cac_hit", "SELECT email_id, key, semantic_score FROM keyed JOIN fresh USING (key)")
put("cac_miss", "SELECT key, min(email_id) AS email_id, count(*) AS mails FROM keyed WHERE key NOT IN (SELECT key FROM fresh) GROUP BY key")

_POSITIONS = (
    "SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id, date_trunc('minute', ts) ORDER BY ts, event_id) AS m, "
    "row_number() OVER (PARTITION BY user_id, date_trunc('day', ts) ORDER BY ts, event_id) AS dd FROM events"
)
put("rtl_decisions", "SELECT event_id AS request_id, user_id, m > 1 OR dd > 5 AS rejected, "
    f"CASE WHEN m > 1 THEN 'minute' WHEN dd > 5 THEN 'day' END AS limit_window FROM ({_POSITIONS})")
put("rtl_window_counts", "SELECT strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M:%S') AS bucket, user_id, count(*) AS requests, count(*) > 1 AS over_limit "
    "FROM events GROUP BY ALL")
put("udf_custom_analyzer", "SELECT email_id, 'long_subject' AS signal, 'LOW' AS severity, 4 AS weight, CAST(length(subject) AS VARCHAR) AS chars FROM emails WHERE length(subject) > 500")
put("udf_isolation", "SELECT email_id, CASE WHEN email_id % 10 IN (3, 4) THEN 0 ELSE 1 END AS n, "
    "CASE WHEN email_id % 10 NOT IN (3, 4) THEN CAST(length(subject) AS VARCHAR) END AS chars, "
    "CASE email_id % 10 WHEN 3 THEN 'ValueError: bad mail' WHEN 4 THEN 'unexpected result type: NoneType' END AS error FROM emails")

# ---- streams: rows in order of arrival, dealt into slices by id, some of them landing twice --------

CTES["arrived"] = (
    "SELECT *, CAST(email_id * 7 % 3 AS INTEGER) + again AS slice FROM (SELECT email_id, send_ts, 0 AS again FROM emails "
    "UNION ALL SELECT email_id, send_ts, 1 FROM emails WHERE email_id % 10 = 3)"
)
CTES["queue"] = (
    "SELECT k.key, a.send_ts AS ts, a.email_id, row_number() OVER (PARTITION BY k.key ORDER BY slice, a.send_ts, a.email_id) AS n "
    "FROM keyed k JOIN arrived a ON a.email_id = k.email_id WHERE a.send_ts IS NOT NULL"
)
put("str_dedup", "SELECT 1 FROM queue")
# one row of each key after the other; it passes if none of those that have passed is less than 24 hours away
ORACLE["str_dedup"] = ORACLE["str_dedup"].replace("WITH ", "WITH RECURSIVE ", 1).rpartition("\n")[0] + """,
ran(key, n, through, email_id, ts, seen) AS (
  SELECT key, n, true, email_id, ts, [ts] FROM queue WHERE n = 1
  UNION ALL
  SELECT key, n, near = 0, email_id, ts, CASE WHEN near = 0 THEN list_append(seen, ts) ELSE seen END FROM (
    SELECT q.*, r.seen, len(list_filter(r.seen, lambda p: abs(epoch(p) - epoch(q.ts)) < 86400)) AS near
    FROM ran r JOIN queue q ON q.key = r.key AND q.n = r.n + 1))
SELECT email_id, key, strftime(ts, '%Y-%m-%d %H:%M:%S') AS sent FROM ran WHERE through
UNION ALL SELECT k.email_id, k.key, NULL FROM keyed k JOIN arrived a ON a.email_id = k.email_id WHERE a.send_ts IS NULL"""
put("str_rate_limit", "SELECT request_id, user_id, m > 1 OR dd > 5 AS rejected, CASE WHEN m > 1 THEN 'minute' WHEN dd > 5 THEN 'day' END AS limit_window FROM ("
    "SELECT request_id, user_id, row_number() OVER (PARTITION BY user_id, date_trunc('minute', ts) ORDER BY slice, ts, request_id) AS m, "
    "row_number() OVER (PARTITION BY user_id, date_trunc('day', ts) ORDER BY slice, ts, request_id) AS dd FROM ("
    "SELECT event_id AS request_id, user_id, ts, event_id * 7 % 3 AS slice FROM events UNION ALL "
    "SELECT event_id, user_id, ts, event_id * 7 % 3 + 1 FROM events WHERE event_id % 10 = 3))")
ORACLE["str_window_counts"] = ORACLE["rtl_window_counts"]
put("str_first_contact", "SELECT p.email_id, sender, recipient, 'first_contact_sender' AS signal, "
    "CASE WHEN levenshtein(folded_reg, 'paypal.com') <= 2 AND reg <> 'paypal.com' THEN 'HIGH' ELSE 'MEDIUM' END AS severity, "
    f"{say(V.TEXT_FIRST_CONTACT, sender='sender')} AS description FROM (SELECT * FROM (SELECT a.email_id, a.slice, m.sender, m.recipient, m.send_ts "
    f"FROM arrived a JOIN ({_PAIR}) m ON m.email_id = a.email_id) "
    "QUALIFY row_number() OVER (PARTITION BY sender, recipient ORDER BY slice, send_ts IS NULL, send_ts, email_id) = 1) p "
    "JOIN dom ON dom.email_id = p.email_id")
