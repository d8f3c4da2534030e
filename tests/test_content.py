from helpers import found, mails

from mailsieve.operators import content

URGENCY = [
    ("Your account  LOCKED now", "account suspension language", "HIGH"),
    ("please verify\nyour email", "account verification demand", "MEDIUM"),
    ("unusual sign-in seen", "unusual activity claim", "MEDIUM"),
    ("do it immediately.", "immediate-action demand", "LOW"),
    ("urgent action", "action-required demand", "MEDIUM"),
    ("click now", "act-now demand", "MEDIUM"),
    ("offer expires", "time-pressure / expiry language", "LOW"),
    ("in the next 5 minutes", "short-window time pressure", "MEDIUM"),
    ("your account will be closed", "account-deletion threat", "HIGH"),
    ("failure to respond", "failure-to-comply threat", "MEDIUM"),
    ("law enforcement", "legal-threat language", "HIGH"),
    ("confirm your credit card", "credential/payment harvesting cue", "HIGH"),
    ("update billing details", "payment-update demand", "HIGH"),
]


def test_each_urgency_rule(spark):
    df = content.add(mails(spark, *[{"body": b} for b, _, _ in URGENCY]))
    rows = df.select("email_id", "content_findings").orderBy("email_id").collect()
    for (body, label, severity), row in zip(URGENCY, rows):
        hits = {f["evidence"]["label"]: f["severity"] for f in row["content_findings"]}
        assert hits.get(label) == severity, body


HTML = [
        ('<IMG src=x width="1" height="1">', "tracking_pixel_1x1_img"),
        ("<img height=1\n width=1>", "tracking_pixel_1x1_img"),
        ("https://a.b/x?open=1", "tracking_url_pattern"),
        ("https://a.b/AbCdEfGhIjKlMnOpQrStUv/p.gif", "tracking_url_pattern"),
        ("https://u1.list-manage.com/tracking", "tracking_url_pattern"),
        ("font-size:0.9em", "hidden_text_zero_font"),
        ("DISPLAY : none", "hidden_text_display_none"),
        ("color:#FFF background:#fff", "hidden_text_color_match"),
        ("<!--" + "x" * 200, "hidden_text_html_comment"),
]


def test_html_rules_fire(spark):
    out = found(content.add(mails(spark, *[{"body": b} for b, _ in HTML])), "content_findings")
    for (body, signal), hits in zip(HTML, out):
        assert signal in [s for s, _ in hits], body


SILENT = [
        "", "accounts locked", "ximmediately", "color:#fff;background:#fff", "<!--" + "x" * 300 + "-->",
        "<!--" + "x" * 199, "color:white background:black", '<img width="20" height="1">',
]


def test_no_finding(spark):
    out = found(content.add(mails(spark, *[{"body": b} for b in SILENT])), "content_findings")
    assert out == [[] for _ in SILENT]


def test_match_start_counts_characters_and_skips_false_starts(spark):
    body = "\U0001F600 ximmediately x é immediately"
    row = content.add(mails(spark, {"body": body})).first()["content_findings"][0]
    assert int(row["evidence"]["match_start"]) == body.rindex("immediately")


def test_letters_with_unicode_twins(spark):
    # the long s and the dotless i match s and i in a case-insensitive search
    bodies = ["account ſuspended", "ımmediately", "ACCOUNT LOCKED"]
    out = found(content.add(mails(spark, *[{"body": b} for b in bodies])), "content_findings")
    assert all(out)


def test_gates_never_hide_a_match(spark, sf_dir):
    """With and without the substring gates the findings are the same."""
    from mailsieve.catalog import views

    e = views.emails(spark, sf_dir)
    gated = content.add(e).select("email_id", "content_findings")
    original = content._gate
    content._gate = lambda groups: "true"
    try:
        want = sorted(map(repr, content.add(e).select("email_id", "content_findings").collect()))
    finally:
        content._gate = original
    assert sorted(map(repr, gated.collect())) == want
