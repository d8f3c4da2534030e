"""Attachment, header, domain, temporal and link rules, with their limits."""

from datetime import datetime, timedelta

from helpers import found, mails
from pyspark.sql import functions as F

from mailsieve.operators import attachments, domains, headers, reputation, temporal

AS_OF = datetime(2024, 1, 25, 12, 0, 0)


def files(*items):
    return {"attachments": list(items)}


FILES = [
        (("report.pdf", "application/pdf", 1), []),
        (("report.pdf", "Application/X-MSDownload; x=1", 1), [("always_suspicious_mime", "CRITICAL")]),
        (("a.pdf", "application/vnd.executable", 1), [("mime_extension_mismatch", "CRITICAL")]),
        (("a.jpg", "text/html", 1), [("mime_extension_mismatch", "HIGH")]),
        (("a.unknown", "text/html", 1), []),
        (("a.jpg", "", 1), []),
        (("x.py", "text/plain", 1), [("dangerous_extension", "HIGH")]),
        (("r.pdf.exe", "application/octet-stream", 1),
         [("dangerous_extension", "CRITICAL"), ("double_extension", "CRITICAL")]),
        (("invoice.js", "text/javascript", 1), [("dangerous_extension", "CRITICAL"), ("lure_filename", "HIGH")]),
        (("my invoice.pdf", "application/pdf", 1), [("lure_filename", "MEDIUM")]),
        (("invoice_7.pdf", "application/pdf", 1), []),
        (("a.txt", "text/plain", 0), [("zero_byte_attachment", "LOW")]),
        (("a.txt", "text/plain", None), [("zero_byte_attachment", "LOW")]),
        (("a.txt", "text/plain", 10 * 1024 * 1024), []),
        (("a.txt", "text/plain", 10 * 1024 * 1024 + 1), [("large_attachment", "LOW")]),
        (("  ", "application/x-msdownload", 0), []),
]


def test_attachment_rules(spark):
    out = found(attachments.add(mails(spark, *[files(item) for item, _ in FILES])), "attachments_findings")
    assert out == [expected for _, expected in FILES]


def test_large_attachment_rounds_ties_to_even(spark):
    out = attachments.add(mails(spark, files(("a.zip", "application/zip", 10747904)))).first()
    assert "(10.2 MB)" in out["attachments_findings"][0]["description"]


def auth(**kw):
    return {"headers": kw.get("headers", {"Authentication-Results": kw.get("ar", "")})}


AUTH = [
        (auth(ar="mx; spf=pass; dkim=pass; dmarc=pass"), ("pass", "LOW"), ("pass", "LOW"), ("pass", "LOW")),
        (auth(ar="SPF=FAIL dkim=permerror dmarc=fail"), ("fail", "HIGH"), ("permerror", "HIGH"), ("fail", "HIGH")),
        (auth(ar="spf=softfail; dkim=fail; dmarc=none"), ("softfail", "MEDIUM"), ("fail", "HIGH"), ("none", "MEDIUM")),
        (auth(headers={}), ("none", "LOW"), ("none", "LOW"), ("none", "MEDIUM")),
        (auth(headers={"Received-SPF": "  Softfail (x)", "DKIM-signature": "v=1"}),
         ("softfail", "MEDIUM"), ("none", "LOW"), ("none", "MEDIUM")),
        (auth(headers={"Received-SPF": "result: pass"}), ("none", "LOW"), ("none", "LOW"), ("none", "MEDIUM")),
]


def test_header_rules(spark):
    rows = headers.add(mails(spark, *[a[0] for a in AUTH])).orderBy("email_id").collect()
    for (mail, *want), row in zip(AUTH, rows):
        assert [(f["evidence"]["result"], f["severity"]) for f in row["headers_findings"]] == want, mail


def test_of_two_spellings_the_last_counts(spark):
    two = "map('authentication-results', 'spf=pass', 'Authentication-Results', 'spf=fail') AS headers"
    row = headers.add(mails(spark, {}).drop("headers").selectExpr("*", two)).first()["headers_findings"]
    assert row[0]["evidence"]["result"] == "fail"


def test_raw_header_is_cut(spark):
    row = headers.add(mails(spark, auth(ar="spf=pass " + "x" * 900))).first()["headers_findings"]
    assert len(row[0]["evidence"]["raw_header"]) == 500


AGES = [
        ("2024-01-18", "HIGH"), ("2023-12-26", "MEDIUM"), ("2023-12-27", "HIGH"), ("2023-07-30", "MEDIUM"),
        ("2023-07-29", None), ("2019-01-01", None), (None, "LOW"), ("2024-02-24", "LOW"), ("not-a-date", "LOW"),
        ("2024-01-18T10:00:00", "HIGH"), ("2024", "LOW"),
]


def test_domain_age(spark):
    rows = mails(spark, *[{"registered_date": d} for d, _ in AGES])
    out = found(domains.add(rows, AS_OF.date(), only=["domain_age"]), "domains_findings")
    for (date, expected), hits in zip(AGES, out):
        assert [s for _, s in hits] == ([expected] if expected else []), date


LOOKALIKES = [
        ("pаypal.com", [("homograph", "HIGH")]),            # Cyrillic a
        ("unknówn-brand.com", [("homograph", "MEDIUM")]),
        ("paypall.com", [("typosquatting", "HIGH")]),
        ("miicrosoftt.com", [("typosquatting", "MEDIUM")]),
        ("paypal.com.evil-phish.ru", [("subdomain_abuse", "HIGH")]),
        ("google.evil-site.net", [("subdomain_abuse", "MEDIUM")]),
        ("mail.paypal.com", []),
        ("PAYPAL.COM", []),
        ("paypa1.com", []),                                 # folds exactly onto the brand
        ("linkedin.com", [("typosquatting", "MEDIUM")]),    # folding li -> h moves it off itself
        ("ｐａｙｐａｌｌ.com", [("homograph", "MEDIUM"), ("typosquatting", "HIGH")]),
        ("", []),
]


def test_lookalikes(spark):
    wanted = ["homograph", "typosquatting", "subdomain_abuse"]
    rows = mails(spark, *[{"sender": "a@" + d} for d, _ in LOOKALIKES])
    out = found(domains.add(rows, AS_OF.date(), only=wanted), "domains_findings")
    for (domain, expected), hits in zip(LOOKALIKES, out):
        assert hits == expected, domain


def date_header(moment):
    return {"headers": {" date ": moment.strftime("%a, %d %b %Y %H:%M:%S +0000")}}


TIMES = [
        (datetime(2024, 1, 25, 1, 59, 59), []),
        (datetime(2024, 1, 25, 2, 0, 0), ["off_hours_send"]),
        (datetime(2024, 1, 25, 4, 59, 59), ["off_hours_send"]),
        (datetime(2024, 1, 25, 5, 0, 0), []),
        (AS_OF + timedelta(minutes=15), []),
        (AS_OF + timedelta(minutes=15, seconds=1), ["future_dated_email"]),
        (AS_OF - timedelta(days=30), []),
        (AS_OF - timedelta(days=30, seconds=1), ["stale_email"]),
]


def test_time_limits(spark):
    out = found(temporal.add(mails(spark, *[date_header(m) for m, _ in TIMES]), AS_OF), "temporal_findings")
    for (moment, expected), hits in zip(TIMES, out):
        assert [s for s, _ in hits] == expected, moment


def test_zone_is_honoured_and_missing_date_stops_the_rest(spark):
    rows = [
        {"headers": {"Date": "Thu, 25 Jan 2024 05:30:00 +0200"}},
        {"headers": {"Date": "soon"}},
        {"headers": {}},
    ]
    out = found(temporal.add(mails(spark, *rows), AS_OF), "temporal_findings")
    missing = [("missing_or_invalid_date_header", "LOW")]
    assert out == [[("off_hours_send", "MEDIUM")], missing, missing]


def test_first_contact_with_history(spark):
    mail = "email_id bigint, sender string, recipient string, ts timestamp_ntz"
    rows = [(1, "a@x.com", "r", AS_OF), (2, "a@x.com", "r", AS_OF - timedelta(1)), (3, "b@paypall.com", "r", None)]
    history = spark.createDataFrame([("a@x.com", "q")], "sender string, recipient string")
    df = spark.createDataFrame(rows, mail)
    out = temporal.first_contacts(df, history=history, internal_domains=["paypal.com"]).collect()
    assert sorted((r.email_id, r.severity) for r in out) == [(2, "MEDIUM"), (3, "HIGH")]
    known = spark.createDataFrame([("a@x.com", "r")], "sender string, recipient string")
    assert [r.email_id for r in temporal.first_contacts(df, history=known).collect()] == [3]


FEED = [("http://bad.example/x", "is_listed", None, None, ["a"] * 12, "7"), ("http://ok.example/y", "no_results", None, None, None, "8")]
PHISH = [("http://bad.example/x", True, True, None, None, None), ("http://ok.example/y", True, False, "1", "p", True)]


def feeds(spark):
    from mailsieve.schema import MALWARE_FEED, PHISH_FEED

    return spark.createDataFrame(FEED, MALWARE_FEED), spark.createDataFrame(PHISH, PHISH_FEED)


def test_links_small_and_large_feed_agree(spark):
    malware, phish = feeds(spark)
    listed = reputation.combine(malware, phish, spark)
    bodies = ["see http://bad.example/x, twice http://bad.example/x", "http://ok.example/y", "", " ".join(
        [f"http://n{i}.example/p" for i in range(10)] + ["http://bad.example/x"])]
    df = reputation.with_urls(mails(spark, *[{"body": b} for b in bodies]))
    small = reputation.add(df, listed)
    large = reputation.add(df, listed, limit=0)
    want = [[("urlhaus_listed", "CRITICAL"), ("phishtank_listed", "CRITICAL")], [], [], []]
    assert found(small, "reputation_findings") == want
    assert found(large, "reputation_findings") == want
    assert small.orderBy("email_id").first()["reputation_findings"][0]["evidence"]["tags"] == ",".join("a" * 10)


def test_missing_feed_means_no_finding(spark):
    malware, phish = feeds(spark)
    df = reputation.with_urls(mails(spark, {"body": "http://bad.example/x"}))
    only_phish = reputation.combine(None, phish, spark)
    assert found(reputation.add(df, only_phish), "reputation_findings") == [[("phishtank_listed", "CRITICAL")]]
    assert found(reputation.add(df, None), "reputation_findings") == [[]]


def test_every_entry_of_a_link_counts(spark):
    """A URL that the feeds list more than once: one finding an entry, the malware feed's first."""
    malware, phish = feeds(spark)
    malware = malware.unionByName(malware.withColumn("id", F.lit("9"))).unionByName(malware)
    phish = phish.unionByName(phish.withColumn("phish_id", F.lit("q")))
    listed = reputation.combine(malware, phish, spark)
    df = reputation.with_urls(mails(spark, dict(body="http://bad.example/x http://bad.example/x http://no.example/z"), dict(body="none")))
    want = [[("urlhaus_listed", "CRITICAL")] * 3 + [("phishtank_listed", "CRITICAL")] * 2, []]
    for done in (reputation.add(df, listed), reputation.add(df, listed, limit=0), reputation.add(df, listed, max_urls=None)):
        assert found(done, "reputation_findings") == want
        ids = [f["evidence"].get("urlhaus_id") or f["evidence"]["phish_id"] for r in done.where("email_id = 0").collect() for f in r["reputation_findings"]]
        assert ids[:3] == ["7", "7", "9"] and "q" in ids[3:]
    links = reputation.explode(mails(spark, dict(body="http://bad.example/x")))
    for limit in (0, 1 << 26):
        assert reputation.long_findings(links, listed, limit=limit).count() == 5
