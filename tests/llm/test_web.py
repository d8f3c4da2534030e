"""The archive and the URL sweep against plain Python and SQL."""

import base64
import hashlib
import random

import duckdb
import pytest

from mailsieve.functions.shared import new_path
from mailsieve.llm import queries, urls, warc

PAGES = "page_id bigint, url string, html string, key string, digest string"


def archive(spark, rows, **options):
    path = new_path(spark, "archive")
    warc.write_archive(spark.createDataFrame(rows, PAGES), path, **options)
    return path, warc.read_archive(spark, path).collect()


ROWS = [
    (3, "http://a/", "same", "x", "y"), (1, "http://b/\r\nWARC-Type: evil", "same", "x", "y"), (2, None, "same", "x", "y"), (4, "u", None, "", ""),
    (5, "u", "", "", ""), (6, "u", "é漢\r\n\r\nWARC/1.1\r\n", "", ""), (1, "again", "same", "", ""), (None, "u", "only null", "", ""),
    (None, "u", "same", "", ""), (8, "u", "z" * 200_000, "", ""),
]


def test_archive(spark):
    path, got = archive(spark, ROWS)
    assert len(got) == len(ROWS)
    want = []
    for page_id, url, html, *_ in ROWS:
        body = (html or "").encode()
        same = [r[0] for r in ROWS if (r[2] or "") == (html or "") and r[0] is not None]
        first = min(same) if same else None
        revisit = first is not None and page_id != first
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        want.append((page_id, "revisit" if revisit else "response", first if revisit else None, digest, body))
    key = lambda r: (str(r[0]), r[3], r[1])
    assert sorted(((r.page_id, r.record_type, r.refers_to, r.digest, bytes(r.payload)) for r in got), key=key) == sorted(want, key=key)
    stored = spark.read.parquet(f"{path}/payloads")
    assert stored.count() == len({r[2] or "" for r in ROWS})


def test_records_are_exact(spark):
    _, got = archive(spark, ROWS)
    for r in got:
        head, _, rest = bytes(r.record).partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        size = int(fields["Content-Length"])
        assert rest[size:] == b"\r\n\r\n"
        assert fields["WARC-Type"] == r.record_type and ("WARC-Target-URI" in fields) == (r.url is not None)
        assert rest[:size].partition(b"\r\n\r\n")[2] == (bytes(r.payload) if r.record_type == "response" else b"")


def test_small_payloads_are_stored_as_responses(spark):
    _, got = archive(spark, ROWS, least_bytes=5)
    assert {r.record_type for r in got} == {"response"}


def test_damage_is_found(spark):
    path, _ = archive(spark, ROWS[:2])
    bad = new_path(spark, "bad")
    spark.read.parquet(f"{path}/headers").write.parquet(f"{bad}/headers")
    spark.read.parquet(f"{path}/payloads").selectExpr("key", "encode('other', 'utf-8') AS payload").write.parquet(f"{bad}/payloads")
    with pytest.raises(Exception, match="damaged payload"):
        warc.read_archive(spark, bad).collect()


def test_no_pages(spark):
    assert archive(spark, [])[1] == []


def judged(spark, pages, rules):
    df = spark.createDataFrame(pages, "page_id bigint, url string, host string, key string")
    return urls.judge(df, spark.createDataFrame(rules, "action string, rule string")).collect()


def plain(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
    host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
    tail = rest[cut:]
    path = tail[: min([i for i in (tail.find(c) for c in "?#") if i >= 0], default=len(tail))]
    best = None
    for action, rule in rules:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            best = max(best or (), (len(rule), len(h), action, rule))
    return host, path, best[3] if best else None, best[2] if best else "allow"


def test_sweep_against_plain_rules(spark, monkeypatch):
    monkeypatch.setattr(urls, "RANGE_HOSTS", 7)
    rng = random.Random(3)
    labels = ["a", "b", "ab", "net", "x-y", "é", "b0"]
    hosts = [".".join(rng.choice(labels) for _ in range(rng.randint(1, 4))) for _ in range(150)]
    paths = ["", "/", "/en/", "/en/x", "/EN/", "/de?x=/en/", "#/en/", "?q", "/en"]
    rules = [(rng.choice(["allow", "block"]), h + p) for h in rng.sample(hosts, 30) for p in rng.sample(["/", "/en/", "/en"], 2)]
    rules += [("block", "net/"), ("allow", "net/"), ("block", "a.net/")]
    pages = [(i, "http://" + (h.upper() if i % 5 == 0 and h.isascii() else h) + rng.choice(paths), "x", "y") for i, h in enumerate(hosts * 3)]
    pages += [(900, None, "x", "y"), (901, "no scheme", "x", "y"), (902, "a://", "x", "y"), (902, "a://", "x", "y"), (None, "h://net/", "x", "y"),
              (903, "h://.net./en/", "x", "y"), (904, "h://net" + "/a" * 5000, "x", "y")]
    got = judged(spark, pages, rules)
    key = str
    assert sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got), key=key) == sorted(((i, *plain(u, rules)) for i, u, *_ in pages), key=key)


def test_no_rules_and_no_pages(spark):
    assert [(r.rule, r.verdict) for r in judged(spark, [(1, "http://a.b/c", "", "")], [])] == [(None, "allow")]
    assert judged(spark, [], [("block", "net/")]) == []


@pytest.mark.parametrize("name", ["op2_content_addressed_warc", "op10_url_sweep"])
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf_dir}/pages.parquet'")
    df = queries.QUERIES[name](spark, sf_dir)
    out = con.execute(queries.ORACLE[name])
    names = [c[0] for c in out.description]
    assert sorted(map(repr, out.fetchall())) == sorted(repr(tuple(r)) for r in df.select(names).collect())
